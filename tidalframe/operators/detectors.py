"""Detectors: window expressions where they suffice, one numpy kernel a series where the method is sequential."""


from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .series import ID, TS, VALUE, divide, ordered


def per_series(series: DataFrame, f: Callable[[np.ndarray, np.ndarray], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of f(times, values) for each series in time order, with its series_id first. One series is one task's work."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna(subset=[VALUE]).sort_values([TS, VALUE], kind="stable")
        rows = [(key[0], *r) for r in f(frame[TS].to_numpy(), frame[VALUE].to_numpy(float))] if len(frame) else []
        return pd.DataFrame(rows, columns=[ID, *names])

    return series.select(F.col(ID).cast("string").alias(ID), TS, VALUE).groupBy(ID).applyInPandas(run, f"{ID} string, {schema}")


# ---- thresholds and rolling statistics -------------------------------------------


def static_threshold(series: DataFrame, low: float, high: float) -> DataFrame:
    """The value as score, and whether it leaves [low, high]."""
    return series.select(ID, TS, F.col(VALUE).alias("score"), (~F.col(VALUE).between(low, high)).alias("alert"))


def rolling_detector(series: DataFrame, n: int, statistic: str = "z_score", base: float = 1.0) -> DataFrame:
    """Score of each point by one of the rolling statistics; 0 until the window is full."""
    from ..functions.indicators import rolling_scores

    return series.select(ID, TS, VALUE, (F.coalesce(rolling_scores(F.col(VALUE), n)[statistic], F.lit(0.0)) * base).alias("score"))


def stat_sig(series: DataFrame, n_control: int, n_test: int, unit_seconds: int, corrected: bool = True) -> DataFrame:
    """Two-sample t score of the n_test units up to each point against the n_control units before them.

    Half-open time windows; pooled sample deviation, scaled by sqrt(1/n1 + 1/n2)
    where corrected. predicted: the control mean; magnitude: the difference; df.
    """
    at = Window.partitionBy(ID).orderBy(F.unix_micros(TS))
    us = 1_000_000 * unit_seconds
    test = at.rangeBetween(us - n_test * us, us - 1)
    control = at.rangeBetween(us - (n_test + n_control) * us, us - n_test * us - 1)
    v = F.col(VALUE)
    s = series.where(v.isNotNull())
    a = {f"{k}{i}": f(v).over(w) for i, w in ((0, control), (1, test)) for k, f in (("n", F.count), ("m", F.avg), ("q", F.var_samp))}
    s = s.select(ID, TS, VALUE, *[c.alias(k) for k, c in a.items()])
    df = F.col("n0") + F.col("n1") - 2
    pooled = F.sqrt(divide((F.col("n0") - 1) * F.coalesce("q0", F.lit(0.0)) + (F.col("n1") - 1) * F.coalesce("q1", F.lit(0.0)), df))
    se = pooled * F.sqrt(divide(F.lit(1.0), F.col("n0")) + divide(F.lit(1.0), F.col("n1"))) if corrected else pooled
    ok = (F.col("n0") >= 2) & (F.col("n1") >= 1)
    return s.select(ID, TS, F.when(ok, F.col("m0")).alias("predicted"), F.when(ok, F.col("m1") - F.col("m0")).alias("magnitude"), F.when(ok, df).alias("df"), F.coalesce(F.when(ok, divide(F.col("m1") - F.col("m0"), se)), F.lit(0.0)).alias("score"))


def benjamini_hochberg(p: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Adjusted p values within each group of keys."""
    n = F.count(column).over(Window.partitionBy(*keys))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(column))
    last = F.max("_r").over(Window.partitionBy(*keys, column))
    d = p.withColumn("_n", n).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(column))).withColumn("_q", F.col(column) * F.col("_n") / last)
    down = Window.partitionBy(*keys).orderBy(F.col(column).desc()).rangeBetween(Window.unboundedPreceding, 0)
    return d.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("_q").over(down))).withColumn("p_rank", rank).drop("_n", "_r", "_q")


def robust_stat(series: DataFrame, n: int = 5, p_value: float = 0.01) -> DataFrame:
    """Change points where the smoothed two-step difference is extreme; at least n points apart, the earliest kept."""
    w = ordered()
    s = series.where(F.col(VALUE).isNotNull()).withColumn("i", F.row_number().over(w) - 1)
    mean = F.when(F.col("i") >= n - 1, F.avg(VALUE).over(w.rowsBetween(-(n - 1), 0)))
    s = s.withColumn("m", mean).withColumn("m", F.coalesce("m", F.first("m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))))
    s = s.withColumn("d", F.coalesce(F.col("m") - F.lead("m", 2).over(w), F.lit(0.0)))
    e = Window.partitionBy(ID)
    s = s.withColumn("z", F.coalesce(divide(F.col("d") - F.avg("d").over(e), F.stddev_pop("d").over(e)), F.lit(0.0)))
    hit = s.where(F.abs("z") > K.norm_ppf(1 - p_value)).groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("i", TS, "z"))).alias("h"))
    kept = F.aggregate("h", F.filter("h", lambda x: F.lit(False)), lambda a, x: F.when((F.size(a) == 0) | (x["i"] - F.element_at(a, -1)["i"] >= n), F.concat(a, F.array(x))).otherwise(a))
    return hit.select(ID, F.explode(kept).alias("c")).select(ID, F.col("c.i").cast("bigint").alias("cp_index"), F.col(f"c.{TS}").alias("start"), F.col("c.z").alias("z"))


# ---- A/B interval tests --------------------------------------------------------------

#: Variance of a mean by kind of value: sample variance over n, proportion, count, arrival time.
VARIANCE: dict[str, Callable[[Column, Column, Column], Column]] = {
    "real": lambda v, var, n: var / n,
    "proportion": lambda v, var, n: v * (1 - v) / n,
    "count": lambda v, var, n: v / n,
    "arrival": lambda v, var, n: v * v / n,
}


def ab_statistic(frame: DataFrame, kind: str = "real", relative: bool = False) -> DataFrame:
    """z of value_b against value_a beyond effect_size at each time; columns of the two-sample schema."""
    c = F.col
    va = VARIANCE[kind](c("value_a"), c("variance_a"), c("sample_count_a"))
    vb = VARIANCE[kind](c("value_b"), c("variance_b"), c("sample_count_b"))
    if relative:
        a, b = F.greatest(c("value_a"), F.lit(1e-9)), F.greatest(c("value_b"), F.lit(1e-9))
        z = divide(F.log(b) - F.log(a) - F.log1p(c("effect_size")), F.sqrt(va / (a * a) + vb / (b * b)))
    else:
        z = divide(c("value_b") - c("value_a") - c("effect_size"), F.sqrt(va + vb))
    return frame.withColumn("test_statistic", z)


def ab_intervals(frame: DataFrame, alpha: float = 0.05, n: int | None = None, m: int | None = None, kind: str = "real", relative: bool = False) -> DataFrame:
    """Runs of at least m rejections among n times: m is the least whose chance stays below alpha, the critical value follows from it."""
    n = n or 30
    m = m or K.least_run(alpha, n, alpha)
    bar = K.norm_ppf(1 - K.least_p(m, n, alpha))
    return runs(ab_statistic(frame, kind, relative).withColumn("hit", F.coalesce(F.col("test_statistic") >= bar, F.lit(False))), "hit").where(F.col("points") >= m)


def validate_ab(frame: DataFrame) -> DataFrame:
    """The frame, failing on nulls, counts under 1 or negative variances."""
    ok = F.lit(True)
    for x in ("a", "b"):
        ok = ok & F.col(f"value_{x}").isNotNull() & (F.coalesce(F.col(f"sample_count_{x}"), F.lit(0)) > 0) & (F.coalesce(F.col(f"variance_{x}"), F.lit(-1.0)) >= 0)
    return frame.withColumn("_ok", F.assert_true(ok, "invalid A/B row")).where(F.col("_ok").isNull()).drop("_ok")


# ---- scores to alerts ---------------------------------------------------------------------


def runs(frame: DataFrame, flag: str) -> DataFrame:
    """(series_id, start, end, points): runs of true flags; end is the first time that isn't, or the last of the series."""
    w = ordered()
    s = frame.withColumn("_nx", F.lead(TS).over(w)).withColumn("_new", F.when(F.col(flag) == F.lag(flag).over(w), 0).otherwise(1))
    s = s.withColumn("_run", F.sum("_new").over(w)).where(flag)
    return s.groupBy(ID, "_run").agg(F.min(TS).alias("start"), F.coalesce(F.max_by("_nx", TS), F.max(TS)).alias("end"), F.count("*").alias("points")).drop("_run")


def alerts(scores: DataFrame, low: float = -2.0, high: float = 2.0, window_seconds: int = 1, fraction: float = 1.0) -> DataFrame:
    """Alert intervals of (series_id, ts, score): the share of crossings within the window reaches ``fraction``; with volume, height and magnitude."""
    t = Window.partitionBy(ID).orderBy(F.unix_micros(TS)).rangeBetween(-window_seconds * 1_000_000 + 1, 0)
    w = ordered()
    s = scores.withColumn("_x", ((F.col("score") > high) | (F.col("score") < low)).cast("double"))
    s = s.withColumn("_first", F.min(TS).over(Window.partitionBy(ID))).withColumn("on", (F.avg("_x").over(t) >= fraction) & (F.col(TS) >= F.timestamp_add("SECOND", F.lit(window_seconds), "_first")))
    over = F.when(F.col("score") > high, F.col("score") - high).when(F.col("score") < low, low - F.col("score")).otherwise(0.0)
    s = s.withColumn("_over", over).withColumn("_share", F.when(F.col("score") > high, divide(F.col("_over"), F.lit(abs(high)))).otherwise(divide(F.col("_over"), F.lit(abs(low)))))
    s = s.withColumn("_sec", (F.unix_micros(F.lead(TS).over(w)) - F.unix_micros(TS)) / 1e6).withColumn("_nx", F.lead(TS).over(w))
    s = s.withColumn("_new", F.when(F.col("on") == F.lag("on").over(w), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w)).where("on")
    g = s.groupBy(ID, "_run").agg(F.min(TS).alias("start"), F.coalesce(F.max_by("_nx", TS), F.max(TS)).alias("end"), F.count("*").alias("points"), F.coalesce(F.sum(F.col("_over") * F.col("_sec")), F.lit(0.0)).alias("volume"), F.coalesce(F.sum("_sec"), F.lit(0.0)).alias("seconds"), F.max("_share").alias("magnitude"))
    return g.select(ID, "start", "end", "points", "volume", F.coalesce(divide(F.col("volume"), F.col("seconds")), F.lit(0.0)).alias("height"), "magnitude")


def overall_severity(alerts: DataFrame) -> DataFrame:
    """One row a series of alert intervals: their number, volume, duration in seconds, height averaged over time and greatest magnitude."""
    seconds = F.sum((F.unix_micros("end") - F.unix_micros("start")) / 1e6)
    g = alerts.groupBy(ID).agg(F.count("*").alias("alerts"), F.sum("volume").alias("volume"), seconds.alias("duration"), F.max("magnitude").alias("magnitude"))
    return g.select(ID, "alerts", "volume", "duration", F.coalesce(divide(F.col("volume"), F.col("duration")), F.lit(0.0)).alias("height"), "magnitude")


def classify_alerts(series: DataFrame, intervals: DataFrame, volatility: float = 2.0, level: float = 1.5, alpha: float = 0.05) -> DataFrame:
    """What each interval (series_id, start, end: times of the series) shows; more than one may hold.

    outlier: fewer than five points. level_shift: at the end or the start, what
    lies before differs in mean from the rest (pooled t test at ``alpha``) and the
    intercept of its line is not within a factor ``level`` of the whole series'.
    trend_change: the slopes before the start and from the end on have opposite
    signs. volatility_change: at the end or the start, deviations before and from
    there on differ by a factor ``volatility``. Sides of one point decide nothing.

    One sort of the series gives running sums from which every side's regression
    follows; intervals join the two rows of their own times.
    """
    from .forecast import _t_column

    w, whole = ordered(), Window.partitionBy(ID)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    s = series.where(F.col(VALUE).isNotNull()).withColumn("i", (F.row_number().over(w) - 1).cast("double"))
    terms = {"n": F.lit(1.0), "y": F.col(VALUE), "yy": F.col(VALUE) ** 2, "iy": F.col("i") * F.col(VALUE)}
    sums = s.select(ID, TS, "i", *[F.coalesce(F.sum(c).over(past), F.lit(0.0)).alias(f"b_{k}") for k, c in terms.items()], *[F.sum(c).over(whole).alias(f"w_{k}") for k, c in terms.items()])
    place = lambda name: sums.select(F.col(ID).alias(f"{name}_id"), F.col(TS).alias(f"{name}_ts"), F.struct("i", *[f"{side}_{k}" for side in "bw" for k in terms]).alias(name))
    j = intervals.select(ID, "start", "end")
    for name, at in (("p", "start"), ("q", "end")):
        j = j.join(place(name), (F.col(ID) == F.col(f"{name}_id")) & (F.col(at) == F.col(f"{name}_ts")))

    def side(row: str, part: str) -> dict[str, Column]:
        g = {k: F.col(f"{row}.{part}_{k}") if part in "bw" else F.col(f"{row}.w_{k}") - F.col(f"{row}.b_{k}") for k in terms}
        first = F.col(f"{row}.i") if part == "a" else F.lit(0.0)
        middle = first + (g["n"] - 1) / 2
        g["slope"] = divide(g["iy"] - middle * g["y"], g["n"] * (g["n"] * g["n"] - 1) / 12)
        g["mean"] = divide(g["y"], g["n"])
        g["intercept"] = g["mean"] - g["slope"] * middle
        g["ss"] = F.greatest(g["yy"] - g["y"] * g["mean"], F.lit(0.0))
        return g

    shift, change = F.lit(False), F.lit(False)
    for row in "qp":
        x, y, all_ = side(row, "b"), side(row, "a"), side(row, "w")
        enough = (x["n"] > 1) & (y["n"] > 1)
        df = x["n"] + y["n"] - 2
        error = F.sqrt((x["ss"] + y["ss"]) / df * (1 / x["n"] + 1 / y["n"]))
        differs = F.abs(x["mean"] - y["mean"]) >= _t_column(df, alpha) * error
        like = (x["intercept"] < level * all_["intercept"]) & (x["intercept"] > all_["intercept"] / level)
        shift = shift | F.coalesce(enough & differs & ~like, F.lit(False))
        a, b = F.sqrt(x["ss"] / x["n"]), F.sqrt(y["ss"] / y["n"])
        change = change | F.coalesce(enough & ((a >= volatility * b) | (a <= b / volatility)), F.lit(False))
    x, y = side("p", "b"), side("q", "a")
    trend = F.coalesce((x["n"] > 1) & (y["n"] > 1) & (x["slope"] * y["slope"] < 0), F.lit(False))
    return j.select(ID, "start", "end", (F.col("q.i") - F.col("p.i") < 5).alias("outlier"), shift.alias("level_shift"), trend.alias("trend_change"), change.alias("volatility_change"))


# ---- kernels by series -----------------------------------------------------------------------


def cusum(series: DataFrame, directions=("increase", "decrease"), threshold: float = 0.01, delta_std_ratio: float = 1.0) -> DataFrame:
    def run(t, v):
        for d in directions if len(v) > 3 else ():
            r = K.cusum(v, d == "increase", threshold=threshold, ratio=delta_std_ratio)
            yield d, r["index"], t[r["index"]], r["mu0"], r["mu1"], r["delta"], r["llr"], r["p_value"], r["stable"], r["detected"]

    return per_series(series, run, "direction string, cp_index int, start timestamp, mu0 double, mu1 double, delta double, llr double, p_value double, stable boolean, detected boolean")


def cusum_first_pass(series: DataFrame) -> DataFrame:
    """(series_id, cp_index): where the cumulative sum of deviations is least, without iteration; windows only."""
    w = ordered()
    s = series.where(F.col(VALUE).isNotNull()).withColumn("d", F.col(VALUE) - F.avg(VALUE).over(Window.partitionBy(ID))).withColumn("i", F.row_number().over(w) - 1)
    s = s.withColumn("c", F.round(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6))
    return s.groupBy(ID).agg(F.min_by("i", F.struct("c", "i")).cast("bigint").alias("cp_index"), F.min("c").alias("cumsum"))


def multivariate_cusum(wide: DataFrame, columns: list[str], key: str = ID) -> DataFrame:
    def run(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(TS)
        r = K.multi_cusum(f[columns].to_numpy(float))
        return pd.DataFrame([(k[0], r["index"], f[TS].iloc[r["index"]], r["llr"], r["p_value"], r["detected"])], columns=[key, "cp_index", "start", "llr", "p_value", "detected"])

    return wide.groupBy(key).applyInPandas(run, f"{key} string, cp_index int, start timestamp, llr double, p_value double, detected boolean")


def bocpd(series: DataFrame, model: str = "normal", lag: int = 10, prior: float = 0.01, threshold: float = 0.5, aggregate: bool = True, choose_priors: bool = False) -> DataFrame:
    """Change probability of each point. choose_priors tries 25 pairs of precision and prior and takes the one of the sharpest posterior."""

    def run(t, v):
        best = (1.0, prior)
        if choose_priors:
            best = max(((m, p) for m in range(1, 6) for p in (0.001, 0.002, 0.005, 0.01, 0.02)), key=lambda c: float(np.max(K.bocpd(v, model, 3, c[1], c[0], False))))
        p = K.bocpd(v, model, lag, best[1], best[0], aggregate)
        for a, b in zip(t, p):
            yield a, float(b), bool(b > threshold)

    return per_series(series, run, "ts timestamp, probability double, change boolean")


def outliers(series: DataFrame, period: int = 7, iqr_mult: float = 3.0, multiplicative: bool = False) -> DataFrame:
    """Points outside the quartile fences of the residual; seasons are taken out if they explain 60 % of the detrended variance."""

    def run(t, v):
        if len(v) < 2 * period + 1:
            return
        season, trend, resid = K.classical(v, period, multiplicative)
        detr = v / trend if multiplicative else v - trend
        strong = 1 - resid.var() / max(detr.var(), 1e-12) >= 0.6
        r = (v / season if multiplicative else v - season) - trend if strong else v - trend
        q1, q3 = np.percentile(r, [25, 75])
        lo, hi = q1 - iqr_mult * (q3 - q1), q3 + iqr_mult * (q3 - q1)
        for a, b, x in zip(t, v, r):
            yield a, float(b), float((x - lo) / (hi - lo)) if hi > lo else 0.5, bool(x < lo or x > hi)

    return per_series(series, run, "ts timestamp, value double, score double, is_outlier boolean")


def mann_kendall(series: DataFrame, n: int = 20, threshold: float = 0.8, alpha: float = 0.05, smooth: float = 0.2) -> DataFrame:
    """Trend of the last n smoothed values at each time from the n-th on."""

    def run(t, v):
        s = K.ses(v, smooth)[1:] if len(v) else v
        for i in range(n, len(v)):
            r = K.mann_kendall(s[i - n + 1 : i + 1], alpha)
            yield t[i], r["trend"] if abs(r["tau"]) > threshold else "no trend", r["p"], r["tau"]

    return per_series(series, run, "ts timestamp, trend string, p double, tau double")


def top_trends(trends: DataFrame, at: str, k: int) -> DataFrame:
    """The k series of the largest |tau| at a time."""
    return trends.where(F.col(TS) == F.lit(at).cast("timestamp")).orderBy(F.abs("tau").desc(), ID).limit(k)


def anomaly_times(scores: DataFrame, alpha: float) -> DataFrame:
    """Times whose p_value is below alpha."""
    return scores.where(F.col("p_value") < alpha)


def top_anomalies(scores: DataFrame, at: str, k: int, column: str = "score") -> DataFrame:
    """The k rows of the largest score at a time."""
    return scores.where(F.col(TS) == F.lit(at).cast("timestamp")).orderBy(F.col(column).desc(), ID).limit(k)


def seasonality(series: DataFrame, method: str = "fft") -> DataFrame:
    """(series_id, period): by peaks of the spectrum or of the autocorrelation."""
    return per_series(series, lambda t, v: ((float(p),) for p in (K.fft_seasonality(v) if method == "fft" else K.acf_seasonality(v))), "period double")


def dtw_anomalies(series: DataFrame, window: int, skip: int, mad_threshold: float = 1.0) -> DataFrame:
    """Series whose least-matched window is far from every window of other series.

    Windows are compared in blocks of about 64 series: a block goes to the tasks as a
    list, and each task keeps the least distance of its windows, pruned by
    the envelope bound.
    """
    from .series import to_arrays

    arrays = to_arrays(series).select(ID, "values")
    block, least, band = 64, None, max(1, window // 3)
    blocks = -(-arrays.count() // block)
    cut = lambda v: [np.array(v[i : i + window], float) for i in range(0, len(v) - window + 1, skip) if max(v[i : i + window]) > 1e-9]
    for at in range(blocks):
        others = [(r[0], cut(r[1])) for r in arrays.where(F.pmod(F.xxhash64(ID), F.lit(blocks)) == at).collect()]

        def run(batches, others=others):
            for f in batches:
                rows = []
                for k, v in zip(f[ID], f["values"]):
                    for i, a in enumerate(cut(v)):
                        best = np.inf
                        for name, windows in others:
                            if name != k:
                                for b in windows:
                                    if K.lb_keogh(a, b, band) < best:
                                        best = min(best, K.dtw(a, b, band, best))
                        rows.append((k, i, best))
                yield pd.DataFrame(rows, columns=[ID, "w", "d"])

        got = arrays.mapInPandas(run, f"{ID} string, w int, d double")
        least = got if least is None else least.unionAll(got)
    if least is None:
        return series.sparkSession.createDataFrame([], f"{ID} string, distance double, score double, is_outlier boolean")
    far = least.groupBy(ID, "w").agg(F.min("d").alias("d")).where("d < double('infinity')").groupBy(ID).agg(F.max("d").alias("distance"))
    mid = far.agg(F.median("distance")).first()[0]
    dev = far.withColumn("a", F.abs(F.lit(mid) - F.col("distance")))
    spread = dev.agg(F.avg("a")).first()[0]
    score = F.coalesce(divide(F.col("a"), F.lit(spread).cast("double")), F.lit(0.0))
    return dev.select(ID, "distance", score.alias("score"), (score > mad_threshold).alias("is_outlier"))


def distribution_distance(percentiles: DataFrame, columns: list[str], window_seconds: int) -> DataFrame:
    """Jensen-Shannon distance, base 2, of each row's percentiles from those a window ago; 0 until there is one.

    Each of the n percentiles has mass 1 / n, equal ones together. The side with
    more different values is the grid (the older one, if both have as many); the
    other's cumulative function, linear from value to value by 1 / n, gives its
    masses there. Null where the other has no mass on the grid.
    """
    w = Window.partitionBy(ID).orderBy(F.unix_micros(TS)).rangeBetween(-window_seconds * 1_000_000, 0)
    n = len(columns)
    s = percentiles.withColumn("_old", F.first(F.struct(TS, *columns)).over(w))
    s = s.select(ID, TS, F.col(f"_old.{TS}").alias("_from"), F.array(*[F.col(f"_old.{c}").cast("double") for c in columns]).alias("_a"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_b"))
    longer = F.size(F.array_distinct("_a")) >= F.size(F.array_distinct("_b"))
    s = s.select(ID, TS, "_from", F.when(longer, F.col("_a")).otherwise(F.col("_b")).alias("_g"), F.when(longer, F.col("_b")).otherwise(F.col("_a")).alias("_o"))
    s = s.withColumn("_grid", F.array_distinct("_g")).withColumn("_steps", F.array_distinct("_o"))
    at_most = lambda values, x: F.size(F.filter(values, lambda v: v <= x))

    def below(x):
        j = at_most(F.col("_steps"), x)
        step = F.try_divide(x - F.get("_steps", j - 1), F.get("_steps", j) - F.get("_steps", j - 1))
        return F.when(j == F.size("_steps"), F.lit(1.0)).when(j == 0, F.lit(0.0)).otherwise(at_most(F.col("_o"), x) / n + step / n)

    s = s.withColumn("_cdf", F.transform("_grid", below))
    s = s.withColumn("_p", F.transform("_grid", lambda x: F.size(F.filter("_g", lambda v: v == x)) / n)).withColumn("_q", F.transform("_cdf", lambda x, i: x - F.coalesce(F.get("_cdf", i - 1), F.lit(0.0))))
    mass = F.aggregate("_q", F.lit(0.0), lambda acc, x: acc + x)
    s = s.withColumn("_m", mass).withColumn("_q", F.transform("_q", lambda x: F.try_divide(x, F.col("_m"))))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    js = F.aggregate(F.zip_with("_p", "_q", lambda p, q: 0.5 * (part(p, (p + q) / 2) + part(q, (p + q) / 2))), F.lit(0.0), lambda acc, x: acc + x)
    span = (F.unix_micros(TS) - F.unix_micros("_from")) / 1e6
    score = F.when(F.col("_m") > 0, F.sqrt(F.greatest(js, F.lit(0.0))))
    return s.select(ID, TS, F.when(span > 0.9 * window_seconds, score).otherwise(0.0).alias("score"))


def hourly_ratio(series: DataFrame) -> DataFrame:
    """Share of each hour in its day's sum, and its z score among the same weekday and hour."""
    d = series.groupBy(ID, F.to_date(TS).alias("day"), F.hour(TS).alias("hour")).agg(F.sum(VALUE).alias("v"))
    d = d.withColumn("ratio", divide(F.col("v"), F.sum("v").over(Window.partitionBy(ID, "day"))))
    w = Window.partitionBy(ID, F.weekday("day"), "hour")
    return d.select(ID, "day", "hour", "ratio", F.coalesce(divide(F.col("ratio") - F.avg("ratio").over(w), F.stddev_pop("ratio").over(w)), F.lit(0.0)).alias("score"))


def change_scores(series: DataFrame, points: DataFrame) -> DataFrame:
    """Percentage change, change and z of each value from the first detected change point on, against what lay before; 0 before it."""
    cp = points.groupBy(ID).agg(F.min("start").alias("cp")).withColumnRenamed(ID, "_id")
    s = series.join(cp, F.col(ID) == F.col("_id"), "left")
    e = Window.partitionBy(ID)
    before = F.when(F.col(TS) < F.col("cp"), F.col(VALUE))
    m, sd = F.avg(before).over(e), F.stddev_pop(before).over(e)
    on = F.col(TS) >= F.col("cp")
    pick = lambda c: F.coalesce(F.when(on, c), F.lit(0.0))
    v = F.col(VALUE)
    return s.select(ID, TS, pick(divide(v - m, m)).alias("percentage_change"), pick(v - m).alias("change"), pick(divide(v - m, sd)).alias("z_score"))


def multivariate_anomaly(wide: DataFrame, columns: list[str], train_rows: int, lags: int = 1, alpha: float = 0.05) -> DataFrame:
    """Residual of a rolling one-step vector autoregression: largest metric, Mahalanobis distance and p at each time."""

    def run(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(TS)
        x = f[columns].to_numpy(float)
        rows = []
        for t in range(train_rows, len(x)):
            past = x[t - train_rows : t]
            z = np.column_stack([past[lags - j : len(past) - j] for j in range(1, lags + 1)] + [np.ones(len(past) - lags)])
            coef = np.linalg.lstsq(z, past[lags:], rcond=None)[0]
            res = past[lags:] - z @ coef
            now = x[t] - np.concatenate([past[-1 - j] for j in range(lags)] + [[1.0]]) @ coef
            cov = np.cov(res.T).reshape(len(columns), -1) + 1e-9 * np.eye(len(columns))
            dev = now - res.mean(0)
            dist = float(np.sqrt(dev @ np.linalg.solve(cov, dev)))
            z_each = np.abs(dev) / np.maximum(res.std(0, ddof=1), 1e-12)
            p = K.chi2_sf(dist, len(columns))
            rows.append((k[0], f[TS].iloc[t], columns[int(z_each.argmax())], float(z_each.max()), dist, p, bool(p < alpha)))
        return pd.DataFrame(rows, columns=[ID, TS, "metric", "metric_score", "distance", "p_value", "is_anomaly"])

    return wide.groupBy(ID).applyInPandas(run, f"{ID} string, {TS} timestamp, metric string, metric_score double, distance double, p_value double, is_anomaly boolean")


def decompose(series: DataFrame, period: int, method: str = "stl", multiplicative: bool = False, robust: bool = False) -> DataFrame:
    """(series_id, ts, value, seasonal, trend, residual)."""

    def run(t, v):
        if len(v) < 2 * period:
            return
        if method == "stl":
            s, g, r = K.stl(np.log(v) if multiplicative else v, period, robust=robust)
            s, g, r = (np.exp(s), np.exp(g), np.exp(r)) if multiplicative else (s, g, r)
        else:
            s, g, r = K.classical(v, period, multiplicative)
        yield from zip(t, map(float, v), map(float, s), map(float, g), map(float, r))

    return per_series(series, run, "ts timestamp, value double, seasonal double, trend double, residual double")


def structure_features(series: DataFrame, period: int = 7) -> DataFrame:
    """Features that need a kernel: entropy, ARCH statistic, partial autocorrelations, first minimum and zero of the autocorrelation, decomposition strengths, smoothing parameters."""

    def run(t, v):
        n = len(v)
        if n < max(10, 2 * period) or v.std() == 0:
            return
        r, p = K.acf(v, n - 1), K.pacf(v, max(period, 6))
        low = next((i for i in range(1, n - 1) if r[i] < r[i - 1] and r[i] < r[i + 1]), n - 1)
        zero = next((i for i in range(1, n) if r[i] <= 0), n - 1)
        s, g, e = K.stl(v, period)
        strength = lambda x: float(max(0.0, min(1.0, 1 - e.var() / max((x + e).var(), 1e-12))))
        k = len(e)
        d = (e - e.mean()) ** 2
        spike = ((d.sum() - d * k / (k - 1)) / (k - 2)).var() if k > 2 else 0.0
        a, b = K.fit_holt_winters(v)
        yield K.spectral_entropy(v), K.arch_lm(v), float((p[1:6] ** 2).sum()), float(p[period]), low, zero, strength(g), strength(s), float(spike), int(s[:period].argmax()), int(s[:period].argmin()), a, b

    return per_series(series, run, "entropy double, heterogeneity double, y_pacf5 double, seas_pacf1 double, firstmin_ac int, firstzero_ac int, trend_strength double, seasonality_strength double, spikiness double, peak int, trough int, holt_alpha double, holt_beta double")
