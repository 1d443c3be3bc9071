"""Scalar features of each series: window and aggregate expressions, one row a series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ParameterError
from .series import ID, TS, VALUE, ordered


LEAST_POINTS = 5


def _numbered(series: DataFrame) -> DataFrame:
    every = Window.partitionBy(ID)
    s = series.where(F.col(VALUE).isNotNull()).withColumn("i", F.row_number().over(ordered()) - 1).withColumn("n", F.count("*").over(every))
    return s.where(F.col("n") >= LEAST_POINTS)


def basic(series: DataFrame) -> DataFrame:
    """length, mean, var (population), linearity (r2 on position), binarize_mean."""
    s = _numbered(series).withColumn("m", F.avg(VALUE).over(Window.partitionBy(ID)))
    return s.groupBy(ID).agg(
        F.count("*").alias("length"), F.avg(VALUE).alias("mean"), F.var_pop(VALUE).alias("var"), F.regr_r2(VALUE, "i").alias("linearity"), F.avg((F.col(VALUE) > F.col("m")).cast("double")).alias("binarize_mean")
    )


def tiles(series: DataFrame, window: int = 20) -> DataFrame:
    """lumpiness and stability: variances over even tiles of the variance and of the mean."""
    s = _numbered(series)
    k, n, i = F.floor(F.col("n") / window) + 1, F.col("n"), F.col("i")
    big, size = n % k, F.floor(n / k)  # the first ``big`` tiles have one more
    tile = F.when(i < big * (size + 1), F.floor(i / (size + 1))).otherwise(big + F.floor((i - big * (size + 1)) / size))
    t = s.groupBy(ID, tile.alias("t")).agg(F.var_pop(VALUE).alias("v"), F.avg(VALUE).alias("m"))
    return t.groupBy(ID).agg(F.var_pop("v").alias("lumpiness"), F.var_pop("m").alias("stability"))


def flat_spots(series: DataFrame, nbins: int = 10) -> DataFrame:
    """flat_spots: the longest run of equal values within chunks of n // nbins points."""
    s = _numbered(series).withColumn("c", F.floor(F.col("i") / F.greatest(F.floor(F.col("n") / nbins), F.lit(1))))
    w = Window.partitionBy(ID, "c").orderBy("i")
    s = s.withColumn("new", F.when(F.col(VALUE) == F.lag(VALUE).over(w), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return s.groupBy(ID, "c", "run").count().groupBy(ID).agg(F.max("count").alias("flat_spots"))


def crossing_points(series: DataFrame) -> DataFrame:
    """crossing_points of the median."""
    s = _numbered(series).withColumn("m", F.percentile(VALUE, F.lit(0.5)).over(Window.partitionBy(ID))).withColumn("nx", F.lead(VALUE).over(ordered()))
    v, m, nx = F.col(VALUE), F.col("m"), F.col("nx")
    return s.groupBy(ID).agg(F.count_if(((v <= m) & (nx > m)) | ((v > m) & (nx <= m))).alias("crossing_points"))


def gradient(series: DataFrame) -> DataFrame:
    """std1st_der: deviation of central differences, one-sided at the ends."""
    w = ordered()
    a, b, v = F.lag(VALUE).over(w), F.lead(VALUE).over(w), F.col(VALUE)
    g = F.when(a.isNull(), b - v).when(b.isNull(), v - a).otherwise((b - a) / 2)
    return _numbered(series).withColumn("g", g).groupBy(ID).agg(F.stddev_pop("g").alias("std1st_der"))


def hurst(series: DataFrame, lag_size: int = 30) -> DataFrame:
    """hurst: slope of log deviation of k-step differences on log k, k from 2 to min(lag_size, n - 1) - 1."""
    s = _numbered(series)
    w = ordered()
    wide = s.select(ID, "n", *[(F.col(VALUE) - F.lag(VALUE, k).over(w)).alias(f"d{k}") for k in range(2, lag_size)])
    sds = wide.groupBy(ID).agg(F.max("n").alias("n"), *[F.stddev_pop(f"d{k}").alias(f"d{k}") for k in range(2, lag_size)])
    long = sds.select(ID, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"d{k}").alias("sd")) for k in range(2, lag_size)])).alias("p")).where("p.k < least(n - 1, %d) and p.sd > 0" % lag_size)
    return long.groupBy(ID).agg(F.regr_slope(F.log("p.sd"), F.log(F.col("p.k").cast("double"))).alias("hurst"))


def histogram_mode(series: DataFrame, nbins: int = 10) -> DataFrame:
    """histogram_mode: left edge of the fullest of nbins even bins, the first among ties."""
    e = Window.partitionBy(ID)
    s = _numbered(series).withColumn("lo", F.min(VALUE).over(e)).withColumn("hi", F.max(VALUE).over(e))
    width = (F.col("hi") - F.col("lo")) / nbins
    b = F.when(width > 0, F.least(F.floor((F.col(VALUE) - F.col("lo")) / F.when(width > 0, width)), F.lit(nbins - 1))).otherwise(F.lit(nbins // 2))
    c = s.groupBy(ID, b.alias("b")).agg(F.count("*").alias("c"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    best = c.groupBy(ID).agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    return best.select(ID, F.when(F.col("hi") > F.col("lo"), F.col("lo") + F.col("b") * (F.col("hi") - F.col("lo")) / nbins).otherwise(F.col("lo") - 0.5 + F.col("b") / nbins).alias("histogram_mode"))


def level_shift(series: DataFrame, window: int = 20) -> DataFrame:
    """level_shift_idx and level_shift_size: the largest step of the rolling mean, the first among ties."""
    w = ordered()
    s = _numbered(series).withColumn("m", F.when(F.col("i") >= window - 1, F.avg(VALUE).over(w.rowsBetween(-(window - 1), 0))))
    s = s.withColumn("d", F.abs(F.col("m") - F.lag("m").over(w))).where("d is not null").withColumn("d", F.round("d", 9))
    best = F.max_by(F.struct((F.col("i") - window).alias("k"), "d"), F.struct(F.col("d"), -F.col("i")))
    return s.groupBy(ID).agg(best.alias("b")).select(ID, F.col("b.k").cast("bigint").alias("level_shift_idx"), F.col("b.d").alias("level_shift_size"))


def acf(series: DataFrame, lags: int, column: str = VALUE, prefix: str = "r") -> DataFrame:
    """(series_id, n, r1..): biased autocorrelations, all lags in one pass of windows."""
    s = series.where(F.col(column).isNotNull()).withColumn("_x", F.col(column) - F.avg(column).over(Window.partitionBy(ID)))
    w = ordered()
    wide = s.select(ID, "_x", *[(F.col("_x") * F.lag("_x", k).over(w)).alias(f"p{k}") for k in range(1, lags + 1)])
    return wide.groupBy(ID).agg(F.count("*").alias(f"{prefix}_n"), *[F.try_divide(F.coalesce(F.sum(f"p{k}"), F.lit(0.0)), F.sum(F.col("_x") * F.col("_x"))).alias(f"{prefix}{k}") for k in range(1, lags + 1)])


def acf_features(series: DataFrame, period: int = 7, lag: int = 6) -> DataFrame:
    """First autocorrelation, sum of squares of the first five (as far as known) of y, its first and second differences, and the seasonal one."""
    w = ordered()
    s = series.where(F.col(VALUE).isNotNull()).withColumn("d1", F.col(VALUE) - F.lag(VALUE).over(w))
    s = s.withColumn("d2", F.col("d1") - F.lag("d1").over(w))
    frames = [acf(s, max(period, lag), VALUE, "y"), acf(s.where("d1 is not null"), lag, "d1", "e"), acf(s.where("d2 is not null"), lag, "d2", "g")]
    j = reduce(lambda a, b: a.join(b, ID), frames)
    square = lambda p: sum((F.pow(F.col(f"{p}{k}"), 2) for k in range(2, 6)), F.pow(F.col(f"{p}1"), 2))
    return j.where(F.col("y_n") >= 10).select(
        ID, F.col("y1").alias("y_acf1"), square("y").alias("y_acf5"), F.col("e1").alias("diff1y_acf1"), square("e").alias("diff1y_acf5"), F.col("g1").alias("diff2y_acf1"), square("g").alias("diff2y_acf5"), F.col(f"y{period}").alias("seas_acf1")
    )



def kpss(series: DataFrame) -> DataFrame:
    """unitroot_kpss: statistic about a trend with one lag of Bartlett weight."""
    e = Window.partitionBy(ID)
    w = ordered()
    s = _numbered(series).withColumn("a", F.regr_intercept(VALUE, "i").over(e)).withColumn("b", F.regr_slope(VALUE, "i").over(e))
    s = s.withColumn("r", F.col(VALUE) - F.col("a") - F.col("b") * F.col("i"))
    s = s.withColumn("c", F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rr", F.col("r") * F.lag("r").over(w))
    g = s.groupBy(ID).agg(F.count("*").alias("n"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum(F.col("r") * F.col("r")).alias("ss"), F.sum("rr").alias("s1"))
    return g.select(ID, F.try_divide(F.col("cc") / (F.col("n") * F.col("n")), (F.col("ss") + F.col("s1")) / F.col("n")).alias("unitroot_kpss"))


def time_features(series: DataFrame) -> DataFrame:
    """Counts of calendar parts, shares of weekdays and the span in days. time_days counts year and day of month."""
    t = F.col(TS)
    parts = {"years": F.year(t), "months": F.date_format(t, "yyyy-MM"), "weeks": F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), t), F.weekofyear(t)), "days": F.date_format(t, "yyyy-dd"), "hours": F.hour(t), "minutes": F.minute(t), "seconds": F.second(t)}
    return series.groupBy(ID).agg(
        *[F.count_distinct(v).alias(f"time_{k}") for k, v in parts.items()],
        *[F.avg((F.weekday(t) == i).cast("double")).alias(f"weekday_{i}") for i in range(7)],
        F.date_diff(F.max(t), F.min(t)).alias("span_days"),
    )


def nowcasting(series: DataFrame, window: int = 5) -> DataFrame:
    """Means of roc, ma, mom and lag, unknown values as 0."""
    from ..functions import indicators as I

    v = F.col(VALUE)
    s = _numbered(series).select(ID, I.roc(v, window).alias("roc"), I.ma(v, window).alias("ma"), I.mom(v, window).alias("mom"), I.lag(v, window).alias("lag"))
    return s.groupBy(ID).agg(*[F.avg(F.coalesce(c, F.lit(0.0))).alias(f"nowcast_{c}") for c in ("roc", "ma", "mom", "lag")])


GROUPS = {
    "basic": basic, "tiles": tiles, "flat_spots": flat_spots, "crossing_points": crossing_points, "gradient": gradient, "hurst": hurst, "histogram_mode": histogram_mode,
    "level_shift": level_shift, "acf": acf_features, "kpss": kpss, "time": time_features, "nowcasting": nowcasting,
}
DEFAULT = ("basic", "tiles", "flat_spots", "crossing_points", "gradient", "hurst", "histogram_mode", "level_shift", "acf", "kpss")


FUSED = ("basic", "crossing_points", "gradient", "hurst", "level_shift", "acf", "kpss")


def fused(series: DataFrame, lag_size: int = 30, window: int = 20, period: int = 7, lag: int = 6) -> DataFrame:
    """The columns of the FUSED groups from one sort of each series and one aggregation."""
    e, w = Window.partitionBy(ID), ordered()
    v = F.col(VALUE)
    s = _numbered(series).select(ID, TS, v, "i", "n")
    s = s.select("*", F.lag(VALUE).over(w).alias("pv"), F.lead(VALUE).over(w).alias("nx"), F.avg(VALUE).over(w.rowsBetween(-(window - 1), 0)).alias("rm"), *[(v - F.lag(VALUE, k).over(w)).alias(f"h{k}") for k in range(2, lag_size)])
    s = s.select(
        "*", F.avg(VALUE).over(e).alias("m"), F.percentile(VALUE, F.lit(0.5)).over(e).alias("med"), F.regr_intercept(VALUE, "i").over(e).alias("ra"), F.regr_slope(VALUE, "i").over(e).alias("rb"),
        (v - F.col("pv")).alias("d1"), F.round(F.abs(F.when(F.col("i") >= window, F.col("rm") - F.lag("rm").over(w))), 9).alias("step"),
    )
    s = s.withColumn("d2", F.col("d1") - F.lag("d1").over(w)).withColumn("r", v - F.col("ra") - F.col("rb") * F.col("i"))
    s = s.withColumn("x", v - F.col("m")).withColumn("y", F.col("d1") - F.avg("d1").over(e)).withColumn("z", F.col("d2") - F.avg("d2").over(e))
    lags = {"x": max(period, lag), "y": lag, "z": lag}
    s = s.select(
        "*", F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"), (F.col("r") * F.lag("r").over(w)).alias("rr"), *[(F.col(c) * F.lag(c, k).over(w)).alias(f"{c}{k}") for c, n in lags.items() for k in range(1, n + 1)]
    )
    pv, nx, med = F.col("pv"), F.col("nx"), F.col("med")
    g = F.when(pv.isNull(), nx - v).when(nx.isNull(), v - pv).otherwise((nx - pv) / 2)
    sq = lambda c: F.sum(F.col(c) * F.col(c))
    rho = lambda c, k: F.try_divide(F.coalesce(F.sum(f"{c}{k}"), F.lit(0.0)), sq(c))
    five = lambda c: sum((F.pow(rho(c, k), 2) for k in range(2, 6)), F.pow(rho(c, 1), 2))
    n = F.count("*")
    enough = lambda c: F.when(n >= 10, c)
    agg = s.groupBy(ID).agg(
        n.alias("length"), F.avg(VALUE).alias("mean"), F.var_pop(VALUE).alias("var"), F.regr_r2(VALUE, "i").alias("linearity"), F.avg((v > F.col("m")).cast("double")).alias("binarize_mean"),
        F.count_if(((v <= med) & (nx > med)) | ((v > med) & (nx <= med))).alias("crossing_points"), F.stddev_pop(g).alias("std1st_der"),
        F.max_by(F.struct((F.col("i") - window).alias("k"), F.col("step").alias("d")), F.when(F.col("step").isNotNull(), F.struct("step", -F.col("i")))).alias("shift"),
        enough(rho("x", 1)).alias("y_acf1"), enough(five("x")).alias("y_acf5"), enough(rho("y", 1)).alias("diff1y_acf1"), enough(five("y")).alias("diff1y_acf5"), enough(rho("z", 1)).alias("diff2y_acf1"), enough(five("z")).alias("diff2y_acf5"), enough(rho("x", period)).alias("seas_acf1"),
        F.try_divide(sq("c") / (n * n), (sq("r") + F.sum("rr")) / n).alias("unitroot_kpss"), F.array(*[F.stddev_pop(f"h{k}") for k in range(2, lag_size)]).alias("sds"),
    )
    # slope of log deviation on log lag, over the lags that count
    pairs = F.filter(F.transform("sds", lambda sd, j: F.struct(F.log((j + 2).cast("double")).alias("x"), F.log(sd).alias("y"), (j + 2).alias("k"))), lambda p: (p["k"] < F.least(F.col("length") - 1, F.lit(lag_size))) & p["y"].isNotNull())
    agg = agg.withColumn("p", pairs)
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda a, p: a + f(p))
    k = F.size("p")
    hurst_slope = F.try_divide(k * total(lambda p: p["x"] * p["y"]) - total(lambda p: p["x"]) * total(lambda p: p["y"]), k * total(lambda p: p["x"] * p["x"]) - F.pow(total(lambda p: p["x"]), 2))
    return agg.withColumn("hurst", hurst_slope).withColumn("level_shift_idx", F.col("shift.k").cast("bigint")).withColumn("level_shift_size", F.col("shift.d")).drop("p", "sds", "shift")


def features(series: DataFrame, groups=DEFAULT, without=()) -> DataFrame:
    """One row a series with the chosen groups' columns; shorter series than LEAST_POINTS have none.

    Groups that need no second grouping share one sort and one aggregation.
    """
    unknown = set([*groups, *without]) - set(GROUPS)
    if unknown or set(groups) & set(without):
        raise ParameterError(f"unknown or contradictory groups: {sorted(unknown or set(groups) & set(without))}")
    frames = [fused(series)] if set(FUSED) <= set(groups) else []
    frames += [GROUPS[g](series) for g in groups if not frames or g not in FUSED]
    return reduce(lambda a, b: a.join(b, ID, "left"), frames)
