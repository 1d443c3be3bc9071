"""Detectors that compare a series with its own forecast, and features that count what detectors find."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import detectors as D
from . import kernels as K
from .forecast import MODELS
from .series import ID, TS, VALUE, divide, ordered


def in_sample(series: DataFrame, model: str = "piecewise", train_frac: float = 0.5, block: int = 7, confidence: float = 0.8, **params) -> DataFrame:
    """(series_id, ts, value, fcst, fcst_lower, fcst_upper) from the first train_frac points on: the model is fitted anew before every ``block`` points, to what came before."""
    fit = MODELS[model]

    def run(t, v):
        at = max(5, int(len(v) * train_frac))
        while at < len(v):
            k = min(block, len(v) - at)
            f, lo, hi = fit(v[:at], k, alpha=1 - confidence, **params)
            yield from zip(t[at : at + k], map(float, v[at : at + k]), map(float, f), map(float, lo), map(float, hi))
            at += k

    return D.per_series(series, run, "ts timestamp, value double, fcst double, fcst_lower double, fcst_upper double")


def forecast_scores(predicted: DataFrame, score: str = "deviation", confidence: float = 0.8) -> DataFrame:
    """Score of each point of a frame of forecasts: deviation (y - f) / |f|, or z by the band's width; and whether the band is left."""
    e = F.col(VALUE) - F.col("fcst")
    if score == "deviation":
        s = divide(e, F.abs("fcst"))
    else:
        half = (F.col("fcst_upper") - F.col("fcst_lower")) / 2
        s = divide(e, F.greatest(half / K.norm_ppf(confidence / 2 + 0.5), F.lit(1e-9)))
    return predicted.select(ID, TS, VALUE, "fcst", F.coalesce(s, F.lit(0.0)).alias("score"), (~F.col(VALUE).between(F.col("fcst_lower"), F.col("fcst_upper"))).alias("outside"))


def residuals(actual: DataFrame, predicted: DataFrame, scaled: bool = False) -> DataFrame:
    """y - f at common times, by the band's width if scaled."""
    p = predicted.select(F.col(ID).alias("_id"), F.col(TS).alias("_ts"), "fcst", "fcst_lower", "fcst_upper")
    j = actual.join(p, (F.col(ID) == F.col("_id")) & (F.col(TS) == F.col("_ts")))
    e = F.col(VALUE) - F.col("fcst")
    e = divide(e, F.col("fcst_upper") - F.col("fcst_lower")) if scaled else e
    return j.select(ID, TS, e.alias("residual")).where("residual is not null")


def false_alarm_probability(history: DataFrame, scores: DataFrame, buckets: int = 100) -> DataFrame:
    """Each score's place, 0 to 1, in the distribution of its series' historical scores (percentiles, joined by series)."""
    q = history.groupBy(ID).agg(F.percentile("score", F.array(*[F.lit(i / buckets) for i in range(buckets + 1)])).alias("_q")).withColumnRenamed(ID, "_id")
    j = scores.join(q, F.col(ID) == F.col("_id"), "left")
    place = F.size(F.filter("_q", lambda x: x <= F.col("score"))) / F.lit(buckets + 1)
    return j.select(ID, TS, "score", F.coalesce(place, F.lit(0.0)).alias("place"))


def trend_scores(series: DataFrame, changes: int = 10, order: int = 3, period: int = 7, ridge: float = 1.0) -> DataFrame:
    """Change of slope at each knot of a piecewise-linear fit with seasons."""

    def run(t, v):
        n = len(v)
        if n < 2 * changes:
            return
        knots = np.linspace(0, n - 1, changes + 2)[1:-1]
        i = np.arange(n, dtype=float)
        x = np.column_stack([np.ones(n), i / n, np.maximum(0, i[:, None] - knots) / n, K.harmonics(i, period, order)])
        beta = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ v)
        yield from ((t[int(k)], float(b / n)) for k, b in zip(knots, beta[2 : 2 + changes]))

    return D.per_series(series, run, "ts timestamp, score double")


def bocpd_trend(series: DataFrame, alpha: float = 0.1, beta: float = 0.1, **params) -> DataFrame:
    """Change probability of the slope of doubly smoothed values."""

    def run(t, v):
        if len(v) < 4:
            return
        level, slope, out = v[0], v[1] - v[0], []
        for x in v:
            new = alpha * x + (1 - alpha) * (level + slope)
            slope = beta * (new - level) + (1 - beta) * slope
            level = new
            out.append(slope)
        yield from zip(t, map(float, out), map(float, K.bocpd(np.array(out), **params)))

    return D.per_series(series, run, "ts timestamp, slope double, probability double")


def one_sample_proportion(frame: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Clopper-Pearson interval of value (a proportion of sample_count) and whether it lies above effect_size."""

    def run(batches):
        for f in batches:
            ci = [K.clopper_pearson(round(v * n), int(n), 2 * alpha) for v, n in zip(f["value"], f["sample_count"])]
            yield pd.DataFrame({ID: f[ID], TS: f[TS], "lower": [c[0] for c in ci], "upper": [c[1] for c in ci], "hit": [bool(c[0] > e) for c, e in zip(ci, f["effect_size"])]})

    return frame.select(ID, TS, "value", "sample_count", "effect_size").mapInPandas(run, f"{ID} string, {TS} timestamp, lower double, upper double, hit boolean")


def autocorrelation_matrix(phi: float, n: int) -> np.ndarray:
    """Correlations of an AR(1) process."""
    i = np.arange(n)
    return phi ** np.abs(i[:, None] - i)


def correlated_run_probability(p: float, n: int, m: int, cov: np.ndarray, draws: int = 20_000, seed: int = 0) -> float:
    """Chance of a run of m exceedances among n correlated tests, by seeded draws."""
    z = np.random.default_rng(seed).multivariate_normal(np.zeros(n), cov, draws) > K.norm_ppf(1 - p)
    run, hit = np.zeros(draws, int), np.zeros(draws, bool)
    for i in range(n):
        run = np.where(z[:, i], run + 1, 0)
        hit |= run >= m
    return float(hit.mean())


def percentage_change(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Ratio of current to previous means, its delta-method interval, score and significance, from m0, v0, n0, m1, v1, n1 (means, sample variances, counts)."""
    c = F.col
    ratio = divide(c("m1"), c("m0"))
    var = divide(c("v1"), c("n1") * c("m0") * c("m0")) + divide(c("v0") * c("m1") * c("m1"), c("n0") * F.pow(c("m0"), 4))
    q = K.norm_ppf(1 - alpha / 2)
    half = q * F.sqrt(var)
    pooled = F.sqrt(divide((c("n0") - 1) * c("v0") + (c("n1") - 1) * c("v1"), c("n0") + c("n1") - 2))
    return pairs.select(
        "*", ratio.alias("ratio"), (100 * (ratio - 1)).alias("perc_change"), (ratio - half).alias("ratio_lower"), (ratio + half).alias("ratio_upper"), ((ratio - half > 1) | (ratio + half < 1)).alias("stat_sig"), divide(c("m1") - c("m0"), pooled).alias("score")
    )


def empirical_errors(series: DataFrame, model: str, steps: int, folds: int = 8, **params) -> DataFrame:
    """(series_id, fold, step, err): errors of forecasts from evenly spaced origins in the last half."""
    fit = MODELS[model]

    def run(t, v):
        first = max(5, len(v) // 2)
        for k, at in enumerate(np.unique(np.linspace(first, len(v) - steps, folds).astype(int))):
            if first <= at <= len(v) - steps:
                f = fit(v[:at], steps, **params)[0]
                yield from ((k, h + 1, float(v[at + h] - f[h])) for h in range(steps))

    return D.per_series(series, run, "fold int, step int, err double")


def bootstrap_interval(series: DataFrame, model: str, steps: int, block: int = 7, draws: int = 30, confidence: float = 0.8, seed: int = 0, **params) -> DataFrame:
    """Forecast with an interval from block-resampled residuals of a smooth; draws are seeded by the series' length."""
    fit = MODELS[model]

    def run(t, v):
        n = len(v)
        if n < 2 * block:
            return
        smooth = np.convolve(np.pad(v, block // 2, mode="edge"), np.ones(2 * (block // 2) + 1) / (2 * (block // 2) + 1), "valid")
        res = v - smooth
        rng = np.random.default_rng(seed + n)
        sims = []
        for _ in range(draws):
            at = rng.integers(0, n - block + 1, n // block + 1)
            sims.append(fit(smooth + np.concatenate([res[a : a + block] for a in at])[:n], steps, **params)[0])
        lo, mid, hi = np.quantile(sims, [(1 - confidence) / 2, 0.5, (1 + confidence) / 2], axis=0)
        yield from ((h + 1, float(mid[h]), float(lo[h]), float(hi[h])) for h in range(steps))

    return D.per_series(series, run, "step int, fcst double, fcst_lower double, fcst_upper double")


# ---- features from detectors ---------------------------------------------------------------------


def detector_features(series: DataFrame, period: int = 7) -> DataFrame:
    """Counts and sizes of what CUSUM, robust statistics, BOCPD, outliers and Mann-Kendall find in each series."""
    c = D.cusum(series, ("increase",)).groupBy(ID).agg(F.count_if("detected").alias("cusum_num"), F.max("cp_index").alias("cusum_cp_index"), F.max("delta").alias("cusum_delta"), F.max("llr").alias("cusum_llr"), F.min("p_value").alias("cusum_p_value"))
    r = D.robust_stat(series).groupBy(ID).agg(F.count("*").alias("robust_num"), F.avg("z").alias("robust_metric_mean"))
    b = D.bocpd(series).groupBy(ID).agg(F.count_if("change").alias("bocp_num"), F.max("probability").alias("bocp_conf_max"), F.avg("probability").alias("bocp_conf_mean"))
    o = D.outliers(series, period).groupBy(ID).agg(F.count_if("is_outlier").alias("outlier_num"))
    t = D.mann_kendall(series).groupBy(ID).agg(F.count_if(F.col("trend") != "no trend").alias("trend_num"), F.count_if(F.col("trend") == "increasing").alias("trend_num_increasing"), F.avg(F.abs("tau")).alias("trend_avg_abs_tau"))
    ids = series.select(F.col(ID).cast("string").alias(ID)).distinct()
    return reduce(lambda x, y: x.join(y, ID, "left"), [c, r, b, o, t], ids)


def seasonality_features(series: DataFrame) -> DataFrame:
    """Period of the differences' spectrum (7 if none), and strengths and residual of the decomposition by it."""

    def run(t, v):
        if len(v) < 15:
            return
        found = K.fft_seasonality(np.diff(v))
        p = int(round(found[0])) if found and 2 <= round(found[0]) <= len(v) // 2 else 7
        s, g, r = K.stl(v, p)
        yield p, float(g[-1] - g[0]), float(s.max() - s.min()), float(r.std())

    return D.per_series(series, run, "seasonal_period int, trend_mag double, seasonality_mag double, residual_std double")


def nowcast_frame(series: DataFrame, steps: int = 1, lags=(1, 2, 3), roc=(2, 3)) -> DataFrame:
    """Features of nowcasting (lags, rates of change, moving averages) with the value ``steps`` ahead as label."""
    from ..functions import indicators as I

    v = F.col(VALUE)
    return series.select(ID, TS, VALUE, F.lead(VALUE, steps).over(ordered()).alias("label"), *[I.lag(v, k).alias(f"lag_{k}") for k in lags], *[I.roc(v, k).alias(f"roc_{k}") for k in roc], *[I.ma(v, k).alias(f"ma_{k}") for k in roc])


def nowcast(series: DataFrame, steps: int = 1):
    """(series_id, ts, fcst) of the last points, by boosted trees over nowcast_frame, one model for all series, values scaled by each series' mean."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    scaled = series.withColumn("_m", F.avg(VALUE).over(Window.partitionBy(ID))).where("_m <> 0")
    frame = nowcast_frame(scaled.withColumn(VALUE, F.col(VALUE) / F.col("_m")), steps)
    means = series.groupBy(ID).agg(F.avg(VALUE).alias("_m")).withColumnRenamed(ID, "_id")
    cols = [c for c in frame.columns if c not in (ID, TS, VALUE, "label")]
    fitted = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip"), GBTRegressor(maxIter=15, maxDepth=4, seed=0)]).fit(frame.na.drop(subset=["label", *cols]))
    out = fitted.transform(frame.where("label is null").na.drop(subset=cols))
    return out.join(means, F.col(ID) == F.col("_id")).select(ID, TS, (F.col("prediction") * F.col("_m")).alias("fcst"))


def hampel_distance(x: np.ndarray) -> np.ndarray:
    """Robust distances: deviations from the median over the scaled median deviation."""
    med = np.median(x, axis=0)
    mad = np.median(np.abs(x - med), axis=0) * 1.4826
    return np.sqrt((((x - med) / np.where(mad > 0, mad, 1)) ** 2).sum(axis=-1)) if x.ndim > 1 else np.abs(x - med) / (mad if mad > 0 else 1)


def significance(p: float) -> float:
    """-log10 of a probability."""
    return -math.log10(max(p, 1e-300))
