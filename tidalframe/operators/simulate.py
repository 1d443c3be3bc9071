"""Simulated series, level and trend shifts, spikes, and ARMA recurrences."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .series import ID, TS, VALUE, ordered


def base(spark: SparkSession, n_series: int, n_points: int, start: str = "2020-01-01", step_seconds: int = 86400, level: float = 0.0) -> DataFrame:
    """A constant level; series are made where they are used, not on the driver."""
    r = spark.range(n_series * n_points)
    return r.select((F.col("id") / n_points).cast("bigint").cast("string").alias(ID), F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + (F.col("id") % n_points) * step_seconds * 1_000_000).alias(TS), F.lit(float(level)).alias(VALUE))


def _position(series: DataFrame) -> DataFrame:
    return series.withColumn("_i", F.row_number().over(ordered()) - 1)


def _put(series: DataFrame, x, multiply: bool) -> DataFrame:
    return series.withColumn(VALUE, F.col(VALUE) * x if multiply else F.col(VALUE) + x).drop("_i")


def add_trend(series: DataFrame, magnitude: float, kind: str = "linear", multiply: bool = False) -> DataFrame:
    """Linear slope a point, or a sigmoid of that height over the first ten points of time."""
    i = F.col("_i")
    x = magnitude * i if kind == "linear" else magnitude / (1 + F.exp(-(i - 5)))
    return _put(_position(series), x, multiply)


def add_noise(series: DataFrame, magnitude: float = 1.0, seed: int = 0, multiply: bool = False) -> DataFrame:
    """Normal noise; drawn from a hash of series and time, so that a recomputed task draws the same."""
    u = lambda k: (F.pmod(F.xxhash64(ID, TS, F.lit(seed), F.lit(k)), F.lit(2**52)) + 0.5) / 2.0**52
    return _put(series, magnitude * F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2)), multiply)


def add_seasonality(series: DataFrame, magnitude: float, period_seconds: float, multiply: bool = False) -> DataFrame:
    return _put(series, magnitude * F.sin(F.unix_micros(TS) * (2 * math.pi / (period_seconds * 1e6))), multiply)


def level_shift(series: DataFrame, start: int, stop: int, amount: float) -> DataFrame:
    """Adds an amount to positions start to stop - 1."""
    return _put(_position(series), F.when((F.col("_i") >= start) & (F.col("_i") < stop), amount).otherwise(0.0), False)


def trend_shift(series: DataFrame, start: int, slope: float) -> DataFrame:
    return _put(_position(series), F.greatest(F.col("_i") - start, F.lit(0)) * slope, False)


def spikes(series: DataFrame, positions: list[int], z: float) -> DataFrame:
    """Adds z deviations, of the steps about their line, at positions."""
    from pyspark.sql import Window

    e = Window.partitionBy(ID)
    s = _position(series)
    resid = F.col(VALUE) - F.regr_intercept(VALUE, "_i").over(e) - F.regr_slope(VALUE, "_i").over(e) * F.col("_i")
    s = s.withColumn("_r", resid).withColumn("_sd", F.stddev_pop("_r").over(e))
    return _put(s, F.when(F.col("_i").isin(positions), F.col("_sd") * z).otherwise(0.0), False).drop("_r", "_sd")


def arima(n: int, ar=(), ma=(), mu: float = 0.0, sigma: float = 1.0, d: int = 0, burn: int = 10, seed: int = 0) -> np.ndarray:
    """One draw of n points."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, sigma, n + burn)
    x = np.zeros(n + burn)
    for i in range(n + burn):
        x[i] = mu + e[i] + sum(a * x[i - 1 - k] for k, a in enumerate(ar) if i > k) + sum(b * e[i - 1 - k] for k, b in enumerate(ma) if i > k)
    x = x[burn:]
    for _ in range(d):
        x = np.cumsum(x)
    return x
