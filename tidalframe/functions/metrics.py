"""Accuracy metrics as aggregate columns over y, f (forecast) and, for some, w (weight)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..operators.series import ID, TS, divide

NAN = float("nan")


def safe_divide(n: Column, d: Column) -> Column:
    """n / d; by zero: the sign of n."""
    return F.when(d == 0, F.signum(n)).otherwise(divide(n, d))


# ---- by point ------------------------------------------------------------------


def error(y: Column, f: Column) -> Column:
    return y - f


def absolute_error(y: Column, f: Column) -> Column:
    return F.abs(y - f)


def percentage_error(y: Column, f: Column) -> Column:
    return safe_divide(y - f, y)


def absolute_percentage_error(y: Column, f: Column) -> Column:
    return F.abs(percentage_error(y, f))


def weighted(e: Column, w: Column, over) -> Column:
    """e w / sum w over a window."""
    return divide(e * w, F.sum(w).over(over))


# ---- by group ------------------------------------------------------------------


def _mean(e: Column, w: Column | None) -> Column:
    return F.avg(e) if w is None else divide(F.sum(e * w), F.sum(F.when(e.isNotNull(), w)))


def mean_error(y, f):
    return F.avg(y - f)


def mean_absolute_error(y, f, w=None):
    return _mean(F.abs(y - f), w)


def mean_squared_error(y, f, w=None):
    return _mean((y - f) * (y - f), w)


def root_mean_squared_error(y, f, w=None):
    return F.sqrt(mean_squared_error(y, f, w))


def root_mean_squared_log_error(y, f, w=None):
    e = F.log1p(y) - F.log1p(f)
    return F.sqrt(_mean(e * e, w))


def root_mean_squared_percentage_error(y, f, w=None):
    e = percentage_error(y, f)
    return F.sqrt(_mean(e * e, w))


def mean_percentage_error(y, f):
    return F.avg(percentage_error(y, f))


def mean_absolute_percentage_error(y, f):
    return F.avg(absolute_percentage_error(y, f))


def median_absolute_error(y, f):
    return F.median(F.abs(y - f))


def median_absolute_percentage_error(y, f):
    return F.median(absolute_percentage_error(y, f))


def symmetric_mean_absolute_percentage_error(y, f):
    return 2 * scaled_symmetric_mean_absolute_percentage_error(y, f)


def scaled_symmetric_mean_absolute_percentage_error(y, f):
    return F.avg(safe_divide(F.abs(y - f), F.abs(y) + F.abs(f)))


def symmetric_bias(y, f):
    return -2 * F.avg(safe_divide(y - f, F.abs(y) + F.abs(f)))


def tracking_signal(y, f):
    return divide(F.sum(y - f), F.avg(F.abs(y - f)))


def frequency_exceeds_relative_threshold(y, f, threshold: float):
    return F.avg(F.when(absolute_percentage_error(y, f) > threshold, 1.0).otherwise(0.0))


def exceed(y, f, threshold: float):
    """Share of points beyond a quantile forecast: above it from 0.5 on, below it under 0.5."""
    return F.avg(F.when((y > f) if threshold >= 0.5 else (y < f), 1.0).otherwise(0.0))


def pinball_loss(y, f, threshold: float):
    d = y - f
    return F.avg(F.greatest(d * threshold, d * (threshold - 1)))


def coverage(y, lower, upper):
    return F.avg(F.when((y >= lower) & (y <= upper), 1.0).otherwise(0.0))


def interval_error(y, lower, upper, alpha: float = 0.2):
    """Winkler's score of one point."""
    return (upper - lower) + F.when(y < lower, (lower - y) * (2 / alpha)).otherwise(0.0) + F.when(y > upper, (y - upper) * (2 / alpha)).otherwise(0.0)


def interval_score(y, lower, upper, alpha: float = 0.2):
    return F.avg(interval_error(y, lower, upper, alpha))


METRICS: dict[str, Callable] = {f.__name__: f for f in (mean_error, mean_absolute_error, mean_squared_error, root_mean_squared_error, root_mean_squared_log_error, root_mean_squared_percentage_error, mean_percentage_error, mean_absolute_percentage_error, median_absolute_error, median_absolute_percentage_error, symmetric_mean_absolute_percentage_error, scaled_symmetric_mean_absolute_percentage_error, symmetric_bias, tracking_signal)}
ALIASES = {
    "bias": "mean_error", "me": "mean_error", "mae": "mean_absolute_error", "mse": "mean_squared_error", "rmse": "root_mean_squared_error", "rmsle": "root_mean_squared_log_error",
    "rmspe": "root_mean_squared_percentage_error", "mpe": "mean_percentage_error", "mape": "mean_absolute_percentage_error", "mdae": "median_absolute_error", "mdape": "median_absolute_percentage_error",
    "smape": "symmetric_mean_absolute_percentage_error", "sbias": "symmetric_bias",
}


def metric(name: str) -> Callable:
    """The aggregate builder of a metric, by name or alias."""
    name = ALIASES.get(name, name)
    if name not in METRICS:
        raise ParameterError(f"no metric {name!r}; there are {sorted(METRICS) + sorted(ALIASES)}")
    return METRICS[name]


def inspect(name: str) -> dict:
    """What kind of metric it is, and the direction that is better."""
    f = metric(name)
    signed = f in (mean_error, mean_percentage_error, symmetric_bias, tracking_signal)
    return {"name": f.__name__, "type": "bias" if signed else "error", "better": "zero" if signed else "lower", "lower_bound": None if signed else 0.0}


def evaluate(frame: DataFrame, metrics: list[str], keys=(ID,), y: str = "y", f: str = "fcst") -> DataFrame:
    """One row for each key, one column for each metric: a single aggregation."""
    return frame.groupBy(*keys).agg(*[metric(m)(F.col(y), F.col(f)).alias(m) for m in metrics])


# ---- metrics that need the order or the distribution -----------------------------


def mean_absolute_scaled_error(frame: DataFrame) -> DataFrame:
    """(series_id, mase): MAE over the mean absolute step of y."""
    step = F.abs(F.col("y") - F.lag("y").over(Window.partitionBy(ID).orderBy(TS)))
    d = frame.select(ID, F.abs(F.col("y") - F.col("fcst")).alias("e"), step.alias("s"))
    return d.groupBy(ID).agg(F.when(F.avg("s") > 1e-8, F.avg("e") / F.avg("s")).alias("mase"))


def distribution_scores(frame: DataFrame) -> DataFrame:
    """(series_id, leps, crps): mean absolute and squared distance of F(f) and F(y), F the distribution of y.

    Ranks come from one sort of y and f together, not from comparing all pairs.
    """
    both = frame.select(ID, F.explode(F.array(F.struct(F.col("y").alias("x"), F.lit(1).alias("is_y"), F.col(TS).alias("t")), F.struct(F.col("fcst").alias("x"), F.lit(0).alias("is_y"), F.col(TS).alias("t")))).alias("p")).select(ID, "p.*").where("x is not null")
    below = Window.partitionBy(ID).orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    share = F.sum("is_y").over(below) / F.sum("is_y").over(Window.partitionBy(ID))
    wide = both.withColumn("c", share).groupBy(ID, "t").agg(F.max(F.when(F.col("is_y") == 1, F.col("c"))).alias("a"), F.max(F.when(F.col("is_y") == 0, F.col("c"))).alias("b"))
    d = F.col("a") - F.col("b")
    return wide.groupBy(ID).agg(F.avg(F.abs(d)).alias("leps"), F.avg(d * d).alias("crps"))


def rolling_mean_same(e: Column, n: int) -> Column:
    """Centred rolling sum over n points divided by n, zeros beyond the ends."""
    left = n // 2
    return F.sum(e).over(Window.partitionBy(ID).orderBy(TS).rowsBetween(-left, n - 1 - left)) / n
