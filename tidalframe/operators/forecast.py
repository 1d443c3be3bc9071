"""Forecasting, ensembles, reconciliation, folds, backtests and tuning over many series."""


import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import metric
from . import kernels as K
from .series import ID, TS, VALUE, aggregate_level, ordered

FORECAST = "step int, ts timestamp, fcst double, fcst_lower double, fcst_upper double"


def _positions(series: DataFrame) -> DataFrame:
    return series.where(F.col(VALUE).isNotNull()).withColumn("i", (F.row_number().over(ordered()) - 1).cast("double"))


def _step(series: DataFrame) -> DataFrame:
    """(series_id, last, us): last time and most frequent step in microseconds."""
    d = series.select(ID, TS, (F.unix_micros(TS) - F.unix_micros(F.lag(TS).over(ordered()))).alias("d"))
    return d.groupBy(ID).agg(F.max(TS).alias("last"), F.mode("d", True).alias("us"))


def _t_column(df, alpha: float):
    """Student's quantile: its exact value for fewer than 30 degrees of freedom, from there on Cornish-Fisher's series in 1 / df."""
    z = K.norm_ppf(1 - alpha / 2)
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    small = F.array(*[F.lit(K.t_ppf(1 - alpha / 2, n)) for n in range(1, 30)])
    series = F.lit(z) + g[0] / df + g[1] / F.pow(df, 2) + g[2] / F.pow(df, 3) + g[3] / F.pow(df, 4)
    return F.when(df < 30, F.get(small, F.greatest(df.cast("int") - 1, F.lit(0)))).otherwise(series)


def linear(series: DataFrame, steps: int, alpha: float = 0.05) -> DataFrame:
    """Straight line by closed-form aggregates, with its prediction interval: one aggregation, then ``steps`` rows a series."""
    a = _positions(series).groupBy(ID).agg(
        F.count("*").cast("double").alias("n"), F.regr_intercept(VALUE, "i").alias("a"), F.regr_slope(VALUE, "i").alias("b"), F.regr_sxx(VALUE, "i").alias("sxx"), F.regr_syy(VALUE, "i").alias("syy"), F.regr_sxy(VALUE, "i").alias("sxy"), F.avg("i").alias("m"), F.max(TS).alias("last")
    )
    a = a.join(_step(series).select(F.col(ID).alias("_id"), "us"), F.col(ID) == F.col("_id")).where("n > 2")
    h = a.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    x = F.col("n") - 1 + F.col("step")
    f = F.col("a") + F.col("b") * x
    s2 = F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2)
    half = _t_column(F.col("n") - 2, alpha) * F.sqrt(s2 * (1 + 1 / F.col("n") + F.pow(x - F.col("m"), 2) / F.col("sxx")))
    at = F.timestamp_micros(F.unix_micros("last") + F.col("us") * F.col("step"))
    return h.select(ID, "step", at.alias(TS), f.alias("fcst"), (f - half).alias("fcst_lower"), (f + half).alias("fcst_upper"))


def heuristic(series: DataFrame, steps: int, method: str = "mean", q: float = 95) -> DataFrame:
    """Last cycle, or mean, median or percentile by position over the last whole cycles of ``steps`` points."""
    n = F.count("*").over(Window.partitionBy(ID))
    back = F.row_number().over(Window.partitionBy(ID).orderBy(F.col(TS).desc())) - 1
    s = series.where(F.col(VALUE).isNotNull()).withColumn("n", n).withColumn("r", back).where(F.col("r") < F.floor(F.col("n") / steps) * steps)
    s = s.withColumn("step", (steps - F.col("r") % steps).cast("int"))
    f = {"last": F.min_by(VALUE, "r"), "mean": F.avg(VALUE), "median": F.percentile(VALUE, F.lit(0.5)), "percentile": F.percentile(VALUE, F.lit(q / 100))}[method]
    g = s.groupBy(ID, "step").agg(f.alias("fcst"))
    g = g.join(_step(series).withColumnRenamed(ID, "_id"), F.col(ID) == F.col("_id"))
    at = F.timestamp_micros(F.unix_micros("last") + F.col("us") * F.col("step"))
    return g.select(ID, "step", at.alias(TS), "fcst", F.col("fcst").alias("fcst_lower"), F.col("fcst").alias("fcst_upper"))


# ---- kernels: (values, steps, parameters) -> forecast, lower, upper ---------------------


def _quadratic(v, steps, alpha=0.05, **_):
    i, j = np.arange(len(v)), np.arange(len(v), len(v) + steps)
    d = lambda t: np.column_stack([np.ones(len(t)), t, t**2])
    return K.design_forecast(v, d(i), d(j), alpha)


def _linear(v, steps, alpha=0.05, **_):
    d = lambda t: np.column_stack([np.ones(len(t)), t])
    return K.design_forecast(v, d(np.arange(len(v))), d(np.arange(len(v), len(v) + steps)), alpha)


def _harmonic(v, steps, period=7, order=3, alpha=0.05, **_):
    d = lambda t: np.column_stack([np.ones(len(t)), K.harmonics(t, period, order)])
    return K.design_forecast(v, d(np.arange(len(v))), d(np.arange(len(v), len(v) + steps)), alpha, 1e-9)


def _piecewise(v, steps, period=7, order=3, changes=10, ridge=1.0, alpha=0.05, **_):
    """Trend with change points over the first 80 % and Fourier seasons, shrunk changes."""
    n = len(v)
    knots = np.linspace(0, 0.8 * n, changes + 2)[1:-1]
    d = lambda t: np.column_stack([np.ones(len(t)), t / n, np.maximum(0, t[:, None] - knots) / n, K.harmonics(t, period, order)])
    return K.design_forecast(v, d(np.arange(n, dtype=float)), d(np.arange(n, n + steps, dtype=float)), alpha, ridge)


def _theta(v, steps, period=7, alpha=0.05, **_):
    return K.theta(v, steps, period, alpha)


def _holt_winters(v, steps, period=7, multiplicative=False, alpha=0.05, **_):
    if len(v) < 2 * period:
        period = 0
    sse, f = K.holt_winters(v, K.fit_holt_winters(v, period, multiplicative), period, multiplicative, steps)
    half = K.norm_ppf(1 - alpha / 2) * math.sqrt(sse / max(1, len(v) - 3)) * np.sqrt(np.arange(1, steps + 1))
    return f, f - half, f + half


def _arima(v, steps, p=1, d=1, q=1, alpha=0.05, **_):
    return K.arima(v, steps, p, d, q, alpha=alpha)


def _sarima(v, steps, p=1, d=0, q=0, period=7, sp=1, sd=1, alpha=0.05, **_):
    return K.arima(v, steps, p, d, q, period, sp, sd, alpha)


def _stlf(v, steps, period=7, model="theta", alpha=0.05, **_):
    season, trend, resid = K.stl(v, period)
    f, lo, hi = MODELS[model](v - season, steps, period=1 if model == "theta" else period, alpha=alpha)
    s = season[-period:][np.arange(steps) % period]
    return f + s, lo + s, hi + s


def _naive(v, steps, alpha=0.05, **_):
    f = np.full(steps, v[-1])
    half = K.norm_ppf(1 - alpha / 2) * np.diff(v).std() * np.sqrt(np.arange(1, steps + 1)) if len(v) > 1 else 0.0
    return f, f - half, f + half


def _autoregression(v, steps, lags=14, period=7, ridge=1.0, **_):
    """Ridge regression on lags and season position, applied step by step."""
    lags = min(lags, len(v) // 3)
    mean, sd = v.mean(), v.std() or 1.0
    z = list((v - mean) / sd)
    row = lambda h, i: np.concatenate([[1.0], h[-lags:], K.harmonics(np.array([float(i)]), period, 2)[0]])
    x = np.array([row(z[:i], i) for i in range(lags, len(z))])
    y = np.array(z[lags:])
    b = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)
    e = (y - x @ b).std() * sd
    for i in range(len(v), len(v) + steps):
        z.append(float(row(z, i) @ b))
    f = np.array(z[len(v) :]) * sd + mean
    half = K.norm_ppf(0.975) * e * np.sqrt(np.arange(1, steps + 1))
    return f, f - half, f + half


MODELS: dict[str, Callable] = {
    "linear": _linear, "quadratic": _quadratic, "harmonic": _harmonic, "piecewise": _piecewise, "theta": _theta, "holt_winters": _holt_winters,
    "arima": _arima, "sarima": _sarima, "stlf": _stlf, "naive": _naive, "autoregression": _autoregression,
}


def register(name: str, model: Callable) -> None:
    """Adds a model: f(values, steps, **parameters) -> (forecast, lower, upper)."""
    MODELS[name] = model


def forecast(series: DataFrame, model: str, steps: int, **params) -> DataFrame:
    """(series_id, step, ts, fcst, fcst_lower, fcst_upper) of a model fitted to each series."""
    fit = MODELS[model]

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.dropna(subset=[VALUE]).sort_values([TS, VALUE])
        out = pd.DataFrame(columns=[ID, "step", TS, "fcst", "fcst_lower", "fcst_upper"])
        if len(f) < 5:
            return out
        gaps = f[TS].diff().dropna()
        step = gaps.mode().iloc[0]
        a, lo, hi = fit(f[VALUE].to_numpy(float), steps, **params)
        k = np.arange(1, steps + 1)
        return pd.DataFrame({ID: key[0], "step": k, TS: [f[TS].iloc[-1] + step * int(i) for i in k], "fcst": a, "fcst_lower": lo, "fcst_upper": hi})

    return series.select(F.col(ID).cast("string").alias(ID), TS, VALUE).groupBy(ID).applyInPandas(run, f"{ID} string, {FORECAST}")


def vector_forecast(wide: DataFrame, columns: list[str], steps: int, lags: int = 1, prior: tuple | None = None) -> DataFrame:
    """VAR, or its Bayesian form with a Minnesota prior, of the columns of each series_id."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = f.sort_values(TS)[columns].to_numpy(float)
        a, lo, hi = K.var_forecast(x, lags, steps, prior)
        return pd.DataFrame([(key[0], h + 1, c, a[h, j], lo[h, j], hi[h, j]) for h in range(steps) for j, c in enumerate(columns)], columns=[ID, "step", "metric", "fcst", "fcst_lower", "fcst_upper"])

    return wide.groupBy(ID).applyInPandas(run, f"{ID} string, step int, metric string, fcst double, fcst_lower double, fcst_upper double")


# ---- ensembles --------------------------------------------------------------------------------


def ensemble(forecasts: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Median of the models' forecasts (model column), or their mean by (series_id, model, weight)."""
    cols = ["fcst", "fcst_lower", "fcst_upper"]
    if weights is None:
        return forecasts.groupBy(ID, "step", TS).agg(*[F.median(c).alias(c) for c in cols])
    w = weights.select(F.col(ID).alias("_id"), F.col("model").alias("_m"), "weight")
    j = forecasts.join(w, (F.col(ID) == F.col("_id")) & (F.col("model") == F.col("_m")))
    return j.groupBy(ID, "step", TS).agg(*[(F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(c) for c in cols])


def inverse_error_weights(errors: DataFrame, eps: float = 1e-9) -> DataFrame:
    """(series_id, model, weight) from (series_id, model, err)."""
    inv = 1 / (F.col("err") + eps)
    return errors.select(ID, "model", (inv / F.sum(inv).over(Window.partitionBy(ID))).alias("weight"))


# ---- splits and backtests ---------------------------------------------------------------------


def split(series: DataFrame, train_frac: float) -> DataFrame:
    """The series with part: train for the first floor(n f) points, else test."""
    n = F.count("*").over(Window.partitionBy(ID))
    i = F.row_number().over(ordered())
    return series.select(*series.columns, F.when(i <= F.floor(n * F.lit(train_frac)), "train").otherwise("test").alias("part"))


def split_at(series: DataFrame, train_end: str, test_start: str, train_start: str | None = None, test_end: str | None = None) -> DataFrame:
    t = lambda s: F.lit(s).cast("timestamp")
    c = F.col(TS)
    train = (c <= t(train_end)) & ((c >= t(train_start)) if train_start else F.lit(True))
    test = (c >= t(test_start)) & ((c <= t(test_end)) if test_end else F.lit(True))
    return series.select("*", F.when(train, "train").when(test, "test").alias("part")).where("part is not null")


def folds(series: DataFrame, start_frac: float, test_frac: float, steps: int, constant: bool = False, gap_frac: float = 0.0) -> DataFrame:
    """Rolling origins: every point once for each fold that it belongs to, with fold and part.

    Train sizes run evenly from floor(n start) to n less test and gap; constant
    drops the oldest, so that all folds train on as much as the first.
    """
    n = F.count("*").over(Window.partitionBy(ID))
    s = series.withColumn("_n", n).withColumn("_i", F.row_number().over(ordered()))
    first, test, gap = F.floor(F.col("_n") * start_frac), F.floor(F.col("_n") * test_frac), F.floor(F.col("_n") * gap_frac)
    last = F.col("_n") - test - gap
    k = F.col("fold")
    size = F.floor(first + (last - first) * k / max(1, steps - 1)) if steps > 1 else first
    s = s.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("_s", size)
    low = F.col("_s") - first if constant else F.lit(0)
    part = F.when((F.col("_i") > low) & (F.col("_i") <= F.col("_s")), "train").when((F.col("_i") > F.col("_s") + gap) & (F.col("_i") <= F.col("_s") + gap + test), "test")
    return s.withColumn("part", part).where("part is not null").select(*series.columns, "fold", "part")


def backtest(folded: DataFrame, model: str, metrics: list[str], params: dict | None = None) -> DataFrame:
    """(series_id, fold, n_test, one column for each metric): the model fitted to each fold's train points."""
    fit, params = MODELS[model], params or {}

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.dropna(subset=[VALUE]).sort_values(TS)
        train, test = f[f["part"] == "train"], f[f["part"] == "test"]
        if len(train) < 5 or test.empty:
            return pd.DataFrame(columns=[ID, "fold", TS, "y", "fcst"])
        a = fit(train[VALUE].to_numpy(float), len(test), **params)[0]
        return pd.DataFrame({ID: key[0], "fold": key[1], TS: test[TS].to_numpy(), "y": test[VALUE].to_numpy(float), "fcst": a})

    pairs = folded.select(F.col(ID).cast("string").alias(ID), TS, VALUE, "fold", "part").groupBy(ID, "fold").applyInPandas(run, f"{ID} string, fold int, {TS} timestamp, y double, fcst double")
    return pairs.groupBy(ID, "fold").agg(F.count("*").alias("n_test"), *[metric(m)(F.col("y"), F.col("fcst")).alias(m) for m in metrics])


def summarize(errors: DataFrame, metrics: list[str], weighted: bool = False) -> DataFrame:
    """Mean over folds, or weighed by test length."""
    w = F.col("n_test")
    return errors.groupBy(ID).agg(*[(F.sum(F.col(m) * w) / F.sum(w) if weighted else F.avg(m)).alias(m) for m in metrics])


def empirical_interval(point: DataFrame, errors: DataFrame, confidence: float = 0.8) -> DataFrame:
    """Interval of (series_id, step, fcst) from backtest errors (series_id, step, err): a line through the deviation of each step."""
    sd = errors.groupBy(ID, "step").agg(F.stddev_samp("err").alias("sd")).where("sd is not null")
    fit = sd.groupBy(ID).agg(F.coalesce(F.regr_slope("sd", "step"), F.lit(0.0)).alias("a"), F.coalesce(F.regr_intercept("sd", "step"), F.avg("sd")).alias("b")).withColumnRenamed(ID, "_id")
    half = K.norm_ppf(confidence) * (F.col("a") * F.col("step") + F.col("b"))
    j = point.join(fit, F.col(ID) == F.col("_id"))
    return j.select(ID, "step", "fcst", (F.col("fcst") - half).alias("fcst_lower"), (F.col("fcst") + half).alias("fcst_upper"))


# ---- tuning ---------------------------------------------------------------------------------------


def grid_of(space: dict[str, list]) -> list[dict]:
    return [dict(zip(space, c)) for c in itertools.product(*space.values())]


def cardinality(space: dict[str, list]) -> int:
    return math.prod(map(len, space.values()))


def random_of(space: dict[str, list], n: int, seed: int = 0) -> list[dict]:
    rng = np.random.default_rng(seed)
    return [{k: v[int(rng.integers(len(v)))] for k, v in space.items()} for _ in range(n)]


def tune(series: DataFrame, candidates: list[tuple[str, dict]], error: str = "mean_absolute_error", train_frac: float = 0.8) -> DataFrame:
    """(series_id, trial, model, params, err, best): every candidate on every series, spread by series and trial; best: the least error, the first trial among ties."""
    import json

    trials = series.sparkSession.createDataFrame([(i, m, json.dumps(p)) for i, (m, p) in enumerate(candidates)], "trial int, model string, params string")
    parted = split(series, train_frac).select(F.col(ID).cast("string").alias(ID), TS, VALUE, "part")
    spread = parted.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(len(candidates) - 1))))

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        name, params = candidates[int(key[1])]
        f = f.dropna(subset=[VALUE]).sort_values(TS)
        train, test = f[f["part"] == "train"], f[f["part"] == "test"]
        if len(train) < 5 or test.empty:
            return pd.DataFrame(columns=[ID, "t", "y", "fcst"])
        a = MODELS[name](train[VALUE].to_numpy(float), len(test), **params)[0]
        return pd.DataFrame({ID: key[0], "t": key[1], "y": test[VALUE].to_numpy(float), "fcst": a})

    pairs = spread.groupBy(ID, "t").applyInPandas(run, f"{ID} string, t int, y double, fcst double")
    err = pairs.groupBy(ID, "t").agg(metric(error)(F.col("y"), F.col("fcst")).alias("err"))
    best = F.row_number().over(Window.partitionBy(ID).orderBy("err", "t")) == 1
    return err.join(F.broadcast(trials), F.col("t") == F.col("trial")).select(ID, "trial", "model", "params", "err", best.alias("best"))


# ---- hierarchies -----------------------------------------------------------------------------------


def temporal_reconciliation(series: DataFrame, levels: list[int], steps: int, model: str = "naive", method: str = "struc") -> DataFrame:
    """(series_id, step, fcst): forecasts of every aggregation level made coherent; steps is a multiple of every level."""
    got = None
    for k in levels:
        f = forecast(series if k == 1 else aggregate_level(series, k), model, steps // k).select(ID, F.lit(k).alias("level"), "step", "fcst")
        got = f if got is None else got.unionByName(f)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        by = {int(k): g.sort_values("step")["fcst"].to_numpy() for k, g in f.groupby("level")}
        if set(by) != set(levels):
            return pd.DataFrame(columns=[ID, "step", "fcst"])
        return pd.DataFrame({ID: key[0], "step": np.arange(1, steps + 1), "fcst": K.reconcile(levels, steps, by, method)})

    return got.groupBy(ID).applyInPandas(run, f"{ID} string, step int, fcst double")
