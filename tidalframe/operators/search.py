"""Search over parameter spaces: grids, uniform and low-discrepancy draws, halving, and local refinement."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forecast import cardinality, grid_of, random_of, tune
from .series import ID

#: Default spaces by model.
SPACES: dict[str, dict[str, list]] = {
    "theta": {"period": [7, 12, 30]},
    "holt_winters": {"period": [0, 7, 12], "multiplicative": [False, True]},
    "arima": {"p": [0, 1, 2], "d": [0, 1], "q": [0, 1]},
    "sarima": {"p": [0, 1], "d": [0, 1], "sp": [0, 1], "sd": [0, 1], "period": [7]},
    "harmonic": {"period": [7, 30], "order": [1, 3, 5]},
    "piecewise": {"changes": [0, 5, 10, 25], "ridge": [0.01, 0.1, 1.0, 10.0]},
    "stlf": {"period": [7], "model": ["linear", "theta", "quadratic", "naive"]},
    "autoregression": {"lags": [3, 7, 14], "ridge": [0.1, 1.0, 10.0]},
    "linear": {},
    "quadratic": {},
    "naive": {},
}


def space_of(model: str) -> dict[str, list]:
    if model not in SPACES:
        raise ValueError(f"no default space for {model!r}")
    return SPACES[model]


def low_discrepancy(space: dict[str, list], n: int) -> list[dict]:
    """n points of a Halton sequence over the choices."""
    primes = [p for p in range(2, 200) if all(p % q for q in range(2, int(p**0.5) + 1))]

    def radical(i: int, b: int) -> float:
        f, r = 1.0, 0.0
        while i:
            f /= b
            r += f * (i % b)
            i //= b
        return r

    return [{k: v[int(radical(i, primes[j]) * len(v))] for j, (k, v) in enumerate(space.items())} for i in range(1, n + 1)]


def candidates(model: str, method: str = "grid", n: int = 10, seed: int = 0, space: dict | None = None) -> list[tuple[str, dict]]:
    s = space_of(model) if space is None else space
    if method == "grid" or cardinality(s) <= n:
        return [(model, p) for p in grid_of(s)]
    return [(model, p) for p in (low_discrepancy(s, n) if method == "sobol" else random_of(s, n, seed))]


def search(series: DataFrame, models: list[str], method: str = "grid", n: int = 10, error: str = "mean_absolute_error", seed: int = 0) -> DataFrame:
    """tune() over the candidates of several models' spaces."""
    return tune(series, [c for m in models for c in candidates(m, method, n, seed)], error)


def halving(series: DataFrame, models: list[str], keep: float = 0.5, rounds: int = 2, error: str = "mean_absolute_error") -> DataFrame:
    """Rounds over growing shares of the series; the best share of candidates, by mean rank, goes on."""
    left = [c for m in models for c in candidates(m)]
    for r in range(rounds):
        part = series.where(F.pmod(F.xxhash64(ID), F.lit(2 ** (rounds - r))) == 0) if r < rounds - 1 else series
        scored = tune(part, left, error).groupBy("trial").agg(F.avg("err").alias("e")).orderBy("e", "trial").limit(max(1, math.ceil(len(left) * keep))).collect()
        left = [left[i] for i in sorted(x.trial for x in scored)] or left
    return tune(series, left, error)


def evolve(f: Callable[[dict], float], space: dict[str, list], rounds: int = 20, seed: int = 0) -> tuple[dict, float]:
    """A (1 + 1) search on the driver for an objective of parameters: changes one choice at a time."""
    rng = np.random.default_rng(seed)
    best = {k: v[0] for k, v in space.items()}
    value = f(best)
    for _ in range(rounds):
        k = list(space)[int(rng.integers(len(space)))]
        tried = best | {k: space[k][int(rng.integers(len(space[k])))]}
        if (v := f(tried)) < value:
            best, value = tried, v
    return best, value


def save(fitted: DataFrame, path: str) -> None:
    """Tuned parameters, as JSON lines by series."""
    fitted.select(F.to_json(F.struct(*fitted.columns)).alias("value")).write.text(path)


def load(spark, path: str, schema: str = "series_id string, trial int, model string, params string, err double, best boolean") -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("j")).select("j.*")


def parameters(row) -> dict:
    return json.loads(row.params)
