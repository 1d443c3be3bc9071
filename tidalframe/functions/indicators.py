"""Technical indicators over each series: window columns, and arrays where a recurrence needs them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.series import ID, TS, VALUE, divide, ordered


def rolling(n: int) -> Window:
    return ordered().rowsBetween(-(n - 1), 0)


def full(x: Column, n: int, v: Column) -> Column:
    """x once n values are in the frame."""
    return F.when(F.count(v).over(rolling(n)) >= n, x)


def lag(v: Column, n: int) -> Column:
    return F.lag(v, n).over(ordered()) if n >= 0 else F.lead(v, -n).over(ordered())


def roc(v: Column, n: int) -> Column:
    """Rate of change over n - 1 steps."""
    old = lag(v, n - 1)
    return divide(v - old, old)


def mom(v: Column, n: int) -> Column:
    return v - lag(v, n)


def ma(v: Column, n: int) -> Column:
    return full(F.avg(v).over(rolling(n)), n, v) if n > 0 else F.lit(None).cast("double")


def bbands(v: Column, n: int) -> dict[str, Column]:
    """Width 4 sd / mean, and place in the band; sample deviation."""
    mean, sd = F.avg(v).over(rolling(n)), F.stddev_samp(v).over(rolling(n))
    return {f"bb_width_{n}": full(divide(4 * sd, mean), n, v), f"bb_place_{n}": full(divide(v - mean + 2 * sd, 4 * sd), n, v)}


def embed(v: Column, lags: list[int], horizons: list[int]) -> dict[str, Column]:
    return {f"lag_{k}": lag(v, k) for k in lags} | {f"lead_{h}": lag(v, -h) for h in horizons}


def ewm_array(values: Column, alpha: float, adjust: bool = True, min_periods: int = 1) -> Column:
    """Exponentially weighted means of an array without nulls, in one pass.

    adjust: s = s (1 - a) + x, w = w (1 - a) + 1, mean s / w; else the plain
    recurrence from the first value. Entries before min_periods are null.
    """
    keep = 1 - alpha
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"), F.lit(0).alias("n"), F.array().cast("array<double>").alias("out"))

    def step(a, x):
        s = a["s"] * keep + x if adjust else F.when(a["n"] == 0, x).otherwise(a["s"] * keep + alpha * x)
        w = a["w"] * keep + 1 if adjust else F.lit(1.0)
        y = F.when(a["n"] + 1 >= min_periods, s / w)
        return F.struct(s.alias("s"), w.alias("w"), (a["n"] + 1).alias("n"), F.concat(a["out"], F.array(y)).alias("out"))

    return F.aggregate(values, zero, step, lambda a: a["out"])


def ewm_frame(series: DataFrame, spans: dict[str, float]) -> DataFrame:
    """(series_id, ts, value, one column for each name): adjusted exponential means by a blocked window sum.

    alpha = 2 / (span + 1). Weights are scaled within blocks of rows over which
    they fall to e**-40, so that they neither under- nor overflow and only the
    block before still counts: linear in the length of a series, and never an
    array of it.
    """
    out = series.withColumn("_n", F.row_number().over(ordered()) - 1)
    for name, span in spans.items():
        fall = -math.log(1 - 2 / (span + 1)) if span > 1 else 40.0
        block = max(1, math.ceil(40 / fall))
        inside = Window.partitionBy(ID, "_b").orderBy("_n")
        i = F.col("_n") % block
        j = out.withColumn("_b", F.floor(F.col("_n") / block)).withColumn("_s", F.sum(F.col(VALUE) * F.exp(fall * i)).over(inside) * F.exp(-fall * i))
        ends = j.groupBy(ID, "_b").agg(F.max_by("_s", "_n").alias("_e")).select(F.col(ID).alias("_id"), (F.col("_b") + 1).alias("_bb"), "_e")
        j = j.join(ends, (F.col(ID) == F.col("_id")) & (F.col("_b") == F.col("_bb")), "left")
        total = F.col("_s") + F.coalesce("_e", F.lit(0.0)) * F.exp(-fall * (i + 1))
        weight = (1 - F.exp(-fall * (F.col("_n") + 1))) / (1 - math.exp(-fall))
        out = j.withColumn(name, total / weight).drop("_b", "_s", "_id", "_bb", "_e")
    return out.drop("_n")


def macd_arrays(v: Column, n_fast: int = 12, n_slow: int = 21) -> dict[str, Column]:
    """MACD, its signal of span 9 and their difference, as arrays of an ordered value array."""
    least = n_slow - 1
    diff = F.zip_with(ewm_array(v, 2 / (n_fast + 1)), ewm_array(v, 2 / (n_slow + 1)), lambda a, b: a - b)
    known = F.slice(diff, least, F.greatest(F.size(diff) - least + 1, F.lit(0)))
    sign = F.concat(F.array_repeat(F.lit(None).cast("double"), least - 1), ewm_array(known, 2 / 10, True, 8))
    return {"macd": F.transform(diff, lambda x, i: F.when(i >= least - 1, x)), "macd_signal": sign}


def rsi_array(v: Column, n: int) -> Column:
    """Wilder's RSI of an ordered array: means of gains and losses by alpha = 1 / n; 100 without losses."""
    diff = F.transform(v, lambda x, i: F.when(i == 0, 0.0).otherwise(x - v[F.greatest(i - 1, F.lit(0))]))
    gain = ewm_array(F.transform(diff, lambda d: F.greatest(d, F.lit(0.0))), 1 / n, False)
    loss = ewm_array(F.transform(diff, lambda d: F.greatest(-d, F.lit(0.0))), 1 / n, False)
    return F.zip_with(gain, loss, lambda g, x: F.when(x == 0, 100.0).otherwise(100 - 100 / (1 + g / x)))


def trix_array(v: Column, n: int) -> Column:
    """One-step rate of change of the triple exponential mean; the first is 0."""
    a = 2 / (n + 1)
    e = ewm_array(ewm_array(ewm_array(v, a), a), a)
    return F.transform(e, lambda x, i: F.when(i == 0, 0.0).otherwise(divide(x - e[F.greatest(i - 1, F.lit(0))], e[F.greatest(i - 1, F.lit(0))])))


def tsi_array(v: Column, r: int, s: int) -> Column:
    """Doubly smoothed momentum over doubly smoothed absolute momentum."""
    m = F.transform(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), lambda x, i: x - v[i])
    two = lambda x: ewm_array(ewm_array(x, 2 / (r + 1)), 2 / (s + 1))
    return F.concat(F.array(F.lit(None).cast("double")), F.zip_with(two(m), two(F.transform(m, F.abs)), divide))


def exploded(arrays: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows of (series_id, ts, each array's entry) of a frame of arrays (series_id, ts, values)."""
    named = arrays.select(ID, TS, *[c.alias(n) for n, c in columns.items()])
    return named.select(ID, F.explode(F.arrays_zip(TS, *columns)).alias("p")).select(ID, "p.*")


# ---- rolling scores ------------------------------------------------------------


def rolling_scores(v: Column, n: int) -> dict[str, Column]:
    """Scores of each point against its window; mad and iqr include the point, the others take the n points before it."""
    prev = ordered().rowsBetween(-n, -1)
    here = rolling(n)
    q = lambda p, w: F.percentile(v, F.lit(p)).over(w)
    enough = F.count(v).over(prev) >= n
    mean, sd = F.avg(v).over(prev), F.stddev_pop(v).over(prev)
    med, iqr_prev = q(0.5, prev), q(0.75, prev) - q(0.25, prev)
    values = F.collect_list(v).over(here)
    med_here = q(0.5, here)
    dev = F.array_sort(F.transform(values, lambda x: F.abs(x - med_here)))
    size = F.size(dev)
    mad = (F.get(dev, F.floor((size - 1) / 2).cast("int")) + F.get(dev, F.floor(size / 2).cast("int"))) / 2
    values_prev = F.collect_list(v).over(prev)
    dev_prev = F.array_sort(F.transform(values_prev, lambda x: F.abs(x - med)))
    size_prev = F.size(dev_prev)
    mad_prev = (F.get(dev_prev, F.floor((size_prev - 1) / 2).cast("int")) + F.get(dev_prev, F.floor(size_prev / 2).cast("int"))) / 2
    fence = 1.5 * iqr_prev
    side = F.when(v >= q(0.75, prev) + fence, 1.0).when(v < q(0.25, prev) - fence, -1.0).otherwise(0.0)
    return {
        "iqr": full(q(0.75, here) - q(0.25, here), n, v),
        "mad": full(mad, n, v),
        "z_score": F.when(enough, F.when(sd == 0, 0.0).otherwise(divide(v - mean, sd))),
        "modified_z_mad": F.when(enough, F.coalesce(divide(v - med, mad_prev), F.lit(0.0))),
        "modified_z_iqr": F.when(enough, F.coalesce(divide(v - med, iqr_prev), F.lit(0.0))),
        "iqr_median_deviation": F.when(enough, side * F.coalesce(divide(F.abs(v - med), med), F.lit(0.0))),
    }
