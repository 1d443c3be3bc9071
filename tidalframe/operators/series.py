"""Series algebra on long frames: series_id, ts, value (one row a point)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataError, IrregularGranularityError, ParameterError

ID, TS, VALUE = "series_id", "ts", "value"


def ordered(*keys: str) -> Window:
    """Window over each series in time order."""
    return Window.partitionBy(*(keys or (ID,))).orderBy(TS)


def clean(v: Column | str) -> Column:
    """NaN as null, as double: Spark's aggregates skip null, but not NaN."""
    v = (F.col(v) if isinstance(v, str) else v).cast("double")
    return F.when(~F.isnan(v), v)


def from_frame(
    df: DataFrame,
    time: str = "time",
    values: Sequence[str] | None = None,
    key: str | Column | None = None,
    date_format: str | None = None,
    unix_unit: str | None = None,
    tz: str | None = None,
    drop_duplicate_time: bool = False,
    order: str | None = None,
) -> DataFrame:
    """Wide rows (one time column, numeric value columns) as (series_id, ts, value).

    Each value column becomes a series, named by the column, or ``key/column``
    where a key is given. ``drop_duplicate_time`` keeps the first row, by
    ``order`` (else the least value), of each time. tz reads local times of a zone.
    """
    t = F.col(time)
    if unix_unit:
        t = {"s": lambda c: F.timestamp_seconds(c), "ms": lambda c: F.timestamp_millis(c.cast("bigint")), "us": lambda c: F.timestamp_micros(c.cast("bigint")), "ns": lambda c: F.timestamp_micros(F.floor(c / 1000).cast("bigint"))}[unix_unit](t)
    elif dict(df.dtypes)[time] == "string":
        t = F.to_timestamp(t, date_format) if date_format else F.to_timestamp(t)
    else:
        t = t.cast("timestamp")
    if tz:
        t = F.to_utc_timestamp(t, tz)
    taken = {time, key if isinstance(key, str) else None, order}
    values = list(values or [c for c in df.columns if c not in taken])
    bad = [c for c in values if dict(df.dtypes)[c] not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not dict(df.dtypes)[c].startswith("decimal")]
    if bad:
        raise DataError(f"value columns must be numeric: {bad}")
    key_col = F.col(key) if isinstance(key, str) else key
    one = len(values) == 1 and key_col is not None
    pairs = F.array(*[F.struct((key_col.cast("string") if one else F.concat_ws("/", *([key_col.cast("string")] if key_col is not None else []), F.lit(c))).alias(ID), clean(c).alias(VALUE)) for c in values])
    out = df.select(t.alias(TS), (F.col(order) if order else F.lit(0)).alias("_o"), F.explode(pairs).alias("p")).select("p." + ID, TS, "p." + VALUE, "_o")
    if drop_duplicate_time:
        w = Window.partitionBy(ID, TS).orderBy("_o", VALUE)
        out = out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out.drop("_o")


def to_wide(series: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row a time, one column for each named series; names are given, so no job looks for them."""
    return series.groupBy(TS).agg(*[F.max(F.when(F.col(ID) == n, F.col(VALUE))).alias(n) for n in names])


def to_arrays(series: DataFrame) -> DataFrame:
    """(series_id, ts array, values array), in time order."""
    points = F.array_sort(F.collect_list(F.struct(TS, VALUE)))
    return series.groupBy(ID).agg(points.alias("p")).select(ID, F.transform("p", lambda x: x[TS]).alias(TS), F.transform("p", lambda x: x[VALUE]).alias("values"))


def slice_rows(series: DataFrame, start: int, stop: int) -> DataFrame:
    """Points of positions start to stop - 1, negative from the end, of each series."""
    out = series.withColumn("_n", F.row_number().over(ordered()) - 1)
    if start < 0 or stop < 0:
        out = out.withColumn("_k", F.count("*").over(Window.partitionBy(ID)))
    at = lambda i: F.lit(i) if i >= 0 else F.col("_k") + i
    return out.where((F.col("_n") >= at(start)) & (F.col("_n") < at(stop))).select(series.columns)


def exclude(series: DataFrame, start: str, end: str) -> DataFrame:
    """Without the points of the closed range."""
    return series.where(~F.col(TS).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def extend(a: DataFrame, b: DataFrame, validate: bool = False) -> DataFrame:
    """Both frames' points; validate fails if a series' steps then differ."""
    out = a.unionByName(b, allowMissingColumns=True)
    if validate and (bad := is_missing(out).where("missing").limit(5).collect()):
        raise IrregularGranularityError(f"steps differ in {[r[0] for r in bad]}")
    return out


def divide(a: Column, b: Column) -> Column:
    """a / b; null where b is zero."""
    return F.try_divide(a, b)


def combine(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Aligned arithmetic (add, sub, mul, div): a full outer join on series and time; a point that one side lacks has no value."""
    other = b.select(F.col(ID).alias("_id"), F.col(TS).alias("_ts"), F.col(VALUE).alias("_v"))
    j = a.join(other, (F.col(ID) == F.col("_id")) & (F.col(TS) == F.col("_ts")), "full_outer")
    x, y = F.col(VALUE), F.col("_v")
    v = {"add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "div": lambda: divide(x, y)}[op]()
    return j.select(F.coalesce(ID, "_id").alias(ID), F.coalesce(TS, "_ts").alias(TS), v.alias(VALUE))


def combine_scalar(series: DataFrame, op: str, number: float) -> DataFrame:
    """Arithmetic (add, sub, mul, div) of every value with one number; null where it would divide by zero."""
    v, n = F.col(VALUE), F.lit(float(number))
    return series.select(ID, TS, {"add": lambda: v + n, "sub": lambda: v - n, "mul": lambda: v * n, "div": lambda: divide(v, n)}[op]().alias(VALUE))


def melt(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(series_id, ts, variable, value): one row for each of the columns of a wide frame."""
    return frame.unpivot([ID, TS], columns, "variable", VALUE)


def same(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """(series_id, differing): rows of either side without an equal, values rounded, on the other."""
    r = lambda d: d.select(ID, TS, F.round(VALUE, digits).alias(VALUE))
    return r(a).exceptAll(r(b)).unionAll(r(b).exceptAll(r(a))).groupBy(ID).agg(F.count("*").alias("differing"))


def summary(series: DataFrame) -> DataFrame:
    """(series_id, n, n_missing, min, max, first_ts, last_ts)."""
    return series.groupBy(ID).agg(F.count("*").alias("n"), F.count_if(F.col(VALUE).isNull()).alias("n_missing"), F.min(VALUE).alias("min"), F.max(VALUE).alias("max"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"))


def _deltas(series: DataFrame) -> DataFrame:
    return series.select(ID, (F.unix_micros(TS) - F.unix_micros(F.lag(TS).over(ordered()))).alias("d"), F.months_between(TS, F.lag(TS).over(ordered())).alias("m")).where("d is not null")


def infer_frequency(series: DataFrame) -> DataFrame:
    """(series_id, freq_seconds): the most frequent step, the smallest among ties."""
    return _deltas(series).groupBy(ID, "d").count().groupBy(ID).agg((F.max_by("d", F.struct("count", -F.col("d"))) / 1e6).alias("freq_seconds"))


def is_missing(series: DataFrame) -> DataFrame:
    """(series_id, missing): whether steps differ, calendar months not counting as different; never below three points."""
    calendar = (F.min("m") == F.max("m")) & (F.min("m") >= 1) & (F.min("m") == F.floor(F.min("m")))
    return _deltas(series).groupBy(ID).agg(((F.count("*") >= 2) & (F.min("d") != F.max("d")) & ~calendar).alias("missing"))


def grid(series: DataFrame, step: str) -> DataFrame:
    """(series_id, ts): every step from the first to the last time of each series, anchored at midnight of the first day."""
    ends = series.groupBy(ID).agg(F.min(TS).alias("a"), F.max(TS).alias("b"))
    s = F.expr(f"interval {step}")
    points = ends.select(ID, "a", F.explode(F.sequence(F.date_trunc("day", "a"), "b", s)).alias(TS))
    return points.where(F.col(TS) > F.expr(f"a - interval {step}")).select(ID, TS)


def interpolate(series: DataFrame, step: str, method: str = "linear") -> DataFrame:
    """Values on the grid of ``step``: linear in time between neighbours, ffill or bfill. Points off the grid count as neighbours only."""
    g = grid(series, step).withColumn("_grid", F.lit(True))
    have = series.where(F.col(VALUE).isNotNull()).select(F.col(ID).alias("_id"), F.col(TS).alias("_ts"), VALUE)
    j = g.join(have, (F.col(ID) == F.col("_id")) & (F.col(TS) == F.col("_ts")), "full_outer").select(F.coalesce(ID, "_id").alias(ID), F.coalesce(TS, "_ts").alias(TS), VALUE, F.coalesce("_grid", F.lit(False)).alias("_grid"))
    back = ordered().rowsBetween(Window.unboundedPreceding, 0)
    ahead = ordered().rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col(VALUE).isNotNull(), F.struct(F.unix_micros(TS).alias("t"), F.col(VALUE).alias("v")))
    j = j.withColumn("_p", F.last(point, ignorenulls=True).over(back)).withColumn("_n", F.first(point, ignorenulls=True).over(ahead))
    p, n, t = F.col("_p"), F.col("_n"), F.unix_micros(TS)
    between = p["v"] + (n["v"] - p["v"]) * divide((t - p["t"]).cast("double"), (n["t"] - p["t"]).cast("double"))
    v = {"ffill": p["v"], "bfill": n["v"], "linear": F.when(p["t"] == n["t"], p["v"]).when(n.isNull(), p["v"]).otherwise(between)}[method]
    return j.where("_grid").select(ID, TS, v.alias(VALUE))


def set_timezone(series: DataFrame, tz: str) -> DataFrame:
    """Times read as local times of tz, in UTC."""
    return series.withColumn(TS, F.to_utc_timestamp(TS, tz))


def convert_timezone(series: DataFrame, tz: str) -> DataFrame:
    return series.withColumn(TS, F.from_utc_timestamp(TS, tz))


def remove_outliers(series: DataFrame, flagged: DataFrame, step: str | None = None) -> DataFrame:
    """Without the values at the flagged (series_id, ts); interpolated on the grid of ``step`` if given."""
    f = flagged.select(F.col(ID).alias("_id"), F.col(TS).alias("_ts")).distinct()
    cut = series.join(f, (F.col(ID) == F.col("_id")) & (F.col(TS) == F.col("_ts")), "left").select(ID, TS, F.when(F.col("_id").isNull(), F.col(VALUE)).alias(VALUE))
    return interpolate(cut, step) if step else cut


def rename_by_prefix(df: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Renames the one column of each prefix; none or several are an error."""
    names = {}
    for prefix, new in prefixes.items():
        hit = [c for c in df.columns if c.startswith(prefix)]
        if len(hit) != 1:
            raise ParameterError(f"prefix {prefix!r} matches {hit}")
        names[hit[0]] = new
    return df.withColumnsRenamed(names)


def aggregate_level(series: DataFrame, k: int) -> DataFrame:
    """Sums of k points each, aligned to the end: the oldest remainder goes; stamped with the last time."""
    n = F.row_number().over(Window.partitionBy(ID).orderBy(F.col(TS).desc())) - 1
    b = series.withColumn("_b", F.floor(n / k))
    return b.groupBy(ID, "_b").agg(F.max(TS).alias(TS), F.sum(VALUE).alias(VALUE), F.count("*").alias("_c")).where(F.col("_c") == k).select(ID, TS, VALUE)


def pad_front(series: DataFrame, step: str, n: int) -> DataFrame:
    """n more points, of the first value, before each series."""
    first = series.groupBy(ID).agg(F.min(TS).alias("a"), F.min_by(VALUE, TS).alias(VALUE))
    extra = first.select(ID, F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.expr("a") - i * F.expr(f"interval {step}"))).alias(TS), VALUE)
    return series.select(ID, TS, VALUE).unionByName(extra)


def last_n(series: DataFrame, n: int) -> DataFrame:
    """The n latest points of each series."""
    r = F.row_number().over(Window.partitionBy(ID).orderBy(F.col(TS).desc()))
    return series.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def fill_missing(series: DataFrame, step: str) -> DataFrame:
    """Every grid time, without a value where there was none."""
    have = series.select(F.col(ID).alias("_id"), F.col(TS).alias("_ts"), VALUE)
    return grid(series, step).join(have, (F.col(ID) == F.col("_id")) & (F.col(TS) == F.col("_ts")), "left").select(ID, TS, VALUE)


def normalize(series: DataFrame, by: str = "mean", how: str = "div", least: float = 1e-8) -> DataFrame:
    """Values less (sub), over (div) or less and over (sub_div: z) a statistic of their series, kept in ``center`` and ``scale``."""
    e = Window.partitionBy(ID)
    stat = {"mean": F.avg(VALUE), "median": F.percentile(VALUE, F.lit(0.5)), "max": F.max(VALUE), "std": F.stddev_pop(VALUE)}
    center = stat["mean"].over(e) if how == "sub_div" else stat[by].over(e) if how == "sub" else F.lit(0.0)
    scale = F.lit(1.0) if how == "sub" else (stat["std"] if how == "sub_div" else stat[by]).over(e)
    s = series.withColumn("center", center).withColumn("scale", F.when(F.abs(scale) < least, F.lit(least)).otherwise(scale))
    return s.withColumn(VALUE, (F.col(VALUE) - F.col("center")) / F.col("scale"))


def denormalize(frame: DataFrame, column: str = VALUE) -> DataFrame:
    return frame.withColumn(column, F.col(column) * F.col("scale") + F.col("center")).drop("center", "scale")


def first_missing(numbers: DataFrame, column: str) -> DataFrame:
    """(first_missing): the least whole number from 0 on that the column lacks."""
    n = numbers.select(F.col(column).cast("bigint").alias("v")).where("v >= 0").distinct()
    ahead = n.select((F.col("v") + 1).alias("v")).unionAll(n.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("v")))
    return ahead.join(n, "v", "left_anti").agg(F.min("v").alias("first_missing"))
