"""Readers and writers, and the series that the star-schema tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import ID, TS, VALUE, from_frame


def read_series(spark: SparkSession, path: str, fmt: str = "csv", time: str = "time", values=None, key=None, **options) -> DataFrame:
    """Series from csv, json, parquet, orc or any other Spark source."""
    o = {"header": True, "inferSchema": True} | options if fmt == "csv" else options
    return from_frame(spark.read.format(fmt).options(**o).load(path), time, values, key)


def write_series(series: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Sorted by series and time within files, spread by series, so that one series' rows lie together."""
    series.repartition(ID).sortWithinPartitions(ID, TS).write.format(fmt).options(**({"header": True} if fmt == "csv" else {})).mode(mode).save(path)


def _sum(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    """Mean event value by event type and hour."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy(F.col("event_type").alias(ID), F.date_trunc("hour", "ts").alias(TS)).agg((_sum("value") / F.count("value")).alias(VALUE))


def daily_events(spark: SparkSession, sf: str) -> DataFrame:
    """Number of events by type and day."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.groupBy(F.col("event_type").alias(ID), F.date_trunc("day", "ts").alias(TS)).agg(F.count("*").cast("double").alias(VALUE))


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Order value in thousands by priority and day."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.groupBy(F.col("o_orderpriority").alias(ID), F.date_trunc("day", "o_orderdate").alias(TS)).agg((_sum("o_totalprice") / 1000).alias(VALUE))


def monthly_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity by return flag and month."""
    i = spark.read.parquet(f"{sf}/lineitem.parquet")
    return i.groupBy(F.col("l_returnflag").alias(ID), F.date_trunc("month", "l_shipdate").alias(TS)).agg(_sum("l_quantity").alias(VALUE))


def naive_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Daily orders with yesterday's value as forecast and a band of 20 % around it."""
    from pyspark.sql import Window

    f = F.lag(VALUE).over(Window.partitionBy(ID).orderBy(TS))
    return daily_orders(spark, sf).select(ID, TS, F.col(VALUE).alias("y"), f.alias("fcst"), (f * 0.8).alias("fcst_lower"), (f * 1.2).alias("fcst_upper")).where("fcst is not null")


def two_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly quantities of return flags A and R as a two-sample table."""
    i = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_returnflag in ('A', 'R')")
    q = F.col("l_quantity").cast("decimal(18,2)")
    m = i.groupBy(F.date_trunc("month", "l_shipdate").alias(TS)).agg(
        *[c.alias(f"{n}_{x}") for x, flag in (("a", "A"), ("b", "R")) for n, c in (("n", F.count_if(F.col("l_returnflag") == flag)), ("s", F.sum(F.when(F.col("l_returnflag") == flag, q)).cast("double")), ("q", F.sum(F.when(F.col("l_returnflag") == flag, q * q)).cast("double")))]
    )
    m = m.where("n_a > 1 and n_b > 1")
    pick = lambda x: [(F.col(f"s_{x}") / F.col(f"n_{x}")).alias(f"value_{x}"), ((F.col(f"q_{x}") - F.col(f"s_{x}") * F.col(f"s_{x}") / F.col(f"n_{x}")) / (F.col(f"n_{x}") - 1)).alias(f"variance_{x}"), F.col(f"n_{x}").alias(f"sample_count_{x}")]
    return m.select(F.lit("A/R").alias(ID), TS, *pick("a"), *pick("b"), F.lit(0.0).alias("effect_size"))
