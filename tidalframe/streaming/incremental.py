"""Incremental scoring on Structured Streaming: windowed aggregates and state kept by series."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.series import ID, TS, VALUE


def read_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """A stream over files; the schema is that of the files there, unless given."""
    schema = schema or spark.read.format(fmt).options(**options).load(path).schema
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def tumbling(stream: DataFrame, width: str, watermark: str, keys: list[str], time: str = TS, **aggregates) -> DataFrame:
    """Aggregates by key and window of ``width``; rows later than the watermark are dropped."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)
    g = timed.groupBy(F.window(time, width).alias("w"), *keys)
    return g.agg(*[c.alias(n) for n, c in aggregates.items()]).select(*keys, F.col("w.start").alias(TS), *aggregates)


def stateful(stream: DataFrame, step: Callable[[list, np.ndarray, np.ndarray], tuple[list, list[tuple]]], schema: str, watermark: str = "1 day") -> DataFrame:
    """Rows of step(state, times, values) -> (state, rows) for the new points of each series.

    state is a list of floats kept between triggers, empty at first; points of a
    trigger come in time order. Rows later than the watermark are dropped.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames)).dropna(subset=[VALUE]).sort_values([TS, VALUE])
        had = list(state.get[0]) if state.exists else []
        now, rows = step(had, f[TS].to_numpy(), f[VALUE].to_numpy(float))
        state.update(([float(x) for x in now],))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=[ID, *names])

    timed = stream.select(F.col(ID).cast("string").alias(ID), F.col(TS).cast("timestamp").alias(TS), F.col(VALUE).cast("double").alias(VALUE)).withWatermark(TS, watermark)
    return timed.groupBy(ID).applyInPandasWithState(run, f"{ID} string, {schema}", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def rolling_z(n: int):
    """z score of each point against the n before it; 0 until there are n."""

    def step(kept, times, values):
        rows = []
        for t, v in zip(times, values):
            w = np.array(kept[-n:])
            sd = w.std() if len(w) >= n else 0.0
            rows.append((t, v, float((v - w.mean()) / sd) if sd > 0 else 0.0))
            kept = [*kept[-(n - 1) :], v] if n > 1 else [v]
        return kept, rows

    return step, "ts timestamp, value double, score double"


def page_cusum(target: float, slack: float, limit: float):
    """Two-sided cumulative sums about a target; alerts above the limit and starts anew."""

    def step(kept, times, values):
        up, down = kept or (0.0, 0.0)
        rows = []
        for t, v in zip(times, values):
            up, down = max(0.0, up + v - target - slack), max(0.0, down + target - v - slack)
            alert = up > limit or down > limit
            rows.append((t, v, max(up, down), alert))
            if alert:
                up = down = 0.0
        return [up, down], rows

    return step, "ts timestamp, value double, score double, alert boolean"


def two_sample(n_control: int, n_test: int):
    """t score of the last n_test points against the n_control before them; 0 until there are enough."""

    def step(kept, times, values):
        rows = []
        for t, v in zip(times, values):
            kept = [*kept[-(n_control + n_test - 1) :], v]
            score = 0.0
            if len(kept) == n_control + n_test:
                a, b = np.array(kept[:n_control]), np.array(kept[n_control:])
                pooled = np.sqrt((a.var() * n_control + b.var() * n_test) / (n_control + n_test - 2)) * np.sqrt(1 / n_control + 1 / n_test)
                score = float((b.mean() - a.mean()) / pooled) if pooled > 0 else 0.0
            rows.append((t, v, score))
        return kept, rows

    return step, "ts timestamp, value double, score double"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); where it is unset, a local one if Spark is local too, else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + os.path.join(tempfile.gettempdir(), "tidalframe-shared")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all there is and returns what it wrote; complete mode keeps the last result."""
    spark = stream.sparkSession
    base = checkpoint or scratch(spark, "stream")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
