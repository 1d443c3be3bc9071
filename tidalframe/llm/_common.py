"""Shared helpers: stage tables in the shared folder, components, near fingerprints."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, a local one if Spark is local too, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "tidalframe-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame | list[DataFrame], name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here. Of a list, one after the other goes to the same table, when the shuffles of the one before are gone."""
    parts = [df] if isinstance(df, DataFrame) else df
    spark = parts[0].sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # nothing reads the shuffles of a written table again
    try:
        for part in parts:
            part.write.mode("append").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(parts[0].schema).parquet(path)
    out._stage_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes the table of a stage() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stage_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v: any orderable type); returns (node, root), root the smallest node.

    Alternates large-star and small-star steps, each a partial aggregation and an
    equi-join, until the edges are stars. Edges never reach the driver; each
    round is a written table, so lost executors repeat one round only. unstage()
    deletes the last one when the result has been read.
    """
    now = stage(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        # large star: the larger neighbours of u, at the least of u and its neighbours
        both = now.union(now.select("v", "u"))
        # "when" hides from the planner that the sums lie where the edges do: with an exchange of its own, the join can split a hub's edges
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.when(F.col("m").isNotNull(), F.col("u")).alias("n"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["n"]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u's smaller neighbours and u itself, at the least of them
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.when(F.col("m").isNotNull(), F.col("u")).alias("n"), "m")
        small = large.join(low, large["u"] == low["n"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = stage(small, "edges")
        a, b = (x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, after))
        unstage(now)
        now = after
        if a == b:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
            out._stage_path = now._stage_path
            return out
    raise RuntimeError("components did not converge")


def forest(codes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """Spanning stars of the graph that joins codes (distinct uint64) at ``most`` or fewer differing bits.

    A search that compares each reached code with those not reached yet only, so
    that a dense group costs little more than its size.
    """
    left = codes
    while left.size > 1:
        root, left = left[0], left[1:]
        todo, got = [root], []
        while todo and left.size:
            near = np.bitwise_count(left ^ todo.pop()) <= most
            if near.any():
                new = left[near]
                left = left[~near]
                todo.extend(new)
                got.append(new)
        if got:
            yield np.concatenate(got), root


def masks(blocks: int, most: int) -> np.ndarray:
    """Of 64 bits in equal blocks, each choice of blocks - most: ``most`` differing bits leave one choice equal."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]
    return np.array([sum(c) for c in combinations(bits, blocks - most)], dtype=np.uint64)


def pigeonhole_keys(codes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, code): a hash of each choice of bits. With masks(), codes at ``most`` or fewer differing bits share one at least."""
    c = codes.view(np.uint64)
    key = (c[:, None] & chosen) + np.arange(len(chosen), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    return key.ravel().view(np.int64), np.repeat(codes, len(chosen))


def runs(batches: Iterable[pa.RecordBatch], key: str, value: str, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(values, run starts) of the keys that hold two or more values; input sorted by key; a run may cross batches.

    The values of a key above ``limit`` come as (values, None), a stretch at a
    time, so that no more than about that many are held.
    """
    key_now, held, over = None, [], False  # the last key so far and its values, which may go on in the next batch
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        v = b.column(value).to_numpy(zero_copy_only=False)
        if held and k[0] == k[-1] == key_now:
            held.append(v)
        else:
            if held:
                if over:
                    n = int(np.searchsorted(k, key_now, side="right"))
                    yield np.concatenate([*held, v[:n]]), None
                    k, v, over = k[n:], v[n:], False
                else:
                    old = np.concatenate(held)
                    k, v = np.concatenate([np.full(old.size, key_now), k]), np.concatenate([old, v])
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            last = starts[-1]
            key_now, held = k[last], [v[last:]]
            if last:
                yield v[:last], starts[:-1]
        if limit is not None and sum(x.size for x in held) > limit:
            yield np.concatenate(held), None
            held, over = [np.empty(0, np.int64)], True
    if held:
        yield np.concatenate(held), None if over else np.zeros(1, dtype=np.int64)


DENSE_KEY = 1 << 17  # codes of one key that a task compares at once


def near_codes(keyed: DataFrame, most: int, limit: int | None = None) -> DataFrame:
    """(u, v) bigint: for each key the spanning stars of its codes at ``most`` or fewer differing bits.

    keyed: (key bigint, code bigint). Codes that share no key are not compared.
    One shuffle; each task streams sorted keys. A key above ``limit`` codes
    (DENSE_KEY) is not searched by its task: its codes are given longer keys, all
    choices of 9 - most of 9 blocks, which find every pair at ``most`` bits, and
    meet in a second pass over many tasks. The result is a written table.
    """
    limit = DENSE_KEY if limit is None else limit

    def matching(most_codes):
        def match(batches):
            for v, starts in runs(batches, "key", "code", most_codes):
                codes = v.view(np.uint64)
                us, vs, none = [], [], None
                if starts is None:
                    u = np.unique(v)
                    none = np.ones(u.size, bool)
                    both = np.stack([u, u], 1)
                else:
                    ends = np.append(starts[1:], codes.size)
                    size = ends - starts
                    pair = starts[size == 2]  # most keys with company have two codes
                    a, b = codes[pair], codes[pair + 1] if pair.size else codes[pair]
                    ok = (np.bitwise_count(a ^ b) <= most) & (a != b)
                    us.append(a[ok])
                    vs.append(b[ok])
                    for s, e in zip(starts[size > 2], ends[size > 2]):
                        for got, root in forest(np.unique(codes[s:e]), most):
                            us.append(got)
                            vs.append(np.full(got.size, root))
                    both = np.stack([np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)], 1)
                    both = np.unique(both, axis=0) if len(both) else both
                for at in range(0, len(both), 65536):
                    part = both[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1], mask=None if none is None else none[at : at + 65536])], ["u", "v"])

        return match

    def meet(rows, most_codes):
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(matching(most_codes), "u bigint, v bigint").distinct()

    found = stage(meet(keyed, limit), "links")
    links = found.where("v is not null")
    if found.where("v is null").isEmpty():
        return links
    chosen = masks(9, most)

    def longer(batches):
        for b in batches:
            codes = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(codes), 2048):
                k, c = pigeonhole_keys(codes[at : at + 2048], chosen)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["key", "code"])

    return links.union(meet(found.where("v is null").select("u").mapInArrow(longer, "key bigint, code bigint"), None))


def training_rows(docs: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label) of a bounded sample of rows outside the held-out quarter.

    Rows whose crc32(doc_id as text) mod 4 is 2, or without a label, never count.
    Labels are counted first; each then gives about ``most`` rows, those of the
    least hashes of doc_id.
    """
    known = docs.where(F.col(label).isNotNull() & F.expr("crc32(cast(doc_id as string)) % 4 <> 2"))
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    return known.where(sampled(counts, label, most)).select(F.col("text").cast("string").alias("text"), F.col(label).alias("label"))


def sampled(counts: dict, label: str, most: int):
    """Column: whether a row is among the about ``most`` of its label with the least hashes of doc_id."""
    bound = F.lit(0)
    for k, n in sorted(counts.items()):
        bound = F.when(F.col(label) == F.lit(k), F.lit(int(min(1.0, most / n) * 2**31))).otherwise(bound)
    return F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(2**31)) < bound
