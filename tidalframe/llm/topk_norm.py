"""Exact top-k inner-product search with norm buckets and local cosine thresholds.

The table is dealt out once by length and written in that order, in buckets of
BUCKET_ROWS rows of like length. Queries get first thresholds from the longest
vectors; those that need like lengths form a block, and a block reads no bucket
that is too short for all of its queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stage, unstage

QUERY_BLOCK = 1 << 13  # queries sent to the tasks at once: a bound, not a cap; further blocks follow
SEED_ROWS = 1024  # longest vectors, from which the first thresholds come
BUCKET_ROWS = 1 << 9
COORDINATE_FROM = 0.6  # local cosine threshold from which coordinates prune better than lengths
FOCUS = 3
GROUP = 256  # queries of like thresholds that are pruned together
_SLACK = 1 + 1e-9


def _ints(values: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * values.astype(np.float64))


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """q @ p.T of whole numbers, exact: BLAS while sums stay below 2^53, else Python's integers."""
    if q.size == 0 or p.size == 0:
        return np.zeros((len(q), len(p)), dtype=np.int64)
    if float(np.abs(q).max()) * float(np.abs(p).max()) * q.shape[1] < 2.0**53:
        return (q @ p.T).astype(np.int64)
    big = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object)
    return np.clip(big(q) @ big(p).T, -(2**63), 2**63 - 1).astype(np.int64)


class _Best:
    """The k best (score, id) of each query so far, and the score to reach."""

    def __init__(self, theta: np.ndarray, k: int):
        self.theta, self.k, self.held, self.count = theta.copy(), k, [], 0

    def add(self, q, score, ids):
        if q.size:
            self.held.append((q, score, ids))
            self.count += q.size
            if self.count > 50 * self.k * len(self.theta) + 100_000:
                self.squeeze()

    def squeeze(self):
        if not self.held:
            return (np.empty(0, np.int64),) * 3
        q, s, i = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, q)
        at = np.arange(q.size) - first
        keep = at < self.k
        full = at == self.k - 1
        self.theta[q[full]] = np.maximum(self.theta[q[full]], s[full])
        self.held = [(q[keep], s[keep], i[keep])]
        self.count = int(keep.sum())
        return self.held[0]


def needs(theta: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The length from which a vector can reach each query's score; -1 where any may."""
    return np.where((theta > 0) & (length > 0), theta / np.where(length > 0, length, 1) / _SLACK, -1.0)


def _scan(best: _Best, q: np.ndarray, qid: np.ndarray, b: np.ndarray, bid: np.ndarray, bn: np.ndarray) -> None:
    """Brings one bucket into best: rows b with ids bid and lengths bn, longest first."""
    qn = np.sqrt((q * q).sum(1))
    best.squeeze()
    reach = qn * bn[0] * _SLACK
    local = np.where(best.theta > 0, best.theta / np.where(reach > 0, reach, 1e-30), np.where(best.theta < 0, -1.0, 0.0))
    live = np.flatnonzero(local <= 1)  # by Cauchy-Schwarz no row of the bucket helps the others
    live = live[np.argsort(-local[live], kind="stable")]
    split = int(np.searchsorted(-local[live], -COORDINATE_FROM, side="right")) if q.shape[1] > FOCUS and bn[0] > 0 else 0
    for at in range(split, len(live), GROUP):  # by length: rows as long as the least demanding of the group asks for
        g = live[at : at + GROUP]
        need = needs(best.theta[g], qn[g]).min()
        n = int(np.searchsorted(-bn, -need, side="right")) if need > 0 else len(b)
        if n:
            s = _products(q[g], b[:n])
            x, y = np.nonzero((s >= best.theta[g, None]) & (qid[g, None] != bid[None, :n]))
            best.add(g[x], s[x, y], bid[y])
    if split:
        unit_b = b / np.where(bn > 0, bn, 1)[:, None]
        for at in range(0, split, GROUP):
            g = live[at : min(split, at + GROUP)]
            unit_q = q[g] / np.where(qn[g] > 0, qn[g], 1)[:, None]
            focus = np.argsort(-np.abs(unit_q), axis=1)[:, :FOCUS]
            t = np.clip(local[g] / _SLACK**2, 0, 1)[:, None]
            ok = np.ones((len(g), len(b)), dtype=bool)
            for f in range(FOCUS):  # where a row's coordinate must lie for its cosine to reach t
                c = focus[:, f]
                u = unit_q[np.arange(len(g)), c][:, None]
                mid, half = u * t, np.sqrt((1 - t * t) * np.maximum(0, 1 - u * u)) + 1e-7
                v = unit_b[:, c].T
                ok &= (v >= mid - half) | (u < -t)
                ok &= (v <= mid + half) | (u > t)
            rows = np.flatnonzero(ok.any(0))
            if rows.size:
                s = _products(q[g], b[rows])
                x, y = np.nonzero(ok[:, rows] & (s >= best.theta[g, None]) & (qid[g, None] != bid[rows][None]))
                best.add(g[x], s[x, y], bid[rows[y]])


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(x), F.lit(True)))
    )


def _by_dimension(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (rows, matrix) of a list<double> column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(size)
    out = {}
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        at = (ends[rows] - d)[:, None] + np.arange(d)
        out[int(d)] = rows, flat[at].reshape(len(rows), d)
    return out


def _length(column: str):
    """Length of the whole-number vector of an array<double> column."""
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + F.floor(x * 256).cast("double") * F.floor(x * 256).cast("double")))


def in_buckets(vectors: DataFrame) -> DataFrame:
    """The usable vectors as a written table (bucket, length, vec_id, embedding), dealt out and sorted by length, longest first."""
    rows = _usable(vectors).withColumn("length", _length("embedding"))
    rows = rows.repartitionByRange(F.col("length").desc(), "vec_id").sortWithinPartitions(F.col("length").desc(), "vec_id")
    return stage(rows.select(F.shiftright(F.monotonically_increasing_id(), 9).alias("bucket"), "length", "vec_id", "embedding"), "buckets")


def norm_bucket_topk(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products over vectors of its dimension.

    Both tables hold vec_id and embedding; components count as floor(256 * x).
    A row never matches a query of its own vec_id. Ties go to the smaller vec_id.

    Vectors are shuffled once, by length, into buckets over the whole table
    (in_buckets). A query's score to reach, from the SEED_ROWS longest vectors at
    first, over its length is the length that it needs; queries in order of that
    length form blocks of QUERY_BLOCK, and a block's scan starts with a filter on
    length, so that shorter buckets aren't read. Within a bucket, the score to
    reach over the query's length and the bucket's largest is the local cosine
    threshold: above 1 the bucket is passed over, from ``COORDINATE_FROM`` on the
    query's largest coordinates bound where a row's may lie, else lengths prune;
    queries of like thresholds are pruned together, and what is left is
    multiplied out exactly. Tasks return k rows a query.

    Null ids, null vectors and vectors holding null or non-finite components
    take no part. Repeated rows of vectors each count; repeated query ids count
    once (the least vector). Fewer than k candidates: all. Empty tables: no rows.
    Very long vectors are whole rows of a batch. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pool = in_buckets(vectors)
    seeds = pool.orderBy(F.col("length").desc(), "vec_id").limit(SEED_ROWS).select("vec_id", "embedding").toArrow()
    seeds = {d: (_ints(m), seeds.column("vec_id").to_numpy()[rows]) for d, (rows, m) in _by_dimension(seeds.column("embedding")).items()} if seeds.num_rows else {}

    def thresholds(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            theta, need = np.full(len(ids), -np.inf), np.full(len(ids), -1.0)
            for d, (rows, m) in _by_dimension(b.column(1)).items():
                if d in seeds:
                    s, sid = seeds[d]
                    best = _Best(np.full(len(rows), -np.inf), k)
                    for at in range(0, len(s), BUCKET_ROWS):
                        part = s[at : at + BUCKET_ROWS]
                        _scan(best, _ints(m), ids[rows], part, sid[at : at + BUCKET_ROWS], np.sqrt((part * part).sum(1)))
                    best.squeeze()
                    theta[rows], need[rows] = best.theta, needs(best.theta, np.sqrt((_ints(m) ** 2).sum(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(theta), pa.array(need)], ["vec_id", "embedding", "theta", "need"])

    asked = _usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).mapInArrow(thresholds, "vec_id bigint, embedding array<double>, theta double, need double")
    asked = asked.repartitionByRange(F.col("need").desc(), "vec_id").sortWithinPartitions(F.col("need").desc(), "vec_id")
    asked = stage(asked.select(F.floor(F.monotonically_increasing_id() / QUERY_BLOCK).alias("block"), "vec_id", "embedding", "theta", "need"), "queries")
    blocks = asked.groupBy("block").agg(F.count("*").alias("n"), F.min("need").alias("need")).orderBy(F.col("need").desc(), "block").collect()
    joined, size = [], 0  # blocks that range partitions have left small go together
    for r in blocks:
        if not joined or size + r.n > QUERY_BLOCK:
            joined.append([])
            size = 0
        joined[-1].append(r)
        size += r.n
    results = []
    for part in joined:
        got = asked.where(F.col("block").isin([r.block for r in part])).toArrow()
        ask = {d: (got.column("vec_id").to_numpy()[rows], _ints(m), got.column("theta").to_numpy()[rows]) for d, (rows, m) in _by_dimension(got.column("embedding")).items()}
        results.append(_pass(pool, ask, k, min(r.need for r in part)))
    if len(results) > 1:
        results = [stage(r, "topk") for r in results]
        unstage(pool)
    unstage(asked)
    if not results:
        unstage(pool)
        return empty
    out = results[0]
    for r in results[1:]:
        out = out.union(r)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", "copy")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(pool: DataFrame, ask: dict, k: int, need: float) -> DataFrame:
    """The k best of each query in each task, over the buckets of vectors of length ``need`` or more."""

    def run(batches):
        best = {d: _Best(theta, k) for d, (_, _, theta) in ask.items()}
        for b in batches:
            bucket, length, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
            for at, end in zip(starts, [*starts[1:], len(bucket)]):
                for d, (rows, m) in _by_dimension(b.column(3).slice(at, end - at)).items():
                    if d in ask:
                        qid, q, _ = ask[d]
                        _scan(best[d], q, qid, _ints(m), ids[at:end][rows], length[at:end][rows])
        for d, have in best.items():
            q, s, i = have.squeeze()
            if q.size:
                yield pa.RecordBatch.from_arrays([pa.array(ask[d][0][q]), pa.array(i), pa.array(s.astype(np.int64)), pa.array(np.arange(q.size, dtype=np.int64))], ["query_id", "vec_id", "score", "copy"])

    reached = pool.where(F.col("length") >= need) if need > 0 else pool
    return reached.select("bucket", "length", "vec_id", "embedding").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, copy bigint")


def op3_query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return norm_bucket_topk(vectors.where("vec_id % 50 = 0"), vectors, 5)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(p.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 50 = 0 AND q.vec_id <> p.vec_id AND len(q.e) = len(p.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
