"""SimHash near-duplicates found through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a
word of the perfect binary Golay code [23, 12, 7]. A word keeps the index of
every codeword at distance 4 or less: one index, or six for words at distance 3
from the code. Two words that differ in one bit always share an index. Three
differing bits over three segments leave either one segment equal and another
with at most one error, or one error in each; a key for each case makes the join
complete for links at 3 or fewer bits. Joined fingerprints are verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, near_codes, stage, unstage

SEGMENTS = (22, 21, 21)
MOST_BITS = 3
_GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """parity of each 12-bit message, error of each syndrome, index offsets of each syndrome, whether a syndrome has six."""
    parity = np.zeros(4096, dtype=np.int64)
    for m in range(4096):
        r = m << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= _GENERATOR << (bit - 11)
        parity[m] = r
    code = (np.arange(4096) << 11) | parity
    light = code[np.bitwise_count(code) == 7]
    error = np.zeros(2048, dtype=np.int64)
    offsets = np.zeros((2048, 6), dtype=np.int64)
    six = np.zeros(2048, dtype=bool)
    ones = [1 << i for i in range(23)]
    errors = [0, *ones, *(a | b for i, a in enumerate(ones) for b in ones[:i]), *(a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j])]
    for e in errors:
        s = (e & 2047) ^ parity[e >> 11]
        error[s] = e
        if e.bit_count() == 3:
            six[s] = True
            offsets[s, 1:] = light[(light & e) == e] >> 11
    return parity, error, offsets, six


_PARITY, _ERROR, _OFFSETS, _SIX = _golay()


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices at distance 4 or less of 23-bit words, home first; (n,) whether all six count."""
    s = (words & 2047) ^ _PARITY[words >> 11]
    home = (words ^ _ERROR[s]) >> 11
    return home[:, None] ^ _OFFSETS[s], _SIX[s]


def golay_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, code) rows, about 65 for each uint64 code."""
    c = codes.view(np.uint64)
    parts = [(c >> np.uint64(42)).astype(np.int64), (c >> np.uint64(21) & np.uint64(0x1FFFFF)).astype(np.int64), (c & np.uint64(0x1FFFFF)).astype(np.int64)]
    near = [nearby(p) for p in parts]
    keys, owner = [], []
    at = np.arange(len(c))

    def put(kind, key, rows):
        keys.append((kind << 40) | key)
        owner.append(rows)

    kind = 0
    for i in range(3):  # segment i equal, segment j with one error at most
        for j in range(3):
            if i != j:
                index, six = near[j]
                put(kind, parts[i] << 12 | index[:, 0], at)
                m = at[six]
                put(kind, (parts[i][m, None] << 12 | index[m, 1:]).ravel(), np.repeat(m, 5))
                kind += 1
    # one error in each: the home of some segments meets the near ones of the others
    (x, sx), (y, sy), (z, sz) = near
    put(kind, x[:, 0] << 24 | y[:, 0] << 12 | z[:, 0], at)
    m = at[sy]
    put(kind, (x[m, :1] << 24 | y[m, 1:] << 12 | z[m, :1]).ravel(), np.repeat(m, 5))
    for p in range(6):
        for q in range(6):
            if p or q:
                m = at[(sx if p else True) & (sz if q else True) & np.ones(len(c), bool)]
                put(kind, x[m, p] << 24 | y[m, 0] << 12 | z[m, q], m)
    return np.concatenate(keys), codes[np.concatenate(owner)]


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 3-word shingles of a whole text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = (ends[2:] if len(words) > 2 else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), dtype=">u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, carried bigint columns, fp bigint) of every row."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t) for t in b.column(0).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps.view(np.int64))], ["doc_id", *carried, "fp"])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"), *carried)
    return rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in ("doc_id", *carried, "fp")))


def _roots(fps: DataFrame) -> DataFrame:
    """(fp, least, root): each distinct fingerprint, its smallest doc_id and the fingerprint that stands for its component."""
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")

    def expand(batches):
        for b in batches:
            codes = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(codes), 2048):
                k, c = golay_keys(codes[at : at + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["key", "code"])

    links = near_codes(nodes.select("fp").mapInArrow(expand, "key bigint, code bigint"), MOST_BITS)
    roots = components(links)
    named = stage(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    unstage(nodes)
    unstage(roots)
    return named


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text).

    Documents link at 3 or fewer differing fingerprint bits; component_id is the
    smallest doc_id reachable. Equal fingerprints are one node, so a group of
    exact copies costs one row in the join. Null or empty text: fingerprint
    zero, linked like any other. Null doc_id: the row keeps its component, but
    never names it (component_id is null if no row of it has an id). Repeated
    rows: each gets its row. Extra columns are ignored. Empty table: no rows.
    """
    fps = stage(fingerprints(docs), "fingerprints")
    named = _roots(fps)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.select("fp", "root").join(ids, "root").select(F.col("fp").alias("node_fp"), "component_id")
    return fps.join(labels, fps["fp"] == labels["node_fp"]).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of simhash_components; columns unchanged.

    The row that stays is chosen by the row itself: smallest doc_id (rows without
    an id come last), then the hashes of its text and of all its columns. So one
    doc_id with different texts is two documents, and only the component decides
    what goes. Rows equal in doc_id, text and all columns (map columns apart)
    repeat one document: one of them stays. Null and empty texts are one
    component, of which one row stays. Very long texts are hashed whole. Column
    names are free: rows travel as one struct. Empty table: no rows.
    """
    names = docs.columns
    hashed = [F.col(f"`{n}`") for n, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    whole = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(*hashed).alias("row_hash")).withColumn("text_hash", F.xxhash64("text"))
    fps = stage(fingerprints(whole, "text_hash", "row_hash"), "fingerprints")
    named = _roots(fps)
    best = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row_hash")).alias("least"))
    best = best.join(named.select(F.col("fp").alias("node"), "root"), F.col("fp") == F.col("node")).groupBy("root").agg(F.min("least").alias("least"))
    some_id = lambda c: F.coalesce(c, F.lit(-(2**63)))
    kept = stage(best.select(some_id(F.col("least.doc_id")).alias("k0"), F.col("least.text_hash").alias("k1"), F.col("least.row_hash").alias("k2")), "kept")
    unstage(fps)
    unstage(named)
    own = whole.select("row", some_id(F.col("doc_id")).alias("k0"), F.col("text_hash").alias("k1"), F.col("row_hash").alias("k2"))
    return own.join(kept, ["k0", "k1", "k2"], "left_semi").dropDuplicates(["k0", "k1", "k2"]).select("row.*")


def op4_query(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
