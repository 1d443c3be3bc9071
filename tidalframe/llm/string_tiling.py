"""Benchmark decontamination by greedy string tiling with running Karp-Rabin."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED_TOKENS = 5  # also the shortest tile
COVERAGE = 0.8
BLOCK_ITEMS = 20_000  # benchmark items sent to the tasks at once, and characters of them; further blocks follow
BLOCK_CHARS = 32_000_000
_WORDS = re.compile(r"\w+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of every n consecutive ids."""
    m = ids.size - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    for i in range(n):
        out = out * _BASE + x[i : i + m]
    return out


def tile(item: np.ndarray, doc: np.ndarray, least: int = SEED_TOKENS) -> list[tuple[int, int, int]]:
    """(item start, doc start, length) of the tiles of running Karp-Rabin greedy string tiling.

    Passes go from long search lengths to ``least``; a pass hashes the windows
    without marked tokens, extends equal ones and, if it meets a match above
    twice its length, starts again at that length. Matches are marked longest
    first (then the earlier in the item, then in the document); what a mark has
    cut short is looked for again.
    """
    marked_i, marked_d = np.zeros(item.size, bool), np.zeros(doc.size, bool)
    tiles: list[tuple[int, int, int]] = []

    def open_windows(marked: np.ndarray, s: int) -> np.ndarray:
        if marked.size < s:
            return np.empty(0, np.int64)
        c = np.concatenate([[0], np.cumsum(marked)])
        return np.flatnonzero(c[s:] == c[:-s])

    s = max(least, min(20, item.size))
    while True:
        at_i, at_d = open_windows(marked_i, s), open_windows(marked_d, s)
        found, longer = [], 0
        if at_i.size and at_d.size:
            hi, hd = window_hashes(item, s), window_hashes(doc, s)
            where = defaultdict(list)
            for i in at_i:
                where[int(hi[i])].append(int(i))
            done: set[tuple[int, int]] = set()
            reach: dict[int, int] = {}  # of each diagonal, how far a match has been followed
            for d in at_d[np.isin(hd[at_d], hi[at_i])]:
                d = int(d)
                for i in where.get(int(hd[d]), ()):
                    if reach.get(d - i, -1) > d or (i, d) in done:
                        continue
                    n = 0
                    while i + n < item.size and d + n < doc.size and not marked_i[i + n] and not marked_d[d + n] and item[i + n] == doc[d + n]:
                        n += 1
                    if n < s:
                        continue
                    done.add((i, d))
                    reach[d - i] = d + n - s + 1
                    found.append((n, i, d))
                    if n > 2 * s:
                        longer = max(longer, n)
        if longer:
            s = longer
            continue
        again = False
        for n, i, d in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if marked_i[i : i + n].any() or marked_d[d : d + n].any():
                again = True  # a shorter part may be free
                continue
            marked_i[i : i + n] = marked_d[d : d + n] = True
            tiles.append((i, d, n))
        if again:
            continue
        if s == least:
            return tiles
        s = max(least, s // 2)


class _Index:
    """Vocabulary, items and seeds of a block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        self.ids, self.items, seeds, owners, places = [], [], [], [], []
        for item_id, text in items:
            t = tokens(text)
            if not t:
                continue
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in t], dtype=np.int64)
            h = window_hashes(ids, min(SEED_TOKENS, len(t)))
            self.ids.append(item_id)
            self.items.append(ids)
            if len(t) >= SEED_TOKENS:
                seeds.append(h)
                owners.append(np.full(h.size, len(self.items) - 1))
                places.append(np.arange(h.size))
        self.short = [k for k, x in enumerate(self.items) if x.size < SEED_TOKENS]
        h = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.seeds = h[order]
        self.owner = np.concatenate(owners)[order] if seeds else np.empty(0, np.int64)
        self.place = np.concatenate(places)[order] if seeds else np.empty(0, np.int64)

    def matches(self, text: str | None, coverage: float) -> list[tuple[int, int, int, float]]:
        """(item_id, tiles, tokens covered, coverage) of the items that a text covers."""
        words = tokens(text)
        get = self.vocab.get
        doc = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        out = []
        for k in self.short:  # items below the seed length count as one tile
            item = self.items[k]
            if (window_hashes(item, item.size)[0] == window_hashes(doc, item.size)).any():
                out.append((self.ids[k], 1, item.size, 1.0))
        h = window_hashes(doc, SEED_TOKENS)
        if not h.size or not self.seeds.size:
            return out
        lo = np.searchsorted(self.seeds, h)
        hit = np.unique(h[self.seeds[np.minimum(lo, self.seeds.size - 1)] == h])
        shared = defaultdict(set)
        for a, b in zip(np.searchsorted(self.seeds, hit), np.searchsorted(self.seeds, hit, side="right")):
            for k, p in zip(self.owner[a:b].tolist(), self.place[a:b].tolist()):
                shared[k].update(range(p, p + SEED_TOKENS))
        for k, covered in sorted(shared.items()):
            item = self.items[k]
            if len(covered) < coverage * item.size:  # tiles lie within shared seeds
                continue
            tiles = tile(item, doc)
            n = sum(x[2] for x in tiles)
            if n >= coverage * item.size:
                out.append((self.ids[k], len(tiles), n, n / item.size))
        return out


def tiled_items(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered, coverage) of each document row and benchmark item whose tokens it covers by at least ``coverage``.

    Tokens are runs of word characters in lower case. Tiles have SEED_TOKENS
    tokens or more and may lie in the document in any order. The benchmark goes
    to the tasks in blocks of bounded size, and documents are read once for each
    block; documents are never shuffled, so frequent passages make no hot keys.

    Null or empty text on either side matches nothing. Items shorter than a seed
    match as one whole tile. Ties between tiles: the earlier in the item. Null
    ids stay null; repeated rows each give their rows. Extra columns are ignored.
    """
    out = None
    for block in _blocks(benchmark):

        def run(batches, block=block):
            index = _Index(block)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in index.matches(t, coverage)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "n_tiles", "covered", "coverage"])

        got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, item_id bigint, n_tiles bigint, covered bigint, coverage double")
        out = got if out is None else out.union(got)
    return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, n_tiles bigint, covered bigint, coverage double") if out is None else out


def _blocks(benchmark: DataFrame):
    """The benchmark's rows in lists of bounded size."""
    block, chars = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        block.append((item_id, text))
        chars += len(text)
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs without the rows whose text covers an item; columns unchanged; the decision is made row by row in the scan."""
    names = docs.columns
    for block in _blocks(benchmark):

        def run(batches, block=block, at=names.index("text")):
            index = _Index(block)
            for b in batches:
                keep = pa.array([not index.matches(t, coverage) for t in b.column(at).to_pylist()], pa.bool_())
                yield b.filter(keep)

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op10_query(spark, sf_dir: str) -> DataFrame:
    return tiled_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
