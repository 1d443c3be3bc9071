"""Byte-level BPE with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import struct

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 250_000  # of each of two generations
CACHE_CHARS = 64
_NONE = 1 << 62


def _byte_chars() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with: printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain}
    chars.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in plain))
    return chars


class SegmentTreeBPE:
    """Encoder and decoder of a tokenizers JSON file (byte-level BPE, without normaliser)."""

    def __init__(self, content: bytes, pattern: str):
        j = json.loads(content)
        vocab, chars = j["model"]["vocab"], _byte_chars()
        raw = {i: bytes(chars[c] for c in t) for t, i in vocab.items() if all(c in chars for c in t)}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        raw.update((i, t.encode()) for t, i in self.special.items())
        self.token = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.byte_id = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        self.merge = {}
        for rank, m in enumerate(j["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.words = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before; what is used again moves on

    def merge_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token. Leaves hold rank * n + position of each adjacent pair, so the root is the leftmost pair of the lowest rank; a merge changes three leaves and their ancestors."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        merge = self.merge
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            m = merge.get((ids[i], ids[i + 1]))
            if m:
                tree[size + i] = m[0] * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low

        while (top := tree[1]) < _NONE:
            i = top % n
            j = after[i]
            ids[i] = merge[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            put(j, _NONE)
            if k < n:
                before[k] = i
                m = merge.get((ids[i], ids[k]))
                put(i, m[0] * n + i if m else _NONE)
            else:
                put(i, _NONE)
            h = before[i]
            if h >= 0:
                m = merge.get((ids[h], ids[i]))
                put(h, m[0] * n + h if m else _NONE)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out, cache, old = [], self.cache, self.old
        for piece in self.cut.split(text) if self.cut and any(t in text for t in self.special) else (text,):
            if piece in self.special:
                out.append(struct.pack("<I", self.special[piece]))
                continue
            for w in self.words(piece):
                got = cache.get(w)
                if got is None:
                    got = old.get(w)
                    if got is None:
                        ids = self.merge_word(w.encode())
                        got = struct.pack(f"<{len(ids)}I", *ids)
                    if len(w) <= CACHE_CHARS:
                        if len(cache) >= CACHE_WORDS:
                            old = self.old = cache
                            cache = self.cache = {}
                        cache[w] = got
                out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        token = self.token
        return b"".join([token[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


_loaded: dict[str, SegmentTreeBPE] = {}


def _load(content: bytes, pattern: str) -> SegmentTreeBPE:
    key = hashlib.sha256(content).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = SegmentTreeBPE(content, pattern)
    return _loaded[key]


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """Content of a tokenizer file, read on the driver and sent to the tasks, and the pre-token pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of docs (doc_id, text).

    ids: binary, little-endian unsigned 32-bit; decoded: the text that these ids
    give back. Strings of special tokens in a text become those tokens. One pass
    without shuffle; results of short pre-tokens are kept in a bounded cache.
    Null or empty text: no ids, empty text. Null doc_id, repeated rows: each row
    gets its row. Very long pre-tokens cost n log n. Extra columns are ignored.
    """
    content, pattern = vocabulary(path)

    def run(batches):
        bpe = _load(content, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_query(spark, sf_dir: str) -> DataFrame:
    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
