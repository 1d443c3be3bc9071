"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import training_rows

WINDOW = 128  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
EMBED = 6
MAX_TRAIN_DOCS = 2_000  # labelled documents a language that are fitted to, in expectation
TRAIN_WINDOWS = 8  # of each, spread over its whole text
_STEP = WINDOW - max(WIDTHS) + 1
_LETTER = re.compile(r"[^\W\d_]")
_IS_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def windows(text: str) -> np.ndarray:
    """(n, WINDOW) bytes of the whole text; neighbours share what the widest filter needs; zeros fill the last."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-(raw.size - WINDOW + _STEP) // _STEP))
    padded = np.zeros((n - 1) * _STEP + WINDOW, np.uint8)
    padded[: raw.size] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::_STEP]


class ByteCNN:
    """Embedding, filters of several widths, max over each window, softmax."""

    def __init__(self, langs: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.langs = langs
        top, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.table = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.used = np.zeros((top * EMBED, n), np.float32)  # narrower filters see their first bytes only
        for k, w in enumerate(WIDTHS):
            self.used[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        self.filters = (rng.normal(0, 1 / np.sqrt(top * EMBED), self.used.shape) * self.used).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def _patches(self, x: np.ndarray) -> np.ndarray:
        e = self.table[x].reshape(len(x), -1)
        return np.lib.stride_tricks.sliding_window_view(e, max(WIDTHS) * EMBED, axis=1)[:, ::EMBED]

    def predict(self, x: np.ndarray, batch: int = 64) -> np.ndarray:
        """(n, languages) probabilities of byte windows."""
        pooled = np.empty((len(x), self.bias.size), np.float32)
        for at in range(0, len(x), batch):
            p = self._patches(x[at : at + batch])
            a = np.ascontiguousarray(p).reshape(-1, p.shape[2]) @ self.filters
            a.reshape(p.shape[0], p.shape[1], -1).max(1, out=pooled[at : at + batch])
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 0.004, seed: int = 0) -> None:
        """Adam on cross-entropy; the gradient goes to each filter's largest place."""
        rng = np.random.default_rng(seed)
        names = ["table", "filters", "bias", "out", "out_bias"]
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        t, width = 0, max(WIDTHS)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                xb, yb, n = x[rows], y[rows], len(rows)
                p = self._patches(xb)
                a = (np.ascontiguousarray(p).reshape(-1, p.shape[2]) @ self.filters).reshape(n, p.shape[1], -1)
                where = a.argmax(1)
                pre = np.take_along_axis(a, where[:, None], 1)[:, 0] + self.bias
                hid = np.maximum(pre, 0)
                z = hid @ self.out + self.out_bias
                z = np.exp(z - z.max(1, keepdims=True))
                d = z / z.sum(1, keepdims=True)
                d[np.arange(n), yb] -= 1
                d /= n
                g = {"out": hid.T @ d, "out_bias": d.sum(0)}
                dh = (d @ self.out.T) * (pre > 0)
                g["bias"] = dh.sum(0)
                best = p[np.arange(n)[:, None], where]  # (n, filters, width * EMBED)
                g["filters"] = np.einsum("nf,nfk->kf", dh, best) * self.used
                de = (dh[:, :, None] * self.filters.T[None]).reshape(n, dh.shape[1], width, EMBED)
                codes = xb[np.arange(n)[:, None, None], where[:, :, None] + np.arange(width)]
                g["table"] = np.zeros_like(self.table)
                np.add.at(g["table"], codes.ravel(), de.reshape(-1, EMBED))
                t += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    getattr(self, k)[...] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def classify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of whole texts: mean window probabilities, each window weighing its letters; und without a letter."""
        has = [t is not None and _LETTER.search(t) is not None for t in texts]
        cut = [windows(t) for t, h in zip(texts, has) if h]
        if not cut:
            return [("und", 0.0)] * len(texts)
        x = np.concatenate(cut)
        starts = np.cumsum([0] + [len(c) for c in cut[:-1]])
        weight = _IS_LETTER[x].sum(1)[:, None].astype(np.float64)
        sums = np.add.reduceat(self.predict(x) * weight, starts)
        sums /= np.maximum(np.add.reduceat(weight, starts), 1)
        best = iter(zip(sums.argmax(1).tolist(), np.clip(sums.max(1), 0, 1).tolist()))
        return [((lambda k, s: (self.langs[k], s))(*next(best)) if h else ("und", 0.0)) for h in has]


def train(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> ByteCNN | None:
    """Fits a network to labelled rows of docs (doc_id, text, lang) whose crc32(doc_id as text) mod 4 is not 2.

    About max_docs documents of each language, chosen by a hash of doc_id, and
    TRAIN_WINDOWS windows spread over each whole text (all, if fewer). The tasks
    cut the windows: the driver gets 8 of 128 bytes a document, however long it is.
    """

    def cut(batches):
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                if text is None or not _LETTER.search(text):
                    out.append([])
                    continue
                w = windows(text)
                w = w[np.unique(np.linspace(0, len(w) - 1, TRAIN_WINDOWS).astype(int))]
                out.append([bytes(x) for x in (w[_IS_LETTER[w].sum(1) >= 8] if len(w) > 1 else w)])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.list_(pa.binary()))], ["label", "windows"])

    rows = sorted((r[0], bytes(w)) for r in training_rows(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), "lang", max_docs).mapInArrow(cut, "label string, windows array<binary>").collect() for w in r[1] or [b""])
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    code = {k: i for i, k in enumerate(langs)}
    rows = [r for r in rows if r[1]]
    net = ByteCNN(langs)
    if rows:
        net.fit(np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW), np.array([code[r[0]] for r in rows]))
    return net


def _judged(net: ByteCNN | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """classify() of many texts, windows of about a megabyte of text at once; without a network, any language where there is a letter."""
    if net is None:
        return [("und" if t is None or not _LETTER.search(t) else "", 1.0) for t in texts]
    got, size, at = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > 1_000_000 or i == len(texts) - 1:
            got += net.classify(texts[at : i + 1])
            size, at = 0, i + 1
    return got


def identify(docs: DataFrame, net: ByteCNN | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, one pass without shuffle.

    Null text, or no letter in it: und, score 0; so is every text where nothing
    was learnt. Null ids stay null; repeated rows each get their row; very long
    texts are cut into all their windows. Extra columns are ignored.
    """

    def run(batches):
        for b in batches:
            got = _judged(net, b.column(1).to_pylist()) if net else [("und", 0.0)] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: ByteCNN | None, least: float = 0.0) -> DataFrame:
    """docs whose language is recognised, with a score of ``least`` or more if one is given; columns unchanged.

    Null texts and texts without a letter go. Where nothing was learnt, every
    text with a letter stays. Repeated rows and rows without an id are judged by
    their text like any other. Very long texts are classified whole, about a
    megabyte of text at once. Column names are free. Empty table: no rows.
    """

    def run(batches, at=docs.columns.index("text")):
        for b in batches:
            yield b.filter(pa.array([lang != "und" and score >= least for lang, score in _judged(net, b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs))
    return out.select("doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)").alias("held_out"), "lang_pred", "score")
