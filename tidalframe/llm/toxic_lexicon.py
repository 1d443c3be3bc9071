"""Toxicity by a learnt weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sampled, stage, unstage

MAX_TRAIN_DOCS = 4_000  # labelled documents a class that are learnt from, in expectation
STEMS = tuple(range(3, 11))  # lengths of word beginnings that may stand for their words
LEAST_DOCS = 4
LEAST_WEIGHT = 1.5
SHARES = (0.2, 0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7)  # of the heaviest pattern's weight, from which training chooses
PRIOR_DOCS = 4
THRESHOLD = 0.3

#: Characters that look like Latin letters, with those letters.
HOMOGLYPHS = dict(zip("авсеһіјкмпорѕтухѡԁԛԝαβεηικνορτυχω", "abcehijkmnopstyxwdqwabenikvoptuxw"))
#: Digits and signs that are written for letters. l, 1 and ! all fold to i.
SUBSTITUTES = dict(zip("013456789@$!|l€", "oieasgtbgasiiie"))
#: Phrases within which a match doesn't count.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pathetic fallacy", "worthless check", "stupid simple")

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()}
_LEET = {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()}
_WIDE = {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_WIDE |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # soft hyphen and zero-width characters
_TOKEN = re.compile(r"[\w@$!|€]+")
_ODD = re.compile(r"[0-9@$!|€]")


def fold_text(text: str) -> str:
    """Lower case, look-alikes as Latin letters; digits and signs as letters within tokens that hold a letter; l as i."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(_WIDE).translate(_FOLD)
    if _ODD.search(low):
        low = _TOKEN.sub(lambda m: _fold_token(m[0]), low)
    return low.replace("l", "i")


def _fold_token(token: str) -> str:
    """Signs at the start count as letters ($tupid, @ss), at the end only $ and @ (as$): ! and | there are punctuation."""
    core = token.rstrip("!|")
    return token if core.isalpha() or not any(c.isalpha() for c in core) else core.translate(_LEET) + token[len(core) :]


_WORD = re.compile(r"\w+")


def features(folded: str) -> set[str]:
    """Words (with a leading and trailing space) and beginnings of words (with a leading space)."""
    out = set()
    for w in set(_WORD.findall(folded)):
        if not w.isdigit():
            out.add(f" {w} ")
            out.update(" " + w[:n] for n in STEMS if len(w) > n)
    return out


class Lexicon:
    """Weighted patterns and the two-feature logistic curve on what they sum to."""

    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS):
        self.weights = weights
        self.exceptions = [f" {' '.join(_WORD.findall(fold_text(e)))} " for e in exceptions]
        self.curve = np.zeros(3)
        self._machine = None

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def machine(self):
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for p, w in self.weights.items():
                self._machine.add_word(p, (len(p), w))
            for e in self.exceptions:
                self._machine.add_word(e, (len(e), None))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def hits(self, text: str) -> tuple[list[float], int]:
        """Weights of the matches, and the number of words, of a whole text: at each word the heaviest pattern counts, unless an exception phrase covers it."""
        words = _WORD.findall(fold_text(text))
        machine = self.machine()
        if not words or not len(machine):
            return [], len(words)
        line = f" {' '.join(words)} "
        at: dict[int, float] = {}
        spared = []
        for end, (n, w) in machine.iter(line):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            elif w > at.get(start, 0.0):
                at[start] = w
        if spared:
            at = {p: w for p, w in at.items() if not any(a <= p < b for a, b in spared)}
        return list(at.values()), len(words)

    def sums(self, text: str) -> tuple[float, int, int]:
        """(weight, matches, words) of a whole text."""
        found, words = self.hits(text)
        return sum(found), len(found), words

    @staticmethod
    def _inputs(weight: float, words: int) -> tuple[float, float]:
        return np.log1p(weight), np.log1p(100 * weight / words) if words else 0.0

    def rate(self, text: str | None) -> tuple[float, float, int, int]:
        """(score, weight, matches, words) of a whole text."""
        weight, matches, words = self.sums(text or "")
        return self.score(weight, words), weight, matches, words

    def score(self, weight: float, words: int) -> float:
        a, b = self._inputs(weight, words)
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * a + self.curve[2] * b, -30, 30))))

    def calibrate(self, sums: list[tuple[float, int]], labels: list[int], base: float, rounds: int = 40) -> None:
        """Newton steps of a ridge logistic regression on (weight, words) of texts, classes weighted to the base rate."""
        x = np.array([(1.0, *self._inputs(w, n)) for w, n in sums])
        y = np.array(labels, dtype=float)
        w = np.where(y == 1, base / max(y.mean(), 1e-9), (1 - base) / max(1 - y.mean(), 1e-9))
        c = np.zeros(3)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            g = x.T @ (w * (p - y)) + 1e-2 * c
            h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
            step = np.linalg.solve(h, g)
            c -= np.clip(step, -3, 3)
        # matches can't make a text less toxic
        if min(c[1:]) < 0:
            keep = 1 + int(np.argmax(c[1:]))
            c = np.array([c[0], 0.0, 0.0])
            for _ in range(rounds):
                z = x[:, [0, keep]]
                p = 1 / (1 + np.exp(-np.clip(z @ c[[0, keep]], -30, 30)))
                g = z.T @ (w * (p - y)) + 1e-2 * c[[0, keep]]
                h = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
                c[[0, keep]] -= np.clip(np.linalg.solve(h, g), -3, 3)
        self.curve = c


def _weights(counts: dict[str, tuple[int, int]], base: float, scale: float) -> dict[str, float]:
    """Pattern -> weight, of features with their (toxic, clean) documents; ``scale``: clean documents that one of the sample stands for."""
    bad = {f: a for f, (a, _) in counts.items() if a >= LEAST_DOCS}
    longest: Counter = Counter()  # of each beginning, the documents of its most frequent word
    for f, a in bad.items():
        if f[-1] == " ":
            for k in STEMS:
                longest[f[: k + 1]] = max(longest[f[: k + 1]], a)
    out = {}
    for f, a in bad.items() if 0 < base < 1 else ():
        w = float(np.log((a + PRIOR_DOCS * base) / (scale * counts[f][1] + PRIOR_DOCS * (1 - base))) - np.log(base / (1 - base)))
        if w >= LEAST_WEIGHT and (f[-1] == " " or a > 1.2 * longest[f]):  # a beginning must stand for several words
            out[f] = w
    return out


def _heavy(weights: dict[str, float], share: float) -> dict[str, float]:
    least = share * max(weights.values(), default=0.0)
    return {f: w for f, w in weights.items() if w >= least}


def _sums(sample: DataFrame, lexicon: Lexicon, least: list[float]) -> list[tuple]:
    """[(fold, toxic, [(weight, words) by the patterns of each least weight])] of the sampled texts: numbers only come to the driver."""

    def run(batches):
        for b in batches:
            got = [lexicon.hits(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([[sum(w for w in h if w >= x) for x in least] for h, _ in got], pa.list_(pa.float64())), pa.array([n for _, n in got], pa.int64())], ["fold", "toxic", "weights", "words"])

    rows = sample.mapInArrow(run, "fold int, toxic int, weights array<double>, words bigint").collect()
    return [(r.fold, r.toxic, [(w, r.words) for w in r.weights]) for r in rows]


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Lexicon:
    """Learns weights and curve from labelled rows whose crc32(doc_id as text) mod 4 is not 2.

    About max_docs documents of either class, chosen by a hash of doc_id, whole
    texts of any length. A word, or a beginning that several words share, becomes
    a pattern if LEAST_DOCS toxic documents hold it and its log odds over the base
    rate, smoothed by PRIOR_DOCS documents of that rate, reach LEAST_WEIGHT and a
    share of the heaviest.

    The sample falls into three folds by another hash. Shares are compared with
    weights of fold 0 and curves of fold 1, by the errors that they make in fold 2
    at THRESHOLD; the lexicon then has the weights of folds 0 and 1 and a curve of
    fold 2, whose words it wasn't learnt from. (Fewer than 60 documents: one fold
    for all.) Texts stay in the tasks: the driver gets pattern counts, which the
    sample bounds, and two numbers a document. doc_id serves for choosing rows only.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(F.expr("crc32(cast(doc_id as string)) % 4 <> 2")).select("doc_id", F.expr("cast(toxic = 1 as int)").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    base = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = {r[0]: r[1] for r in known.where(sampled(counts, "toxic", max_docs)).collect()}
    ids = docs.sparkSession.createDataFrame(list(picked.items()), "id bigint, toxic int")  # bounded by the sample
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).cast("int")
    sample = stage(texts.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select(F.coalesce("text", F.lit("")).alias("text"), fold.alias("fold"), "toxic"), "toxic-sample")
    size = {(r[0], r[1]): r[2] for r in sample.groupBy("fold", "toxic").count().collect()}
    whole = sum(size.values()) < 60 or any((f, y) not in size for f in range(3) for y in range(2))
    n = [sum(v for (_, y), v in size.items() if y == k) for k in range(2)]
    if not n[0] or not n[1]:
        out = Lexicon({})
        out.curve = np.array([10.0 if n[1] and not n[0] else -10.0, 0, 0])
        unstage(sample)
        return out

    def run(batches):
        counts = defaultdict(lambda: [0] * 6)  # of the sample's texts in this task
        for b in batches:
            for t, k, y in zip(*(c.to_pylist() for c in b.columns)):
                for f in features(fold_text(t)):
                    counts[f][2 * k + y] += 1
        names = list(counts)
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([counts[f][i] for f in part], pa.int32()) for i in range(6))], ["feature", *columns])

    columns = [f"n{k}{y}" for k in range(3) for y in range(2)]
    held_by = sample.mapInArrow(run, "feature string, " + ", ".join(f"{c} int" for c in columns)).groupBy("feature").agg(*[F.sum(c).alias(c) for c in columns])
    found = held_by.where(f"n01 + n11 + n21 >= {LEAST_DOCS}").collect()

    def learnt(folds) -> dict[str, float]:
        clean, bad = (sum(size.get((k, y), 0) for k in folds) for y in range(2))
        scale = (counts[0] / max(1, clean)) / max(1e-9, counts[1] / max(1, bad))
        return _weights({r.feature: (sum(r[f"n{k}1"] for k in folds), sum(r[f"n{k}0"] for k in folds)) for r in found}, base, scale)

    folds = [range(3)] * 3 if whole else [(0,), (1,), (2,)]
    first = learnt(folds[0])
    least = [share * max(first.values(), default=0.0) for share in SHARES]
    sums = _sums(sample, Lexicon(_heavy(first, SHARES[0])), least)
    weight = {1: base / n[1], 0: (1 - base) / n[0]}  # errors as they would count in all rows
    errors = []
    for i in range(len(SHARES)):
        curve = Lexicon({})
        curve.calibrate([v[i] for k, _, v in sums if k in folds[1]], [y for k, y, _ in sums if k in folds[1]], base)
        errors.append(sum(weight[y] * ((curve.score(*v[i]) >= THRESHOLD) != (y == 1)) for k, y, v in sums if k in folds[2]))
    share = SHARES[int(np.argmin(errors))]
    out = Lexicon(_heavy(learnt(range(3) if whole else (0, 1)), share))
    out.share = share
    sums = _sums(sample, out, [0.0])
    out.calibrate([v[0] for k, _, v in sums if k in folds[2]], [y for k, y, _ in sums if k in folds[2]], base)
    unstage(sample)
    return out


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, matches, weight, n_words) of every row, one pass without shuffle.

    Null and empty texts score as a text without a match. Very long texts are
    matched whole, one at a time. Null ids stay null; repeated rows each get their
    row. Extra columns, whatever their names, are ignored. Empty table: no rows.
    """

    def run(batches):
        for b in batches:
            rows = [lexicon.rate(t) for t in b.column(1).to_pylist()]
            s, w, m, n = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(m, pa.int64()), pa.array(w, pa.float64()), pa.array(n, pa.int64())], ["doc_id", "score", "matches", "weight", "n_words"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double, matches bigint, weight double, n_words bigint")


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)").alias("held_out"), "score", F.expr(f"cast(score >= {THRESHOLD} as int)").alias("predicted"), "matches")
