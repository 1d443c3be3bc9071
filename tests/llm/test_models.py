import re

import numpy as np
from pyspark.sql import functions as F

from tidalframe.llm import byte_cnn, toxic_lexicon

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = byte_cnn.op7_query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edges(spark):
    rng = np.random.default_rng(0)
    words = {"aa": ["the", "and", "with"], "bb": ["der", "und", "mit"]}
    rows = [(i, " ".join(rng.choice(words[k], 40)), k, 1.0) for i in range(200) for k in ("aa", "bb")]
    docs = spark.createDataFrame(rows + [(900, "the and", None, 1.0)], "doc_id bigint, text string, lang string, score double")
    net = byte_cnn.train(docs)
    assert net.langs == ["aa", "bb"]
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "12 !? 3"), (None, "the and with " * 9), (4, "und mit der " * 5000), (5, "é")], "doc_id bigint, text string")
    got = [(r.doc_id, r.lang_pred) for r in byte_cnn.identify(odd, net).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (1, "und"), (2, "und"), (3, "und"), (None, "aa"), (4, "bb"), (5, got[-1][1])], key=str)
    kept = byte_cnn.keep_identified(odd, net)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {None, 4}
    assert byte_cnn.train(docs.limit(0)) is None and byte_cnn.identify(odd, None).count() == 7
    assert byte_cnn.identify(odd.limit(0), net).count() == 0


def test_windows_cover_every_byte():
    for n in (0, 1, 127, 128, 129, 252, 253, 1000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        w = byte_cnn.windows(text)
        back = bytes(w[0]) + b"".join(bytes(x[-byte_cnn._STEP :]) for x in w[1:])
        assert back.rstrip(b"\0").decode() == text


def test_gradient():
    rng = np.random.default_rng(1)
    net = byte_cnn.ByteCNN(["a", "b"])
    x = rng.integers(97, 123, (300, byte_cnn.WINDOW)).astype(np.uint8)
    y = (x[:, :3] == 100).any(1).astype(int)
    x[y == 1, 60:64] = 35
    net.fit(x, y, epochs=60, batch=50)
    assert (net.predict(x).argmax(1) == y).mean() > 0.95


def test_toxic_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxic_lexicon.op6_query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit / (held.toxic == 1).sum() > 0.85 and hit / (held.predicted == 1).sum() > 0.9


def test_toxic_fold_and_exceptions(spark):
    rows = [(i, ("you are a loser and so on " if i % 3 == 0 else "a fine day it is and so on ") + str(i)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", F.expr("cast(doc_id % 3 = 0 as int)").alias("toxic"), F.lit("x").alias("text"))
    lex = toxic_lexicon.train(docs, labels)
    lex.exceptions = [" sore ioser "]
    odd = spark.createDataFrame([(1, "what a L0ser he is"), (2, "what a lоsеr he is"), (3, "a sore loser he is"), (4, None), (5, ""), (None, "LOSER"), (7, "12 000"), (7, "12 000")], "doc_id bigint, text string")
    got = {(r.doc_id, r.matches > 0) for r in toxic_lexicon.score_toxicity(odd, lex).collect()}
    assert got == {(1, True), (2, True), (3, False), (4, False), (5, False), (None, True), (7, False)}
    none = toxic_lexicon.train(docs, labels.limit(0))
    assert {r.score < 0.3 for r in toxic_lexicon.score_toxicity(odd, none).collect()} == {True}
    assert toxic_lexicon.score_toxicity(odd.limit(0), lex).count() == 0


def slow_probabilities(net, window):
    """The network by its definition: one place, one filter, one byte at a time."""
    pooled = []
    for k, w in enumerate(byte_cnn.WIDTHS):
        for f in range(k * byte_cnn.FILTERS, (k + 1) * byte_cnn.FILTERS):
            best = -np.inf
            for at in range(byte_cnn.WINDOW - max(byte_cnn.WIDTHS) + 1):
                best = max(best, sum(float(net.table[window[at + i]] @ net.filters[i * byte_cnn.EMBED : (i + 1) * byte_cnn.EMBED, f]) for i in range(w)))
            pooled.append(max(0.0, best + float(net.bias[f])))
    z = np.array([sum(p * float(o) for p, o in zip(pooled, net.out[:, j])) + float(net.out_bias[j]) for j in range(len(net.langs))])
    z = np.exp(z - z.max())
    return z / z.sum()


def test_network_by_definition():
    rng = np.random.default_rng(4)
    net = byte_cnn.ByteCNN(["a", "b", "c"], seed=2)
    net.bias[:] = rng.normal(0, 0.3, net.bias.shape)
    net.out[:] = rng.normal(0, 0.5, net.out.shape)
    x = rng.integers(0, 256, (5, byte_cnn.WINDOW)).astype(np.uint8)
    assert np.abs(net.predict(x, batch=2) - np.array([slow_probabilities(net, w) for w in x])).max() < 1e-4


def slow_sums(lex, text):
    """Patterns tried one by one at each place of the folded words."""
    words = re.findall(r"\w+", toxic_lexicon.fold_text(text))
    line = f" {' '.join(words)} "
    spared = [(i, i + len(e) - 1) for e in lex.exceptions for i in range(len(line)) if line.startswith(e, i)]
    total = hits = 0
    for i in range(len(line)):
        best = max((w for p, w in lex.weights.items() if line.startswith(p, i)), default=0.0)
        if best > 0 and not any(a <= i < b for a, b in spared):
            total, hits = total + best, hits + 1
    return total, hits, len(words)


def test_matching_by_definition():
    rng = np.random.default_rng(3)
    lex = toxic_lexicon.Lexicon({" idiot ": 3.0, " idi": 2.0, " stup": 2.5, " trash ": 1.5, " as": 1.0}, ("trash can", "stupid simple"))
    lex.weights = {toxic_lexicon.fold_text(k): v for k, v in lex.weights.items()}
    bits = ["idiot", "1d10t!", "idiots", "$tupid", "stupid", "simple", "trash", "can", "@s", "as$", "clean", "words", "10", "tr@sh", "ідіот", "!diot"]
    for _ in range(300):
        text = " ".join(rng.choice(bits, int(rng.integers(0, 12))))
        assert lex.sums(text) == slow_sums(lex, text), text


def test_folding():
    same = {"$tupid": "stupid", "@ss": "ass", "as$": "ass", "!diot": "idiot", "1d10t": "idiot", "l0ser": "loser", "stupid!!": "stupid!!", "ѕtupіd": "stupid", "ｓtupid": "stupid", "st\u200bupid": "stupid", "2024": "2024", "$5": "$5"}
    for a, b in same.items():
        assert toxic_lexicon.fold_text(a) == toxic_lexicon.fold_text(b), a
