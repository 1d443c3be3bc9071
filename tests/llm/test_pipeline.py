import hashlib

import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from tidalframe.llm import byte_cnn, fuzzy_lines, string_tiling
from test_lines import slow as slow_lines
from test_pairs import brute_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept, with plain Python in its place."""
    assert [n for n, _ in C.STAGES] == ["identify_language", "dedup_lines", "near_dedup", "decontaminate", "tokenize"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = byte_cnn.train(docs)
    rows = docs.orderBy("doc_id").collect()
    good = [r for r, (lang, score) in zip(rows, net.classify([r.text for r in rows])) if lang != "und"]
    first = C.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns
    assert sorted(r.doc_id for r in first.collect()) == [r.doc_id for r in good]
    lines = slow_lines([(r.doc_id, r.text) for r in good])
    codes = [slow_fingerprint(t) for _, t in lines]
    kept = [lines[i] for i in sorted(set(brute_components(codes, 3)))]
    index = string_tiling._Index([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    clean = [(d, t) for d, t in kept if not index.matches(t, 0.8)]
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((d, len(ref.encode(t, add_special_tokens=False).ids), hashlib.sha256(t.encode()).hexdigest()) for d, t in clean)
    got = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in C.run(spark, SF).collect())
    assert got == want and len(got) < len(kept)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeats, empty and long texts; an empty table."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    line = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(1, line, "en", "a", 57), (1, line, "en", "a", 57), (2, line.upper(), None, None, None), (None, "une autre ligne que personne ne connait encore", "fr", "b", 1), (None, None, None, None, None), (3, None, "en", "c", 0), (4, "", "en", "c", 0), (5, "12 !!", "en", "c", 5), (6, "word " * 30_000, "en", "d", 150_000), (7, "leaked passage of seven words right here", "en", "e", 9)]
    spark.createDataFrame([(1, "leaked passage of seven words right here"), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.createDataFrame(rows, schema)
    kept = []
    for name, f in C.STAGES:
        docs = spark.createDataFrame(f(spark, docs, str(tmp_path)).collect(), schema if name != "tokenize" else "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
        kept.append(sorted(str(r.doc_id) for r in docs.collect()))
    assert kept[0] == ["1", "1", "2", "6", "7", "None"]
    assert kept[1] == kept[0]
    assert kept[2] == ["1", "2", "6", "7", "None"]
    assert kept[3] == kept[4] == ["1", "2", "6", "None"]
    assert sorted(str(r.doc_id) for r in C.run(spark, str(tmp_path)).collect()) == kept[4]
    docs = spark.createDataFrame([], schema)
    for name, f in C.STAGES:
        out = f(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "tokenize" or out.columns == docs.columns)
