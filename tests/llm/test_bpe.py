import hashlib
import struct

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidalframe.llm import bpe_segment_tree as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
REF = Tokenizer.from_file(PATH)
OWN = B.SegmentTreeBPE(*B.vocabulary())


def same(text):
    want = REF.encode(text, add_special_tokens=False).ids
    ids = OWN.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
    assert OWN.decode(ids) == REF.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeinst 'lvdre\n\t0157.,<|endoftext|>é", max_size=200))
def test_likely_text(text):
    same(text)


def test_special_and_long():
    for t in ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext", "ab" * 20000, "\x1c\x1d\x1e\x1f \x85\xa0 ", "e" * 5001, "I'll we've 's", ""]:
        same(t)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "Hello there", 5), (1, "Hello there", 5), (None, "x", 1), (2, None, 0), (3, "", 0)], "doc_id bigint, text string, ids int")
    got = B.digests(B.encode_decode(docs)).collect()
    assert len(got) == 5
    row = next(r for r in got if r.doc_id == 1)
    ids = REF.encode("Hello there", add_special_tokens=False).ids
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(b"Hello there").hexdigest())
    assert next(r for r in got if r.doc_id == 2).decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert B.encode_decode(docs.limit(0)).count() == 0
