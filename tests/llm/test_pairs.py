import random

import numpy as np
import pyarrow as pa
import xxhash

from tidalframe.llm import simhash_golay as G
from tidalframe.llm._common import components, near_codes, runs


def brute_components(codes, most):
    n = len(codes)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_keys_find_every_pair_within_three_bits():
    rng = random.Random(5)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            b ^= 1 << bit
        codes = np.array([a, b], dtype=np.uint64).view(np.int64)
        keys, owner = G.golay_keys(codes)
        assert set(keys[owner == codes[0]]) & set(keys[owner == codes[1]])
    one = np.array([0], dtype=np.int64)  # errors at segment borders
    for bits in ([0, 21, 42], [20, 41, 63], [0, 1, 2], [0, 1, 21], [62, 63, 0]):
        other = np.array([sum(1 << b for b in bits)], dtype=np.uint64).view(np.int64)
        assert set(G.golay_keys(one)[0]) & set(G.golay_keys(other)[0])


def test_fingerprint_matches_definition():
    for t in [None, "", "  \n", "One", "a b", "A  b\tc\x0bd", "É É é x y " * 50, "x " * 3000, " a b c", "a\x1cb c d e"]:
        assert G.fingerprint(t) == slow_fingerprint(t), t


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    base = [rng.choice(["la", "ti", "mo", "ra"]) + str(rng.randint(0, 400)) for _ in range(300)]
    rows = []
    for i in range(160):
        words = [rng.choice(["a", "b", "c"]) + str(rng.randint(0, 60)) for _ in range(40)] if i % 2 else list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "x" + str(rng.randint(0, 9))
        rows.append((1000 - i, " ".join(words), "n", 1))
    rows += [(2001, None, "n", 1), (2000, "", "n", 1), (5, "a b c", "n", 1), (5, "a b c", "n", 1), (None, "a b c", "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, key int")
    got = G.simhash_components(docs).collect()
    assert len(got) == len(rows)
    codes = [slow_fingerprint(r[1]) for r in rows]
    roots = brute_components(codes, 3)
    least = {}
    for r, k in zip(rows, roots):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    want = sorted((str(r[0]), np.array([c], dtype=np.uint64).view(np.int64)[0], least[k]) for r, c, k in zip(rows, codes, roots))
    assert sorted((str(r.doc_id), r.fp, r.component_id) for r in got) == want
    kept = G.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(set(least.values()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert G.simhash_components(docs).count() == 0
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1301)) and len(got) == 502


def test_near_codes_of_one_dense_key(spark):
    rng = np.random.default_rng(1)
    codes = np.unique(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 12, (900, 3), dtype=np.uint64), axis=1)).view(np.int64)
    keyed = spark.createDataFrame([(1, int(c)) for c in codes], "key bigint, code bigint")
    links = near_codes(keyed, 3)
    assert links.count() < len(codes)  # a forest, not all pairs
    got = {r.node: r.root for r in components(links).collect()}
    roots = brute_components([int(c) for c in codes], 3)
    assert len(set(got.values())) == len({r for r in roots if roots.count(r) > 1})


def test_runs_across_batches():
    rng = np.random.default_rng(0)
    key = np.sort(rng.integers(0, 12, 500))
    code = rng.integers(0, 1000, 500)
    for size in (1, 3, 50, 500):
        got = []
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(code[i : i + size])], ["key", "code"]) for i in range(0, 500, size)]
        for v, starts in runs(iter(batches), "key", "code"):
            got += [v[a:b].tolist() for a, b in zip(starts, [*starts[1:], len(v)])]
        assert got == [code[key == k].tolist() for k in np.unique(key)]
    assert list(runs(iter([]), "key", "code")) == []


def test_a_key_above_the_limit_is_searched_by_longer_keys(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(3))])).view(np.int64)
    keyed = spark.createDataFrame([(k, int(c)) for c in codes for k in (1, 2)] + [(3, 5), (3, 4), (9, 77)], "key bigint, code bigint")
    parts = lambda links: {(r.node, r.root) for r in components(links).collect()}
    whole = parts(near_codes(keyed, 3))
    assert whole == parts(near_codes(keyed, 3, limit=20)) and len(whole) > 200 and (5, 4) in whole


def test_runs_above_the_limit():
    rng = np.random.default_rng(0)
    key = np.sort(rng.integers(0, 6, 500))
    code = rng.integers(0, 10**6, 500)
    for size in (1, 7, 40, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(code[i : i + size])], ["key", "code"]) for i in range(0, 500, size)]
        seen = []
        for v, starts in runs(iter(batches), "key", "code", 30):
            assert v.size <= 30 + 2 * size or starts is not None
            seen += v.tolist()
        assert sorted(seen) == sorted(code.tolist())


def test_dropping_keeps_one_row_of_each_component(spark):
    """Repeated ids with different texts, rows without an id, clashing names, in any order of the rows."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a, 0, 0), (1, b, 0, 0), (2, b, 0, 0), (2, b, 0, 0), (None, a, 0, 0), (None, "its own text of five words", 0, 0), (None, "its own text of five words", 1, 0), (4, None, 0, 0), (5, "", 0, 0), (6, "A quite other text here now", 0, 0), (6, "A quite other text here now", 0, 0), (7, "word " * 40_000, 0, 0)]
    schema = "doc_id bigint, text string, kept_id int, row int"
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, schema).repartition(3)
        out = G.drop_near_duplicates(docs)
        assert out.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        assert got == sorted([(1, a), (1, b), (None, "its own text of five words"), (4, None), (6, "A quite other text here now"), (7, "word " * 40_000)], key=str)
    # one row a component, whatever the rows: against brute force
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([a, b, "x y z w v u", None]) if rng.random() < 0.7 else " ".join(rng.choice("abcdefgh") for _ in range(12)), rng.randint(0, 1), 0) for _ in range(80)]
    got = [(r.doc_id, r.text) for r in G.drop_near_duplicates(spark.createDataFrame(rows, schema)).collect()]
    codes = [slow_fingerprint(r[1]) for r in rows]
    roots = brute_components(codes, 3)
    of = dict(zip(codes, roots))
    assert sorted(of[slow_fingerprint(t)] for _, t in got) == sorted(set(roots))
    for d, t in got:
        ids = [r[0] for r, k in zip(rows, roots) if k == of[slow_fingerprint(t)] and r[0] is not None]
        assert d == (min(ids) if ids else None) and (d, t) in {(r[0], r[1]) for r in rows}
    assert G.drop_near_duplicates(spark.createDataFrame([], schema)).count() == 0
