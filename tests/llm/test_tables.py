import random

import numpy as np
from pyspark.sql import functions as F

from tidalframe.llm import perspectives, string_tiling, topk_norm, warc_revisits


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(700):
        v = rng.normal(size=8) * rng.choice([0.01, 0.3, 2.0])
        rows.append((i, [float(x) for x in v], 1.0))
    rows += [(700 + i, rows[3][1], 1.0) for i in range(40)]  # ties
    rows += [(800, None, 1.0), (801, [1.0, None] + [0.0] * 6, 1.0), (802, [float("nan")] + [0.0] * 7, 1.0), (803, [float("inf")] * 8, 1.0), (850, [0.0] * 8, 1.0), (900, [1.0, 2.0], 1.0), (901, [3.0, 1.0], 1.0), (None, [1.0] * 8, 1.0), (5, rows[5][1], 1.0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score double").repartition(3)
    got = sorted(map(tuple, topk_norm.norm_bucket_topk(df.where("vec_id % 50 = 0"), df, 5).collect()))
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in ok if i % 50 == 0}.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:5])]
    assert got == sorted(want)
    assert topk_norm.norm_bucket_topk(df.limit(0), df, 5).count() == 0
    assert topk_norm.norm_bucket_topk(df.where("vec_id % 50 = 0"), df.limit(0), 5).count() == 0


def test_topk_huge_components(spark):
    df = spark.createDataFrame([(0, [3e12, 1.0]), (1, [4e3, -2.0]), (2, [-4e3, 0.0])], "vec_id bigint, embedding array<double>")
    got = topk_norm.norm_bucket_topk(df.where("vec_id = 0"), df).collect()
    a = 256 * 3 * 10**12
    assert [(r.vec_id, r.score) for r in got] == [(1, min(2**63 - 1, a * 1024000 - 256 * 512)), (2, max(-(2**63), -a * 1024000))]


def test_topk_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)], "vec_id bigint, embedding array<double>")
    whole = sorted(map(tuple, topk_norm.norm_bucket_topk(df.where("vec_id % 5 = 0"), df).collect()))
    monkeypatch.setattr(topk_norm, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk_norm, "SEED_ROWS", 40)
    assert sorted(map(tuple, topk_norm.norm_bucket_topk(df.where("vec_id % 5 = 0"), df).collect())) == whole


def test_topk_skips_short_buckets(spark, monkeypatch):
    """A block reads no bucket that is too short for all of its queries; within one, queries are pruned by coordinates or lengths."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (3.0 if i % 100 == 0 else 0.02)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    pool = topk_norm.in_buckets(df)
    buckets = sorted(((r.longest, r.shortest, r.n) for r in pool.groupBy("bucket").agg(F.max("length").alias("longest"), F.min("length").alias("shortest"), F.count("*").alias("n")).collect()), reverse=True)
    assert sum(b[2] for b in buckets) == 6000 and all(a[1] >= b[0] for a, b in zip(buckets, buckets[1:])) and max(b[2] for b in buckets) <= topk_norm.BUCKET_ROWS
    seen, was = [], topk_norm._pass
    monkeypatch.setattr(topk_norm, "_pass", lambda pool, ask, k, need: seen.append((need, len(buckets), sum(b[0] >= need for b in buckets))) or was(pool, ask, k, need))
    out = topk_norm.norm_bucket_topk(df.where("vec_id % 300 = 7"), df).count()
    assert out == 100 and len(seen) == 1 and seen[0][2] <= 2 < seen[0][1] - 8


def test_perspectives(spark):
    rng = random.Random(1)
    rows = [(c, t, r, x, 0) for c in (1, 2, None) for t, r, x in [(0, "ann", "hi"), (1, "bob", "héllo\n"), (1, "bob", "héllo\n"), (2, None, None), (None, "cy", "早"), (3, "system", "be kind"), (4, "x|>\n<|y", "so <|assistant|x|> said")]]
    rows += [(9, t * 50, rng.choice(["a", "b", "c"]), str(t), 0) for t in range(300)] + [(9, 77, "a", "same turn", 0)] * 5 + [(8, 0, "system", "alone", 0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, chunk int")
    safe = lambda x: x.replace("<|", "<\\|")
    for most in (perspectives.MAX_CHARS, 700):
        out = perspectives.rotate_perspectives(df, most).collect()
        assert not any(r.conv_id == 8 for r in out)
        for conv in (1, 2, None, 9):
            mine = [r for r in rows if r[0] == conv]
            mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or ""))
            who = sorted({r[2] or "unknown" for r in mine} - {"system"})
            assert who == sorted({r.perspective for r in out if r.conv_id == conv})
            for p in who:
                parts = sorted((r for r in out if r.conv_id == conv and r.perspective == p), key=lambda r: (r.chunk, r.part))
                assert len(parts) == 1 if most > 1000 or conv != 9 else len(parts) > 5  # 305 messages in one row
                assert [m for r in parts for m in zip(r.names, r.contents, r.mask)] == [(r[2] or "unknown", r[3] or "", int((r[2] or "unknown") == p)) for r in mine]
                for r in parts:
                    assert r.roles == ["assistant" if n == p else "system" if n == "system" else "user" for n in r.names]
                    assert r.text == "".join(f"<|{role}|{safe(n).replace('|>', '|' + chr(92) + '>')}|>\n{safe(c)}\n" for role, n, c in zip(r.roles, r.names, r.contents))
                    spans = [r.text[int(a) : int(b)] for a, b in (s.split(":") for s in r.spans.split(",") if s)]
                    assert spans == [safe(c) for c, m in zip(r.contents, r.mask) if m]
                    assert most > 1000 or len(r.text) < 2 * most
    assert perspectives.rotate_perspectives(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def slow_revisit(r, rows):
    if r[1] is None or r[2] is None:
        return None
    past = [x for x in rows if x[3] in (200, 203) and x[1] == r[1] and x[2] is not None and x[2] < r[2]]
    return max(past, key=lambda x: (x[2], x[0]), default=None)


def test_revisits(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        url = rng.choice(["http://h.org/x", "http://h.org/y", "http://k.org/z", None])
        status = rng.choice([200, 203, 304, 404])
        h = rng.choice([None, {"ETag": rng.choice(['"a"', 'W/"a"', '"b"']), "Content-Length": str(i), "X": str(i)}, {"Last-Modified": rng.choice(["m", "n"]), "date": "d", "DATE": "e"}, {"Vary": None}])
        rows.append((i, url, rng.choice([None, rng.randint(0, 400_000)]) if i % 9 else 100, status, h, "clash"))
    df = spark.createDataFrame(rows, "record_id bigint, url string, captured_at bigint, status int, headers map<string,string>, bucket string")
    got = {r.record_id: r for r in warc_revisits.resolve_revisits(df).collect()}
    assert sorted(got) == [r[0] for r in rows if r[3] == 304]
    for r in rows:
        if r[3] == 304:
            src, out = slow_revisit(r, rows), got[r[0]]
            assert out.source_id == (src and src[0]), r
            if src is None:
                assert out.outcome == "orphan" and out.headers is None
                continue
            low = lambda h: {k.lower(): v for k, v in reversed(list((h or {}).items())) if v is not None}
            a, b = low(r[4]), low(src[4])
            kind = "etag" if "etag" in a and "etag" in b else "last-modified" if "last-modified" in a and "last-modified" in b else None
            want = "unverified" if kind is None else "resolved" if a[kind].removeprefix("W/") == b[kind].removeprefix("W/") else "mismatch"
            assert out.outcome == want
            if want == "mismatch":
                assert out.headers is None
            else:
                assert out.headers == {**b, **{k: v for k, v in a.items() if k != "content-length"}}
    assert warc_revisits.resolve_revisits(df.limit(0)).count() == 0


def test_canonical_urls(spark):
    cases = {
        "HTTP://Ex.org:80/a?utm_source=x&b=1#f": "ex.org/a?b=1", "https://ex.org/a?b=1": "ex.org/a?b=1", "ex.org": "ex.org/", "http://ex.org/?utm_a=1": "ex.org/", None: None, "": "/",
        "http://h.org:443/a": "h.org:443/a", "https://h.org:443/a": "h.org/a", "https://h.org:80/a": "h.org:80/a", "http://u:p@H.org.:8080/": "h.org:8080/",
        "http://h/a/./b/../c": "h/a/c", "http://h/../../x/..": "h/", "http://h/a/.": "h/a/", "http://h/a..b/.c": "h/a..b/.c",
        "http://h/?b=2&&a=1&utm_x=&b=1": "h/?a=1&b=1&b=2", "http://h/%7euser/%2f%zz%e4?q=%41%3d": "h/~user/%2F%zz%E4?q=A%3D", "http://h/100%": "h/100%", "http://h/%2e%2E/x": "h/x",
    }
    urls = list(cases)
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc_revisits.canonical_url(__import__("pyspark").sql.functions.col("u"))).collect()]
    assert got == list(cases.values())


def test_registered_revisits_show_each_outcome(spark):
    got = {r[0]: r[1] for r in warc_revisits.op2_query(spark, "/root/testdata/sf0.001").groupBy("outcome").count().collect()}
    assert set(got) == {"resolved", "unverified", "mismatch", "orphan"}, got


def slow_tiles(item, doc, least):
    """Greedy string tiling by its definition."""
    mi, md, tiles = set(), set(), []
    while True:
        best = []
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in mi and d + n not in md:
                    n += 1
                if n >= least:
                    best.append((-n, i, d))
        if not best:
            return tiles
        n, i, d = min(best)
        tiles.append((i, d, -n))
        mi.update(range(i, i - n))
        md.update(range(d, d - n))


def test_tiling_against_definition():
    rng = random.Random(11)
    for _ in range(150):
        item = [rng.randint(0, 30) for _ in range(rng.randint(5, 40))]
        doc = [rng.randint(0, 30) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            a = rng.randrange(len(item))
            at = rng.randint(0, len(doc))
            doc[at:at] = item[a : a + rng.randint(1, 30)]
        got = string_tiling.tile(np.array(item), np.array(doc, dtype=np.int64))
        want = slow_tiles(item, doc, 5)
        assert sorted(x[2] for x in got) == sorted(x[2] for x in want)
        for i, d, n in got:
            assert item[i : i + n] == doc[d : d + n]


def test_reordered_passage_is_caught(spark):
    words = [f"w{i}" for i in range(40)]
    moved = " ".join(words[20:40] + ["between"] * 5 + words[:20])
    docs = spark.createDataFrame([(1, "start " + moved + " end", 0), (2, "clean text " * 20, 0), (3, None, 0), (4, "", 0), (5, " ".join(words[:10]), 0), (6, "short one here", 0), (1, moved.upper(), 0)], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(7, " ".join(words), "x"), (8, None, "x"), (9, "", "x"), (10, "one here", "x")], "item_id bigint, text string, doc_id string")
    got = sorted(map(tuple, string_tiling.tiled_items(docs, bench).collect()))
    assert got == [(1, 7, 2, 40, 1.0), (1, 7, 2, 40, 1.0), (6, 10, 1, 2, 1.0)]
    kept = string_tiling.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert string_tiling.tiled_items(docs, bench.limit(0)).count() == 0 and string_tiling.tiled_items(docs.limit(0), bench).count() == 0
    assert string_tiling.drop_contaminated(docs, bench.limit(0)).count() == 7
