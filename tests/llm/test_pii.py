import random
import re
from collections import Counter

import numpy as np
import pytest

from tidalframe.llm import bilstm_crf as P

BASE = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def slow_base(text):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (12 <= len(d) <= 19 and P.luhn(d)):
                continue
            if k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_patterns_against_the_definition():
    rng = random.Random(4)
    for alphabet in ("a.@_-é ", "0123.", "01 -4", "+1 ().-05", "a1.@+- ()4_%é"):
        for _ in range(1500):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert P.base_spans(t) == slow_base(t), t
    for t in ["4111 1111 1111 1111", "256.1.1.1 255.0.0.001 1.2.3.4.5.6.7.8", "a@b.com_x@d.e", "+49 (0)30 1234567", "x" * 200_000 + "@", "1" * 200_000, "+1" + " " * 100_000]:
        assert P.base_spans(t) == slow_base(t) if len(t) < 1000 else P.base_spans(t) == []


@pytest.fixture(scope="module")
def net(spark):
    """Trained on documents of sf0.01 with even ids."""
    return P.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 0"))


@pytest.fixture(scope="module")
def held(spark):
    return [r.text[:2500] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 10 = 3 and length(text) > 200").orderBy("doc_id").collect()]


def slow_tags(net, text):
    """One window decoder a window, emissions averaged place by place, one Viterbi over the whole text."""
    step = P.WINDOW - P.OVERLAP
    n = max(1, -(-(len(text) - P.OVERLAP) // step))
    sums, weights = np.zeros((len(text), 5)), np.zeros(len(text))
    for k in range(n):
        ids = np.full((1, P.WINDOW), 129, np.uint8)
        part = P.classes(text)[k * step : k * step + P.WINDOW]
        ids[0, : part.size] = part
        em = net.emissions(ids)[:, :, 0]
        for i in range(part.size):
            w = 1.0
            if k and i < P.OVERLAP:
                w = (i + 1) / (P.OVERLAP + 1)
            if k < n - 1 and i >= step:
                w = (P.WINDOW - i) / (P.OVERLAP + 1)
            sums[k * step + i] += w * em[i]
            weights[k * step + i] += w
    em, t = sums / weights[:, None], net.p["t"].astype(float)
    score, back = em[0].copy(), []
    for row in em[1:]:
        both = score[:, None] + t
        back.append(both.argmax(0))
        score = both.max(0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_tags_are_the_best_path_of_the_whole_text(net, held):
    rng = np.random.default_rng(5)
    texts = ["", "7", "1" * 900, "call 0049 30 1234567", "a@b.co " * 200] + [t[: int(rng.integers(1, 1800))] for t in held[:12]]
    texts += [t[:400] + " " + P.written(rng, k % 4) + " " + t[400:1300] for k, t in enumerate(held[:12])]
    for batch in (P.BATCH, 2):  # overlaps within a batch of windows and across two
        was, P.BATCH = P.BATCH, batch
        got = P.tag_texts(net, texts)
        P.BATCH = was
        for t, g in zip(texts, got):
            assert len(g) == len(t) and (not t or g.tolist() == slow_tags(net, t)), t
    assert P.tag_texts(net, []) == []


def test_spans_at_every_seam(net, held):
    """Data that only the network finds, wherever it lies about the borders of windows."""
    step = P.WINDOW - P.OVERLAP
    rng = np.random.default_rng(6)
    plain = " ".join(t for t in held[:8] if not P.base_spans(t))
    for kind, form in ((0, AT_DOT), (1, "[.]"), (2, "_"), (3, "(ddd) ddd-dddd")):
        data = P.written(rng, kind, form)
        hits = places = 0
        for at in [*range(step - 50, step + P.OVERLAP + 10, 3), *range(2 * step - 40, 2 * step + P.OVERLAP, 9)]:
            g = plain.rindex(" ", 0, at)
            text = plain[:g] + " " + data + " " + plain[g:]
            assert not P.base_spans(text)
            places += 1
            hits += (g + 1, kind, g + 1 + len(data)) in P.all_spans(text, P.tag_texts(net, [text])[0], [])
        assert hits >= 0.9 * places, (kind, hits, places)


AT_DOT = (" [at] ", " [dot] ")
UNSEEN = [(0, ("<at>", "<dot>")), (0, (" (at) ", ".")), (1, "{.}"), (1, "(dot)"), (1, " (.) "), (2, " / "), (3, "(0dd) dddd dddd"), (3, "+nd ddd dddd ddd"), (3, "0dd dddddddd")]


def test_recall_and_precision_by_kind(net, held):
    """Data planted in documents that the network hasn't seen, in forms it was trained on and in others."""
    rng = np.random.default_rng(7)
    added = wrong = 0
    for unseen in (False, True):
        hits, planted = Counter(), Counter()
        forms = UNSEEN if unseen else [(k, f) for k, fs in enumerate((P.AT_DOT, P.IP_SEPARATORS, P.CARD_SEPARATORS, P.PHONES)) for f in fs]
        for kind, form in forms:
            for t in rng.choice(held, 25, replace=False):
                gaps = [i for i, c in enumerate(t) if c == " "]
                g, data = int(rng.choice(gaps)), P.written(rng, kind, form)
                text = t[:g] + " " + data + t[g:]
                base = P.base_spans(text)
                found = P.all_spans(text, P.tag_texts(net, [text])[0], base)
                assert set(base) <= set(found)
                ours = [s for s in found if s[0] < g + 1 + len(data) and s[2] > g + 1]
                planted[kind] += 1
                hits[kind] += any(k == kind and min(b, g + 1 + len(data)) - max(a, g + 1) >= 0.7 * len(data) for a, k, b in ours)
                added += len(found) - len(base)
                wrong += len([s for s in found if s not in base and s not in ours])
        assert all(hits[k] >= 0.9 * planted[k] for k in range(4)), (unseen, hits, planted)
    assert wrong < 0.1 * added


def test_spans_of_a_table(spark, net):
    docs = spark.createDataFrame([(1, None, 0), (1, None, 0), (2, "", 0), (None, "é a@b.co", 0), (3, "x" * 50_000 + " 1.2.3.4", 0)], "doc_id bigint, text string, spans int")
    got = {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.base)) for r in P.find_personal_data(docs, net).collect()}
    assert got == {(1, ()), (2, ()), (None, (("email", 2, 8),)), (3, (("ip", 50_001, 50_008),))}
    for r in P.find_personal_data(docs, net).collect():
        assert set(r.base) <= set(r.spans)
    assert P.find_personal_data(docs.limit(0), net).count() == 0 and P.train(docs.limit(0)) is None


def test_gradient():
    net = P.BiLstmCrf(3)
    rng = np.random.default_rng(2)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    ids, tags = rng.integers(90, 100, (5, 12)), rng.integers(0, 5, (5, 12))
    _, g = net.loss_gradient(ids, tags)
    for k, i in (("uf", (3, 2)), ("ub", (20, 1)), ("xb", (5, 95)), ("t", (0, 1)), ("ob", (1, 2)), ("bf", (7, 0)), ("e", (2, 0))):
        was = net.p[k][i]
        both = []
        for step in (1e-2, -1e-2):
            net.p[k][i] = was + step
            both.append(net.loss_gradient(ids, tags)[0])
        net.p[k][i] = was
        assert abs((both[0] - both[1]) / 2e-2 - g[k][i]) < 2e-3 + 0.02 * abs(g[k][i]), k


def test_whole_table_keeps_base_spans(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in P.op9_query(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base = slow_base(r.text or "")
        out = got[r.doc_id]
        assert [out.n_email, out.n_ip, out.n_card, out.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        joined = ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert out.base_sha256 == __import__("hashlib").sha256(joined.encode()).hexdigest()
        assert {f"{P.KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(out.spans.split(","))
