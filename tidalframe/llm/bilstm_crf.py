"""Personal data by fixed patterns and a character BiLSTM with CRF transitions, trained in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WINDOW, OVERLAP = 512, 64  # characters
BATCH = 640  # windows
HIDDEN = 8  # of each direction
TRAIN_DOCS = 400  # documents that training pieces come from, in expectation
TRAIN_PIECES = 8  # at most of each: of known spans, of other digits, of any text
TRAIN_WINDOWS = 12_000
TRAIN_LENGTH = 96
STEPS = 640

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Matches of local@domain: each @ has one possible local part, the run of its characters before it."""
    at, pos = text.find("@"), 0
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        pos = m.end() if m else at + 1
        at = text.find("@", pos)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted; matches that fail a check are dropped whole."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the network -------------------------------------------------------------

_CLASS = np.full(129, 128, np.uint8)
_CLASS[:128] = np.arange(128)
_CLASS[65:91] = np.arange(97, 123)  # letters without case
_CLASS[49:58] = 49  # digits but 0 as one: 0 and 00 lead phone numbers
_CLASS[[ord(c) for c in "[{<"]] = ord("(")  # brackets as round ones
_CLASS[[ord(c) for c in "]}>"]] = ord(")")


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(points, 128)]


class BiLstmCrf:
    """Tags: 0 for none, 1 + kind number. Arrays are (features, windows), so that each gate is one stretch of memory."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, len(KINDS) + 1
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (4 * h, 130)).astype(np.float32)  # by character class; 129: beyond the text
            self.p["u" + d] = rng.normal(0, 0.3, (4 * h, h)).astype(np.float32)
            self.p["b" + d] = np.zeros((4 * h, 1), np.float32)
            self.p["b" + d][h : 2 * h] = 0.5  # of i, f, o, g in turn: remembers at first
            self.p["o" + d] = rng.normal(0, 0.3, (k, h)).astype(np.float32)
        self.p["e"] = np.zeros((k, 1), np.float32)
        self.p["t"] = np.zeros((k, k), np.float32)
        self._fast = None

    def __getstate__(self):
        return {"p": self.p, "_fast": None}

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(length, tags, windows) of (windows, length) character classes."""
        if self._fast is None:  # sigmoid(x) = (1 + tanh(x / 2)) / 2: one tanh serves all gates
            half = np.ones((4 * HIDDEN, 1), np.float32)
            half[: 3 * HIDDEN] = 0.5
            # h comes out doubled, so what is multiplied with it is halved: exact, as all are powers of two
            self._fast = {d: (np.ascontiguousarray((self.p["x" + d] + self.p["b" + d]) * half), np.ascontiguousarray(self.p["u" + d] * half * np.float32(0.5)), self.p["o" + d] * np.float32(0.5)) for d in "fb"}
        n, length = ids.shape
        turned = np.ascontiguousarray(ids.T)
        out = np.empty((length, len(KINDS) + 1, n), np.float32)
        out[:] = self.p["e"]
        h3 = 3 * HIDDEN
        a, tmp = np.empty((4 * HIDDEN, n), np.float32), np.empty((4 * HIDDEN, n), np.float32)
        e, small = np.empty(out.shape[1:], np.float32), np.empty((HIDDEN, n), np.float32)
        for d in "fb":
            x, u, o = self._fast[d]
            h, c = np.zeros((HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
            for t in range(length) if d == "f" else range(length - 1, -1, -1):
                np.take(x, turned[t], axis=1, out=a, mode="clip")
                np.matmul(u, h, out=tmp)
                a += tmp
                np.tanh(a, out=a)
                gates = a[:h3]
                gates += 1  # twice the gates
                c *= a[HIDDEN : 2 * HIDDEN]
                np.multiply(a[:HIDDEN], a[h3:], out=small)
                c += small
                c *= 0.5
                np.tanh(c, out=h)
                h *= a[2 * HIDDEN : h3]
                np.matmul(o, h, out=e)
                out[t] += e
        return out

    def gains(self) -> np.ndarray:
        """For each tag but none: the most that the two transitions at one place can add over those of none."""
        t = self.p["t"].astype(np.float64)
        return np.array([(t[:, k] - t[:, 0]).max() + (t[k] - t[0]).max() for k in range(1, len(t))])

    def may_gain(self, em: np.ndarray, begin: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which places of stretches (starting at begin) lie in a run of tags whose bound on its gain over none isn't negative: the largest sum over a run through the place."""
        t = self.p["t"].astype(np.float64)
        t = t - t[0, 0]
        enter, leave, stay = t[0, 1:].max(), t[1:, 0].max(), t[1:, 1:].max()
        d = em[:, 1:].max(1) - em[:, 0] + stay
        d = d + first * max(0.0, -enter) + last * max(0.0, -leave)  # no transition leads into or out of a text
        wall = np.zeros(len(d))
        wall[begin] = 1e5 + np.abs(d).max()  # no run crosses from stretch to stretch
        total = np.cumsum(d - wall)
        before = total - d  # just inside the wall
        into = total - np.minimum.accumulate(before)
        onward = np.maximum.accumulate(total[::-1])[::-1] - before
        return into + onward - d + enter + leave - stay > -1e-2

    def search(self, em: np.ndarray, lengths: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Best tags of stretches of places between places tagged none; stretches one after another in em (places, tags).

        first, last: whether a stretch begins or ends its text, where no transition leads in or out.
        """
        t = self.p["t"].astype(np.float64)
        order = np.argsort(-lengths, kind="stable")
        size, start = lengths[order], (np.cumsum(lengths) - lengths)[order]
        out = np.zeros(len(em), np.uint8)
        at = 0
        while at < len(order):  # stretches of similar lengths together, about a million cells at once
            n = int(max(1, min(len(order) - at, 1_000_000 // size[at])))
            top, st, sz = int(size[at]), start[at : at + n], size[at : at + n]
            back = np.zeros((top, n, len(t)), np.uint8)
            score = em[st] + np.where(first[order[at : at + n]], 0.0, 1.0)[:, None] * t[0]
            for i in range(1, top):
                k = int(np.searchsorted(-sz, -i))  # stretches with a place i
                step = score[:k, :, None] + t
                back[i, :k] = step.argmax(1)
                score[:k] = step.max(1) + em[st[:k] + i]
            tag = (score + np.where(last[order[at : at + n]], 0.0, 1.0)[:, None] * t[:, 0]).argmax(1)
            for i in range(top - 1, -1, -1):
                k = int(np.searchsorted(-sz, -i))
                out[st[:k] + i] = tag[:k]
                if i:
                    tag[:k] = back[i, np.arange(k), tag[:k]]
            at += n
        return out

    def loss_gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tag sequences, and its gradient."""
        n, length = ids.shape
        hs, p = HIDDEN, self.p
        sig = lambda v: 1 / (1 + np.exp(-v))
        em = np.broadcast_to(p["e"], (length, *p["e"].shape)).repeat(n, axis=2).astype(np.float32)
        kept = {}
        for d in "fb":
            h, c = np.zeros((hs, n), np.float32), np.zeros((hs, n), np.float32)
            kept[d] = []
            for t in range(length) if d == "f" else range(length - 1, -1, -1):
                a = p["x" + d][:, ids[:, t]] + p["u" + d] @ h + p["b" + d]
                i, f, o, g = sig(a[:hs]), sig(a[hs : 2 * hs]), sig(a[2 * hs : 3 * hs]), np.tanh(a[3 * hs :])
                old = h, c
                c = f * c + i * g
                tc = np.tanh(c)
                h = o * tc
                em[t] += p["o" + d] @ h
                kept[d].append((t, i, f, o, g, tc, h, old))
        # CRF: forward and backward in log space
        tr = p["t"]
        alpha = np.empty_like(em)
        alpha[0] = em[0]
        add = lambda v, ax: np.log(np.exp(v - (m := v.max(ax, keepdims=True))).sum(ax)) + m.squeeze(ax)
        for t in range(1, length):
            alpha[t] = add(alpha[t - 1][:, None] + tr[:, :, None], 0) + em[t]
        z = add(alpha[-1], 0)
        beta = np.zeros_like(em)
        dt = np.zeros_like(tr)
        cols = np.arange(n)
        gold = em[0][tags[:, 0], cols].copy()
        for t in range(length - 2, -1, -1):
            ahead = em[t + 1] + beta[t + 1]
            pair = np.exp(alpha[t][:, None] + tr[:, :, None] + ahead[None] - z)
            dt += pair.sum(2)
            np.add.at(dt, (tags[:, t], tags[:, t + 1]), -1)
            gold += em[t + 1][tags[:, t + 1], cols] + tr[tags[:, t], tags[:, t + 1]]
            beta[t] = add(tr[:, :, None] + ahead[None], 1)
        de = np.exp(alpha + beta - z)
        for t in range(length):
            de[t][tags[:, t], cols] -= 1
        de /= n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["t"], g["e"] = dt / n, de.sum((0, 2))[:, None]
        for d in "fb":
            steps, das = [], []
            dh, dc = np.zeros((hs, n), np.float32), np.zeros((hs, n), np.float32)
            for t, i, f, o, gg, tc, h, (h0, c0) in reversed(kept[d]):
                g["o" + d] += de[t] @ h.T
                dh = dh + p["o" + d].T @ de[t]
                dc = dc + dh * o * (1 - tc * tc)
                da = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)])
                g["b" + d] += da.sum(1, keepdims=True)
                g["u" + d] += da @ h0.T
                steps.append(t)
                das.append(da)
                dh, dc = p["u" + d].T @ da, dc * f
            at, das = ids[:, steps].T.ravel(), np.stack(das, 1).reshape(4 * hs, -1)
            g["x" + d] += np.stack([np.bincount(at, row, 130) for row in das])
        return float((z - gold).mean()), g

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = STEPS, batch: int = 96, rate: float = 0.02, seed: int = 0) -> float:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        loss = 0.0
        for s in range(1, steps + 1):
            rows = rng.integers(0, len(ids), batch)
            loss, g = self.loss_gradient(ids[rows], tags[rows])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k, x in g.items():
                x = x * min(1.0, 5.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                fall = rate * (1 - 0.9 * s / steps)
                self.p[k] = (self.p[k] - fall * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)).astype(np.float32)
        self._fast = None
        return loss


_UP = ((np.arange(OVERLAP) + 1) / (OVERLAP + 1)).astype(np.float32)[:, None, None]


def reconciled(net: BiLstmCrf, texts: list[str]):
    """Yields (places, emissions) of stretches of the texts laid end to end, all places in order.

    Windows overlap; in an overlap the emissions of both are averaged, each
    weighing more the farther its place lies from its edge.
    """
    step = WINDOW - OVERLAP
    counts = [max(1, -(-(len(t) - OVERLAP) // step)) if t else 0 for t in texts]
    offset = np.cumsum([0, *map(len, texts)])
    of = np.repeat(np.arange(len(texts)), counts)
    number = np.concatenate([np.arange(n) for n in counts]) if len(of) else of
    more = number < np.repeat(counts, counts) - 1  # another window of the text follows
    coded, held = (-1, None), None
    for at in range(0, len(of), BATCH):
        stop = min(at + BATCH, len(of))
        ids = np.full((stop - at, WINDOW), 129, np.uint8)
        for r in range(at, stop):
            if coded[0] != of[r]:
                coded = of[r], classes(texts[of[r]])
            part = coded[1][number[r] * step : number[r] * step + WINDOW]
            ids[r - at, : part.size] = part
        em = net.emissions(ids)
        joins, goes = np.flatnonzero(number[at:stop] > 0), np.flatnonzero(more[at:stop])
        em[:OVERLAP, :, joins] *= _UP
        em[-OVERLAP:, :, goes] *= _UP[::-1]
        if held is not None:
            em[:OVERLAP, :, 0] += held
        inner = joins[joins > 0]
        em[:OVERLAP, :, inner] += em[-OVERLAP:, :, inner - 1]
        held = em[-OVERLAP:, :, -1].copy() if more[stop - 1] else None
        begin = offset[of[at:stop]] + number[at:stop] * step
        own = np.where(more[at:stop], step, offset[of[at:stop] + 1] - begin)
        row = np.repeat(np.arange(stop - at), own)
        col = np.arange(row.size) - np.repeat(np.cumsum(own) - own, own)
        yield begin[row] + col, em[col, :, row]


def tag_texts(net: BiLstmCrf, texts: list[str]) -> list[np.ndarray]:
    """Tags of every character of whole texts: the best path of each text as a whole, over the reconciled emissions of its windows.

    A place where none beats each tag by more than the transitions about it can
    add is none on the best path, whatever lies beside it; so is a place in no
    run of tags that could gain on none. The search runs over the stretches
    between such places only, and finds the path of the whole text.
    """
    offset = np.cumsum([0, *map(len, texts)])
    tags = np.zeros(offset[-1], np.uint8)
    ends = np.zeros(offset[-1] + 1, bool)
    ends[offset] = True  # where a text starts, and the last one ends
    gain = net.gains() + 1e-3
    places, kept = [np.empty(0, np.int64)], [np.empty((0, len(KINDS) + 1))]
    for at, em in reconciled(net, texts):
        open_ = (em[:, 1:].max(1) + gain.max() > em[:, 0]).nonzero()[0]
        open_ = open_[(em[open_, 1:] + gain > em[open_, :1]).any(1)]
        places.append(at[open_])
        kept.append(em[open_].astype(np.float64))
    places, kept = np.concatenate(places), np.concatenate(kept)
    starts = lambda p: np.flatnonzero(np.concatenate([[True], (np.diff(p) > 1) | ends[p[1:]]])) if p.size else np.empty(0, np.int64)
    if places.size:
        may = net.may_gain(kept, starts(places), ends[places], ends[places + 1])
        places, kept = places[may], kept[may]
    if places.size:
        begin = starts(places)
        lengths = np.diff(np.append(begin, places.size))
        tags[places] = net.search(kept, lengths, ends[places[begin]], ends[places[begin + lengths - 1] + 1])
    return [tags[a:b] for a, b in zip(offset, offset[1:])]


_AT = re.compile(r"@|\bat\b|_at_", re.I)
_DOT = re.compile(r"\.|\bdot\b|_dot_", re.I)
_WORD = re.compile(r"\w")
_LETTERS = re.compile(r"[^\W\d_]")


def plausible(kind: int, span: str) -> bool:
    """Whether a tagged run can be of its kind: an email names its @ and a dot after it, an address has four parts of at most 255, the others hold no letters and as many digits as their kind has."""
    digits = "".join(_DIGIT.findall(span))
    if kind == 0:
        first = _WORD.search(span)
        at = _AT.search(span, first.end()) if first else None
        dots = list(_DOT.finditer(span, at.end())) if at else ()
        return bool(dots) and _WORD.search(span, at.end(), dots[-1].start()) is not None and _WORD.search(span, dots[-1].end()) is not None
    if kind == 1:
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not _LETTERS.search(re.sub(r"\bdot\b", "", span, flags=re.I))
    if _LETTERS.search(span):
        return False
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def all_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and the plausible runs of one tag that overlap none of them; a run's ends move out to the ends of the words they lie in, then past white space and closing marks."""
    out = list(base)
    hot = np.flatnonzero(tags)
    if hot.size:
        cut = np.flatnonzero((np.diff(hot) > 1) | (np.diff(tags[hot].astype(int)) != 0)) + 1
        near, taken = 0, 0  # base spans end before the run; where the last added span ended
        for run in np.split(hot, cut):
            a, b = int(run[0]), int(run[-1]) + 1
            while a > taken and text[a].isalnum() and text[a - 1].isalnum():
                a -= 1
            while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
                b += 1
            while a < b and not (text[a].isalnum() or text[a] in "(+"):
                a += 1
            while a < b and not text[b - 1].isalnum():
                b -= 1
            while near < len(base) and base[near][0] < a and base[near][2] <= a:
                near += 1
            kind = int(tags[run[0]]) - 1
            if a < b and a >= taken and plausible(kind, text[a:b]) and not any(a < e and x < b for x, _, e in base[near:]):
                out.append((a, kind, b))
                taken = b
    return sorted(out)


# ---- training ----------------------------------------------------------------

#: Ways of writing @ and dot (the two at one place go together), of parting the numbers of an address, and of parting the groups of a card.
AT_DOT = [("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" @ ", " . "), (" at ", "."), ("{at}", "{dot}"), (" @ ", " dot ")]
IP_SEPARATORS = [".", " . ", "[.]", "(.)", " dot ", "[dot]", " [.] "]
CARD_SEPARATORS = ["", " ", "-", ".", "_", " - ", "/", " . "]
#: Phone numbers: d stands for a digit, n for one from 1 to 9.
PHONES = ["+d (ddd) ddd-dddd", "(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "ndd ddd dddd", "00nd ddd ddddddd", "00nd dd dddddddd", "00nd (0)dd dddddddd", "0ddd/dddddd", "0ddd dddddd", "d-ddd-ddd-dddd", "(ddd)ddd-dddd", "00ndddddddddd", "0dd-dddd-dddd"]
#: Numbers that are nobody's data.
OTHERS = ["20dd-0n-0d", "0d:dd:dd", "d.d.d", "dddd", "ddd,ddd.dd", "n.ddd", "dddddddddddddddddd", "$dd.dd", "page ddd", "dd/dd/20dd", "v0.dd.d", "dd%"]


def _filled(rng: np.random.Generator, form: str) -> str:
    return "".join(str(rng.integers(0, 10)) if c == "d" else str(rng.integers(1, 10)) if c == "n" else c for c in form)


def card_number(rng: np.random.Generator, separator: str) -> str:
    body = str(rng.choice(["4", "5", "6"])) + _filled(rng, "d" * 14)
    body += next(c for c in "0123456789" if luhn(body + c))
    return separator.join(body[i : i + 4] for i in range(0, 16, 4))


def written(rng: np.random.Generator, kind: int, form=None) -> str:
    """A made-up piece of data of a kind, in a form of the lists above or the one given."""
    name = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwz"), rng.integers(3, 9)))
    pick = lambda forms: forms[int(rng.integers(0, len(forms)))] if form is None else form
    if kind == 0:
        at, dot = pick(AT_DOT)
        local = name() + (str(rng.choice([".", "_", "-", dot])) + name() if rng.random() < 0.4 else "") + _filled(rng, "d" * int(rng.integers(0, 3)))
        return local + at + name() + (dot + name() if rng.random() < 0.2 else "") + dot + str(rng.choice(["com", "org", "net", "de", "io", "info"]))
    if kind == 1:
        return pick(IP_SEPARATORS).join(str(x) for x in rng.integers(1, 255, 4))
    return card_number(rng, pick(CARD_SEPARATORS)) if kind == 2 else _filled(rng, pick(PHONES))


_NUMBERS = re.compile(r"[0-9a-f]{12,}|[0-9]{3,}")


def pieces(text: str, seed: int) -> list[tuple[int, str, list[tuple[int, int, int]]]]:
    """(sort, piece, base spans within it) of a text: TRAIN_PIECES at most about base spans (0), at other numbers (1), anywhere (2)."""
    rng = np.random.default_rng(seed % (1 << 32))
    base = base_spans(text)
    marks = [a for a, _, _ in base], [m.start() for m in _NUMBERS.finditer(text)], range(0, max(1, len(text) - 40))
    out = []
    for sort, places in enumerate(marks):
        for i in rng.choice(len(places), min(len(places), TRAIN_PIECES), replace=False) if len(places) else ():
            at = max(0, int(places[int(i)]) - (int(rng.integers(0, 60)) if sort < 2 else 0))
            part = text[at : at + TRAIN_LENGTH]
            out.append((sort, part, [(max(0, a - at), k, min(b - at, len(part))) for a, k, b in base if b > at and a < at + len(part)]))
    return out


def training_windows(found: list[tuple[int, str, list[tuple[int, int, int]]]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: pieces as they are, and pieces with written-out data, or with numbers that are nobody's, put between their words."""
    ids = np.full((TRAIN_WINDOWS, TRAIN_LENGTH), 129, np.uint8)
    tags = np.zeros(ids.shape, np.uint8)
    by_sort = [[p for p in found if p[0] == sort] or found for sort in range(3)]
    for r in range(TRAIN_WINDOWS):
        way = r % 8  # 0, 1: base spans; 2: numbers; 3: any; 4 to 6: written-out data; 7: other numbers put in
        of = by_sort[0 if way < 2 else 1 if way == 2 else 2]
        _, part, spans = of[int(rng.integers(0, len(of)))]
        mark = np.zeros(len(part), np.uint8)
        for a, k, b in spans:
            mark[a:b] = k + 1
        if way > 3:
            gaps = [m.start() for m in re.finditer(r"\s|$", part)]
            g = int(rng.choice(gaps[: max(1, len(gaps) * 2 // 3)]))
            if g == len(mark) or not mark[g]:
                k = int(rng.integers(0, 4)) if way < 7 else -1
                new = written(rng, k) if k >= 0 else _filled(rng, OTHERS[int(rng.integers(0, len(OTHERS)))])
                tail = str(rng.choice(["", "", ".", ",", ")", ";", "\n"]))
                part = part[:g] + " " + new + tail + part[g:]
                mark = np.concatenate([mark[:g], [0], np.full(len(new), k + 1, np.uint8), np.zeros(len(tail), np.uint8), mark[g:]])
        c = classes(part)[:TRAIN_LENGTH]
        ids[r, : c.size] = c
        tags[r, : c.size] = mark[: c.size]
    return ids, tags


def train(docs: DataFrame, seed: int = 0) -> BiLstmCrf | None:
    """Fits the network to pieces of about TRAIN_DOCS documents, chosen by a hash of their texts; None without any text.

    The pieces are cut in the tasks: the driver gets 3 * TRAIN_PIECES of TRAIN_LENGTH characters a document at most, however long the texts.
    """
    known = docs.select(F.col("text").cast("string").alias("text")).where("length(text) > 0").withColumn("h", F.xxhash64("text", F.lit("pii")))
    n = known.count()
    if not n:
        return None
    share = int(min(1.0, TRAIN_DOCS / n) * 2**31)
    kind = "array<struct<sort:int,part:string,spans:array<struct<start:int,kind:int,end:int>>>>"

    def run(batches):
        as_row = lambda p: {"sort": p[0], "part": p[1], "spans": [dict(zip(("start", "kind", "end"), x)) for x in p[2]]}
        shape = pa.list_(pa.struct([("sort", pa.int32()), ("part", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])))]))
        for b in batches:
            rows = [[as_row(p) for p in pieces(t, h)] for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, shape)], ["h", "pieces"])

    cut = known.where(F.pmod("h", F.lit(2**31)) < share).mapInArrow(run, f"h bigint, pieces {kind}").dropDuplicates(["h"])
    rows = sorted(cut.collect(), key=lambda r: r.h)
    found = [(p.sort, p.part, [(s.start, s.kind, s.end) for s in p.spans]) for r in rows for p in r.pieces]
    net = BiLstmCrf(seed)
    net.fit(*training_windows(found or [(2, "no text", [])], np.random.default_rng(seed)))
    return net


def find_personal_data(docs: DataFrame, net: BiLstmCrf | None) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (kind, start, end) in code points, end exclusive, by start, then kind.

    base: the fixed patterns. spans: those and what the network adds. One pass
    without shuffle over whole texts, a megabyte of them at once; a longer text is
    tagged whole, a batch of windows at a time, and takes a few bytes a character.
    Null or empty text: no spans. Null ids stay null; repeated rows each get their
    row. Extra columns, whatever their names, are ignored. Empty table: no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    show = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            base, every, size, at = [], [], 0, 0
            for i, t in enumerate(texts):  # about a megabyte of text at once
                size += len(t)
                if size > 500_000 or i == len(texts) - 1:
                    part = texts[at : i + 1]
                    found = [base_spans(x) for x in part]
                    base += found
                    every += [all_spans(x, g, s) for x, g, s in zip(part, tag_texts(net, part), found)] if net else found
                    size, at = 0, i + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(show, base), kind), pa.array(map(show, every), kind)], ["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id bigint, base {span}, spans {span}")


def op9_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = find_personal_data(docs, train(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"),
    )
