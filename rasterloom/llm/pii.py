"""Personal data by patterns and a character-level bidirectional LSTM with CRF transitions, in numpy.

The patterns give the *base* spans, which always stay. The network is for what they cannot see: addresses
spelled out, masked or dotted card numbers, phone numbers without a country's sign, defanged IPs. It is trained
on labelled spans of two kinds, in a bounded sample of documents: the base spans, and made ones of such forms,
planted between the words beside decoys (dates, prices, versions, numbers that are no cards). Characters go
in, tags (outside; begin and inside of each kind) come out, with learned transitions between tags.

At inference overlapping windows cover every text whole. All of them are read by the network; a window whose
scores leave no way but "outside" everywhere (by a bound on every path, so exactly) is not traced back. Spans
are reconciled over the whole text: a span cut off at a window's inner edge gives way to a neighbouring
window, where it lies whole; where none holds it, its parts that meet are decoded again in a window around
them, twice as long each time until no inner edge cuts it. Base spans win over overlapping ones, and of the
others that gain ``least`` in log odds or more the set of greatest total score that does not overlap is kept.

Patterns are matched in time linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import lowest, table, tidy

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile("[0-9@]")


def _luhn(digits: str) -> bool:
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) by kind and start: leftmost non-overlapping matches per kind, less failing ones."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        head = text[last:at]
        start = last + len(head.rstrip(_LOCAL))
        if domain and start < at:
            out.append((0, start, domain.end()))
            last = domain.end()
        else:
            last = at + 1
        at = text.find("@", last)
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m[0].split(".") if len(p.lstrip("0")) <= 3) and all(len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


SYMBOLS = 131
TAGS = 1 + 2 * len(KINDS)


def symbols(text: str) -> np.ndarray:
    """Numbers of characters: ASCII as it is, letters beyond it 128, other characters 129 (130: past the end)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, c, np.where((c >= 0xC0) & (c < 0x2000), 128, 129)).astype(np.int16)


def allowed() -> np.ndarray:
    """Transitions a path may take: inside only after begin or inside of the kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Two LSTMs of ``hidden`` units, an emission layer and a CRF; windows are columns."""

    def __init__(self, hidden: int = 10, seed: int = 5) -> None:
        r, h = np.random.default_rng(seed), hidden
        self.h, p = h, {}
        for d in "fb":
            p[f"x{d}"], p[f"u{d}"] = r.normal(0, 0.3, (SYMBOLS, 4 * h)), r.normal(0, 0.3, (4 * h, h))
            p[f"x{d}"][:, h : 2 * h] += 1.0
        p["e"], p["b"], p["t"], p["s"] = r.normal(0, 0.3, (TAGS, 2 * h)), np.zeros((TAGS, 1)), np.zeros((TAGS, TAGS)), np.zeros((TAGS, 1))
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.ok = np.where(allowed(), 0, -1e4).astype(np.float32)
        self.first = np.zeros((TAGS, 1), np.float32)

    def _read(self, ids: np.ndarray, d: str, out: np.ndarray, keep: bool) -> list:
        x, u, h = np.ascontiguousarray(self.p[f"x{d}"].T), self.p[f"u{d}"], self.h
        s = c = np.zeros((h, ids.shape[1]), np.float32)
        notes = []
        for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
            g = np.take(x, ids[t], axis=1)
            g += u @ s
            gates, n = g[: 3 * h], g[3 * h :]
            gates *= 0.5
            np.tanh(g, out=g)
            gates += 1
            gates *= 0.5
            i, f, o = gates[:h], gates[h : 2 * h], gates[2 * h :]
            new = f * c
            new += i * n
            tc = np.tanh(new)
            if keep:
                notes.append((t, s, c, i, f, o, n, tc))
            c, s = new, o * tc
            out[t] = s
        return notes

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """ids: characters, windows. Scores of tags: characters, tags, windows."""
        h = self.h
        states = np.empty((len(ids), 2 * h, ids.shape[1]), np.float32)
        notes = [self._read(ids, "f", states[:, :h], keep), self._read(ids, "b", states[:, h:], keep)]
        em = np.matmul(self.p["e"], states) + self.p["b"]
        return (em, (ids, states, notes)) if keep else em

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag paths, and its gradients."""
        em, (ids, states, notes) = self.emissions(ids, True)
        n, tr = ids.shape[1], self.p["t"] + self.ok
        T = len(ids)
        lse = lambda a, ax: (m := a.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(a - m).sum(ax))
        alpha = np.empty_like(em)
        alpha[0] = em[0] + self.p["s"]
        for t in range(1, T):
            alpha[t] = em[t] + lse(alpha[t - 1][:, None] + tr[:, :, None], 0)
        z = lse(alpha[-1], 0)
        beta = np.zeros_like(em)
        for t in range(T - 2, -1, -1):
            beta[t] = lse(tr[:, :, None] + (em[t + 1] + beta[t + 1])[None], 1)
        post = np.exp(alpha + beta - z)
        cols = np.arange(n)
        gold = np.zeros_like(em)
        gold[np.arange(T)[:, None], tags, cols] = 1
        score = (em * gold).sum((0, 1)) + self.p["s"][tags[0], 0]
        gt = np.zeros_like(tr)
        for t in range(1, T):
            score = score + tr[tags[t - 1], tags[t]]
            gt += np.exp(alpha[t - 1][:, None] + tr[:, :, None] + (em[t] + beta[t])[None] - z).sum(2)
            np.add.at(gt, (tags[t - 1], tags[t]), -1)
        de = (post - gold) / n
        g = {"t": gt / n * (self.ok == 0), "s": (post[0] - gold[0]).sum(1, keepdims=True) / n, "e": np.einsum("tkn,thn->kh", de, states), "b": de.sum((0, 2))[:, None]}
        ds, h = np.matmul(self.p["e"].T, de), self.h
        for k, (d, note) in enumerate(zip("fb", notes, strict=True)):
            part, u = ds[:, k * h : (k + 1) * h], self.p[f"u{d}"]
            gx, gu = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u)
            back, bc = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            for t, s, c, i, f, o, nn, tc in reversed(note):
                dh = back + part[t]
                dc = bc + dh * o * (1 - tc * tc)
                dg = np.concatenate([dc * nn * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - nn * nn)])
                bc, back = dc * f, u.T @ dg
                gu += dg @ s.T
                np.add.at(gx, ids[t], dg.T)
            g |= {f"x{d}": gx, f"u{d}": gu}
        return float((z - score).mean()), g

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best paths (characters, windows), and each character's gain in log odds over staying outside."""
        em = self.emissions(ids)
        path, gain = np.zeros(ids.shape, np.int8), np.zeros(ids.shape, np.float32)
        # A path differs from staying outside by its stretches of other tags, each with a gain of its own: the
        # way in, its tags, the way out. The most that a stretch can gain whose last span is of a kind, by the
        # best ways between tags; where that is nowhere over 0, no path beats staying outside.
        tr, out = self.p["t"] + self.ok, em[:, :1]
        tr = tr - tr[0, 0]
        begin, on = em[:, 1::2] - out, em[:, 2::2] - out
        on += tr[:, 2::2].max(0)[:, None]
        into, beside = tr[0, 1::2][:, None], tr[1:, 1::2].max(0)[:, None]
        leave = np.maximum(tr[1::2, 0], tr[2::2, 0])[:, None]
        run = begin[0] + (self.p["s"][1::2] - self.p["s"][0])
        best = run + leave
        for b, i in zip(begin[1:], on[1:], strict=True):
            run = np.maximum(b + np.maximum(into, beside + run.max(0)), run + i)
            best = np.maximum(best, run + leave)
        some = np.flatnonzero((np.maximum(best, run) > 0).any(0))
        if len(some):
            path[:, some], gain[:, some] = self._trace(np.ascontiguousarray(em[:, :, some]))
        return path, gain

    def _trace(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tr = (self.p["t"] + self.ok)[:, :, None]
        best, back = em[0] + self.p["s"] + self.ok[0][:, None], np.empty(em.shape, np.int8)
        for t in range(1, len(em)):
            a = best[:, None] + tr
            back[t] = a.argmax(0)
            best = a.max(0) + em[t]
        cols = np.arange(em.shape[2])
        path = np.empty((len(em), em.shape[2]), np.int8)
        path[-1] = best.argmax(0)
        for t in range(len(em) - 1, 0, -1):
            path[t - 1] = back[t][path[t], cols]
        gain = np.take_along_axis(em, path[:, None].astype(int), 1)[:, 0] - em[:, 0]
        gain[1:] += tr[path[:-1], path[1:], 0] - tr[0, 0, 0]
        gain[0] += (self.p["s"][path[0], 0] - self.p["s"][0, 0])
        return path, gain


def _tags(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.int8)
    for kind, a, b in sorted(spans, key=lambda s: s[0], reverse=True):
        out[a:b] = 2 + 2 * kind
        out[a] = 1 + 2 * kind
    # What a higher kind has cut through begins again.
    for p in np.flatnonzero((out >= 2) & (out % 2 == 0)):
        if not p or out[p - 1] not in (out[p], out[p] - 1):
            out[p] -= 1
    return out


def _digits(r: np.random.Generator, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def _card(r: np.random.Generator) -> str:
    """Sixteen digits that pass the check."""
    d = str(r.integers(2, 7)) + _digits(r, 14)
    return next(d + str(k) for k in range(10) if _luhn(d + str(k)))


def made(r: np.random.Generator, word: str) -> tuple[int, str]:
    """(kind, text): personal data in a form that the patterns do not take; word: for names."""
    pick = lambda *x: x[int(r.integers(len(x)))]
    kind, name = int(r.integers(len(KINDS))), (word.lower() or "x") + pick("", "", f".{_digits(r, 2)}", _digits(r, 1), "_" + pick("a", "jr", "mail"))
    if kind == 0:
        host, tld = pick("mail", "example", "post", "web", word.lower() or "x") + pick("", _digits(r, 1)), pick("com", "org", "net", "de", "fr", "io", "info")
        at, dot = pick((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT "), (" @ ", "."), (" @ ", " . "), ("[at]", "[.]"), ("@", "[.]"))
        return kind, f"{name}{at}{host}{pick('', '', dot + 'example')}{dot}{tld}"
    if kind == 1:
        dot = pick("[.]", "(.)", " . ", "[dot]")
        parts = [str(x) for x in r.integers(1, 256, 4)]
        return kind, dot.join(parts) if r.random() < 0.7 else ".".join(parts[:3]) + dot.strip() + parts[3]
    if kind == 2:
        c, mark = _card(r), pick("x", "X", "*")
        g = [c[i : i + 4] for i in range(0, 16, 4)]
        return kind, pick(pick(".", "/", "_", "  ").join(g), pick("-", " ").join([g[0], mark * 4, mark * 4, g[3]]), pick("-", " ").join([mark * 4] * 3 + [g[3]]), g[0] + mark * 8 + g[3])
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return kind, pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{pick('49', '33', '1')} {a} {b}{c}", f"0{a}/{b}{c}", f"0{a}-{b}{c}", f"({a}){b}-{c}")


def decoy(r: np.random.Generator, word: str) -> str:
    """Something like personal data that is none."""
    pick = lambda *x: x[int(r.integers(len(x)))]
    d = lambda n: _digits(r, n)
    long = d(int(r.integers(13, 20)))
    while _luhn(long):
        long = d(len(long))
    return pick(f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}.0{d(1)}.20{d(2)}", f"1{d(1)}:{d(2)}", f"1{d(1)}:{d(2)}:{d(2)}", f"${d(1)},{d(3)}.{d(2)}", f"{d(1)}.{d(5)}", f"v{d(1)}.{d(1)}.{d(1)}", f"{d(2)}-{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{word} at {word}", f"dot {word}", f"#{d(5)}", f"id={d(6)}", long, long, f"token = \"{'%032x' % int(r.integers(1 << 62))}\"", f"@{word}", " ".join([word] * int(r.integers(10, 40))), f"**{word}**", f"({d(3)})", f"[{d(2)}]", "-" * 12, "x" * 8, f"{d(4)}")


def planted(r: np.random.Generator, text: str, every: int = 40, most: int = 8) -> tuple[str, list[tuple[int, int, int]], list[int]]:
    """The text with made spans and decoys between some of its words, the made spans' (kind, start, stop), and places in all that was planted."""
    edges = [m.start() + 1 for m in re.finditer(" ", text)]
    words = re.findall("[A-Za-z]{2,12}", text[:4000]) or ["name"]
    at = sorted(r.choice(edges, min(most, -(-len(edges) // every)), replace=False).tolist()) if edges else [len(text)]
    out, spans, starts, last, size = [], [], [], 0, 0
    for p in at:
        word = words[int(r.integers(len(words)))]
        kind, x = made(r, word) if r.random() < 0.6 else (-1, decoy(r, word))
        for part in (text[last:p], x, ("", ".", ",", ";")[int(r.integers(4))] + " "):
            if part is x:
                starts += range(size, size + len(x), 100)
            if part is x and kind >= 0:
                spans.append((kind, size, size + len(x)))
            out.append(part)
            size += len(part)
        last = p
    return "".join([*out, text[last:]]), spans, starts


def fit(texts: list[str], size: int = 64, steps: int = 900, batch: int = 64, seed: int = 5, top: float = 0.04) -> Tagger:
    """Trains on windows around base spans, made spans and decoys, and on one window anywhere in each text."""
    r, net = np.random.default_rng(seed), Tagger(seed=seed)
    ids, tags = [], []
    for t in texts:
        t, more, starts = planted(r, t)
        base = base_spans(t)
        # A made span wins over a pattern that takes a part of it.
        base = [s for s in base if not any(s[1] < b and a < s[2] for _, a, b in more)]
        s, g = symbols(t), _tags(len(t), base + more)
        last = -size
        for p in sorted([a for _, a, _ in base] + starts + [m.start() for m in _TRIGGER.finditer(t)] + [int(r.integers(max(1, len(t))))]):
            if p - last < size // 2:
                continue
            last, a = p, max(0, p - int(r.integers(4, size - 8)))
            ids.append(np.pad(s[a : a + size], (0, max(0, size - len(s[a : a + size]))), constant_values=130))
            w = np.pad(g[a : a + size], (0, size - len(g[a : a + size])))
            if w[0] and w[0] % 2 == 0:
                w[0] -= 1
            tags.append(w)
    if not ids:
        net.p["b"][0] = 9
        return net
    ids, tags = np.array(ids).T.astype(int), np.array(tags).T.astype(int)
    with_, without = np.flatnonzero(tags.any(0)), np.flatnonzero(~tags.any(0))
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        pick = [r.choice(x, min(len(x), batch * share // 5)) for x, share in ((with_, 3), (without, 2)) if len(x)]
        k = np.concatenate(pick)
        rate = top * (1 - 0.95 * t / steps)
        for name, g in net.loss(ids[:, k], tags[:, k])[1].items():
            g = np.clip(g, -1, 1)
            m[name] = 0.9 * m[name] + 0.1 * g
            v[name] = 0.99 * v[name] + 0.01 * g * g
            net.p[name] = (net.p[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return net


def fit_rows(docs: DataFrame, text: str = "text", most: int = 1500, longest: int = 20000) -> Tagger:
    """Fits on the ``most`` texts that have the lowest hashes.

    Texts over ``longest`` characters are left out of this sample, so that it has a bound in bytes too; texts
    in it are whole.
    """
    t = F.col(text).cast("string")
    rows = docs.select(t.alias("t")).where(F.char_length(t) <= longest).select(F.xxhash64("t").alias("h"), F.char_length("t").alias("n"), "t")
    rows = lowest(rows, most).dropDuplicates(["h", "n"]).orderBy("h", "n").limit(most)
    return fit([r.t for r in rows.collect()])


def reconcile(base: list[tuple[int, int, int]], found: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those of (score, kind, start, stop) that go with them, by kind and start."""
    taken = sorted((a, b) for _, a, b in base)
    stops = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
    free: dict[tuple[int, int, int], float] = {}
    for s, k, a, b in found:
        i = np.searchsorted([x for x, _ in taken], b) if taken else 0
        if i and stops[i - 1] > a:
            continue
        free[k, a, b] = max(s, free.get((k, a, b), s))
    todo = sorted(free, key=lambda x: (x[2], x[1], x[0]))
    ends = [b for _, _, b in todo]
    best: list[tuple[float, int, bool]] = []
    for i, x in enumerate(todo):
        j = int(np.searchsorted(ends[:i], x[1], "right")) - 1
        take = free[x] + (best[j][0] if j >= 0 else 0)
        best.append((take, j, True) if not i or take > best[i - 1][0] else (best[i - 1][0], i - 1, False))
    out, i = list(base), len(todo) - 1
    while i >= 0:
        _, j, took = best[i]
        if took:
            out.append(todo[i])
        i = j
    return sorted(out)


def open_parts(cuts: list[tuple[int, int, int, int]], whole: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, stop, twice the window's length) of parts (kind, start, stop, window's length) that no whole span of their kind holds; those that meet are one."""
    out: list[list[int]] = []
    for kind in sorted({c[0] for c in cuts}):
        own = sorted((a, b) for k, a, b in whole if k == kind)
        starts, stops = [a for a, _ in own], np.maximum.accumulate([b for _, b in own]) if own else []
        first = len(out)
        for _, a, b, length in sorted(c for c in cuts if c[0] == kind):
            j = bisect_right(starts, a)
            if j and stops[j - 1] >= b:
                continue
            if len(out) > first and a <= out[-1][1]:
                out[-1][1:] = max(b, out[-1][1]), max(2 * length, out[-1][2])
            else:
                out.append([a, b, 2 * length])
    return [(a, b, n) for a, b, n in out]


def tag_texts(net: Tagger, texts: list[str], size: int = 288, overlap: int = 32, batch: int = 512, least: float = 2.0) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text. Windows of ``size`` characters share ``overlap`` with the next one."""
    step, queue = size - overlap, {}
    found, whole, cuts = [[] for _ in texts], [[] for _ in texts], [[] for _ in texts]

    def run(length: int) -> None:
        todo = queue.pop(length)
        ids = np.full((length, len(todo)), 130)
        for k, (_, _, s, _, _) in enumerate(todo):
            ids[: len(s), k] = s
        path, gain = net.decode(ids)
        for k in np.flatnonzero(path.any(0)):
            i, a, s, last, part = todo[k]
            p, n = path[:, k], len(s)
            b = np.flatnonzero((p[:n] % 2 == 1))
            for x in b:
                y = x + 1
                while y < n and p[y] == p[x] + 1:
                    y += 1
                span = (int(p[x]) // 2, a + int(x), a + int(y))
                if part and (span[1] >= part[1] or span[2] <= part[0]):
                    continue
                if (x == 0 and a) or (y == n and not last):
                    cuts[i].append((*span, length))
                    continue
                whole[i].append(span)
                # The log odds of this span against none, the way back outside included.
                score = float(gain[x : y + 1, k].sum())
                if score >= least:
                    found[i].append((score, *span))

    # Windows wait with those of about their own length, so that few end in padding.
    for i, text in enumerate(texts):
        s = symbols(text)
        for a in range(0, max(1, len(s) - overlap), step) if len(s) else ():
            length = min(size, -(-(len(s) - a) // 32) * 32)
            wait = queue.setdefault(length, [])
            wait.append((i, a, s[a : a + size], a + size >= len(s), None))
            if len(wait) == batch:
                run(length)
    for length in sorted(queue):
        run(length)
    while any(cuts):
        wider: dict[int, list[tuple[int, int, int]]] = {}
        for i, c in enumerate(cuts):
            for s, e, length in open_parts(c, whole[i]):
                while length < e - s + size:
                    length *= 2
                wider.setdefault(length, []).append((i, s, e))
        cuts[:] = [[] for _ in texts]
        for length, some in sorted(wider.items()):
            for i, s, e in some:
                a = max(0, min((s + e - length) // 2, len(texts[i]) - length))
                queue.setdefault(length, []).append((i, a, symbols(texts[i][a : a + length]), a + length >= len(texts[i]), (s, e)))
                if len(queue[length]) * length >= batch * size:
                    run(length)
            if length in queue:
                run(length)
    out = []
    for text, f in zip(texts, found, strict=True):
        base = base_spans(text)
        out.append((base, reconcile(base, f)))
    return out


def find(docs: DataFrame, net: Tagger, text: str = "text") -> DataFrame:
    """All columns of docs, with pii_base and pii_spans: arrays of (kind, start, stop) in code points.

    Null texts count as empty. Columns of docs by these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    out = docs.drop("pii_base", "pii_spans")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = tag_texts(shared.value, [t or "" for t in f[text]])
            for k, name in enumerate(("pii_base", "pii_spans")):
                f[name] = [[{"kind": KINDS[s[0]], "start": s[1], "stop": s[2]} for s in x[k]] for x in got]
            yield f

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    span = "array<struct<kind: string, start: long, stop: long>>"
    return out.mapInPandas(tidy("pii", run), f"{kinds}, pii_base {span}, pii_spans {span}")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit_rows(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("pii_base"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))
