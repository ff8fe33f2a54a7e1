"""Personal data: exact base patterns, and a character BiLSTM with CRF transitions, trained in numpy, that adds spans."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

# The kinds in their order and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    # A match starts at the head of a run of digits anyway; saying so spares trying each of them.
    "ip": re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The forms that an added span may have: spaced or spelled signs, any separators, no country code.
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:(?:\.|\[\.\]| \. )[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[ ./-]?[0-9])+"),
    "phone": re.compile(r"(?=.*[0-9][ ().-]+[0-9])[(+]?[0-9][ ().0-9-]+[0-9]"),
}
_DIGIT = re.compile(r"[0-9]")
#: A run of digits of a card's length: what a card looks like before its checksum is known.
_RUN = re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])")
#: What no kind can be without: windows lie around these.
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")

WIDTH, STRIDE = 48, 24
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
# The characters that are inputs of their own; others fall into a few classes.
_OWN = {c: i for i, c in enumerate(" @.+-()%_,:;=/\"'\n")}
CLASSES = len(_OWN) + 5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    """The check that a match of a kind's pattern must pass."""
    digits = "".join(_DIGIT.findall(text))
    if kind == "ip":
        parts = [x.lstrip("0") or "0" for x in re.findall("[0-9]+", text)]
        return all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches; leftmost and non-overlapping for each kind, failing ones dropped."""
    out = []
    if "@" in text:
        out += [(m.start(), m.end(), "email") for m in _emails(text)]
    if _DIGIT.search(text):
        for kind in KINDS[1:]:
            out += [(m.start(), m.end(), kind) for m in PATTERNS[kind].finditer(text) if valid(kind, m.group())]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _emails(text: str):
    """finditer of the email pattern, tried only where a run of local characters meets an @ (elsewhere none can start)."""
    at, find = 0, PATTERNS["email"]
    while (sign := text.find("@", at)) >= 0:
        start = sign
        while start > at and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = find.match(text, start) if start < sign else None
        if m:
            yield m
        at = m.end() if m else sign + 1


def encode(texts: list[str]) -> np.ndarray:
    """Character classes, WIDTH a row; 0 pads."""
    out = np.zeros((len(texts), WIDTH), np.int64)
    for i, t in enumerate(texts):
        out[i, : len(t)] = [_OWN[c] + 1 if c in _OWN else len(_OWN) + (1 if c.isdigit() else 2 if c.islower() else 3 if c.isupper() else 4) for c in t]
    return out


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows, STRIDE apart on one grid, that hold a trigger or lie next to one that does.

    A window far from triggers can hold no kind (each kind's check asks for one), so its decoding is known: outside.
    """
    cells: dict[int, None] = {}
    last = len(text) // STRIDE
    for m in _TRIGGER.finditer(text):
        c = m.start() // STRIDE
        cells[c] = cells[max(c - 1, 0)] = cells[min(c + 1, last)] = None
    return [c * STRIDE for c in sorted(cells)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    """p: embedding, then for each direction input, recurrent and bias weights, then emission weights and bias, transitions."""

    p: list[np.ndarray]

    @staticmethod
    def new(dim: int = 12, hidden: int = 16, seed: int = 5) -> Tagger:
        r = np.random.default_rng(seed)
        p = [r.normal(0, 0.3, (CLASSES + 1, dim))]
        for _ in range(2):
            b = np.zeros(4 * hidden)
            b[hidden : 2 * hidden] = 1
            p += [r.normal(0, dim**-0.5, (dim, 4 * hidden)), r.normal(0, hidden**-0.5, (hidden, 4 * hidden)), b]
        return Tagger([*p, r.normal(0, 0.2, (2 * hidden, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS))])

    def _lstm(self, x: np.ndarray, k: int) -> tuple[np.ndarray, list]:
        w, u, b = self.p[k : k + 3]
        n, steps, _ = x.shape
        h = c = np.zeros((n, u.shape[0]))
        pre, out, kept = x @ w + b, np.zeros((n, steps, u.shape[0])), []
        for t in range(steps):
            i, f, o, g = np.split(pre[:, t] + h @ u, 4, axis=1)
            i, f, o, g = _sigmoid(i), _sigmoid(f), _sigmoid(o), np.tanh(g)
            old, prev = c, h
            c = f * c + i * g
            h = o * np.tanh(c)
            out[:, t] = h
            kept.append((i, f, o, g, old, c, prev))
        return out, kept

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = self.p[0][x]
        a, ka = self._lstm(e, 1)
        b, kb = self._lstm(e[:, ::-1], 4)
        h = np.concatenate([a, b[:, ::-1]], 2)
        return h @ self.p[7] + self.p[8], (e, h, ka, kb)

    def _back(self, k: int, x: np.ndarray, kept: list, dh_all: np.ndarray, grads: list) -> np.ndarray:
        w, u, _ = self.p[k : k + 3]
        dx, dh, dc = np.zeros_like(x), 0.0, 0.0
        for t in reversed(range(x.shape[1])):
            i, f, o, g, old, c, prev = kept[t]
            dh = dh_all[:, t] + dh
            th = np.tanh(c)
            dc = dc + dh * o * (1 - th * th)
            z = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
            grads[k] += x[:, t].T @ z
            grads[k + 1] += prev.T @ z
            grads[k + 2] += z.sum(0)
            dx[:, t] = z @ w.T
            dh, dc = z @ u.T, dc * f
        return dx

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """CRF loss (mean over the windows) and its gradients."""
        em, (e, h, ka, kb) = self.emissions(x)
        n, steps, _ = em.shape
        tr, grads = self.p[9], [np.zeros_like(q) for q in self.p]
        alpha, beta = np.zeros_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0]
        lse = lambda v, axis: np.log(np.exp(v - (m := v.max(axis, keepdims=True))).sum(axis)) + m.squeeze(axis)
        for t in range(1, steps):
            alpha[:, t] = em[:, t] + lse(alpha[:, t - 1, :, None] + tr, 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = lse(tr + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        de = np.exp(alpha + beta - z[:, None, None])
        rows = np.arange(n)
        score = em[rows, 0, y[:, 0]].sum()
        for t in range(1, steps):
            pair = np.exp(alpha[:, t - 1, :, None] + tr + (em[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
            grads[9] += pair.sum(0)
            np.add.at(grads[9], (y[:, t - 1], y[:, t]), -1)
            score += em[rows, t, y[:, t]].sum() + tr[y[:, t - 1], y[:, t]].sum()
        de[rows[:, None], np.arange(steps), y] -= 1
        grads[7] += np.tensordot(h, de, ([0, 1], [0, 1]))
        grads[8] += de.sum((0, 1))
        dh = de @ self.p[7].T
        k = dh.shape[2] // 2
        dx = self._back(1, e, ka, dh[:, :, :k], grads) + self._back(4, e[:, ::-1], kb, dh[:, ::-1, k:], grads)[:, ::-1]
        np.add.at(grads[0], x, dx)
        return float((z.sum() - score) / n), [g / n for g in grads]

    def best_path(self, em: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tag path of each row (Viterbi) over its first lengths emissions."""
        n, steps, _ = em.shape
        best, back = em[:, 0].copy(), np.zeros((n, steps, TAGS), np.int8)
        for t in range(1, steps):
            s = best[:, :, None] + self.p[9]
            back[:, t] = s.argmax(1)
            go = t < lengths
            best[go] = s[go].max(1) + em[go, t]
        out = np.zeros((n, steps), np.int64)
        rows, at = np.arange(n), best.argmax(1)
        for t in range(steps - 1, -1, -1):
            out[:, t] = at
            at = np.where((t < lengths) & (t > 0), back[rows, t, at], at)
        return out


def tags_of(text: str, spans: list[tuple[int, int, str]], start: int) -> np.ndarray:
    out = np.zeros(WIDTH, np.int64)
    for a, b, kind in spans:
        a, b, k = a - start, b - start, 1 + 2 * KINDS.index(kind)
        if b > 0 and a < WIDTH:
            out[max(a, 0) : b] = k + 1
            if a >= 0:
                out[a] = k
    return out


def shapes(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """What the tagger learns to see: the base spans, and digit runs of a card's length whatever their checksum, which the
    check of added spans settles."""
    return base + [(m.start(), m.end(), "card") for m in _RUN.finditer(text) if not any(a < m.end() and m.start() < b for a, b, _ in base)]


def _word(r: np.random.Generator) -> str:
    return "".join(map(chr, r.integers(97, 123, int(r.integers(2, 9)))))


def varied(text: str, tags: list[int], r: np.random.Generator) -> tuple[str, list[int]]:
    """A looser writing of a labelled window: the signs of each whole span spaced, spelled or dropped, digits put before."""
    out, marks, at = [], [], 0
    while at < len(text):
        tag, end = tags[at], at + 1
        if tag % 2 == 0:
            out.append(text[at])
            marks.append(tag)
            at = end
            continue
        while end < len(text) and tags[end] == tag + 1:
            end += 1
        span, kind, ahead = text[at:end], KINDS[tag // 2], ""
        if kind == "email" and "@" in span:
            name, _, host = span.partition("@")
            if r.random() < 0.7:
                name = str(r.choice(["", ".", "_"])).join(_word(r) for _ in range(int(r.integers(1, 3))))
                host = ".".join(_word(r) for _ in range(int(r.integers(2, 4))))
            span = name + str(r.choice(["@", " @ ", "(at)", " (at) ", "[at]", " [at] "])) + host
        elif kind == "ip":
            span = span.replace(".", str(r.choice(["[.]", " . "])))
        elif kind == "phone":
            digits = _DIGIT.findall(span)
            form = int(r.integers(4))
            tail = "".join(digits[-10:])
            span = [span.lstrip("+"), f"({tail[:-7]}) {tail[-7:-4]}-{tail[-4:]}", f"{tail[:-7]}-{tail[-7:-4]}-{tail[-4:]}", f"{tail[:-7]}.{tail[-7:-4]}.{tail[-4:]}"][form]
        elif kind == "card" and len(span) == 16:
            groups = [span[k : k + 4] for k in range(0, 16, 4)]
            if r.random() < 0.5:
                span = str(r.choice([".", "/"])).join(groups)
            else:
                ahead = "".join(map(str, r.integers(0, 10, int(r.integers(1, 9))))) + " "
        out.append(ahead + span)
        marks += [0] * len(ahead) + [tag] + [tag + 1] * (len(span) - 1)
        at = end
    marks = marks[:WIDTH]
    return "".join(out)[:WIDTH], marks + [0] * (WIDTH - len(marks))


def train(rows: list[tuple[str, list[int]]], steps: int = 400, batch: int = 64) -> Tagger:
    """Adam on the CRF loss over labelled windows (text, tags), each also in a looser writing; a fixed seed, so the same rows
    give the same tagger."""
    model, r = Tagger.new(), np.random.default_rng(11)
    if not rows:
        return model
    rows = rows + [varied(t, y, r) for t, y in rows for _ in range(3) if any(y)]
    x, y = encode([t for t, _ in rows]), np.array([y for _, y in rows])
    m, v = [np.zeros_like(q) for q in model.p], [np.zeros_like(q) for q in model.p]
    for t in range(1, steps + 1):
        i = r.integers(0, len(rows), batch)
        _, grads = model.gradients(x[i], y[i])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1, 2 * (steps - t + 1) / steps)
        for k, g in enumerate(grads):
            g = g * min(1, 5 / (norm + 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            model.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return model


_DEPTH = np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1]) + 1.0


def _paths(texts: list[str], model: Tagger, block: int = 512):
    """(text number, start, tags) of each stretch of overlapping windows, reconciled: where windows overlap, their emissions are
    averaged by how deep the character lies in each, and one path is decoded over the whole stretch."""
    where = [(i, s) for i, t in enumerate(texts) for s in windows(t)]
    em = [model.emissions(encode([texts[i][s : s + WIDTH] for i, s in where[lo : lo + block]]))[0] for lo in range(0, len(where), block)]
    em = np.concatenate(em) if em else np.zeros((0, WIDTH, TAGS))
    first = [k for k, (i, s) in enumerate(where) if not k or where[k - 1][0] != i or s - where[k - 1][1] > STRIDE]
    spans = []
    for a, b in zip(first, first[1:] + [len(where)]):
        i, start = where[a]
        spans.append((min(where[b - 1][1] + WIDTH, len(texts[i])) - start, i, start, a, b))
    spans.sort()
    lo = 0
    while lo < len(spans):
        hi = lo + 1
        while hi < len(spans) and hi - lo < block and (hi - lo + 1) * spans[hi][0] < 200_000:
            hi += 1
        part, lo = spans[lo:hi], hi
        steps = part[-1][0]
        total = np.zeros((len(part), steps + WIDTH, TAGS))
        weight = np.zeros((len(part), steps + WIDTH, 1))
        for k, (_, _, start, a, b) in enumerate(part):
            for w in range(a, b):
                at = where[w][1] - start
                total[k, at : at + WIDTH] += em[w] * _DEPTH[:, None]
                weight[k, at : at + WIDTH, 0] += _DEPTH
        lengths = np.array([x[0] for x in part])
        tags = model.best_path((total / np.maximum(weight, 1))[:, :steps], lengths)
        for (n, i, start, _, _), row in zip(part, tags):
            yield i, start, row[:n]


def added_spans(texts: list[str], base: list[list[tuple[int, int, str]]], model: Tagger) -> list[list[tuple[int, int, str]]]:
    """The spans that the tagger finds and the base patterns don't: those of a form and check of their kind that start and end
    with a word and touch no base span."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i, start, tags in _paths(texts, model):
        t = texts[i]
        begins = np.flatnonzero((tags > 0) & ((tags % 2 == 1) | (np.append(0, tags[:-1]) < tags - 1) | (np.append(0, tags[:-1]) > tags)))
        for a in begins.tolist():
            k, b = (int(tags[a]) - 1) // 2, a + 1
            while b < len(tags) and tags[b] == 2 * k + 2:
                b += 1
            x, y = start + a, start + b
            s = t[x:y]
            whole = not (x and t[x - 1].isalnum() and s[0].isalnum()) and not (y < len(t) and t[y].isalnum() and s[-1].isalnum())
            if whole and LOOSE[KINDS[k]].fullmatch(s) and valid(KINDS[k], s) and not any(x < q and p < y for p, q, _ in base[i]):
                out[i].append((x, y, KINDS[k]))
    return [sorted(o) for o in out]


def labelled_windows(docs: DataFrame, slots: int) -> list[tuple[str, list[int]]]:
    """At most `slots` distinct windows of each kind and of none with their tags, over all documents.

    A window's hash deals it to a slot of its kind, and the window of least hash stays: equal windows count once, rare kinds
    have as many slots as frequent ones, and a task sends no more than the slots. The driver gets 5 * slots rows at most.
    """

    def cut(batches):
        held: dict[tuple[int, int], tuple[int, str, bytes]] = {}
        for batch in batches:
            for t in batch.column("text").to_pylist():
                at = windows(t)
                spans = shapes(t, base_spans(t)) if at else []
                for s in at:
                    w = t[s : s + WIDTH]
                    h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=7).digest(), "big")
                    near = [x for x in spans if x[1] > s and x[0] < s + WIDTH]
                    key = (1 + KINDS.index(near[h % len(near)][2]) if near else 0, h % slots)
                    if key not in held or h < held[key][0]:
                        held[key] = (h, w, tags_of(t, near, s).astype(np.uint8).tobytes())
        rows = [(k, slot, *v) for (k, slot), v in held.items()]
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary()))], names=["kind", "slot", "key", "text", "tags"])

    found = docs.mapInArrow(cut, "kind int, slot int, key bigint, text string, tags binary")
    found = found.groupBy("kind", "slot").agg(F.min(F.struct("key", "text", "tags")).alias("w")).select("w.*")
    return [(r["text"], list(r["tags"])) for r in sorted(found.collect(), key=lambda r: (r["key"], r["text"]))]


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


FIELDS = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, redacted string"


def find(docs: DataFrame, slots: int = 600) -> DataFrame:
    """Per document: counts and digest of the base spans, all spans, how many the tagger added, and the redacted text.

    The tagger learns from at most 5 * `slots` windows around digits and @ with their base spans as labels, as they are and in
    looser writings, and reads every such window of every whole text. Null and empty texts have no spans. Repeated rows give
    a row each; an empty table gives none; extra columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cast = docs.sparkSession.sparkContext.broadcast(train(labelled_windows(src, slots)))  # a few thousand weights

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                texts = part.column("text").to_pylist()
                base = [base_spans(t) for t in texts]
                rows = []
                for d, t, b, more in zip(part.column("doc_id").to_pylist(), texts, base, added_spans(texts, base, cast.value)):
                    clean, end = [], 0
                    for x, y, k in sorted(b + more, key=lambda s: (s[0], -s[1])):
                        if x >= end:
                            clean += [t[end:x], f"<{k}>"]
                        end = max(end, y)
                    rows.append((d, *(sum(s[2] == k for s in b) for k in KINDS), hashlib.sha256(_join(b).encode()).hexdigest(), _join(b + more), len(more), "".join([*clean, t[end:]])))
                kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in FIELDS.split(", ")])

    return src.mapInArrow(run, FIELDS)

