"""Near-duplicate lines by a deletion-neighbourhood join over words: equal variants meet, the edit is verified, the earliest stays.

The texts are hashed once, into a table of lines. Equal lines meet by content; of each content the first copy goes on. Lines that
share a half with another one are candidates, whose texts are cut out once; their deletions meet by hash, so do the copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_bytes, filter_size, in_buckets, in_filter, joined, materialize, mix, put_together, repeated, runs_of, split_by_keys, text_bytes, unpacked

_B = 0xD6E8FEB86659FD93
_INVERSE = pow(_B, -1, 1 << 64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA24BAED4963EE407)
#: Roles in a meeting of equal variants: a word replaced at one place; the shorter line of an insertion; the longer one.
REPLACED, SHORTER, LONGER = 0, 1, 2
HALVES = ("front", "back", "front_less", "back_less")


class Lines:
    """The lines of some texts that hold words: document, number, and range hashes over the words of each."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        ends = np.flatnonzero(data == 10)
        bounds = np.sort(np.concatenate([offsets, ends + 1]))
        many = 1 + np.searchsorted(ends, offsets[1:]) - np.searchsorted(ends, offsets[:-1])
        doc = np.repeat(np.arange(len(many)), many)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        self.words = Words(data, bounds)
        h = self.words.hashes
        n = len(h) + 2
        self._pow = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _B, np.uint64))])
        self._inv = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _INVERSE, np.uint64))])
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self._pow[: len(h)])])
        use = np.flatnonzero(self.words.n)
        self.doc, self.number = doc[use], number[use]
        self.a, self.n = self.words.first[use], self.words.n[use].astype(np.int64)

    def _range(self, a, b):
        return (self._sums[b] - self._sums[a]) * self._inv[a]

    def contents(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each line's words: one of their hashes, and a digest of their bytes, which shares no structure with it."""
        b = self.a + self.n
        data, at = joined(self.words)
        raw = memoryview(data)
        digests = b"".join(hashlib.blake2b(raw[x:y], digest_size=8).digest() for x, y in zip(at[self.a].tolist(), at[b].tolist()))
        return mix(self._range(self.a, b) + self.n.astype(np.uint64) * _K1), np.frombuffer(digests, np.uint64).copy()

    def halves(self, least: int) -> list[np.ndarray]:
        """Keys in the order of HALVES, 0 where there is none: two lines one edit apart agree in their first or last m // 2
        words, m being the shorter one's words; so a line has the keys for its own length and for one word less."""
        out = []
        for less in (0, 1):
            q = (self.n - less) // 2
            # Of an odd number of words, one word less has the same halves.
            has = (self.n >= least) & (q > 0) & ((self.n % 2 == 0) | (less == 0))
            b = self.a + self.n
            for suffix, h in enumerate((self._range(self.a, self.a + q), self._range(b - q, b))):
                out.append(np.where(has, mix(h + q.astype(np.uint64) * _K1 + np.uint64(3 + suffix)) | np.uint64(1), np.uint64(0)))
        return out

    def variants(self, front: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line place, key, role) of the deletions of single words and of the lines themselves. An edit behind a common first
        half, or before a common last half, is all that a line with only such a key can have."""
        q = (self.n - 1) // 2
        low, high = np.where(back, 0, q), np.where(front, self.n, self.n - q)
        many = high - low
        i = np.arange(len(self.n))
        row = np.repeat(i, many)
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        a, b = self.a[row], self.a[row] + self.n[row]
        h = self._range(a, a + at) + (self._sums[b] - self._sums[a + at + 1]) * self._inv[a + 1]
        n = self.n[row].astype(np.uint64)
        replaced = mix(h + n * _K1 + at.astype(np.uint64) * _K2 + np.uint64(5))
        longer = mix(h + (n - np.uint64(1)) * _K1 + np.uint64(7))
        whole = mix(self._range(self.a, self.a + self.n) + self.n.astype(np.uint64) * _K1 + np.uint64(7))
        roles = np.repeat(np.array([REPLACED, LONGER, SHORTER], np.int32), [len(row), len(row), len(i)])
        return np.concatenate([row, row, i]), np.concatenate([replaced, longer, whole]), roles


def one_edit(a: list, b: list) -> bool:
    """Whether word lists a and b are at most one insertion, deletion or replacement apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = (i + 1, i + 1) if len(a) == len(b) else (i + 1, i) if len(a) > len(b) else (i, i + 1)
    return a[x:] == b[y:]


PLACE = "doc_id bigint, text_key bigint, line int"
LINES = PLACE + ", words int, c bigint, d bigint, " + ", ".join(f"{h} bigint" for h in HALVES)
#: Rows that a task holds before it sends them to their buckets.
HELD = 500_000


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).to_numpy(zero_copy_only=False))


def _hashed_lines(src: DataFrame, least: int) -> DataFrame:
    """One row of LINES for each line with words."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                x = Lines(part.column("text"))
                who = pa.array(x.doc)
                c, d = x.contents()
                place = [part.column("doc_id").take(who), part.column("text_key").take(who), pa.array(x.number.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*place, pa.array(x.n.astype(np.int32)), _signed(c), _signed(d), *map(_signed, x.halves(least))], names=_names(LINES))

    return src.mapInArrow(run, LINES)


def _bucketed(rows: DataFrame, arrays, least_rows, log_p: int, names: list[str]) -> DataFrame:
    """Rows dealt to buckets by the top bits of their first array, a 64-bit hash; a task first drops what least_rows(*arrays)
    doesn't pick, so that a hash that very many rows have comes to its bucket a few times a task."""

    def run(batches):
        held, n = [], 0

        def flush():
            found = [np.concatenate(c) for c in zip(*held)]
            keep = least_rows(*found)
            found = [x[keep] for x in found]
            return in_buckets((found[0] >> np.uint64(64 - log_p)).astype(np.int64), dict(zip(names, found)))

        for batch in batches:
            if batch.num_rows:
                held.append(arrays(batch))
                n += len(held[-1][0])
            if n >= HELD:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return rows.mapInArrow(run, "bucket bigint, " + ", ".join(f"{c} binary" for c in names)).groupBy("bucket")


def _key_filter(keys: DataFrame, column: str, log_p: int, log_bits: int) -> np.ndarray:
    """A filter (see in_filter) over the top bits of a column of hashes; what the driver gets is bounded by log_bits."""
    own = 1 << (log_bits - log_p)
    at = F.shiftrightunsigned(column, 64 - log_bits)

    def build(key, table):
        bits = np.zeros(own, bool)
        bits[np.asarray(table.column("at")) & (own - 1)] = True
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    places = keys.select(F.shiftrightunsigned(column, 64 - log_p).alias("bucket"), at.alias("at")).distinct()
    return put_together(places.groupBy("bucket").applyInArrow(build, "bucket bigint, bits binary"), log_p, log_bits)


def _heads(*keys: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by all keys, starts in it of the runs alike in the first `by`)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys[:by]:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _first_copies(lines: DataFrame, log_p: int) -> DataFrame:
    """(c, d, first_doc, first_line) of the contents that several lines have."""

    def arrays(batch):
        return [_column(batch, "c").view(np.uint64), _column(batch, "d").view(np.uint64), _column(batch, "doc_id"), _column(batch, "line")]

    def ends(c, d, doc, line):
        """The least and the greatest place of each content."""
        order, at = _heads(c, d, doc, line, by=2)
        last = np.append(at[1:], len(order)) - 1
        return order[np.unique(np.concatenate([at, last]))]

    def firsts(table):
        c, d, doc, line = (unpacked(table, n, t) for n, t in (("c", np.uint64), ("d", np.uint64), ("doc", np.int64), ("line", np.int32)))
        order, at = _heads(c, d, doc, line, by=2)
        last = order[np.append(at[1:], len(order)) - 1]
        head = order[at]
        k = (doc[head] != doc[last]) | (line[head] != line[last])
        h = head[k]
        return pa.table({"c": _signed(c[h]), "d": _signed(d[h]), "first_doc": pa.array(doc[h]), "first_line": pa.array(line[h])})

    dealt = _bucketed(lines.select("c", "d", "doc_id", "line"), arrays, ends, log_p, ["c", "d", "doc", "line"])
    return dealt.applyInArrow(firsts, "c bigint, d bigint, first_doc bigint, first_line int")


def _in(cast, log_bits: int, hashes: np.ndarray) -> np.ndarray:
    return in_filter(cast.value, hashes, log_bits)


def _marked(lines: DataFrame, cast, log_bits: int) -> DataFrame:
    """lines with met: whether the content may have several copies."""

    def run(batches):
        for batch in batches:
            hit = _in(cast, log_bits, _column(batch, "c").view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*batch.schema.names, "met"])

    return lines.mapInArrow(run, LINES + ", met boolean")


def _candidates(single: DataFrame, cast, log_bits: int) -> DataFrame:
    """(doc_id, text_key, line, front, back) of the lines that share a first or a last half with a line of other words."""

    def run(batches):
        for batch in batches:
            keys = [_column(batch, h).view(np.uint64) for h in HALVES]
            hit = [(k != 0) & _in(cast, log_bits, k) for k in keys]
            front, back = hit[0] | hit[2], hit[1] | hit[3]
            k = front | back
            out = batch.filter(pa.array(k)).select(["doc_id", "text_key", "line"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(front[k]), pa.array(back[k])], names=[*out.schema.names, "front", "back"])

    return single.mapInArrow(run, PLACE + ", front boolean, back boolean")


def _variants(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return Lines(batch.column("text")).variants(_column(batch, "front").astype(bool), _column(batch, "back").astype(bool))


def _sources(held: DataFrame, log_p: int) -> DataFrame:
    """(key, role, source_doc, source_line): for each variant that lines of several places have in fitting roles, the earliest
    line that one of the role is to be compared with."""

    def arrays(batch):
        place, key, role = _variants(batch)
        return [key, role, _column(batch, "doc_id")[place], _column(batch, "line")[place]]

    def ends(key, role, doc, line):
        order, at = _heads(key, role, doc, line, by=2)
        last = np.append(at[1:], len(order)) - 1
        return order[np.unique(np.concatenate([at, last[role[order[last]] == REPLACED]]))]

    def meet(table):
        key, role, doc, line = (unpacked(table, n, t) for n, t in (("key", np.uint64), ("role", np.int32), ("doc", np.int64), ("line", np.int32)))
        order, at = _heads(key, role, doc, line, by=2)
        head, last = order[at], order[np.append(at[1:], len(order)) - 1]
        several = (role[head] == REPLACED) & ((doc[head] != doc[last]) | (line[head] != line[last]))
        # A key's shorter and longer lines stand side by side: each is compared with the other's earliest.
        pair = np.flatnonzero((key[head[1:]] == key[head[:-1]]) & (role[head[:-1]] == SHORTER) & (role[head[1:]] == LONGER))
        who = np.concatenate([head[several], head[pair], head[pair + 1]])
        from_ = np.concatenate([head[several], head[pair + 1], head[pair]])
        return pa.table({"key": _signed(key[who]), "role": pa.array(role[who]), "source_doc": pa.array(doc[from_]), "source_line": pa.array(line[from_])})

    dealt = _bucketed(held, arrays, ends, log_p, ["key", "role", "doc", "line"])
    return dealt.applyInArrow(meet, "key bigint, role int, source_doc bigint, source_line int")


def _met_variants(held: DataFrame, cast, log_bits: int) -> DataFrame:
    """(key, role, doc_id, text_key, line) of the variants whose key may have a source."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                place, key, role = _variants(batch)
                k = np.flatnonzero(_in(cast, log_bits, key))
                at = pa.array(place[k])
                yield pa.RecordBatch.from_arrays([_signed(key[k]), pa.array(role[k]), *(batch.column(c).take(at) for c in ("doc_id", "text_key", "line"))], names=["key", "role", "doc_id", "text_key", "line"])

    return held.mapInArrow(run, "key bigint, role int, " + PLACE)


def _verified(pairs: DataFrame) -> DataFrame:
    """PLACE of the pairs (mine, theirs) that are at most one word apart."""

    def run(batches):
        for batch in batches:
            mine, theirs = (Words(*text_bytes(batch.column(c))) for c in ("mine", "theirs"))
            word = lambda w, i: [w.lower[s:e].tobytes() for s, e in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])]
            ok = [one_edit(word(mine, i), word(theirs, i)) for i in range(batch.num_rows)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["doc_id", "text_key", "line"])

    return pairs.mapInArrow(run, PLACE)


def repeated_lines(src: DataFrame, least: int = 8, edits: int = 1) -> DataFrame:
    """(doc_id, text_key, line, near) of the lines of src (doc_id, text, text_key) that an earlier line repeats."""
    broadcast = src.sparkSession.sparkContext.broadcast  # filters of 16 MB at most
    lines = materialize(_hashed_lines(src, least), "lines")
    log_p, log_bits = filter_size(src)
    firsts = materialize(_first_copies(lines, log_p), "firsts")
    marked = _marked(lines, broadcast(_key_filter(firsts, "c", log_p, log_bits)), log_bits)
    # Plain exchanges on both sides: a line that very many documents hold is split by the adaptive skew join.
    met = marked.where("met").drop("met").join(firsts, ["c", "d"], "left")
    later = F.struct("doc_id", "line") > F.struct(F.col("first_doc").alias("doc_id"), F.col("first_line").alias("line"))
    met = materialize(met.select(*_names(LINES), F.coalesce(F.col("first_doc").isNotNull() & later, F.lit(False)).alias("equal")), "met")
    equal = met.where("equal").select(*_names(PLACE), F.lit(False).alias("near"))
    if not edits:
        return equal
    # One line of each content goes on. All have contents of their own, so a half that two of them have is of different lines.
    single = marked.where("not met").drop("met").unionByName(met.where("not equal").drop("equal")).where(F.col("words") >= least)
    single = materialize(single.select(*_names(PLACE), "c", *HALVES), "single")

    def halves(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys, c = np.concatenate([_column(batch, h).view(np.uint64) for h in HALVES]), _column(batch, "c")
        k = np.flatnonzero(keys)
        return keys[k], np.tile(c, len(HALVES))[k]

    half = broadcast(repeated(single, halves, log_p, log_bits, text=None))
    chosen = _candidates(single, half, log_bits).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("line", "front", "back")).alias("chosen"))
    chosen = materialize(chosen, "chosen")
    own, _ = split_by_keys(src, chosen, ["doc_id", "text_key"])
    cut = own.join(chosen, ["doc_id", "text_key"]).select("doc_id", "text_key", F.split("text", "\n", -1).alias("parts"), F.explode("chosen").alias("x"))
    held = materialize(cut.select("doc_id", "text_key", "x.*", F.get("parts", F.col("x.line")).alias("text")), "held")
    sources = materialize(_sources(held, log_p), "sources")
    rows = _met_variants(held, broadcast(_key_filter(sources, "key", log_p, log_bits)), log_bits)
    earlier = (F.col("source_doc") < F.col("doc_id")) | ((F.col("source_doc") == F.col("doc_id")) & (F.col("source_line") < F.col("line")))
    found = rows.join(sources, ["key", "role"]).where(earlier).select(*_names(PLACE), "source_doc", "source_line").distinct()
    once = held.dropDuplicates(_names(PLACE))  # rows that repeat a document have cut its lines as often
    mine = once.select(*_names(PLACE), F.col("text").alias("mine"))
    theirs = once.select(F.col("doc_id").alias("source_doc"), F.col("line").alias("source_line"), F.col("text").alias("theirs"))
    near = materialize(_verified(found.join(mine, _names(PLACE)).join(theirs, ["source_doc", "source_line"])), "near")
    return equal.unionByName(near.withColumn("near", F.lit(True)))


def dedup_lines(docs: DataFrame, least: int = 8, edits: int = 1) -> DataFrame:
    """docs with text without the lines that an earlier line repeats, and n_lines, n_removed, n_near.

    Lines are the parts of a text between newlines, compared by their lower-cased words. A line goes if an earlier one (by
    doc_id, then line number, over the whole table) has the same words; one of `least` words or more goes too if an earlier
    line of as many is at most `edits` (0 or 1) word insertions, deletions or replacements away, and n_near counts those
    without an equal one. Shorter lines take no part in the latter, as one word is much of them; a line in a script without
    spaces is one word, so it is compared for equality alone. Lines without words stay. Lines are judged on the input, not on
    what is left.

    Null text: no line, and it stays null. A text whose lines all go is empty. A row with null doc_id has no place in the
    order and is left alone. Rows that repeat a doc_id tie line by line, and ties stay. Empty tables give no rows. Other
    columns pass through; extra ones named as an output are replaced.
    """
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    src = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.withColumn("text_key", F.xxhash64("text"))
    gone = repeated_lines(src, least, edits)
    by_doc = gone.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("__qm_gone"), F.collect_set(F.when(~F.col("near"), F.col("line"))).alias("__qm_equal"))
    by_doc = materialize(by_doc.select(F.col("doc_id").alias("__qm_doc"), F.col("text_key").alias("__qm_key"), "__qm_gone", F.array_except("__qm_gone", "__qm_equal").alias("__qm_near")), "gone")
    keyed = docs.withColumns({"__qm_doc": F.col("doc_id").cast("bigint"), "__qm_key": F.xxhash64(F.col("text").cast("string"))})
    hit, rest = split_by_keys(keyed, by_doc, ["__qm_doc", "__qm_key"])
    hit = hit.join(by_doc, ["__qm_doc", "__qm_key"], "left")
    rest = rest.withColumns({c: F.lit(None).cast(hit.schema[c].dataType) for c in ("__qm_gone", "__qm_near")})
    both = hit.unionByName(rest).drop("__qm_doc", "__qm_key")
    parts = F.split(F.col("text").cast("string"), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("__qm_gone", i.cast("int"))), "\n")
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("bigint")
    new = {"n_lines": size(parts), "n_removed": size("__qm_gone"), "n_near": size("__qm_near"), "text": F.when(F.col("__qm_gone").isNull(), F.col("text").cast("string")).otherwise(kept)}
    return both.withColumns(new).drop("__qm_gone", "__qm_near")
