"""Phrase collocations: Rabin-Karp fingerprints of all n-grams from prefix polynomials, added up in a shuffle with pointers
to their texts, checked against these, and only frequent phrases made into strings."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, by_bytes, filter_size, in_filter, materialize, mix, put_together, runs_of, text_bytes, unpacked

# What ends a piece, and what else ends a word.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
_IN_WORD = np.ones(256, np.uint8)
_IN_WORD[list(PIECE_ENDS + BLANKS)] = 0
_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_ENDS)] = True
#: Polynomials are taken modulo a Mersenne prime, with two bases: 62 bits together.
PRIME = np.uint64((1 << 31) - 1)
BASES = (1_732_050_807, 1_414_213_562)
#: Words whose n-grams one vectorised step takes, n-grams a task holds before it sends them on.
STEP_WORDS, HELD = 150_000, 2_000_000


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x under 2**62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _mod(out * np.uint64(pow(base, len(out), int(PRIME))))])
    return out


_TABLES: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of each base and of its inverse, n at least; kept for the next step."""
    if not _TABLES or len(_TABLES[0]) < n:
        _TABLES[:] = [_powers(x, n) for b in BASES for x in (b, pow(b, -1, int(PRIME)))]
    return _TABLES


def grams(part: pa.RecordBatch, longest: int):
    """The n-grams of a batch (text, lang) in steps: (key, size, start, end, row, buffer).

    buffer holds the step's words, lower-cased, one space after each; an n-gram is buffer[start:end], a run of words of one
    piece. Its key mixes the polynomials of these bytes with its length and its language.
    """
    names = part.column("lang").dictionary_encode()
    salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names.dictionary.to_pylist()] or [0], np.uint64)
    code = np.asarray(names.indices.to_numpy(zero_copy_only=False)).astype(np.int64)
    data, offsets = text_bytes(part.column("text"))
    w = Words(data, offsets, _IN_WORD)
    # Neither number ever falls, so the sum is the same for two words only if both are.
    piece = np.concatenate([[0], np.cumsum(_ENDS[data])])[w.starts] + w.row
    for lo in range(0, len(w.starts), STEP_WORDS):
        own = min(STEP_WORDS, len(w.starts) - lo)
        s, e = w.starts[lo : lo + own + longest - 1], w.ends[lo : lo + own + longest - 1]
        row, pid, lens = w.row[lo : lo + len(s)], piece[lo : lo + len(s)], e - s
        at = np.concatenate([[0], np.cumsum(lens + 1)])
        buffer = np.full(at[-1], 0x20, np.uint8)
        skip = np.cumsum(lens) - lens
        k = np.arange(int(lens.sum()))
        buffer[k + np.repeat(np.arange(len(s)), lens)] = w.lower[k + np.repeat(s - skip, lens)]
        tables = _tables(len(buffer) + 1)
        code_points = buffer.astype(np.uint64) + np.uint64(1)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mod(code_points * tables[2 * b][: len(buffer)]))]) for b in range(len(BASES))]
        for size in range(1, longest + 1):
            i = np.arange(min(own, len(s) - size + 1))
            i = i[pid[i] == pid[i + size - 1]]
            a, z = at[i], at[i + size - 1] + lens[i + size - 1]
            both = [_mod((x[z] - x[a]) % PRIME * tables[2 * b + 1][a]) for b, x in enumerate(sums)]
            fp = (both[0] << np.uint64(31)) | both[1]
            yield mix(mix(fp + salts[code[row[i]]]) + np.uint64(size)), size, a, z, row[i], buffer


def frequent(src: DataFrame, least: int, longest: int, log_p: int, log_bits: int) -> np.ndarray:
    """A filter of 2**log_bits bits over keys: set for each n-gram that occurs `least` times or more (and, rarely, for others).

    Tasks send a key once for about a million words, as 32 bits to one of 2**log_p buckets, with its count if that is not 1.
    """
    cut, low = np.uint64(64 - log_p), np.uint64(32 - log_p)

    def emit(batches):
        held, n = [], 0

        def flush():
            key = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count, key = np.diff(np.append(at, len(key))), key[at]
            b = (key >> cut).astype(np.int64)
            short = ((key >> low) & np.uint64(0xFFFFFFFF)).astype("<u4")
            edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
            columns: list[list[bytes]] = [[], [], []]
            for x, y in zip(edge[:-1], edge[1:]):
                k, c = short[x:y], count[x:y]
                for out, v in zip(columns, (k[c == 1], k[c > 1], c[c > 1].astype("<u4"))):
                    out.append(v.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(b[edge[:-1]])] + [pa.array(x, pa.binary()) for x in columns], names=["bucket", "once", "more", "times"])

        for batch in batches:
            for part in by_bytes(batch, "text"):
                for key, *_ in grams(part, longest):
                    held.append(key)
                    n += len(key)
                if n >= HELD:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    own = log_bits - log_p

    def add_up(key, table):
        once, more, times = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<u4") for c in ("once", "more", "times"))
        keys, counts = np.concatenate([once, more]), np.concatenate([np.ones(len(once), np.int64), times])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        bits = np.zeros(1 << own, bool)
        bits[keys[at][np.add.reduceat(counts[order], at) >= least] >> np.uint32(32 - own)] = True
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    found = src.mapInArrow(emit, "bucket bigint, once binary, more binary, times binary").groupBy("bucket").applyInArrow(add_up, "bucket bigint, bits binary")
    return put_together(found, log_p, log_bits)


def gathered(data: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The bytes of data[start : start + lens], one after the other."""
    return data[np.arange(int(lens.sum())) + np.repeat(start - (np.cumsum(lens) - lens), lens)]


def added(key: np.ndarray, count: np.ndarray, start: np.ndarray, lens: np.ndarray, data: np.ndarray):
    """(key, count, start, lens) of distinct texts, in the order of keys: the counts of equal texts are added up.

    Each entry's bytes data[start : start + lens] are compared with those of the first of its key; where two texts share a
    key, the texts themselves are sorted apart.
    """
    order, at = runs_of(key)
    if not len(order):
        return key, count, start, lens
    first = order[np.repeat(at, np.diff(np.append(at, len(order))))]
    same = lens[order] == lens[first]
    rest = np.flatnonzero(same & (order != first))
    for lo in range(0, len(rest), 500_000):
        r = rest[lo : lo + 500_000]
        x, y, n = order[r], first[r], lens[order[r]]
        differs = gathered(data, start[x], n) != gathered(data, start[y], n)
        if differs.any():
            same[np.unique(np.repeat(r, n)[differs])] = False
    if same.all():
        pick = order[at]
        return key[pick], np.add.reduceat(count[order], at), start[pick], lens[pick]
    text = [data[a : a + n].tobytes() for a, n in zip(start[order].tolist(), lens[order].tolist())]
    seen: dict[tuple, list] = {}
    for k, i, t in zip(key[order].tolist(), order.tolist(), text):
        seen.setdefault((k, t), [i, 0])[1] += int(count[i])
    pick = np.array([i for i, _ in seen.values()], np.int64)
    return key[pick], np.array([c for _, c in seen.values()], np.int64), start[pick], lens[pick]


def counted(src: DataFrame, bits, least: int, longest: int, log_p: int, log_bits: int) -> DataFrame:
    """(lang, size, phrase, f) of the n-grams of 1 to `longest` words that occur `least` times; size 0 counts a language's words.

    Tasks add up the n-grams that pass the filter and send key, count and a pointer into the texts that go along.
    """
    cut = np.uint64(64 - log_p)
    names = ["bucket", "lang", "keys", "counts", "lens", "texts"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def together(held: list[tuple]) -> tuple:
        """Entries (key, count, lens, texts) added up; the bytes of entry i follow those of i - 1."""
        key, count, lens, data = (np.concatenate(c) for c in zip(*held))
        key, count, start, lens = added(key, count, np.cumsum(lens) - lens, lens, data)
        return key, count, lens, gathered(data, start, lens)

    def emit(batches):
        held: dict[str, list[tuple]] = {}
        words: dict[str, int] = {}
        n = 0

        def flush():
            rows = []
            for lang, entries in held.items():
                key, count, lens, data = together(entries)
                b = (key >> cut).astype(np.int64)
                edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
                bound = np.concatenate([[0], np.cumsum(lens)])
                rows += [(int(b[x]), lang, key[x:y].tobytes(), count[x:y].astype("<i8").tobytes(), lens[x:y].astype("<i4").tobytes(), data[bound[x] : bound[y]].tobytes()) for x, y in zip(edge[:-1], edge[1:])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for part in by_bytes(batch, "text"):
                langs = part.column("lang").to_pylist()
                codes = {x: c for c, x in enumerate(dict.fromkeys(langs))}
                code = np.array([codes[x] for x in langs])
                for key, size, a, z, row, buffer in grams(part, longest):
                    for lang, c in codes.items():
                        mine = code[row] == c
                        if size == 1:
                            words[lang] = words.get(lang, 0) + int(mine.sum())
                        k = np.flatnonzero(mine)
                        k = k[in_filter(bits.value, key[k], log_bits)]
                        if len(k):
                            got, count, start, lens = added(key[k], np.ones(len(k), np.int64), a[k], (z - a)[k], buffer)
                            held.setdefault(lang, []).append((got, count, lens, gathered(buffer, start, lens)))
                            n += len(got)
                if n >= HELD:
                    held = {x: [together(y)] for x, y in held.items()}
                    n = sum(len(y[0][0]) for y in held.values())
                    if n >= HELD // 2:
                        yield flush()
                        held, n = {}, 0
        if held:
            yield flush()
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(words), pa.int64()), pa.array(list(words), pa.string()), pa.array([b""] * len(words), pa.binary()), pa.array([np.int64(x).tobytes() for x in words.values()], pa.binary()), *[pa.array([b""] * len(words), pa.binary())] * 2], names=names)

    def add_up(key, table):
        bucket, lang = (x.as_py() for x in key)
        keys, counts, lens, data = (unpacked(table, c, t) for c, t in (("keys", np.uint64), ("counts", "<i8"), ("lens", "<i4"), ("texts", np.uint8)))
        if bucket < 0:
            rows = [("", int(counts.sum()))]
        else:
            lens = lens.astype(np.int64)
            _, count, start, lens = added(keys, counts, np.cumsum(lens) - lens, lens, data)
            k = np.flatnonzero(count >= least)
            rows = [(data[a : a + n].tobytes().decode(), c) for c, a, n in zip(count[k].tolist(), start[k].tolist(), lens[k].tolist())]
        return pa.table({"lang": pa.array([lang] * len(rows), pa.string()), "size": pa.array([p.count(" ") + 1 if p else 0 for p, _ in rows], pa.int32()), "phrase": pa.array([p for p, _ in rows], pa.string()), "f": pa.array([c for _, c in rows], pa.int64())})

    sent = src.mapInArrow(emit, "bucket bigint, lang string, keys binary, counts binary, lens binary, texts binary")
    return sent.groupBy("bucket", "lang").applyInArrow(add_up, "lang string, size int, phrase string, f bigint")


def _part(words, start, n):
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, group: str = "lang", least: int = 10, longest: int = 3, share: int = 50, top: int = 2000, salts: int = 32) -> DataFrame:
    """The `top` collocations of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), cut into pieces at PIECE_ENDS and into words at BLANKS. A candidate is a run of 2 to
    `longest` words of a piece that occurs a >= `least` times in its language. Of its cuts into a first part, which occurs l
    times, and a rest, r times, the one of the lowest score floor(1000000 a a / (l r)) counts, the first on ties. It is left
    out if a longer candidate around it occurs `share` percent of a or more. n counts the language's words.

    Counts are exact: the filter only spares work, and n-grams that share a fingerprint are told apart by their texts. Null
    and empty texts and blank ones hold no words; a null language is `und`, an empty one a language of its own; repeated rows
    count each time; an empty table gives no rows; other columns are ignored. Ties rank by a, then by the phrase's bytes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(text.alias("text"), F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("lang"))
    log_p, log_bits = filter_size(src)
    bits = docs.sparkSession.sparkContext.broadcast(frequent(src, least, longest, log_p, log_bits))  # at most 16 MB
    known = materialize(counted(src, bits, least, longest, log_p, log_bits), "phrases")
    words = F.split("phrase", " ")
    wanted = known.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"))
    cuts = wanted.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", _part("words", F.lit(1), F.col("k")).alias("left"), _part("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    # A part occurs at least as often as the whole, so its count is known.
    half = lambda name, count: known.where("size > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    scored = cuts.join(half("left", "l"), ["lang", "left"]).join(half("right", "r"), ["lang", "right"])
    whole = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    scored = scored.withColumn("score", F.expr(f"({whole('a')} * {whole('a')} * CAST(1000000 AS DECIMAL(7, 0))) div ({whole('l')} * {whole('r')})"))
    best = scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _part("words", i, m))))
    around = wanted.where("size > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(around, ["lang", "phrase"], "left").where(f"longer IS NULL OR {whole('longer')} * 100 < {whole('a')} * {share}")
    left = left.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # The best of each salt first: then a language's task ranks top * salts rows at most.
    some = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    totals = known.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
