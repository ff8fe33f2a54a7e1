"""Helpers shared by the operators: shared-folder tables, Arrow text access, vectorised words, skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes at most (a longer single text is a step of its own).
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster sets it.

    Unset, as in tests, a temporary folder serves a local master and the warehouse any other.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        if not local:
            return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        global _LOCAL
        _LOCAL = _LOCAL or tempfile.mkdtemp(prefix="quillmill-")
        found = f"file://{_LOCAL}"
    return found.rstrip("/")


_LOCAL = ""


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def appended(df: DataFrame, fields: list[tuple[str, str]]) -> str:
    """A DDL schema: the columns of df, then fields."""
    return ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` {t}" for n, t in fields])


def with_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], list], fields: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """df with further columns that fn computes from Arrow batches; every input column passes through untouched.

    fn gets the text column (nulls as empty strings) and returns one Arrow array or list for each field.
    A field replaces an input column of the same name, so clashing extra columns don't break the call.
    """
    names = {n.lower() for n, _ in fields}
    kept = [c for c in df.columns if c.lower() not in names or c == text]
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__qm_text"))
    out_names = [c for c in kept if c.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "__qm_text"):
                new = fn(part.column("__qm_text"))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in out_names] + [x if isinstance(x, pa.Array) else pa.array(x) for x in new], names=out_names + [n for n, _ in fields])

    return src.mapInArrow(run, appended(df.select(*[F.col(f"`{c}`") for c in out_names]), fields))


def by_bytes(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `most` bytes; never cuts a text."""
    _, offsets = text_bytes(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column without nulls as its bytes (from 0) and row offsets; no copy."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    if len(column) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


# ASCII upper case folds to lower; word bytes are digits, a-z and everything from 0x80.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
# Classes for tokens with symbols: 0 white space and control, 1 word bytes of either case, 2 other symbols.
TOKEN_KINDS = np.zeros(256, np.uint8)
TOKEN_KINDS[0x21:] = 2
TOKEN_KINDS[_WORD] = TOKEN_KINDS[0x41:0x5B] = 1
_RNG = np.random.default_rng(20240131)
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(255, _BASE, np.uint64))])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def powers(n: int) -> np.ndarray:
    return _POWERS[:n] if n <= len(_POWERS) else np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, _BASE, np.uint64))])


class Words:
    """The words of some texts: where they start and end, whose they are, and their 64-bit hashes.

    kinds gives each byte's class: a word is a run of bytes of one class over 0. fold lower-cases A-Z first.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = _WORD, fold: bool = True):
        self.lower = _LOWER[data] if fold else data
        kind = kinds[self.lower]
        turn = np.ones(len(kind) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=turn[1:-1])
        turn[offsets] = True
        mask = kind > 0
        self.starts = np.flatnonzero(mask & turn[:-1])
        self.ends = np.flatnonzero(mask & turn[1:]) + 1
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self.n = np.bincount(self.row, minlength=len(offsets) - 1) if len(offsets) > 1 else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.mask = mask

    @property
    def hashes(self) -> np.ndarray:
        lens = self.ends - self.starts
        if not len(lens):
            return np.zeros(0, np.uint64)
        at = np.concatenate([[0], np.cumsum(lens)[:-1]])
        place = np.arange(int(lens.sum())) - np.repeat(at, lens)
        return mix(np.add.reduceat(_BYTE_CODE[self.lower[self.mask]] * powers(int(lens.max()))[place], at))

    def prefix_hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash of its first `size` bytes) of words longer than size."""
        which = np.flatnonzero(self.ends - self.starts > size)
        h = np.zeros(len(which), np.uint64)
        for i in range(size):
            h += _BYTE_CODE[self.lower[self.starts[which] + i]] * _POWERS[i]
        return which, mix(h + np.uint64(size))

    def windows(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of `size` words that lies in one text."""
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out += h[k : k + n] * powers(size)[k]
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return at, mix(out[at])

    def text(self, i: int, size: int) -> bytes:
        return b" ".join(self.lower[s:e].tobytes() for s, e in zip(self.starts[i : i + size], self.ends[i : i + size]))


def joined(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words, a space after each, as one array of bytes; and where each starts in it, and its end."""
    lens = w.ends - w.starts
    at = np.concatenate([[0], np.cumsum(lens + 1)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    k = np.arange(int(lens.sum()))
    out[k + np.repeat(np.arange(len(lens)), lens)] = w.lower[w.mask]
    return out, at


def runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of equal runs in it); the first key is the most significant."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def in_buckets(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Arrays that are in the order of their buckets as a row for each bucket, of bytes."""
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    cuts = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]])] + [pa.array([x[i:j].tobytes() for i, j in cuts], pa.binary()) for x in columns.values()], names=["bucket", *columns])


def unpacked(table: pa.Table, column: str, kind) -> np.ndarray:
    """A column of in_buckets() as one array again."""
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def repeated(src: DataFrame, hashes: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], log_p: int, log_bits: int, text: str | None = "text") -> np.ndarray:
    """A filter of 2**log_bits bits over the top bits of 64-bit hashes: set for each that two owners have (and, rarely, others).

    hashes(part) gives evenly spread hashes and their owners' numbers; parts are cut by the bytes of the column text, if any. Tasks send each of their hashes once, as 32 bits to
    one of 2**log_p buckets, with a mark for those that they have met twice; a bucket's size follows the number of tasks.
    """
    cut, low = np.uint64(64 - log_p), np.uint64(32 - log_p)

    def emit(batches):
        held, n = [], 0

        def flush():
            h, d = (np.concatenate(c) for c in zip(*held))
            order, at = runs_of(h)
            h, d = h[order], d[order]
            many = np.maximum.reduceat(d, at) != np.minimum.reduceat(d, at)
            h = h[at]
            b = (h >> cut).astype(np.int64)
            key = ((h >> low) & np.uint64(0xFFFFFFFF)).astype("<u4")
            edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
            keys = [key[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])]
            twice = [key[i:j][many[i:j]].tobytes() for i, j in zip(edge[:-1], edge[1:])]
            return pa.RecordBatch.from_arrays([pa.array(b[edge[:-1]]), pa.array(keys, pa.binary()), pa.array(twice, pa.binary())], names=["bucket", "once", "twice"])

        for batch in batches:
            for part in by_bytes(batch, text) if text else [batch]:
                held.append(hashes(part))
                n += len(held[-1][0])
                if n >= 2_000_000:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    own = 1 << (log_bits - log_p)

    def shared(key, table):
        once = np.sort(np.concatenate([np.frombuffer(b, "<u4") for b in table.column("once").to_pylist()]))
        twice = [np.frombuffer(b, "<u4") for b in table.column("twice").to_pylist()]
        hit = np.concatenate([once[1:][once[1:] == once[:-1]], *twice])
        bits = np.zeros(own, bool)
        bits[hit >> np.uint32(32 - (log_bits - log_p))] = True
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    found = src.mapInArrow(emit, "bucket bigint, once binary, twice binary").groupBy("bucket").applyInArrow(shared, "bucket bigint, bits binary")
    return put_together(found, log_p, log_bits)


def put_together(slices: DataFrame, log_p: int, log_bits: int) -> np.ndarray:
    """The slices (bucket, bits) of one fixed-size filter, put together."""
    out, own = np.zeros(1 << (log_bits - 3), np.uint8), 1 << (log_bits - log_p - 3)
    for r in slices.toLocalIterator():
        out[r[0] * own : (r[0] + 1) * own] = np.frombuffer(r[1], np.uint8)
    return out


def in_filter(bits: np.ndarray, hashes: np.ndarray, log_bits: int) -> np.ndarray:
    """Which hashes a filter of repeated() has."""
    i = (hashes >> np.uint64(64 - log_bits)).astype(np.int64)
    return (bits[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1 > 0


def filter_size(src: DataFrame) -> tuple[int, int]:
    """(log_p, log_bits) for repeated(): buckets and bits follow the number of tasks, to a million buckets and 16 MB of bits."""
    return filter_bits(src.rdd.getNumPartitions())


def filter_bits(tasks: int) -> tuple[int, int]:
    log_p = min(20, max(6, (8 * max(tasks, 1) - 1).bit_length()))
    return log_p, max(log_p + 7, min(27, 21 + (max(tasks, 1) - 1).bit_length()))


def split_by_keys(rows: DataFrame, keyed: DataFrame, keys: list[str], log_bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """rows that may have their keys in keyed, and rows that certainly haven't: the latter needn't shuffle for a join.

    A bit set of 2**log_bits hashed keys, built by Spark's bitmap aggregate, is broadcast as rows of 4 KB: 2 MB at most.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(1 << log_bits))
    bits = keyed.select(at.alias("__qm_at")).groupBy(F.bitmap_bucket_number("__qm_at").alias("__qm_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__qm_at")).alias("__qm_bits"))
    bits = materialize(bits, "bits")
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("__qm_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0, F.lit(False))
    flagged = rows.withColumn("__qm_part", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "__qm_part", "left").withColumn("__qm_hit", hit).drop("__qm_part", "__qm_bits")
    return flagged.where("__qm_hit").drop("__qm_hit"), flagged.where("not __qm_hit").drop("__qm_hit")


def labelled(spark: SparkSession, sf_dir: str, label: str, most: int) -> DataFrame:
    """(doc_id, y) of at most `most` rows that may be learned from: crc32 of the id as text, modulo 5, is not 0.

    The rows with the lowest hashes are taken, the same on each run; a null label or id teaches nothing, and equal rows count once.
    Hashes below twice the share that is wanted go on to the sort, so the one task that ends it gets some 2 * `most` rows.
    """
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col(label).cast("double").alias("y")).dropna()
    rows = rows.where(~held_out(F.col("doc_id"))).distinct()
    share = min(1.0, 2 * most / max(rows.count(), 1))
    low = F.xxhash64("doc_id")
    rows = rows.where(low <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))))
    return rows.orderBy(low, "doc_id", "y").limit(most)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
