"""Packed training matrices: best-fit decreasing within bounded pools, lossless splits, segment lengths and position resets."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes
from .tokens import default_path, encoder, ids, pieces

SCHEMA = (
    "pool string, sequence bigint, n_tokens bigint, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<bigint>, pieces array<int>, starts array<bigint>, piece_crc32 array<bigint>"
)
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
_NAMES = ["pool", "sequence", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "pieces", "starts", "piece_crc32"]


class CapacityTree:
    """A segment tree over remaining capacities: how many open sequences have each, and the least that holds a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, length: int) -> int:
        """The least capacity >= length of an open sequence; -1 if there is none."""
        i = length + self.leaves
        if self.count[i]:
            return length
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Sequences as lists of places in lengths: longest first, each into the fullest sequence that still holds it."""
    tree, by_room, out = CapacityTree(size), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[i])
        if room < 0:
            seq, room = len(out), size
            out.append([])
        else:
            seq = by_room[room].pop()
            tree.add(room, -1)
        out[seq].append(i)
        left = room - lengths[i]
        if left:
            by_room.setdefault(left, []).append(seq)
            tree.add(left, 1)
    return out


PIECES = "doc_id bigint, piece int, start bigint, piece_crc32 bigint, copy int, ids binary"


def id_pieces(docs: DataFrame, size: int, path: str, width: int) -> DataFrame:
    """Each document's pieces of at most size tokens with their ids; copy counts rows alike in a batch, so that they part."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            copies: Counter = Counter()
            for part in by_bytes(batch, "text"):
                rows = []
                for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    got = ids(enc, t)
                    if int(got.max()) >> (8 * width):
                        raise ValueError(f"id {int(got.max())} needs more than {width} bytes")
                    narrow = got.astype(f"<u{width}")
                    rows += [(d, k, s, zlib.crc32(got[s : s + n].tobytes()), copies[d, t], narrow[s : s + n].tobytes()) for k, (s, n) in enumerate(pieces(len(got), size))]
                    copies[d, t] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, PIECES)


def pack_matrices(docs: DataFrame, size: int = 1024, path: str | None = None, pool_tokens: int = 2_000_000, width: int = 2, tasks: int = 10_000) -> DataFrame:
    """One row for each packed sequence: its ids (little-endian, `width` bytes each, zero padded to size), cumulative segment
    lengths from 0, the positions at which position ids restart, and each segment's document, piece, start and checksum.

    A hash deals the pieces to pools of about pool_tokens tokens, as many as the table's bytes ask for, and a task packs one
    pool after the other, one alone up to `tasks` pools; so a pool's size and what shares a sequence follow the rows, not how
    the input is split. A task holds twice pool_tokens at most and starts a further pool beyond. Overlong documents are cut into pieces of size tokens after a
    shorter first one; pieces and starts put them together again. width 2 holds ids below 65,536, as the default file's
    are; an id that doesn't fit raises ValueError, none is cut.

    Null or empty text: one segment with the end id alone. Repeated rows are packed as often as they occur. An empty table
    gives no rows. Extra columns are ignored.
    """

    def flush(pool: str, rows: list, first: int) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in _NAMES]
        for k, seq in enumerate(best_fit([len(r[4]) // width for r in rows], size)):
            own = [rows[i] for i in seq]
            cu = [0, *accumulate(len(r[4]) // width for r in own)]
            matrix = b"".join(r[4] for r in own).ljust(size * width, b"\0")
            for c, v in zip(cols, (pool, first + k, cu[-1], matrix, cu, cu[:-1], [r[0] for r in own], [r[1] for r in own], [r[2] for r in own], [r[3] for r in own])):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)

    def run(batches):
        rows, held, first, pool = [], 0, 0, None
        for batch in batches:
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("pool", "doc_id", "piece", "start", "piece_crc32", "ids"))):
                if rows and (own != pool or held >= 2 * pool_tokens):
                    yield (out := flush(str(pool), rows, first))
                    rows, held, first = [], 0, first + out.num_rows
                if own != pool:
                    pool, first = own, 0
                rows.append(row)
                held += len(row[4]) // width
        if rows:
            yield flush(str(pool), rows, first)

    # About three bytes a token, and an end id for each row; this decides the number of pools only.
    tokens = docs.agg((F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)) / 3 + F.count("*")).alias("n")).first()["n"]
    pools = max(1, math.ceil(tokens / pool_tokens))
    pool = F.pmod(F.xxhash64("doc_id", "piece", "piece_crc32", "copy"), F.lit(pools)).cast("int")
    parts = min(pools, tasks)
    dealt = id_pieces(docs, size, path or default_path(), width).withColumn("pool", pool).repartitionById(parts, F.col("pool") % parts)
    # In one order whatever the shuffle's, a task that is run again packs alike.
    return dealt.sortWithinPartitions("pool", "doc_id", "piece", "start", "piece_crc32", "ids").drop("copy").mapInArrow(run, SCHEMA)


def write_packed(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def segments(df: DataFrame, width: int = 2) -> DataFrame:
    """The packed pieces again: doc_id, piece, start, length and their ids as bytes."""
    at = F.posexplode("doc_ids").alias("k", "doc_id")
    x = df.select("ids", "cu_seqlens", "pieces", "starts", at)
    lo, hi = F.col("cu_seqlens")[F.col("k")], F.col("cu_seqlens")[F.col("k") + 1]
    return x.select("doc_id", F.col("pieces")[F.col("k")].alias("piece"), F.col("starts")[F.col("k")].alias("start"), (hi - lo).alias("length"), F.substring("ids", lo * width + 1, (hi - lo) * width).alias("piece_ids"))
