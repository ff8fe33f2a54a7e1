"""Best-fit packing planned on a length histogram: the driver sees counts by length only, documents take planned slots by rank."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, materialize
from .tokens import default_path, encoder, ids, pieces

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, size: int, path: str) -> DataFrame:
    """Each document's pieces of at most size tokens, with a checksum of their ids."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                rows = []
                for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    got = ids(enc, t)
                    rows += [(d, k, s, n, zlib.crc32(got[s : s + n].tobytes())) for k, (s, n) in enumerate(pieces(len(got), size))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts by length: runs (length, first slot, slots, first sequence, slots a sequence, offset).

    Sequences that were filled alike stay together as ranges, so the work follows the number of lengths, not of documents.
    Placing one of `length` in the tightest open sequence leaves that sequence the tightest for the next while it fits:
    a range therefore takes room // length of them in each of its sequences at once.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, slot = counts[length], 0
        room = length
        while left:
            while room < size and not free[room]:
                room += 1
            each = room // length
            if free[room]:
                first, n = free[room].pop()
            else:
                first, n = opened, -(-left // each)
                opened += n
            used = min(n, -(-left // each))
            if used < n:
                free[room].append((first + used, n - used))
            whole = min(used, left // each)
            for start, many, per in ((first, whole, each), (first + whole, used - whole, left - whole * each)):
                if many:
                    runs.append((length, slot, many * per, start, per, size - room))
                    slot += many * per
                    if room > per * length:
                        free[room - per * length].append((start, many))
            left = counts[length] - slot
    return runs


def pack(docs: DataFrame, size: int = 1024, path: str | None = None, salt_rows: int = 250_000) -> DataFrame:
    """Pack all documents into few sequences of at most size tokens: one row for each piece with its place.

    A document's rank among the pieces of its length is its rank within (length, salt) plus the counts of the salts
    before; salts grow with the rows, so no length makes a large group. The plan is joined as slot ranges.

    Null or empty text: one piece that holds the end id alone. Repeated rows and ties take slots of their own. A null
    doc_id is packed like any other. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    cut = materialize(token_pieces(docs, size, path or default_path()), "pieces")
    salts = max(16, cut.count() // salt_rows)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    by_salt = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    runs = spark.createDataFrame(plan(counts, size), "run_length bigint, slot bigint, slots bigint, first bigint, per bigint, at bigint")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = cut.withColumn("rank", rank.cast("bigint")).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("rank") - 1)
    # The runs number a few for each length, whatever the rows: a bounded table.
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("slot")) & (F.col("rank") < F.col("slot") + F.col("slots")))
    nth = F.col("rank") - F.col("slot")
    seq = (F.col("first") + F.floor(nth / F.col("per"))).cast("bigint")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", seq.alias("sequence_id"), (F.col("at") + F.pmod(nth, F.col("per")) * F.col("length")).cast("bigint").alias("offset"))
