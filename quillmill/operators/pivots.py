"""Exact nearest neighbours by pivots: vectors lie in cells around them, and the triangle inequality of angles bounds what a
cell can score, so cells that cannot hold one of the k best are not visited. Queries and vectors meet in joins of packed blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .lexical import top_k

#: What rounding may take from an angle, and from a score of six decimals.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 2e-6
#: Pivots are at most so many vectors; they alone are known to every task.
MOST_PIVOTS = 1024
BLOCK, PACK = 1024, 256
#: Rows of bounds of cells up to which they are broadcast; more are joined.
BROADCAST_CELLS = 100_000
#: Values of all queries' vectors up to which scan() may be asked, and scores that it looks at at once.
SCANNED, SCORES = 1 << 20, 1 << 20


@dataclass(frozen=True)
class Cells:
    """blocks (tag, cell, lo, hi, low_norm, high_norm, ids, matrix) and the pivots; lo and hi bound the angles to the pivot."""

    blocks: DataFrame
    pivots: np.ndarray
    metric: str


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _tagged(df: DataFrame, tag: str | None, *columns: Column) -> DataFrame:
    named = F.col(tag).cast("string") if tag else F.lit("")
    return df.select(*columns, named.alias("tag"), F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL AND tag IS NOT NULL")


def _packed(rows: Iterator[pa.RecordBatch], by: tuple[str, ...], most: int) -> Iterator[dict]:
    """Runs of rows equal in `by`, at most `most` rows each, as columns."""
    held: list[dict] = []
    for batch in rows:
        for row in batch.to_pylist():
            if held and (len(held) == most or any(held[0][c] != row[c] for c in by)):
                yield {c: [r[c] for r in held] for c in held[0]}
                held = []
            held.append(row)
    if held:
        yield {c: [r[c] for r in held] for c in held[0]}


def build(vectors: DataFrame, metric: str = "cosine", tag: str | None = None, most_pivots: int = MOST_PIVOTS, block: int = BLOCK) -> Cells:
    """Cells of vectors (chunk, vector[, tag]). Vectors of a tag have cells of their own; a null vector or tag is left out.

    The pivots are vectors of the lowest hashes, about the square root of their number. Zero vectors, which have no angle, are
    in cell -1. A cell is packed in blocks of `block` vectors by rings of their angle, so no cell is a group in memory.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric {metric}")
    src = _tagged(vectors, tag, F.col("chunk").cast("bigint").alias("chunk"))
    n = src.count()
    some = src.where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("chunk"), "chunk").limit(max(1, min(most_pivots, math.isqrt(n)))).select("vector").collect()
    pivots = _unit(np.array([r[0] for r in some])) if some else np.zeros((1, 1))
    salts = max(1, n // (len(pivots) * block))

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("vector"))
            norm = np.linalg.norm(m, axis=1)
            near = _unit(m) @ pivots.T
            cell = np.where(norm > 0, near.argmax(axis=1), -1)
            least = np.where(norm > 0, np.arccos(np.clip(near.max(axis=1), -1, 1)), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("tag"), pa.array(cell.astype(np.int32)), pa.array(least), pa.array(norm), b.column("chunk"), b.column("vector")], names=["tag", "cell", "angle", "norm", "chunk", "vector"])

    placed = src.mapInArrow(assign, "tag string, cell int, angle double, norm double, chunk bigint, vector array<double>")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")).repartition("tag", "cell", "salt").sortWithinPartitions("tag", "cell", "salt", "angle", "chunk")

    def pack(batches):
        for x in _packed(batches, ("tag", "cell", "salt"), block):
            m = np.array(x["vector"], np.float64)
            row = [x["tag"][0], x["cell"][0], min(x["angle"]), max(x["angle"]), min(x["norm"]), max(x["norm"]), x["chunk"], (_unit(m) if metric == "cosine" else m).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), *[pa.float64()] * 4, pa.list_(pa.int64()), pa.binary()))], names=["tag", "cell", "lo", "hi", "low_norm", "high_norm", "ids", "matrix"])

    blocks = placed.mapInArrow(pack, "tag string, cell int, lo double, hi double, low_norm double, high_norm double, ids array<bigint>, matrix binary")
    return Cells(materialize(blocks, "vector-blocks"), pivots, metric)


def _bounds(metric: str, angle: np.ndarray, norm: np.ndarray, x: dict) -> np.ndarray:
    """The greatest scores of queries at `angle` from the pivot with the vectors of block x."""
    best = np.cos(np.maximum(np.maximum(angle - x["hi"], x["lo"] - angle) - ANGLE_SLACK, 0.0))
    return best if metric == "cosine" else norm * np.where(best > 0, best * x["high_norm"], best * x["low_norm"])


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, column) of the k greatest scores of each row, ties by id. Only scores from the k-th on are sorted."""
    if s.shape[1] > k:
        row, at = np.nonzero(s >= np.partition(s, -k, axis=1)[:, -k:].min(axis=1, keepdims=True))
    else:
        row, at = (x.ravel() for x in np.indices(s.shape))
    order = np.lexsort((ids[at], -s[row, at], row))
    row, at = row[order], at[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], ids[at[first]], at[first]


def scan(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", tag: str | None = None) -> DataFrame:
    """search() without cells: all queries go to the tasks, which read the vectors once and keep the k best of each query."""
    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric {metric}")
    rows = _tagged(queries, tag, F.col("query_id").cast("bigint").alias("query_id")).collect()
    unit = _unit if metric == "cosine" else lambda m: m
    asked = (np.array([r["query_id"] for r in rows], np.int64), np.array([r["tag"] for r in rows], object), unit(np.array([r["vector"] for r in rows], np.float64)) if rows else None)
    sent = vectors.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        ids, tags, q = sent.value
        held: list[tuple] = []

        def kept() -> tuple:
            row, s, chunk = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((chunk, -s, row))
            row, s, chunk = row[order], s[order], chunk[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            return row[first], s[first], chunk[first]

        step = max(1, SCORES // max(len(ids), 1))
        for b in batches if len(ids) else ():
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                chunks = part.column("chunk").to_numpy(zero_copy_only=False)
                s = np.round(q @ unit(_matrix(part.column("vector"))).T, 6)
                if tag:
                    s[tags[:, None] != part.column("tag").to_numpy(zero_copy_only=False)] = -math.inf
                row, best, at = _best(s, chunks, k)
                some = s[row, at] > -math.inf
                held.append((row[some], s[row, at][some], best[some]))
                if sum(len(x[0]) for x in held) > max(1 << 18, 2 * k * len(ids)):
                    held = [kept()]
        if held:
            row, s, chunk = kept()
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(chunk), pa.array(s)], names=["query_id", "chunk", "score"])

    src = _tagged(vectors, tag, F.col("chunk").cast("bigint").alias("chunk"))
    return top_k(src.mapInArrow(run, "query_id bigint, chunk bigint, score double"), k)


def _visit(cells: Cells, asked: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk, score): the k best of each block for the queries that visit its cell: visits (query_id, tag, cell,
    angle, limit). Queries go along in packs; a block's own bound is looked at once more before its vectors are multiplied."""
    metric = cells.metric
    # A cell's blocks are copied for each of its packs, so there are no more packs than queries fill.
    salts = max(1, min(16, asked.count() // PACK))

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("tag"), pa.array([m.tobytes() for m in _matrix(b.column("vector"))], pa.binary())], names=["query_id", "tag", "vector"])

    # A query goes along with each of its visits: as bytes, that Python needn't take apart.
    vectors = asked.mapInArrow(packed, "query_id bigint, tag string, vector binary")
    going = visits.join(vectors, ["query_id", "tag"]).withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int"))
    going = going.repartition("tag", "cell", "salt").sortWithinPartitions("tag", "cell", "salt")

    def pack(batches):
        for x in _packed(batches, ("tag", "cell", "salt"), PACK):
            row = [x["tag"][0], x["cell"][0], x["query_id"], x["angle"], [-math.inf if v is None else v for v in x["limit"]], b"".join(x["vector"])]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary()))], names=["tag", "cell", "queries", "angles", "limits", "asked"])

    packs = going.select("tag", "cell", "salt", "query_id", "angle", "limit", "vector").mapInArrow(pack, "tag string, cell int, queries array<bigint>, angles array<double>, limits array<double>, asked binary")

    def score(batches):
        for b in batches:
            for x in b.to_pylist():
                queries, ids = np.array(x["queries"]), np.array(x["ids"])
                q, m = np.frombuffer(x["asked"]).reshape(len(queries), -1), np.frombuffer(x["matrix"]).reshape(len(ids), -1)
                most = _bounds(metric, np.array(x["angles"]), np.linalg.norm(q, axis=1), x)
                near = np.flatnonzero((most >= np.array(x["limits"]) - SCORE_SLACK) | (x["cell"] < 0))
                if not len(near):
                    continue
                s = np.round((_unit(q) if metric == "cosine" else q)[near] @ m.T, 6)
                row, best, at = _best(s, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(queries[near][row]), pa.array(best), pa.array(s[row, at])], names=["query_id", "chunk", "score"])

    met = packs.join(cells.blocks, ["tag", "cell"])
    return met.mapInArrow(score, "query_id bigint, chunk bigint, score double")


def searched(cells: Cells, queries: DataFrame, k: int = 10, tag: str | None = None, first: int = 4) -> tuple[DataFrame, DataFrame]:
    """The k nearest (query_id, chunk, score, rank), ties by chunk, and (query_id, cells, visited).

    Queries (query_id, vector[, tag]) visit the `first` cells of the greatest bounds; their k-th score closes all cells that
    are bounded below it, and the others are visited. A query of null vector or tag, or of a tag without vectors, finds nothing.
    """
    pivots, metric = cells.pivots, cells.metric
    asked = materialize(_tagged(queries, tag, F.col("query_id").cast("bigint").alias("query_id")), "asked")

    def angles(batches):
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("vector"))
                a = _angles(_unit(m), pivots)
                rows, cell = (x.ravel() for x in np.indices(a.shape))
                at = pa.array(np.append(rows, np.arange(len(m))))
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("tag").take(at), pa.array(np.append(cell, [-1] * len(m)).astype(np.int32)), pa.array(np.append(a.ravel(), np.zeros(len(m)))), pa.array(np.linalg.norm(m, axis=1)).take(at)], names=["query_id", "tag", "cell", "angle", "norm"])

    around = cells.blocks.groupBy("tag", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("low_norm").alias("low_norm"), F.max("high_norm").alias("high_norm"))
    # Left to itself Spark takes the angles, a row for each query and pivot, for as small as the queries and may send them through the driver.
    around = materialize(around, "cells")
    around = F.broadcast(around) if around.count() <= BROADCAST_CELLS else around.hint("merge")
    met = asked.mapInArrow(angles, "query_id bigint, tag string, cell int, angle double, norm double").join(around, ["tag", "cell"])
    gap = F.greatest(F.greatest(F.col("angle") - F.col("hi"), F.col("lo") - F.col("angle")) - ANGLE_SLACK, F.lit(0.0))
    best = F.cos(gap)
    bound = best if metric == "cosine" else F.col("norm") * F.when(best > 0, best * F.col("high_norm")).otherwise(best * F.col("low_norm"))
    met = met.select("query_id", "tag", "cell", "angle", F.when(F.col("cell") >= 0, bound).otherwise(F.lit(math.inf)).alias("bound"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "angle", "cell"))
    met = materialize(met.withColumn("early", nth <= first), "cell-bounds")
    some = materialize(_visit(cells, asked, met.where("early").withColumn("limit", F.lit(None).cast("double")), k), "first-cells")
    limit = top_k(some, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("limit"))
    later = met.join(limit, "query_id", "left").withColumn("open", ~F.col("early") & (F.col("limit").isNull() | (F.col("bound") >= F.col("limit") - SCORE_SLACK)))
    found = top_k(some.unionByName(_visit(cells, asked, later.where("open").drop("open", "early", "bound"), k)), k)
    return found, later.groupBy("query_id").agg(F.count("*").alias("cells"), F.count_if(F.col("early") | F.col("open")).alias("visited"))


def search(cells: Cells, queries: DataFrame, k: int = 10, tag: str | None = None, first: int = 4) -> DataFrame:
    return searched(cells, queries, k, tag, first)[0]
