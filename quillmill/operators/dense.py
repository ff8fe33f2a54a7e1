"""Exact nearest neighbours over vector tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import materialize
from . import pivots


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def knn_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", tag: str | None = None) -> DataFrame:
    """(query_id, chunk, score, rank) of the k nearest: queries (query_id, vector[, tag]) against vectors (chunk, vector[, tag]),
    with tag only those of the query's tag. Few queries meet all vectors in one reading, as dealing the vectors to cells would
    take as many products. Searches that share a table build its cells once (see pivots)."""
    queries = materialize(queries, "queries")
    n, values = queries.agg(F.count("*"), F.sum(F.size("vector"))).first()
    if n <= pivots.MOST_PIVOTS and (values or 0) <= pivots.SCANNED:
        return pivots.scan(vectors, queries, k, metric, tag)
    vectors = materialize(vectors, "vectors")  # the cells' build reads them three times
    return pivots.search(pivots.build(vectors, metric, tag), queries, k, tag)


def with_similarity(df: DataFrame, distance: str = "distance") -> DataFrame:
    return df.withColumn("score", 1 - F.col(distance))


def embed_corpus(df: DataFrame, embed: Callable[[list[str]], list[list[float]]], dim: int, key: str = "chunk", text: str = "text", batch: int = 16, most: int = 2000, segment: int = 500) -> DataFrame:
    """(key, vector, failed, calls, seconds, tokens): embed is called on batches of texts cut to `most` characters.
    It returns the vectors, or the vectors and the tokens that it has billed; a batch's usage is in the row of its first text.

    A batch that fails is tried text by text on sanitised text, then on the mean of its segments; what still fails, and
    blank text, gets zeros and failed = true. Batches are of a task's own rows.
    """
    import re
    import time
    import unicodedata

    def ask(texts: list[str], used: list) -> list[list[float]]:
        """embed(texts), with one call, its seconds and its tokens added to used, also if it fails."""
        began = time.monotonic()
        used[0] += 1
        try:
            got = embed(texts)
        finally:
            used[1] += time.monotonic() - began
        vectors, tokens = got if isinstance(got, tuple) else (got, 0)
        used[2] += tokens
        return vectors

    def tidy(t: str) -> str:
        t = "".join(c for c in unicodedata.normalize("NFKC", t) if c in "\n\r\t" or unicodedata.category(c)[0] != "C")
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()[:most]

    def one(t: str, used: list) -> list[float] | None:
        for form in ([t], [t[i : i + segment] for i in range(0, len(t), segment)]):
            try:
                return np.mean(np.array(ask(form, used), float), axis=0).tolist()
            except Exception:  # noqa: BLE001, S112 - the caller's model may raise anything
                continue
        return None

    def run(frames):
        for f in frames:
            rows = []
            for lo in range(0, len(f), batch):
                part, used = f.iloc[lo : lo + batch], [0, 0.0, 0]
                texts = [(t or "")[:most] for t in part["t"]]
                try:
                    got = list(ask(texts, used)) if all(t.strip() for t in texts) else None
                except Exception:  # noqa: BLE001
                    got = None
                got = got or [one(s, used) if (s := tidy(t)) else None for t in texts]
                rows += [(k, v if v is not None else [0.0] * dim, v is None, *(used if i == 0 else (0, 0.0, 0))) for i, (k, v) in enumerate(zip(part["k"], got))]
            yield pd.DataFrame(rows, columns=[key, "vector", "failed", "calls", "seconds", "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, vector array<double>, failed boolean, calls int, seconds double, tokens bigint")


def embed_stats(df: DataFrame) -> DataFrame:
    """One row: texts, calls, failures, seconds spent in calls, their mean, and tokens."""
    calls, seconds = F.coalesce(F.sum("calls"), F.lit(0)).cast("bigint"), F.coalesce(F.sum("seconds"), F.lit(0.0))
    return df.agg(F.count("*").alias("rows"), calls.alias("calls"), F.count_if("failed").alias("failed"), F.round(seconds, 2).alias("seconds"), F.round(seconds / F.greatest(calls, F.lit(1)), 2).alias("seconds_a_call"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"))


def write_embedded(df: DataFrame, path: str, label: str) -> DataFrame:
    """Write the rows of embed_corpus() to path/vectors and, gathered by the same pass, one row of their usage to path/usage."""
    seen = Observation(label)
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum("calls").alias("calls"), F.count_if("failed").alias("failed"), F.sum("seconds").alias("seconds"), F.sum("tokens").alias("tokens")]
    df.observe(seen, *aggs).write.mode("overwrite").parquet(f"{path}/vectors")
    got = seen.get
    row = (label, got["rows"], got["calls"] or 0, got["failed"] or 0, round(got["seconds"] or 0.0, 2), got["tokens"] or 0)
    usage = df.sparkSession.createDataFrame([row], "label string, rows bigint, calls bigint, failed bigint, seconds double, tokens bigint")
    usage.write.mode("append").parquet(f"{path}/usage")
    return usage


