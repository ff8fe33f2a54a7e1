"""Fusion of ranked legs. A leg is (query_id, leg, rank, key, score, ...); key identifies a text, equal texts being one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _weight(weights: Mapping[int, float] | None, default: Column) -> Column:
    if not weights:
        return default
    return F.coalesce(*[F.when(F.col("leg") == leg, F.lit(float(w))) for leg, w in weights.items()], F.lit(0.0))


def _ranked(fused: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "first.leg", "first.rank", "key")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first")


def rrf_fuse(legs: DataFrame, k: int = 60, top_k: int = 10, weights: Mapping[int, float] | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Sum of weight / (k + rank) over all appearances of a key; ties as first seen, leg by leg."""
    part = _weight(weights, F.lit(1.0)) / (k + F.col("rank"))
    legs = legs.repartition(*by)  # once for all steps; and the branches of a union are not taken for one partitioning
    fused = legs.groupBy(*by, "key").agg(F.round(F.sum(part), 9).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    return _ranked(fused, list(by), top_k)


def weighted_fuse(legs: DataFrame, weights: Mapping[int, float] | None = None, top_k: int = 10, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Weighted sum of scores scaled to 0..1 within each leg of a query (1 where all are equal; no score counts as 0).

    Without weights each leg of the query has the same share.
    """
    w = Window.partitionBy(*by, "leg")
    legs = legs.repartition(*by)
    s = F.coalesce("score", F.lit(0.0))
    low, span = F.min(s).over(w), F.max(s).over(w) - F.min(s).over(w)
    scaled = legs.withColumn("scaled", F.when(span > 0, (s - low) / span).otherwise(F.lit(1.0)))
    if not weights:
        n = F.size(F.collect_set("leg").over(Window.partitionBy(*by)))
        scaled = scaled.withColumn("share", F.lit(1.0) / n)
    part = F.col("scaled") * (_weight(weights, F.lit(1.0)) if weights else F.col("share"))
    fused = scaled.groupBy(*by, "key").agg(F.round(F.sum(part), 9).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    return _ranked(fused, list(by), top_k)


def hybrid(legs: DataFrame, strategy: str = "rrf", **options) -> DataFrame:
    if strategy not in ("rrf", "weighted"):
        raise ValueError(f"unknown fusion {strategy}")
    return rrf_fuse(legs, **options) if strategy == "rrf" else weighted_fuse(legs, **options)


def expand_queries(queries: DataFrame, variants: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, place, query, weight): each query and its first `most` variants, equal texts once at their first place.

    variants is (query_id, variants array); the original weighs 3, a variant 1.
    """
    q = queries.join(variants, "query_id", "left")
    texts = F.array_distinct(F.concat(F.array("query"), F.coalesce(F.slice("variants", 1, most), F.array().cast("array<string>"))))
    return q.select("query_id", F.posexplode(texts).alias("place", "query")).withColumn("weight", F.when(F.col("place") == 0, 3.0).otherwise(1.0))


def first_score(df: DataFrame) -> Column:
    """A hit's score by the first of fused_score, rrf_score and score that it has, else 0."""
    have = [F.col(c).cast("double") for c in ("fused_score", "rrf_score", "score") if c in df.columns]
    return F.coalesce(*have, F.lit(0.0))


def multi_query(legs: DataFrame, original: float = 3.0, variant: float = 1.0, top_k: int = 10, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(by, key, score, rank) of the hits of a query's forms, leg 0 being the query itself: weighted fusion of their scores.

    A query of which one form alone has hits keeps that form's order and scores as they are.
    """
    legs = legs.withColumn("score", first_score(legs))
    forms = legs.groupBy(*by).agg((F.min("leg") == F.max("leg")).alias("alone"))
    legs = legs.join(forms, list(by)).withColumn("form", F.col("leg"))
    single = legs.where("alone").where(F.col("rank") <= top_k).select(*by, "key", "score", "rank")
    both = legs.where("not alone").select(*by, "form", "leg", "rank", "key", "score", F.when(F.col("form") == 0, original).otherwise(variant).alias("weight"))
    w = Window.partitionBy(*by, "leg")
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    scaled = both.withColumn("part", F.col("weight") * F.when(span > 0, (F.col("score") - low) / span).otherwise(F.lit(1.0)))
    fused = scaled.groupBy(*by, "key").agg(F.round(F.sum("part"), 9).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    return single.unionByName(_ranked(fused, list(by), top_k).select(*by, "key", "score", "rank"))


def resolve_variants(queries: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with variants, misses) of a cache keyed by md5 of the query."""
    keyed = queries.withColumn("key", F.md5("query"))
    return keyed.join(cache, "key"), keyed.join(cache, "key", "left_anti")
