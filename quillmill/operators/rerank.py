"""Reranking of candidates (query_id, rank, key, source_file, ...): scores, caps by source, rule boosts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.meta import _any, _first_rule, query_tag
from ..functions.text import words


def overlap_score(query: Column, text: Column, tokens=words) -> Column:
    """The share of the query's distinct tokens that the text has."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, tokens(text))) / F.size(q), 6)).otherwise(F.lit(0.0))


def by_model(score: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Column, Column], Column]:
    """A scorer from a function of two series; where it fails, the rows have no score and so keep their order."""

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        try:
            return score(q, t).astype("float64")
        except Exception:  # noqa: BLE001 - the caller's model may raise anything
            return pd.Series([None] * len(q), dtype="float64")

    return run


def rerank(cands: DataFrame, score: Callable[[Column, Column], Column] = overlap_score, top_n: int | None = 5, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The top_n (all, if None) of each query by rerank_score, ties and unscored rows in their old order."""
    w = Window.partitionBy(*by).orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    scored = cands.withColumn("rerank_score", score(F.col("query"), F.col("text")))
    ranked = scored.withColumn("new_rank", F.row_number().over(w))
    return (ranked.where(F.col("new_rank") <= top_n) if top_n else ranked).drop("rank").withColumnRenamed("new_rank", "rank")


def dedup_by_source(cands: DataFrame, max_per_source: int = 2, top_k: int | None = None, source: str = "source_file", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first max_per_source of each source in rank order, then the first top_k; ranks are counted anew, gaps stay unfilled."""
    nth = F.row_number().over(Window.partitionBy(*by, F.coalesce(source, F.lit(""))).orderBy("rank"))
    kept = cands.withColumn("nth", nth).where(F.col("nth") <= max_per_source).drop("nth")
    out = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("rank")))
    return out.where(F.col("rank") <= top_k) if top_k else out


def _boosted(cands: DataFrame, active: Column, boost: Column, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds boost where active, and ranks anew (stable). Queries without a signal keep their order and have null boosts."""
    score = F.coalesce(F.col("rerank_score"), F.lit(0.0))
    out = cands.withColumn("metadata_boost", F.when(active, boost)).withColumn("rerank_score", F.when(active, F.round(score + F.col("metadata_boost"), 6)).otherwise(F.col("rerank_score")))
    w = Window.partitionBy(*by).orderBy(F.when(F.col("metadata_boost").isNotNull(), -F.col("rerank_score")), "rank")
    return out.withColumn("rank", F.row_number().over(w))


def topic_boost(cands: DataFrame, year: str = "2025-2026", boost: float = 0.08, bonus: float = 0.02, tags=rules.TAGS, signals=rules.TOPIC_TIME, notice: str = rules.NOTICE) -> DataFrame:
    """For questions with a topic and a strong time signal: notices of that topic rise, more so those of the current year."""
    tag = query_tag(F.col("query"), tags)
    add = F.when((F.col("doc_type") == notice) & (F.col("business_tag") == tag), F.lit(boost) + F.when(F.contains("effective_date", F.lit(year)), F.lit(bonus)).otherwise(F.lit(0.0)))
    return _boosted(cands, (tag != "") & _any(F.col("query"), signals), F.coalesce(add, F.lit(0.0)))


def metadata_boost(cands: DataFrame, time: float = 0.3, year: float = 0.1, scope: float = 0.2, signals=rules.META_TIME, scopes=rules.META_SCOPE, notice: str = rules.NOTICE, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Notices rise for questions with a time signal, more so those of the asked year; rows of the asked scope rise too."""
    q = F.col("query")
    timely, asked = _any(q, signals), F.coalesce(_first_rule(q, scopes), F.lit(""))
    p = r"(\d{4})[-—](\d{4})"
    asked_year = F.when(q.rlike(p), F.concat(F.regexp_extract(q, p, 1), F.lit("-"), F.regexp_extract(q, p, 2))).otherwise(F.lit(""))
    is_notice = timely & (F.col("doc_type") == notice)
    add = F.when(is_notice, F.lit(time)).otherwise(F.lit(0.0))
    add = add + F.when(is_notice & (asked_year != "") & F.contains("effective_date", asked_year), F.lit(year)).otherwise(F.lit(0.0))
    add = add + F.when((asked != "") & (F.col("scope") == asked), F.lit(scope)).otherwise(F.lit(0.0))
    return _boosted(cands, timely | (asked != ""), add, by)


def retrieve(cands: DataFrame, score=overlap_score, fetch_k: int = 10, top_k: int = 5, max_per_source: int | None = 2, boost: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The production chain after fusion: rerank (all candidates if a cap follows, else fetch_k), boost, cap or cut."""
    ranked = rerank(cands, score, None if max_per_source else fetch_k)
    ranked = boost(ranked) if boost else ranked
    return dedup_by_source(ranked, max_per_source, top_k) if max_per_source else ranked.where(F.col("rank") <= top_k)
