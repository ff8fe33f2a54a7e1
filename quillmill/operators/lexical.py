"""BM25 over a chunk table: index statistics and top-k. Nothing is pruned, so results are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words

K1, B, FLOOR = 1.5, 0.75, 0.25  # fixed values: the widely used defaults of the Okapi form


#: Distinct query tokens up to which they are broadcast; more are joined.
BROADCAST_TOKENS = 200_000


def token_counts(chunks: DataFrame, text: str, tokens=words) -> DataFrame:
    """(token, df, length): the chunks that have each token; the row of token null counts all chunks and sums their lengths.
    Tasks add up before the shuffle, so it carries a task's vocabulary and not its texts."""
    ts = chunks.select(tokens(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
    rows = ts.select(F.size("ts").alias("size"), F.explode(F.concat(F.array_distinct("ts"), F.array(F.lit(None).cast("string")))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("df"), F.sum(F.when(F.col("token").isNull(), F.col("size"))).alias("length"))


def token_stats(counts: DataFrame) -> DataFrame:
    """(token, df, idf) of token_counts(); an idf below 0 becomes FLOOR of the mean idf over the tokens."""
    n_chunks = counts.where("token is null").select(F.col("df").alias("n"))  # one row
    raw = counts.where("token is not null").crossJoin(F.broadcast(n_chunks)).select("token", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(queries: DataFrame, chunks: DataFrame, key: str, text: str, tokens=words) -> DataFrame:
    """(query_id, chunk, score) of all chunks that share a token; each occurrence of a query's token counts.

    Only the queries' tokens leave the texts. They are dealt by chunk once: counting them, meeting the queries and adding up
    scores need no further shuffle, and what ranks the scores keeps a query's best in each task.
    """
    counts = token_counts(chunks, text, tokens)
    totals = counts.where("token is null").select((F.col("length") / F.col("df")).alias("mean_length"))  # one row
    asked = queries.select("query_id", F.explode(tokens(F.coalesce(F.col("query"), F.lit("")))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    vocabulary = asked.select("token").distinct()
    few = vocabulary.count() <= BROADCAST_TOKENS
    bounded = lambda df: F.broadcast(df) if few else df
    weights = asked.join(token_stats(counts), "token").select("query_id", "token", (F.col("times") * F.col("idf")).alias("weight"))
    t = chunks.select(F.col(key).alias("chunk"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
    met = t.select("chunk", F.size("ts").alias("length"), F.explode("ts").alias("token")).join(bounded(vocabulary), "token", "left_semi")
    posts = met.repartition("chunk").groupBy("chunk", "token", "length").agg(F.count("*").alias("tf"))
    tf = F.col("tf")
    part = F.col("weight") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = posts.join(bounded(weights), "token").crossJoin(F.broadcast(totals))
    return scored.groupBy("query_id", "chunk").agg(F.round(F.sum(part), 6).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "query_id", order: tuple[str, ...] = ("chunk",)) -> DataFrame:
    """The k best of each query by score, ties in `order`; rank counts from 1. Spark limits each task's groups first."""
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), *order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_topk(queries: DataFrame, chunks: DataFrame, key: str = "doc_id", text: str = "text", k: int = 10, tokens=words) -> DataFrame:
    """Chunks with a score over 0, ties in corpus order."""
    return top_k(bm25_scores(queries, chunks, key, text, tokens).where("score > 0"), k)
