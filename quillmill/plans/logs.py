"""Request logs and load-test results over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate
from ..streaming import requests
from .registry import query, table

RESULT = "SELECT event_id AS request_id, ts, value AS total_s, value * 0.11 AS retrieval_s, value * 0.87 AS llm_s, CAST(json_extract_string(props, '$.k') AS BIGINT) AS total_tokens, event_type = 'view' AS fallback, event_id % 4 AS citation_count, event_type <> 'error' AS success, event_type FROM events"


def log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("request_id"), "ts", F.col("value").alias("total_s"), (F.col("value") * 0.11).alias("retrieval_s"), (F.col("value") * 0.87).alias("llm_s"), F.get_json_object("props", "$.k").cast("bigint").alias("total_tokens"), (F.col("event_type") == "view").alias("fallback"), (F.col("event_id") % 4).cast("int").alias("citation_count"), (F.col("event_type") != "error").alias("success"), "event_type")


@query(f"SELECT request_id, total_s FROM ({RESULT}) ORDER BY ts DESC, request_id DESC LIMIT 50")
def recent_requests(spark, sf_dir):
    return requests.recent_requests(log(spark, sf_dir)).select("request_id", "total_s")


@query(f"SELECT count(*) AS total, round_even(avg(total_s), 3) AS avg_total_s, round_even(avg(retrieval_s), 3) AS avg_retrieval_s, round_even(avg(llm_s), 3) AS avg_llm_s, round_even(avg(total_tokens), 0) AS avg_tokens, round_even(avg(citation_count), 1) AS avg_citations, count(*) FILTER (fallback) AS fallback_count, round_even(count(*) FILTER (fallback) / count(*) * 100, 1) AS fallback_rate FROM ({RESULT})")
def request_stats(spark, sf_dir):
    return requests.request_stats(log(spark, sf_dir))


def _measures() -> str:
    out = []
    for m in ("total_s", "retrieval_s", "llm_s"):
        out.append(f"round(avg({m}) FILTER (success), 6) AS {m}_mean, " + ", ".join(f"round(quantile_cont({m}, {p / 100}) FILTER (success), 6) AS {m}_p{p}" for p in (50, 95, 99)) + f", round(min({m}) FILTER (success), 6) AS {m}_min, round(max({m}) FILTER (success), 6) AS {m}_max")
    return ", ".join(out)


@query(f"SELECT event_type, count(*) AS requests, round(avg(CAST(success AS DOUBLE)), 6) AS success_rate, {_measures()} FROM ({RESULT}) GROUP BY event_type")
def latency_report(spark, sf_dir):
    return evaluate.latency_report(log(spark, sf_dir), by=("event_type",))


@query(f"SELECT event_type, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(avg(total_tokens), 6) AS mean_tokens FROM ({RESULT}) WHERE success GROUP BY event_type")
def token_report(spark, sf_dir):
    return evaluate.token_report(log(spark, sf_dir), ("event_type",))


@query(f"SELECT event_type, round(avg(retrieval_s) / avg(total_s), 6) AS retrieval_s_share, round(avg(llm_s) / avg(total_s), 6) AS llm_s_share FROM ({RESULT}) WHERE success GROUP BY event_type")
def stage_share(spark, sf_dir):
    return evaluate.stage_share(log(spark, sf_dir), by=("event_type",))


@query(f"SELECT request_id, ts FROM ({RESULT}) WHERE NOT success")
def failed_requests(spark, sf_dir):
    return evaluate.failed_requests(log(spark, sf_dir)).select("request_id", "ts")


@query("SELECT event_id AS request_id, event_id % 2 = 0 AS fallback, round(value, 6) AS total_s, 'src1' AS first_file FROM events")
def parsed_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    payload = F.to_json(F.struct(F.array(F.struct(F.lit("t").alias("doc_title"), F.lit("src1").alias("source_file"), F.lit("").alias("article"))).alias("retrieved_docs"), (F.col("event_id") % 2 == 0).alias("fallback"), (F.col("value") / 2).alias("retrieval_s"), (F.col("value") / 4).alias("llm_s"), (F.col("value") / 4).alias("verify_s")))
    p = requests.parse_request_log(e.select(F.col("event_id").alias("request_id"), "ts", payload.alias("payload")))
    return p.select("request_id", "fallback", "total_s", F.get("retrieved_docs", F.lit(0))["source_file"].alias("first_file"))


@query("SELECT count(*) AS windows, CAST(sum(total) AS BIGINT) AS total FROM (SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS w, count(DISTINCT event_id) AS total FROM events GROUP BY ALL)")
def windowed_stats(spark, sf_dir):
    """The streaming statistics over the table as one batch: the state that the stream ends with."""
    s = requests.stream_request_stats(log(spark, sf_dir))
    return s.agg(F.count("*").alias("windows"), F.sum("total").alias("total"))
