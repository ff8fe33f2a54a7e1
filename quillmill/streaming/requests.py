"""Request logs in batch and as streams: recent requests, statistics, idempotent imports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions

LOG = "request_id bigint, ts timestamp, question string, total_s double, retrieval_s double, llm_s double, total_tokens bigint, citation_count int, fallback boolean"
PAYLOAD = "struct<retrieved_docs:array<struct<doc_title:string,source_file:string,article:string>>,fallback:boolean,retrieval_s:double,context_build_s:double,llm_s:double,verify_s:double>"


def recent_requests(log: DataFrame, limit: int = 50) -> DataFrame:
    """The newest requests, 100 at most."""
    return log.orderBy(F.col("ts").desc(), F.col("request_id").desc()).limit(min(limit, 100))


def _stats() -> list[Column]:
    n = F.count("*")
    mean = lambda c, d: F.bround(F.coalesce(F.avg(c), F.lit(0.0)), d)
    return [
        n.alias("total"), mean("total_s", 3).alias("avg_total_s"), mean("retrieval_s", 3).alias("avg_retrieval_s"), mean("llm_s", 3).alias("avg_llm_s"), mean("total_tokens", 0).alias("avg_tokens"),
        mean("citation_count", 1).alias("avg_citations"), F.count_if("fallback").alias("fallback_count"), F.bround(F.when(n > 0, F.count_if("fallback") / n * 100).otherwise(F.lit(0.0)), 1).alias("fallback_rate"),
    ]


def request_stats(log: DataFrame) -> DataFrame:
    """One row of totals and means; zeros for an empty log."""
    return log.agg(*_stats())


def parse_request_log(raw: DataFrame) -> DataFrame:
    """(request_id, ts, payload JSON) as typed rows; total_s is the sum of the four stages."""
    p = raw.withColumn("p", F.from_json("payload", PAYLOAD))
    part = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(0.0))
    total = part("retrieval_s") + part("context_build_s") + part("llm_s") + part("verify_s")
    return p.select("request_id", "ts", "p.retrieved_docs", F.coalesce("p.fallback", F.lit(False)).alias("fallback"), F.round(total, 6).alias("total_s"))


def stream_request_stats(stream: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Statistics by tumbling window; repeats of a request within the watermark count once, so state stays bounded. A batch
    gives what the stream ends with."""
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"]) if stream.isStreaming else stream.dropDuplicates(["request_id"])
    return once.groupBy(F.window("ts", every)).agg(*_stats())


def running_request_stats(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """request_stats() of all requests since the stream began, renewed by every batch (output mode complete).

    Tasks add up their own rows, so a batch sends one row a task and the state is one row, beside the ids of the watermark's
    time, within which a request counts once however often it is sent. Requests later than that are left out.
    """
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"]).agg(*_stats())


def stream_import(stream: DataFrame, store: str, checkpoint: str, build):
    """Append build(new files) to the store batch by batch. Each batch overwrites its own folder, so a replay adds nothing."""

    def add(batch: DataFrame, n: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{store}/batch={n}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_imported(spark: SparkSession, store: str, before: int | None = None) -> DataFrame | None:
    """The rows that batches (before the given one) have added to a store of import_with_ids(), or None."""
    try:
        rows = spark.read.parquet(f"{store}/rows")
    except AnalysisException:
        return None
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def import_with_ids(stream: DataFrame, store: str, checkpoint: str, year: str, text: str = "text", order: str = "ordinal"):
    """Import new documents batch by batch as records whose numbers count on within their file (see versions.import_docs).

    Beside the rows, each batch leaves the greatest number of the files that it has touched. A batch looks at the numbers of
    earlier batches alone and overwrites its own folders, so one that is run again gives the ids it gave, and a restarted
    stream those of one import.
    """
    spark = stream.sparkSession

    def add(batch: DataFrame, n: int) -> None:
        try:
            had = spark.read.schema("batch bigint, source_file string, nth bigint").parquet(f"{store}/numbers").where(F.col("batch") < n)
        except AnalysisException:
            had = spark.createDataFrame([], "batch bigint, source_file string, nth bigint")
        last = had.groupBy("source_file").agg(F.max("nth").alias("nth"))
        known = last.select(F.concat("source_file", F.lit("__chunk_"), "nth").alias("chunk_id"), F.lit("").alias("text"), *[F.col(c) if c == "source_file" else F.lit("").alias(c) for c in versions.CORE])
        made = versions.import_docs(known, batch, year, text, order).where("text != ''")
        made.write.mode("overwrite").parquet(f"{store}/rows/batch={n}")
        fresh = spark.read.parquet(f"{store}/rows/batch={n}")
        number = F.regexp_extract("chunk_id", r"__chunk_(\d+)$", 1).cast("bigint")
        fresh.groupBy("source_file").agg(F.max(number).alias("nth")).write.mode("overwrite").parquet(f"{store}/numbers/batch={n}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
