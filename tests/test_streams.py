"""Running totals and imports of streams against their batch forms."""

from pyspark.sql import functions as F

from quillmill.operators import versions
from quillmill.plans.logs import log
from quillmill.streaming import requests

SF = "/root/testdata/sf0.001"


def test_running_totals_count_repeats_once(spark, tmp_path):
    rows = log(spark, SF).withColumn("total_tokens", F.when(F.col("request_id") % 7 > 0, F.col("total_tokens")))
    folder, seen = str(tmp_path / "in"), []

    def run():
        out = requests.running_request_stats(spark.readStream.schema(rows.schema).parquet(folder), "4000 days")
        out.writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda b, n: seen.extend(b.collect())).trigger(availableNow=True).start().awaitTermination()
        return seen[-1]

    first = rows.where("request_id < 400")
    first.unionByName(first.limit(50)).write.parquet(folder)
    assert run() == requests.request_stats(first).first()
    rows.where("request_id >= 300").write.mode("append").parquet(folder)  # a hundred of them were counted before
    assert run() == requests.request_stats(rows).first()


def test_restarted_import_gives_the_ids_of_one(spark, tmp_path):
    schema = "ordinal long, text string, source_file string, business_tag string"
    data = [(i, None if i % 9 == 0 else f"text {i}", f"f{i % 3}", "t") for i in range(40)]
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(folder)
        requests.import_with_ids(stream, store, str(tmp_path / checkpoint), "2020-2021").awaitTermination()

    assert requests.read_imported(spark, store) is None
    for part in (data[:15], data[15:40]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        run("ck")
    whole = versions.import_docs(versions.corpus_records(spark.createDataFrame([], schema)), spark.createDataFrame(data, schema), "2020-2021")
    pick = lambda d: sorted((r.chunk_id, r.text, r.academic_year, r.business_tag) for r in d.collect())
    # A batch numbers its rows within their files by their order, blank ones left out first, as one import does.
    assert pick(requests.read_imported(spark, store)) == pick(whole)
    assert requests.read_imported(spark, store, 1).count() == sum(1 for x in data[:15] if x[1])
