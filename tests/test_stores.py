"""Stores of one version: updates that stop half way, replaced and dropped parts, a cache that fills and empties."""

import pytest
from pyspark.sql import functions as F

from quillmill.operators import versions
from quillmill.operators.stores import PairedCorpus, Stores, VariantStore


def pair(spark, rows):
    corpus = spark.createDataFrame(rows, "chunk_id string, academic_year string, text string")
    return corpus, corpus.select("chunk_id", "academic_year", F.array(F.length("text").cast("double")).alias("vector"))


def ids(frames):
    return [None if f is None else sorted(r.chunk_id for r in f.collect()) for f in frames]


def test_a_half_written_version_is_never_seen(spark, tmp_path):
    both = PairedCorpus(spark, str(tmp_path / "root"))
    assert both.read() == (None, None)
    both.rebuild(*pair(spark, [("a", "2020-2021", "x"), ("b", "2021-2022", "xx"), ("c", "", "y")]))

    @F.udf("string")
    def broken(x):
        raise ValueError("the writer dies")

    corpus, vectors = pair(spark, [("b2", "2021-2022", "new")])
    with pytest.raises(Exception, match="the writer dies"):
        both.rebuild(corpus, vectors.withColumn("chunk_id", broken("chunk_id")))
    assert ids(both.read()) == [["a", "b", "c"]] * 2
    before = both.read()
    both.rebuild(corpus, vectors)
    assert ids(both.read()) == [["a", "b2", "c"]] * 2
    assert ids(before) == [["a", "b", "c"]] * 2  # an open reader keeps its version
    assert versions.check_consistency(*both.read()).count() == 0
    both.drop("2020-2021")
    assert ids(both.read()) == [["b2", "c"]] * 2
    both.rebuild(corpus.limit(0), vectors.limit(0), ["2021-2022"])
    assert ids(both.read()) == [["c"]] * 2
    both.drop("none")
    assert both.read() == (None, None)
    assert both.stores.version() == 5


def test_two_writers_of_one_version(spark, tmp_path):
    stores = Stores(spark, str(tmp_path / "root"))
    rows = spark.createDataFrame([(1, "a/b c=d")], "k int, p string")
    stores.publish({"s": (rows, F.col("p"))})
    assert [r.k for r in stores.read("s", ["a/b c=d"]).collect()] == [1]
    assert stores.read("s", ["other"]) is None
    stale = Stores(spark, str(tmp_path / "root"))
    stale.version = lambda: 0
    with pytest.raises(Exception, match="(?i)exists"):
        stale.publish({"s": (rows, F.col("p"))})


def test_variants_of_run_one_are_hits_of_run_two(spark, tmp_path):
    store = VariantStore(spark, str(tmp_path / "cache"), buckets=4)
    queries = spark.createDataFrame([(i, f"q{i % 5}") for i in range(8)], "query_id int, query string")
    hits, misses = store.resolve(queries)
    assert (hits.count(), misses.count()) == (0, 8)
    store.append(misses.select("query", F.array(F.concat("query", F.lit("'"))).alias("variants")))
    hits, misses = store.resolve(queries)
    assert (hits.count(), misses.count()) == (8, 0)
    reader = store.read()
    folders = {x[2]: x[3] for x in store.stores.manifest()}
    store.append(spark.createDataFrame([("q1", ["new"]), ("q9", None), (None, ["x"])], "query string, variants array<string>"))
    after = {x[2]: x[3] for x in store.stores.manifest()}
    assert any(folders[b] == after[b] for b in folders)  # untouched buckets keep their folder
    assert {r.key: r.variants for r in store.resolve(queries)[0].where("query = 'q1'").collect()}.popitem()[1] == ["new"]
    assert reader.count() == 5 and store.read().count() == 6
    store.clear()
    assert store.resolve(queries)[0].count() == 0 and store.read().count() == 0
