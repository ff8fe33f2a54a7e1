"""Every registered query over the smallest tables, against its SQL in DuckDB where it has one; invariants of fusion and caps."""

import duckdb
import pytest

from quillmill.operators import fuse, rerank, versions
from quillmill.plans import registry
from quillmill.streaming import requests

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in registry.TABLES:
        import os

        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 5)
    return int(v) if hasattr(v, "item") and not isinstance(v.item(), float) and not isinstance(v.item(), bool) else v


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    rows = [tuple(plain(v) for v in r) for r in got.select(*sorted(got.columns)).collect()]
    assert len(set(got.columns)) == len(got.columns)
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        names = list(want.columns)
        assert sorted(names) == sorted(got.columns)
        order = [names.index(c) for c in sorted(names)]
        expected = [tuple(plain(r[i]) for i in order) for r in want.fetchall()]
        assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_cap_and_fusion(spark):
    legs = spark.createDataFrame([(1, 1, 1, "a", 0.9), (1, 1, 2, "b", 0.5), (1, 2, 1, "b", 3.0), (1, 2, 2, "c", 1.0)], "query_id int, leg int, rank int, key string, score double")
    assert [r.key for r in fuse.rrf_fuse(legs).orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r.key for r in fuse.weighted_fuse(legs).orderBy("rank").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        fuse.hybrid(legs, "other")
    c = spark.createDataFrame([(1, i, "s" if i < 4 else "t") for i in range(1, 7)], "query_id int, rank int, source_file string")
    assert [r.rank for r in rerank.dedup_by_source(c, 2).collect()] == [1, 2, 3, 4]


def test_store_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", "2020-2021"), ("b", "2021-2022")], "chunk_id string, academic_year string")
    path = str(tmp_path / "store")
    versions.write_store(d, path)
    versions.write_store(spark.createDataFrame([("c", "2021-2022")], d.schema), path)
    assert {r.chunk_id for r in versions.read_store(spark, path).collect()} == {"a", "c"}


def test_stream_matches_batch(spark, tmp_path):
    from quillmill.plans.logs import log

    rows = log(spark, SF)
    rows.unionByName(rows.limit(50)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = requests.stream_request_stats(stream).writeStream.outputMode("complete").format("memory").queryName("stats").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("SELECT sum(total) FROM stats").first()[0]
    assert got == rows.count()


def test_a_single_form_passes_unfused(spark):
    rows = [(1, 0, 1, "a", 0.9), (1, 0, 2, "b", 0.5), (1, 1, 1, "b", 3.0), (2, 1, 1, "c", 7.5), (2, 1, 2, "d", 7.0), (2, 1, 3, "e", 1.0)]
    legs = spark.createDataFrame(rows, "query_id int, leg int, rank int, key string, score double")
    got = {(r.query_id, r.key): (r.score, r["rank"]) for r in fuse.multi_query(legs, top_k=2).collect()}
    assert got == {(1, "a"): (3.0, 1), (1, "b"): (1.0, 2), (2, "c"): (7.5, 1), (2, "d"): (7.0, 2)}
    from pyspark.sql import functions as F

    several = legs.withColumns({"rrf_score": F.lit(0.25), "fused_score": F.when(F.col("key") == "a", 2.0)})
    assert {r.key: r.s for r in several.select("key", fuse.first_score(several).alias("s")).where("key < 'c'").distinct().collect()} == {"a": 2.0, "b": 0.25}
