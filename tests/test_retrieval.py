"""Steps that the searches share: hashed vectors and visits of cells shuffle no more than they must."""

import hashlib
import re

from quillmill.operators import pivots, postings
from quillmill.plans import retrieval


def test_hashed_vectors(spark):
    texts = [(1, "the cat, the dog"), (2, ""), (3, None), (4, "ñu 学生 42 ñu"), (5, "...")]
    got = retrieval.hashed_vector(spark.createDataFrame(texts, "k long, t string"), "k", "t")
    want = {}
    for k, t in texts:
        for w in re.findall(r"[a-zñ]+|[学生]|[0-9]+", t or ""):
            want.setdefault(k, [0.0] * 64)[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
    assert {r["k"]: r["vector"] for r in got.collect()} == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_few_queries_are_one_pack_a_cell(spark):
    rows = [(i, [float(i % 7) + 1, float(i % 5)]) for i in range(80)]
    cells = pivots.build(spark.createDataFrame(rows, "chunk long, vector array<double>"), most_pivots=2)
    asked = pivots.materialize(pivots._tagged(spark.createDataFrame(rows[:40], "query_id long, vector array<double>"), None, pivots.F.col("query_id")), "asked")
    visits = asked.selectExpr("query_id", "tag", "0 AS cell", "0D AS angle", "CAST(NULL AS DOUBLE) AS limit")
    plan = pivots._visit(cells, asked, visits, 3)._jdf.queryExecution().executedPlan().toString()
    assert "pmod(xxhash64(query_id" in plan and ", 16)" not in plan


def test_vectors_of_the_index(spark, tmp_path):
    """The index's postings make the vectors that the texts make, without a look at the texts."""
    texts = [(i, " ".join(f"w{i * j % 37}" if j % 3 else "学生 the" for j in range(i % 11))) for i in range(100)] + [(100, ""), (101, None), (102, "ñu 学生 42 ñu")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = postings.write_index(docs, str(tmp_path / "index"), per_range=4)
    got = {r["chunk"]: r["vector"] for r in postings.token_vectors(index, retrieval.md5_buckets, 64).collect()}
    assert got == {r["doc_id"]: r["vector"] for r in retrieval.hashed_vector(docs, "doc_id", "text").collect()}
