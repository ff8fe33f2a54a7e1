"""Readers and sinks on small files."""

from pyspark.sql import functions as F

from quillmill.operators import dense, evaluate, versions
from quillmill.sources import io
from quillmill.streaming import requests


def test_corpus_dir(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A\ntext", encoding="utf-8")
    (tmp_path / "sub" / "b.html").write_text("<html><head><title> T </title></head><body><nav>n</nav><article><h2>H</h2><p>p &amp; q</p><table><tr><th>x</th></tr><tr><td>1</td></tr></table><pre>c = 1</pre></article><footer>f</footer></body></html>", encoding="utf-8")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r.source_file: r for r in io.read_corpus_dir(spark, str(tmp_path)).collect()}
    assert got["a.md"].text == "# A\ntext" and got["a.md"].error is None
    assert got["b.html"].title == "T" and got["b.html"].text == "## H\np & q\n| x |\n| --- |\n| 1 |\n```\nc = 1\n```"
    assert got["c.txt"].error == "not UTF-8" and got["d.pdf"].error == "unsupported type"
    assert io.read_text_docs(spark, str(tmp_path / "a.md")).first().text == "# A\ntext"


def test_golden_and_eval(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id": 1, "question": "q", "source_files": ["a"]}\n\n{"id": 2, "negative_sample": true}\n', encoding="utf-8")
    assert io.read_golden(spark, str(tmp_path / "g.jsonl")).count() == 2
    io.write_eval(spark.createDataFrame([("x", 1, 0.5)], "label string, k int, recall double"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).first().label == "x"


def test_pages(spark):
    rows = [("d", 1, 2, "b", False), ("d", 1, 1, "a", False), ("d", 2, 1, "", False), ("d", 3, 1, "ocr", True)]
    r = io.assemble_pages(spark.createDataFrame(rows, "doc string, page int, part int, text string, from_image boolean")).first()
    assert (r.text, r.total_pages, r.ocr_pages) == ("a\n\nb\n\nocr", 3, [3])
    assert [tuple(x) for x in r.page_map] == [(1, 4), (3, 3)]


def test_embedding_ladder(spark):
    def model(texts):
        if any("bad" in t and len(t) > 500 for t in texts):
            raise RuntimeError
        return [[1.0, float(len(t))] for t in texts]

    d = spark.createDataFrame([(1, "ok"), (2, "bad " * 200), (3, " ")], "chunk long, text string").coalesce(1)
    got = {r.chunk: r for r in dense.embed_corpus(d, model, 2).collect()}
    assert got[1].vector == [1.0, 2.0] and not got[2].failed and got[3].failed and got[3].vector == [0.0, 0.0]


def test_stream_import_is_idempotent(spark, tmp_path):
    for n in range(2):
        spark.range(n * 3, n * 3 + 3).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        requests.stream_import(s, str(tmp_path / "out"), str(tmp_path / "ck"), lambda b: b.withColumn("x", F.col("id") * 2)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_recall_grows_with_k(spark):
    c = spark.createDataFrame([(1, i, f"f{i}", "t") for i in range(1, 8)], "query_id int, rank int, source_file string, business_tag string")
    g = spark.createDataFrame([(1, ["f3"], ["t"], False, True), (2, ["f9"], [], True, False)], "query_id int, source_files array<string>, source_tags array<string>, negative_sample boolean, is_table_question boolean")
    r = {(x.subset, x.k): x.recall for x in evaluate.recall_at_k(evaluate.eval_detail(c, g)).collect()}
    assert r == {("all", 1): 0, ("all", 3): 1, ("all", 5): 1, ("table", 1): 0, ("table", 3): 1, ("table", 5): 1}


def test_rows_are_numbered_within_files_across_stretches(spark):
    rows = [("a", k * 7 % 101 - 20) for k in range(101)] + [(None, k) for k in (5, 3, None)] + [("b", 4)]
    got = versions.numbered(spark.createDataFrame(rows, "source_file string, k int"), "k", "nth", step=10).collect()
    want = []
    for f in ("a", "b", None):
        own = sorted((x for x in rows if x[0] == f), key=lambda x: (x[1] is not None, x[1]))
        want += [(f, k, i) for i, (_, k) in enumerate(own)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    text = versions.numbered(spark.createDataFrame([("a", "y"), ("a", "x")], "source_file string, k string"), "k", "nth").collect()
    assert sorted((r.k, r.nth) for r in text) == [("x", 0), ("y", 1)]


def test_usage_is_gathered_by_the_pass_that_writes(spark, tmp_path):
    d = spark.createDataFrame([(i, f"text {i}" if i else " ") for i in range(40)], "chunk long, text string").repartition(3)
    model = lambda texts: ([[float(len(t))] for t in texts], 2 * len(texts))
    rows = dense.embed_corpus(d, model, 1)
    used = dense.write_embedded(rows, str(tmp_path / "e"), "m").first()
    assert (used.label, used.rows, used.failed, used.tokens) == ("m", 40, 1, 78) and used.calls >= 3
    assert spark.read.parquet(str(tmp_path / "e" / "vectors")).count() == 40
    stats = dense.embed_stats(rows).first()
    assert (stats.calls, stats.tokens, stats.failed) == (used.calls, 78, 1)


def test_runs_leave_detail_and_summary(spark, tmp_path):
    c = spark.createDataFrame([(q, i, f"f{i}", "t") for q in (1, 2) for i in range(1, 8)], "query_id int, rank int, source_file string, business_tag string")
    g = spark.createDataFrame([(1, ["f3"], ["t"], False, True), (2, ["f1"], [], False, False)], "query_id int, source_files array<string>, source_tags array<string>, negative_sample boolean, is_table_question boolean")
    for label in ("a", "b"):
        io.write_eval_run(evaluate.eval_detail(c, g), str(tmp_path / "runs"), label)
    got = {r.label: r for r in io.read_eval_summaries(spark, str(tmp_path / "runs")).collect()}
    assert set(got) == {"a", "b"} and got["a"].questions == 2 and got["a"].hits_at_3 == 2 and got["a"].seconds >= 0
    assert got["b"].recall == {"all_1": 0.5, "all_3": 1.0, "all_5": 1.0, "table_1": 0.0, "table_3": 1.0, "table_5": 1.0}


def test_corpus_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(0, "x", "f", "2020-2021"), (1, " ", "f", ""), (2, "y", "f", None)], "ordinal long, text string, source_file string, academic_year string")
    io.write_corpus(d, str(tmp_path / "c"))
    assert sorted((r.chunk_id, r.text, r.academic_year) for r in io.read_corpus(spark, str(tmp_path / "c")).collect()) == [("f__chunk_0", "x", "2020-2021"), ("f__chunk_2", "y", "")]


def test_pages_with_code_cells_and_loose_ends(spark):
    cases = {
        "<body><p>run <code>ls -l</code> now</p></body>": "run\n```\nls -l\n```\nnow",
        "<body><pre><code>a = 1\nb</code></pre>x</body>": "```\na = 1\nb\n```\nx",
        "<main><h2>Use <code>f</code></h2></main>": "## Use f",
        "<body><table><tr><td>a<td><pre>b\nc</pre><tr><td>d<code>e</code></table>z</body>": "| a | b c |\n| --- | --- |\n| de |\nz",
        "<body><pre>x<script>y</script>z</pre></body>": "```\nxz\n```",
        "<body>k<pre>cut off": "k\n```\ncut off\n```",
        "<h3></h3>plain": "plain",
        "": "",
    }
    rows = spark.createDataFrame([(i, h) for i, h in enumerate([*cases, None])], "i int, html string")
    got = {r.i: r.p for r in rows.select("i", io.html_to_text("html").alias("p")).collect()}
    assert [got[i].text for i in range(len(cases))] == list(cases.values())
    assert got[len(cases)].text is None and got[len(cases)].title is None
