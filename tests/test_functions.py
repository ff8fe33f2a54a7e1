"""Scalar rules on hand-written rows."""

import random

from pyspark.sql import functions as F

from quillmill.functions import clean, meta, rules, structure, text
from quillmill.operators import chunk


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_clean_text(spark):
    assert one(spark, "Page 3\r\n​ a  b \n- 4 -\n\n\n\n\nc\n| x  y |", clean.clean_text) == "a b\n\n\nc\n| x  y |"
    assert one(spark, None, clean.clean_text) is None


def test_sanitize_and_values(spark):
    assert one(spark, "ＡＢ\x07 ​c\n\n\n\nd", clean.sanitize_text) == "AB c\n\nd"
    assert one(spark, "１６６．５ ％", clean.normalize_value) == "166.5%"


def test_code_runs_of_three(spark):
    assert one(spark, "a();\nb();\nc();\nplain\nd();", structure.mark_code_blocks) == "```\na();\nb();\nc();\n```\nplain\nd();"


def test_tables_and_headings(spark):
    assert one(spark, "a\n | x | \n| y |\nb", structure.normalize_tables) == "a\n\n| x |\n| y |\n\nb"
    assert one(spark, "第一章 总则\n一、范围\n1.1 适用\n1. a。", structure.normalize_headings) == "## 第一章 总则\n### 一、范围\n#### 1.1 适用\n1. a。"


def test_table_to_markdown(spark):
    row = spark.createDataFrame([([["a", "b"], ["1\n2", None], ["x", "y", "z"]],), ([],)], "c array<array<string>>")
    got = [r[0] for r in row.select(structure.table_to_markdown(F.col("c"))).collect()]
    assert got == ["| a | b |\n| --- | --- |\n| 1 2 |  |\n| x | y |", ""]


def test_metadata_rules(spark):
    d = spark.createDataFrame([("3 关于2024-2025学年第一学期选课的通知.pdf", "正文 2024年3月5日")], "source_file string, text string")
    r = meta.extract_metadata(d).first()
    assert (r.business_tag, r.academic_year, r.doc_type, r.effective_date, r.update_time) == ("选课", "2024-2025", "通知", "2024-2025-一", "2024-03-05")
    assert one(spark, "7 浙工大发〔2022〕46号浙江工业大学奖学金评定办法.pdf", meta.doc_title) == "浙江工业大学奖学金评定办法"
    assert one(spark, "第二章 x 第三条", meta.article_mark) == "第三条"
    assert one(spark, "1. **a**\n\n2、`b`", meta.parse_rewrites) == ["a", "b"]


def test_chunking(spark):
    assert list(chunk.sections("p\n# A\nx\n## B\ny\n# C\nz")) == [([], "p"), (["A"], "x"), (["A", "B"], "y"), (["C"], "z")]
    assert list(chunk.blocks("a\n|x|\n|y|\n```\nc\n```\nb")) == [("text", "a"), ("table", "|x|\n|y|"), ("code", "```\nc\n```"), ("text", "b")]
    assert chunk.pack_paragraphs("aaaa\n\nbbbb\n\ncccc", 8, 2) == ["aaaa\n\nbbbb", "bb\n\ncccc"]
    assert chunk.pack_paragraphs("aa\n\nbbbbbbbbbbbb\n\ncc\n\n \n\ndd", 6, 2) == ["aa", "bbbbbb", "bbbbbb", "bbbb", "cc\n\ndd"]
    assert chunk.split_table("h\n-") == ["h\n-"] and chunk.split_table("h\n-\n" + "r" * 20, 5) == ["h\n-\n" + "r" * 20]
    assert chunk.split_table("h\n-\n" + "\n".join("r" * 5 for _ in range(4)), 14) == ["h\n-\nrrrrr\nrrrrr", "h\n-\nrrrrr\nrrrrr"]
    text = "".join(chr(97 + i % 26) for i in range(1234))
    parts = one(spark, text, chunk.hard_split)
    assert parts[0] + "".join(p[50:] for p in parts[1:]) == text
    rows = chunk.chunk(spark.createDataFrame([("f", "# A\nx"), ("g", None)], "source_file string, text string")).collect()
    assert [(r.content, r.heading_level, r.chunk_index) for r in rows] == [("A\n\nx", 1, 0)]


def test_build_corpus(spark):
    body = "第一章 总则\nPage 3\n本办法自2022年9月1日起施行。\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n第二章 附则\n" + "其他规定。" * 150
    rows = [(1, "浙江工业大学学生管理办法.docx", body, 1.5, 9), (2, "2023软件工程专业培养计划.pdf", "plain", None, 9), (2, "2023软件工程专业培养计划.pdf", "plain", None, 9), (3, "x.txt", None, 0.0, 9), (4, "y.txt", "", 0.0, 9)]
    docs = spark.createDataFrame(rows, "doc_id int, source_file string, text string, size double, section int")
    got = chunk.build_corpus(docs).orderBy("doc_id", "chunk_index").collect()
    plain = structure.mark_structures(docs.where("text is not null").select("doc_id", clean.clean_text(F.col("text")).alias("text")))
    want = chunk.chunk(plain, key="doc_id").orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.section, r.chunk_index, r.content_type, r.heading_path, r.content) for r in got] == [(r.doc_id, r.section, r.chunk_index, r.content_type, r.heading_path, r.content) for r in want]
    first = [r for r in got if r.doc_id == 1]
    assert len(first) > 3 and {r.content_type for r in first} == {"text", "table"} and {r["size"] for r in first} == {1.5} and {r.chunk_strategy for r in first} == {"structured"}
    meta_of = {r.doc_id: r for r in meta.extract_metadata(plain.join(docs.select("doc_id", "source_file").distinct(), "doc_id")).collect()}
    assert all(r[c] == meta_of[r.doc_id][c] for r in got for c in ("file_type", "business_tag", "academic_year", "chapter", "doc_type", "effective_date", "scope", "update_time"))
    assert chunk.build_corpus(docs.limit(0)).count() == 0 and chunk.build_corpus(docs, strategy="recursive").where("heading_path != ''").count() == 0


def test_tokens_of_batches(spark):
    """Texts are cut as the engine's pattern cuts them: every character, terms that overlap or span texts, odd cases and lengths."""
    rng = random.Random(3)
    letters = ["a", "Z", "É", "İ", "ß", "7", "٣", " ", "-", "\n", "々", "〇", "学", "分", "要", "求", "한", "𠀀", "𝔸", "😀", "é", *rules.TERMS]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(400)]
    texts += ["", "学分", "要求", "", "毕业要求求", "专业选修专业必修通识选修", "学分要求学分要求", "abc", "abc12学x", ""]
    texts += ["".join(chr(i) for i in range(lo, lo + 2048) if not 0xD800 <= i < 0xE000) for lo in range(0, 0x110000, 2048)]
    texts += ["".join(f"{chr(i)} " for i in range(lo, lo + 2048) if not 0xD800 <= i < 0xE000) for lo in range(0, 0x32000, 2048)]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", F.lower("t").alias("low"), text.words(F.col("t")).alias("ts")).orderBy("k").toArrow()
    table = text.code_points(spark)
    for lo, hi in ((0, len(texts)), (3, 405), (395, 410), (401, 401), (400, 401)):
        part = d.column("low").combine_chunks().slice(lo, hi - lo)
        ts, counts = text.cut(part, table, rules.TERMS)
        want = d.column("ts").slice(lo, hi - lo).to_pylist()
        assert counts.tolist() == [len(w) for w in want]
        assert ts.to_pylist() == [t for w in want for t in w]
