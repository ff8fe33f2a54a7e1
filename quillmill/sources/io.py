"""Readers and writers of the pipeline's tables."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.versions import corpus_records, numbered, read_store

EXTENSIONS = (".md", ".txt", ".html", ".htm")
GOLD = "id bigint, question string, answer string, difficulty string, category string, is_table_question boolean, source_tags array<string>, source_files array<string>, negative_sample boolean"


def read_corpus_dir(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, source_path, file_type, modified, text, title, error) of the text and HTML files below a folder.

    Files of other types are rows with an error, as are undecodable ones; none stops the job.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    ok = kind.isin(*EXTENSIONS) & text.isNotNull()
    page = html_to_text(text)
    is_html = kind.isin(".html", ".htm")
    df = raw.select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("source_file"), F.col("path").alias("source_path"), kind.alias("file_type"), F.col("modificationTime").alias("modified"), F.when(ok, text).alias("raw"), F.when(ok & is_html, page).alias("page"), F.when(~kind.isin(*EXTENSIONS), F.lit("unsupported type")).when(~ok, F.lit("not UTF-8")).alias("error"))
    return df.select("source_file", "source_path", "file_type", "modified", F.coalesce("page.text", "raw").alias("text"), "page.title", "error")


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file"), F.col("value").alias("text"))


class _Page(HTMLParser):
    """Collects a page's title and the text of its first article, main or body: headings and tables as Markdown, code fenced."""

    SKIP = {"script", "style", "nav", "footer", "header"}
    VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}

    #: Elements whose text is gathered as a whole. Inside one of them another has no meaning of its own, but that a cell ends a cell.
    WHOLE = {"title", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "code", "td", "th"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.skip, self.stack = "", 0, []
        self.roots: dict[str, list[str]] = {}
        self.open: dict[str, int] = {}
        self.all: list[str] = []
        self.whole, self.depth, self.block = "", 0, []
        self.rows: list[list[str]] | None = None

    def _add(self, text: str) -> None:
        for part in [self.all, *(self.roots[k] for k in self.open)]:
            part.append(text)

    def _finish(self) -> None:
        """What the open whole element has gathered goes to its place."""
        tag, text = self.whole, "".join(self.block).strip()
        self.whole, self.block = "", []
        if tag == "title":
            self.title = self.title or text
        elif tag in ("td", "th"):
            if self.rows:
                self.rows[-1].append(text.replace("\n", " "))
        elif tag in ("pre", "code"):
            self._add("```\n" + text + "\n```")
        elif text:
            self._add("#" * int(tag[1]) + " " + text)

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        if self.whole in ("td", "th") and tag in ("td", "th", "tr"):
            self._finish()
        self.stack.append(tag)
        if tag in self.SKIP:
            self.skip += 1
        if tag in ("article", "main", "body") and tag not in self.roots:
            self.roots[tag], self.open[tag] = [], len(self.stack)
        cell = tag in ("td", "th")
        if tag in self.WHOLE and not self.whole and not self.skip and (cell or tag == "title" or self.rows is None) and not (cell and self.rows is None):
            self.whole, self.depth = tag, len(self.stack)
        if tag == "table":
            self.rows = []
        if tag == "tr" and self.rows is not None:
            self.rows.append([])

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            last = self.stack.pop()
            if last in self.SKIP:
                self.skip -= 1
            if last == tag:
                break
        if self.whole and len(self.stack) < self.depth:
            self._finish()
        if tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if any(r)], None
            if rows:
                self._add("\n".join(["| " + " | ".join(rows[0]) + " |", "| " + " | ".join("---" for _ in rows[0]) + " |", *("| " + " | ".join(r) + " |" for r in rows[1:])]))
        self.open = {k: n for k, n in self.open.items() if n <= len(self.stack)}

    def close(self):
        super().close()
        if self.whole:
            self._finish()

    def handle_data(self, data):
        if self.skip:
            return
        if self.whole:
            self.block.append(data)
        elif data.strip() and self.rows is None:
            self._add(data.strip())

    def text(self) -> str:
        return "\n".join(next((self.roots[k] for k in ("article", "main", "body") if k in self.roots), self.all))


@F.pandas_udf(StructType().add("title", "string").add("text", "string"))
def html_to_text(html: pd.Series) -> pd.DataFrame:
    """Title and Markdown-like text of pages; a null page gives nulls."""
    rows = []
    for h in html:
        if h is None:
            rows.append((None, None))
            continue
        p = _Page()
        p.feed(h)
        p.close()
        rows.append((p.title, p.text()))
    return pd.DataFrame(rows, columns=["title", "text"])


def extract_pages(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    return df.withColumn("page", html_to_text(html)).select(*[c for c in df.columns if c not in (html, url)], F.col(url).alias("source_url"), "page.title", "page.text")


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(doc, text, page_map, total_pages, ocr_pages) of parts (doc, page, part, text, from_image): parts of a page and pages
    joined by empty lines, pages without text left out of the text and the map but counted."""
    p = pages.groupBy("doc", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("part", "text")))), lambda x: x["text"]), "\n\n").alias("text"),
        (~F.bool_or(~F.col("from_image") & (F.coalesce("text", F.lit("")) != "")) & F.bool_or(F.col("from_image") & (F.coalesce("text", F.lit("")) != ""))).alias("ocr"),
    )
    full = F.struct("page", "text")
    rows = F.array_sort(F.collect_list(F.when(F.col("text") != "", full)))
    d = p.groupBy("doc").agg(rows.alias("rows"), F.count("*").alias("total_pages"), F.array_sort(F.collect_list(F.when(F.col("ocr"), F.col("page")))).alias("ocr_pages"))
    return d.select("doc", F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n").alias("text"), F.transform("rows", lambda r: F.struct(r["page"].alias("page"), F.char_length(r["text"]).alias("length"))).alias("page_map"), "total_pages", "ocr_pages")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions of a JSON lines file; blank lines are skipped."""
    return spark.read.schema(GOLD).json(path).where("id is not null")


def write_corpus(df: DataFrame, path: str) -> None:
    corpus_records(df).write.mode("overwrite").partitionBy("academic_year").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The records of write_corpus(), with the year as text and '' where there is none."""
    return read_store(spark, path)


def write_vectors(df: DataFrame, path: str, drop_old: bool = False) -> None:
    df.write.mode("overwrite" if drop_old else "append").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_corpus(vectors: DataFrame) -> DataFrame:
    """All rows of a vector table as corpus records of six metadata fields, numbered within their files."""
    keep = ["source_file", "business_tag", "academic_year", "chapter", "chunk_strategy", "heading_path"]
    return numbered(vectors, "chunk", "__nth").select(F.concat("source_file", F.lit("__chunk_"), "__nth").alias("chunk_id"), "text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in keep])


def write_eval(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("label").json(path)


SUMMARY = "label string, questions bigint, hits_at_3 bigint, seconds double, recall map<string,double>"


def write_eval_run(detail: DataFrame, path: str, label: str) -> DataFrame:
    """Write a run's detail (see evaluate.eval_detail) to path/detail/label=... and one summary row to path/summary: questions,
    hits and seconds are gathered by the pass that writes, recall from what it has written."""
    spark, seen, began = detail.sparkSession, Observation(label), time.monotonic()
    rows = detail.withColumn("hits", F.map_filter("hit", lambda _, h: h)).withColumn("hits", F.map_keys("hits"))
    seen_rows = rows.observe(seen, F.count(F.lit(1)).alias("questions"), F.count_if(F.array_contains("hits", 3)).alias("hits_at_3"))
    seen_rows.withColumn("ks", F.map_keys("hit")).drop("hit").write.mode("overwrite").json(f"{path}/detail/label={label}")
    seconds = round(time.monotonic() - began, 2)
    written = spark.read.json(f"{path}/detail/label={label}", schema="is_table_question boolean, hits array<int>, ks array<int>")
    each = written.select("is_table_question", "hits", F.explode("ks").alias("k"))
    parts = each.groupBy("k").agg(F.avg(F.array_contains("hits", F.col("k")).cast("double")).alias("all"), F.avg(F.when(F.col("is_table_question"), F.array_contains("hits", F.col("k")).cast("double"))).alias("table")).collect()  # a row each k
    recall = {f"{s}_{r.k}": round(r[s], 6) for r in parts for s in ("all", "table") if r[s] is not None}
    got = seen.get
    row = spark.createDataFrame([(label, got["questions"], got["hits_at_3"] or 0, seconds, recall)], SUMMARY)
    row.write.mode("overwrite").json(f"{path}/summary/run={label}")
    return row


def read_eval_summaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY).json(f"{path}/summary/*")
