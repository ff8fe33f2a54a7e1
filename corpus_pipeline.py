"""The training-data pipeline: five stages over documents, each written as a table and reread by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bestfit, common, decontaminate, lines, neardup, quality

#: A trained classifier is one of the stages, so no SQL says what run() returns.
ORACLE_SQL = None


def _apart(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """operator(docs) with the columns of docs alone: all but doc_id and text go through it under reserved names, so that none
    of its outputs meets a column of the same name."""
    names = {c: c if c in ("doc_id", "text") else f"__kept_{i}" for i, c in enumerate(docs.columns)}
    found = operator(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return found.select(*[F.col(n).alias(c) for c, n in names.items()])


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3.

    Null and empty texts score by their lack of words. Repeated rows stay or go together; an empty table stays empty. The
    columns of docs stay as they are, whatever their names.
    """
    return _apart(docs, lambda d: quality.score(d, quality.fit(spark, sf_dir, d)).where("predicted = 1"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line repeats; n_chars, if there, follows a text that loses lines.

    A null text stays null, one whose lines all go is empty; a row with null doc_id is left alone. Lines of rows that repeat a
    doc_id tie and stay. Other columns stay as they are, whatever their names; an empty table stays empty.
    """
    before = docs.withColumn("__before", F.col("text"))
    found = _apart(before, lines.dedup_lines)
    if "n_chars" in docs.columns:
        cut = ~F.col("text").eqNullSafe(F.col("__before"))
        found = found.withColumn("n_chars", F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.drop("__before")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least doc_id.

    Texts without words, null ones too, are one class. Rows alike in doc_id and words leave one; a class of null doc_ids alone
    keeps one row. The columns of docs stay as they are, whatever their names; an empty table stays empty.
    """
    return _apart(docs, neardup.keep_one)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words the benchmark's windows cover less than a twentieth.

    Null and empty texts have no words and stay, as do rows with null doc_id; repeated rows stay or go together. The columns of
    docs stay as they are, whatever their names; an empty table stays empty.
    """
    return _apart(docs, lambda d: decontaminate.decontaminate(d, common.table(spark, sf_dir, "benchmark")).where("not contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens.

    Null and empty texts are one piece, the end id; rows with null doc_id and repeated rows are packed like any other. Columns
    but doc_id and text are ignored; an empty table gives no rows.
    """
    return bestfit.pack(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_documents),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialize(docs, name.replace(" ", "-"))
    return docs
