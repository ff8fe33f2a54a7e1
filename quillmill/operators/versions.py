"""Corpus versions by academic year. A corpus is a table of chunks; stores are Parquet folders partitioned by year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import rules

CORE = ["source_file", "business_tag", "academic_year", "chapter", "chunk_strategy", "heading_path", "doc_type", "effective_date", "scope"]


def core_fields(df: DataFrame) -> list[Column]:
    """The core fields as strings: null, missing, array and struct values are ''."""
    have = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return [(F.coalesce(F.col(c).cast("string"), F.lit("")) if have.get(c, "array") not in ("array", "struct", "map") else F.lit("")).alias(c) for c in CORE]


def numbered(df: DataFrame, order: str, name: str, step: int = 1_000_000) -> DataFrame:
    """df with `name`, each row's place from 0 within its source_file by a column of order.

    A large file's rows are no single group: by a numeric order they are ranked within stretches of `step` values, to which
    the counts of the stretches before are added, one row for each stretch. Other orders rank a file as a whole.
    """
    kind = df.schema[order].dataType
    place = F.floor(F.col(order) / step).cast("bigint") if isinstance(kind, NumericType) else F.lit(None).cast("bigint")
    stretch = F.coalesce(place, F.lit(-(1 << 62)).cast("bigint"))  # nulls come first
    df = df.withColumn("__stretch", stretch)
    sizes = df.groupBy("source_file", "__stretch").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("source_file").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("source_file").alias("__file"), F.col("__stretch").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("source_file", "__stretch").orderBy(order)) - 1
    ranked = df.withColumn(name, within).join(bases, F.col("source_file").eqNullSafe(F.col("__file")) & (F.col("__stretch") == F.col("__of")))
    return ranked.withColumn(name, F.col("__base") + F.col(name)).drop("__stretch", "__file", "__of", "__base")


def corpus_records(df: DataFrame, text: str = "text", order: str = "ordinal") -> DataFrame:
    """(chunk_id, text, core fields) without blank texts; the number in an id is the row's place within its file, counted
    before blank rows go, so it needs no global order."""
    named = numbered(df, order, "__nth").withColumn("chunk_id", F.concat(F.coalesce("source_file", F.lit("")), F.lit("__chunk_"), "__nth"))
    return named.where(F.trim(F.coalesce(text, F.lit(""))) != "").select("chunk_id", F.col(text).alias("text"), *core_fields(df))


def list_years(df: DataFrame) -> DataFrame:
    year = F.coalesce(F.when(F.col("academic_year") != "", F.col("academic_year")), F.lit(rules.NO_YEAR))
    return df.groupBy(year.alias("academic_year")).agg(F.count("*").alias("chunks"))


def count_year(df: DataFrame, year: str) -> DataFrame:
    return df.where(F.col("academic_year") == year).agg(F.count("*").alias("chunks"))


def preview_delete(df: DataFrame, year: str) -> DataFrame:
    return df.where(F.col("academic_year") == year).agg(F.count("*").alias("chunks"), F.count_distinct("source_file").alias("files"))


def delete_year(df: DataFrame, year: str, files: DataFrame | None = None) -> DataFrame:
    """df without the year, or without those of its rows whose file is in files."""
    hit = F.coalesce(F.col("academic_year"), F.lit("")) == year
    if files is None:
        return df.where(~hit)
    marked = files.select("source_file").distinct().withColumn("listed", F.lit(True))
    return df.join(marked, "source_file", "left").where(~(hit & F.coalesce("listed", F.lit(False)))).drop("listed")


def remove_files(df: DataFrame, files: DataFrame) -> DataFrame:
    return df.join(files.select("source_file").distinct(), "source_file", "left_anti")


def import_docs(corpus: DataFrame, new: DataFrame, year: str, text: str = "text", order: str = "ordinal") -> DataFrame:
    """corpus and the records of new under the given year; ids count on after the greatest number that the file has."""
    fresh = new.withColumn("academic_year", F.lit(year)).where(F.trim(F.coalesce(text, F.lit(""))) != "")
    number = F.regexp_extract("chunk_id", r"__chunk_(\d+)$", 1)
    had = corpus.groupBy("source_file").agg((F.max(F.when(number != "", number.cast("bigint"))) + 1).alias("had"))
    fresh = numbered(fresh, order, "nth").join(had, "source_file", "left")
    ids = F.concat("source_file", F.lit("__chunk_"), F.coalesce("had", F.lit(0)) + F.col("nth"))
    return corpus.unionByName(fresh.select(ids.alias("chunk_id"), F.col(text).alias("text"), *core_fields(fresh)))


def rebuild_year(corpus: DataFrame, new: DataFrame, year: str, confirmed: bool = True, **options) -> DataFrame:
    """The year deleted and imported anew; the corpus as it was unless the deletion is confirmed."""
    return import_docs(delete_year(corpus, year), new, year, **options) if confirmed else corpus


def write_store(df: DataFrame, path: str) -> None:
    """Write the years that df has, leaving the store's other years as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("academic_year").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumn("academic_year", F.coalesce(F.col("academic_year").cast("string"), F.lit("")))


def check_consistency(corpus: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, state): rows of one store that the other lacks, counting repeats."""
    a, b = (d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((corpus, "a"), (vectors, "b")))
    j = a.join(b, key, "full_outer").na.fill(0, ["a", "b"]).where("a != b")
    return j.select(key, F.when(F.col("a") > F.col("b"), "missing_in_vectors").otherwise("missing_in_corpus").alias("state"))
