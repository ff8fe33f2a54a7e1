"""Stores that change together: a manifest names the folders of every store's parts, and one rename brings a version to light.

A folder, once named, never changes. An update writes the parts that it touches into new folders, of all its stores, and then
the next manifest; until that one is there readers find the old version whole, so a writer that dies between two stores, or a
reader in the midst of an update, sees no mixture.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version bigint, store string, part string, folder string"


class Stores:
    """The stores below a root folder. A row's part is text: an academic year, a bucket."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> list[tuple[int, str, str, str]]:
        """Rows (version, store, part, folder) of the newest version: as many as there are parts."""
        try:
            known = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/*")
        except AnalysisException:
            return []
        newest = known.agg(F.max("version")).first()[0]
        return [tuple(r) for r in known.where(F.col("version") == newest).collect() if r.store] if newest is not None else []

    def version(self) -> int:
        """The newest version's number; 0 before there is one."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/*").agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def read(self, store: str, parts: Iterable[str] | None = None) -> DataFrame | None:
        """The store's rows, or those of some parts, as of the newest version; None if it has none."""
        wanted = None if parts is None else set(parts)
        return self._rows([x for x in self.manifest() if x[1] == store and (wanted is None or x[2] in wanted)])

    def read_all(self) -> dict[str, DataFrame]:
        """All stores as of one version."""
        known = self.manifest()
        return {s: self._rows([x for x in known if x[1] == s]) for s in dict.fromkeys(x[1] for x in known)}

    def _rows(self, entries: list[tuple[int, str, str, str]]) -> DataFrame | None:
        return self.spark.read.parquet(*[x[3] for x in entries]) if entries else None

    def publish(self, changes: dict[str, tuple[DataFrame, Column]], parts: Iterable[str] = (), drop: Iterable[str] = ()) -> int:
        """The next version's number: each store's rows replace those of the parts that they hold, and of `parts`, which may
        come out empty; the parts in drop go from every store. All other parts keep their folders.

        changes gives a store's rows and the column that tells a row's part. A second writer of the same version fails.
        """
        old, number = self.manifest(), self.version() + 1
        gone, fresh, cleared = set(drop), [], set(parts)
        for store, (rows, part) in changes.items():
            at = f"{self.root}/data/{store}-{uuid.uuid4().hex}"
            rows.withColumn("__part", part.cast("string")).write.partitionBy("__part").parquet(at)
            held = [r[0] for r in self.spark.read.schema("__part string").parquet(at).select("__part").distinct().collect()]  # as many as parts
            fresh += [(number, store, p, f"{at}/__part={_escaped(p)}") for p in held]
        replaced = {(s, p) for _, s, p, _ in fresh} | {(s, p) for s in changes for p in cleared}
        rows = [(number, s, p, f) for _, s, p, f in old if p not in gone and (s, p) not in replaced] + fresh
        # One file, written aside and renamed when its job commits. A version without parts is a row of nulls.
        table = self.spark.createDataFrame(rows or [(number, None, None, None)], MANIFEST).coalesce(1)
        table.write.mode("errorifexists").parquet(f"{self.root}/manifests/{number:012d}")
        return number


def _escaped(part: str) -> str:
    """A partition value as Spark writes it in a folder's name."""
    return "".join(c if c.isalnum() or c in "-_. ," or not c.isascii() else f"%{ord(c):02X}" for c in part)


class PairedCorpus:
    """Chunks and their vectors by academic year, always of one version."""

    def __init__(self, spark: SparkSession, root: str):
        self.stores = Stores(spark, root)

    def rebuild(self, corpus: DataFrame, vectors: DataFrame, years: Iterable[str] = ()) -> int:
        """Put the years that the two tables hold, and those named, in place of what there was. Both have academic_year."""
        year = F.coalesce(F.when(F.col("academic_year") != "", F.col("academic_year")), F.lit("none"))
        return self.stores.publish({"corpus": (corpus, year), "vectors": (vectors, year)}, parts=years)

    def drop(self, *years: str) -> int:
        return self.stores.publish({}, drop=years)

    def read(self) -> tuple[DataFrame | None, DataFrame | None]:
        both = self.stores.read_all()
        return both.get("corpus"), both.get("vectors")


class VariantStore:
    """Query variants by the md5 of the query, kept between runs: (key, variants array<string>) in buckets of the key."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.stores, self.buckets = Stores(spark, root), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("string")

    def read(self) -> DataFrame:
        found = self.stores.read("variants")
        return found if found is not None else self.stores.spark.createDataFrame([], "key string, variants array<string>")

    def resolve(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Queries (query_id, query) with their variants, and those without; repeats of a query each have a row."""
        keyed, known = queries.withColumn("key", F.md5("query")), self.read()
        return keyed.join(known, "key"), keyed.join(known, "key", "left_anti")

    def append(self, new: DataFrame) -> int:
        """Add (query, variants): a known query's variants are replaced. Only the buckets of the new keys are written anew."""
        new = new.where("query IS NOT NULL").select(F.md5("query").alias("key"), "variants").dropDuplicates(["key"])
        touched = [r[0] for r in new.select(self._bucket().alias("b")).distinct().collect()]  # at most `buckets`
        old = self.stores.read("variants", touched)
        rows = new if old is None else old.join(new, "key", "left_anti").unionByName(new)
        return self.stores.publish({"variants": (rows, self._bucket())})

    def clear(self) -> int:
        return self.stores.publish({}, drop=[str(b) for b in range(self.buckets)])
