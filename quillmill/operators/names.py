"""The nearest of many names: candidates meet on shared segments, within an edit distance that grows until one is found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize, spread

STEPS = (1, 2, 3, 4, 6, 8)
#: Up to so many names each wanted one is compared with all: at a great distance segments are short and meet most names anyway.
FEW = 4096


def _distances(most: int):
    """Growing distances up to `most`."""
    d = 0
    for d in STEPS:
        yield d
    while d < most:
        d += d // 2
        yield d


def _segments(d: int):
    """Columns (start from 0, size) of segment i of a name of l letters cut into d + 1: the later ones take the remainder."""
    k = d + 1
    size, over = F.floor(F.col("l") / k), F.col("l") % k
    late = F.greatest(F.col("i") - (k - over), F.lit(0))
    return (F.col("i") * size + late).cast("int"), (size + F.when(F.col("i") >= k - over, 1).otherwise(0)).cast("int")


def _within(wanted: DataFrame, names: DataFrame, d: int) -> DataFrame:
    """(wanted, d, name) of the wanted names with a name at most d edits away: the nearest, the first on ties.

    d edits leave one of d + 1 segments of a name as it is, at most d places off. Names of up to d letters have no such
    segments and meet by their length.
    """
    start, size = _segments(d)
    cut = names.where(F.col("l") > d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(d)))).withColumns({"start": start, "size": size})
    cut = cut.select("name", "l", "i", F.substring(F.col("name"), F.col("start") + 1, F.col("size")).alias("segment"))
    lengths = wanted.withColumn("l", F.explode(F.sequence(F.greatest(F.length("wanted") - d, F.lit(0)), F.length("wanted") + d)))
    probe = lengths.where(F.col("l") > d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(d)))).withColumns({"start": start, "size": size})
    low, high = F.greatest(F.col("start") - d, F.lit(0)), F.least(F.col("start") + d, F.length("wanted") - F.col("size"))
    probe = probe.withColumns({"low": low, "high": high}).where("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    probe = probe.select("wanted", "l", "i", F.substring(F.col("wanted"), F.col("at") + 1, F.col("size")).alias("segment")).distinct()
    met = probe.join(cut, ["l", "i", "segment"]).select("wanted", "name")
    short = lengths.where(F.col("l") <= d).join(names.where(F.col("l") <= d), "l").select("wanted", "name")
    far = F.levenshtein("wanted", "name", d)
    return met.unionByName(short).distinct().withColumn("d", far).where("d >= 0").groupBy("wanted").agg(F.min(F.struct("d", "name")).alias("m")).select("wanted", "m.d", "m.name")


def nearest_names(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(wanted, d, name): the name of the least edit distance to each wanted one, the first on ties. Both are tables of one
    column; nulls are left out, repeats count once, and without names there are no rows. Few names are compared with all wanted."""
    names = materialize(names.toDF("name").where("name IS NOT NULL").distinct().withColumn("l", F.length("name")), "names")
    left = materialize(wanted.toDF("wanted").where("wanted IS NOT NULL").distinct(), "wanted")
    out = left.select("wanted", F.lit(0).alias("d"), F.col("wanted").alias("name")).join(names.select("name"), "name", "left_semi").select("wanted", "d", "name")
    left = materialize(left.join(out, "wanted", "left_anti"), "left")
    if names.count() <= FEW:
        pairs = spread(left).crossJoin(F.broadcast(names.select("name")))  # a wanted name's pairs stay in its task
        near = pairs.groupBy("wanted").agg(F.min(F.struct(F.levenshtein("wanted", "name").alias("d"), "name")).alias("m"))
        return out.unionByName(near.select("wanted", "m.d", "m.name"))
    most = names.agg(F.max("l")).first()[0]
    if most is None:
        return out
    most = max(most, left.agg(F.max(F.length("wanted"))).first()[0] or 0)
    for d in _distances(most):
        if left.isEmpty():
            break
        found = materialize(_within(left, names, d), "found")
        out = out.unionByName(found)
        left = materialize(left.join(found, "wanted", "left_anti"), "left")
    return out
