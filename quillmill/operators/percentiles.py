"""Exact percentiles of large groups: order statistics are found by counting ranges, so no group's values meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize

#: Parts that a pass cuts a range into; values up to which a range is ranked.
PARTS, RANKED = 4096, 10_000


def exact_percentiles(df: DataFrame, value: str, shares: tuple[float, ...], by: tuple[str, ...] = (), parts: int = PARTS, ranked: int = RANKED) -> DataFrame:
    """(by, share, percentile): interpolated between the two order statistics around share * (n - 1).

    A pass counts the values in `parts` parts of each open range and keeps the part that holds a wanted rank, until it holds
    one value (however often) or at most `ranked` rows, which are then ranked. Two or three passes do; what a pass gathers is
    `parts` rows a range. Nulls and NaN don't count; groups may have null keys; a group without values has no rows.
    """
    keys = [f"__by{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    # Joined through a text that null keys have as well.
    group = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("")
    rows = rows.withColumn("g", group).select("g", "v")
    sizes = materialize(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    place = F.col("share") * (F.col("n") - 1)
    wanted = sizes.select("g", "lo", "hi", "n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    wanted = wanted.select("g", "lo", "hi", "n", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank")).distinct()
    targets = materialize(wanted.select("g", "rank", "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside")), "targets")
    while not targets.where((F.col("lo") < F.col("hi")) & (F.col("inside") > ranked)).isEmpty():
        wide = targets.where((F.col("lo") < F.col("hi")) & (F.col("inside") > ranked))
        ranges = wide.select("g", "lo", "hi").distinct()
        met = rows.join(ranges, "g").where("v BETWEEN lo AND hi")
        # Halves, so that the width of a range can't overflow.
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * parts), F.lit(parts - 1)).cast("int")
        counted = met.groupBy("g", "lo", "hi", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = Window.partitionBy("g", "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0)))
        hit = wide.join(counted, ["g", "lo", "hi"]).where("rank - below >= base AND rank - below < base + c")
        narrowed = hit.select("g", "rank", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("below") + F.col("base")).alias("below"), F.col("c").alias("inside"))
        targets = materialize(targets.where((F.col("lo") >= F.col("hi")) | (F.col("inside") <= ranked)).unionByName(narrowed), "targets")
    some = targets.where("lo < hi")
    inside = rows.join(some.select("g", "lo", "hi").distinct(), "g").where("v BETWEEN lo AND hi")
    nth = F.row_number().over(Window.partitionBy("g", "lo", "hi").orderBy("v")) - 1
    picked = some.join(inside.withColumn("nth", nth), ["g", "lo", "hi"]).where("rank - below = nth").select("g", "rank", "v")
    known = materialize(targets.where("lo >= hi").select("g", "rank", F.col("lo").alias("v")).unionByName(picked), "statistics")
    asked = sizes.select("g", "n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).withColumn("place", place)
    side = lambda f, name: asked.select("g", "share", "place", f("place").alias("rank")).join(known, ["g", "rank"]).select("g", "share", "place", F.col("v").alias(name))
    both = side(F.floor, "a").join(side(F.ceil, "b").drop("place"), ["g", "share"])
    rest = F.col("place") - F.floor("place")
    out = both.select("g", "share", (F.col("a") * (1 - rest) + F.col("b") * rest).alias("percentile"))
    types = {k: df.schema[c].dataType for c, k in zip(by, keys)}
    if not keys:
        return out.select("share", "percentile")
    ddl = ", ".join(f"{k} {t.simpleString()}" for k, t in types.items())
    return out.withColumn("s", F.from_json("g", ddl)).select(*[F.col(f"s.{k}").alias(c) for c, k in zip(by, keys)], "share", "percentile")
