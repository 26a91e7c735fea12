"""Exact order statistics of groups of any size: no group is gathered or sorted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightline.functions.materialise import discard, materialise

BINS = 1024


def exact_medians(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """keys (at least one) and the median of value (a double) of each group, the mean of the middle two of an even number; null for a group without values.

    The middle values are found by rounds: each round counts the values of a group's range in BINS bins, of which one holds the value wanted, and goes on with what is really
    in it. Counts are combined before the shuffle, so a round moves at most BINS rows a group and task; it narrows a range BINS times,
    and a group is done once its range is one value. Nulls, NaN and infinities do not count.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("v")).withColumn("v", F.when(F.abs("v") < float("inf"), F.col("v")))
    groups = rows.groupBy(*names).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    # One row a group and place wanted: the place counts from 1 within the range.
    places = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)))
    wanted = materialise(groups.withColumn("which", F.explode(places)).withColumn("place", F.col("which")), "median-ranges")
    while not wanted.where("low < high").isEmpty():
        width = F.col("high") / BINS - F.col("low") / BINS
        # The least and the largest value are never in one bin, also where doubles are too coarse for so narrow bins: each round narrows the range.
        bin_ = F.when(F.col("v") == F.col("low"), 0).when(width > 0, F.greatest(F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(BINS - 1)), F.lit(1))).otherwise(BINS - 1)
        ranges = wanted.where("low < high").drop("n").withColumnsRenamed({n: f"of_{n}" for n in names})
        same = [F.col(n).eqNullSafe(F.col(f"of_{n}")) for n in names]
        met = rows.join(ranges, [*same, F.col("v").between(F.col("low"), F.col("high"))])
        met = met.select(*names, "which", "place", "v", bin_.alias("bin"))
        counts = met.groupBy(*names, "which", "place", "bin").agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*names, "which").orderBy("bin"))
        hit = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("c") < F.col("place")))
        hit = hit.select(*names, F.lit(1).cast("long").alias("n"), "low", "high", "which", (F.col("place") - (F.col("upto") - F.col("c"))).alias("place"))
        narrowed = materialise(hit.unionByName(wanted.where("NOT low < high OR low IS NULL")), "median-ranges")
        discard(wanted)
        wanted = narrowed
    found = wanted.groupBy(*names).agg(F.avg("low").alias(out))
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], out)
