"""Mixing sources to target weights: weighted sampling without replacement by exponential keys.

Each source gets a target of words by its weight. Whole epochs of a source come first; what the target
asks beyond them is filled by documents in the order of the Efraimidis-Spirakis keys -ln(u) / weight,
whose sizes are summed up to the budget. Only DataFrame functions are used.

A source may hold any share of the rows: the keys are range-partitioned over all sources and written once,
each slab is summed by itself, and the slabs' totals shift the sums within them.

Defined results. A null text has size 0 and is taken with 0 words. A null source is a source of its own and
comes last. A null doc_id is mixed like any other. Equal rows get equal keys; of several rows that tie at the
end of a budget any may be taken, and they can't be told apart. Of several labels of a document the highest
quality counts; documents without a label or with a null one have the weight UNLABELLED. A source without
words has target 0, as has every source if all texts are empty. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightline.functions.materialise import materialise
from brightline.llm.common import WORD_PATTERN

#: The weights that sources get in turn, the share of all words to mix and the most epochs of one source.
CYCLE = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Weight of a document by its label's quality (0 or 1), and without one.
BY_QUALITY = (0.25, 1.0)
UNLABELLED = 0.5


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size: the number of words of the whole text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
    )


def weighted(sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the quality weight of each document."""
    quality = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    by = F.when(F.col("quality") >= 1, BY_QUALITY[1]).when(F.col("quality") <= 0, BY_QUALITY[0]).otherwise(UNLABELLED)
    return sizes.join(quality, "doc_id", "left").withColumn("weight", by).drop("quality")


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Adds the exponential key: -ln(u) / weight, u from the digest of seed and doc_id, in (0, 1)."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return docs.withColumn("key", -F.log(u) / F.col("weight"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target of each source.

    target = min(MOST_EPOCHS * source_size, level * weight), the level being such that all targets together are
    SHARE of all sizes. With sources in the order of cap / weight, the first whose cap reaches the level that the
    uncapped ones would share gives it. One row per source is all that the windows without a partition see.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in CYCLE]), (F.pmod(turn, F.lit(len(CYCLE))) + 1).cast("int"))
    one = one.withColumn("turn", turn).withColumn("share_weight", weight)
    one = one.withColumn("cap", F.col("source_size") * float(MOST_EPOCHS))
    order = Window.orderBy(F.col("cap") / F.col("share_weight"), "turn")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = one.withColumns({
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left": F.sum("share_weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(every) * SHARE,
        "place": F.row_number().over(order),
    })
    level = (F.col("total") - F.col("capped")) / F.col("left")
    one = one.withColumn("meets", F.when(F.col("cap") / F.col("share_weight") >= level, F.col("place")))
    one = one.withColumn("level", F.min_by(level, "meets").over(every))
    fits = F.coalesce(F.col("level") * F.col("share_weight") < F.col("cap"), F.lit(False))
    return one.select("source", "source_size", F.when(fits, F.col("level") * F.col("share_weight")).otherwise(F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, labels: DataFrame, seed: int = 7) -> DataFrame:
    """Each document with source, size, its source's source_size and target, copies (0 to MOST_EPOCHS) and taken = copies * size.

    docs: doc_id, text, source. labels: doc_id, quality.
    """
    rows = keyed(weighted(sized(docs), labels), seed)
    rows = rows.repartitionByRange("source", "key", "doc_id").withColumn("slab", F.spark_partition_id())
    rows = materialise(rows.select("doc_id", "source", "size", "key", "slab"), "mix")
    slabs = rows.groupBy("source", "slab").agg(F.sum("size").alias("slab_size"))
    slabs = slabs.withColumn("before_slab", F.sum("slab_size").over(Window.partitionBy("source").orderBy("slab")) - F.col("slab_size"))
    shared = slabs.join(targets(slabs.withColumnRenamed("slab_size", "size")).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "slab_size")
    shared = shared.select(F.col("source").alias("of"), F.col("slab").alias("of_slab"), "before_slab", "source_size", "target")
    within = Window.partitionBy("source", "slab").orderBy("key", "doc_id", "size")
    rows = rows.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(shared, F.col("source").eqNullSafe(F.col("of")) & (F.col("slab") == F.col("of_slab")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    # A document is in the last, partial epoch if its middle is within what is left of the target.
    middle = F.col("before_slab") + F.col("upto") - F.col("size") / 2
    part = (middle <= F.col("target") - epochs * F.col("source_size")) & (epochs < MOST_EPOCHS)
    copies = (epochs + part.cast("long")).cast("long")
    return rows.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
