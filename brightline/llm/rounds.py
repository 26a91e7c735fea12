"""Links among rows that share postings, in rounds of leaders: all links between different components are found, not all pairs within one.

In the first round each row is paired with one row that leads: the one that leads most of its postings, where those lead that have the fewest postings
to themselves, as what near copies were made from has. What links falls together under one label, and a group of near copies is mostly one label then. In each further round some rows of a posting lead, and every row of the posting
that has another label is paired with them; pairs that pass the filters are judged, none twice. The leaders of a posting of c rows are those whose
place, a hash of the key in [0, 1), is below GROWTH ** round / c; so their number grows with each round until all rows lead, or one label is left. Rows
that don't link are all paired in the end, as they must be. There is no bound at which anything is left out, and no round that takes
all pairs because of what the data are like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightline.functions.materialise import discard, materialise
from brightline.llm.components import components

GROWTH = 64


def class_labels(
    posted: DataFrame, near: Callable[[str, str], Column], sketches: DataFrame, alike: Callable[[str, str], Column], judged: Callable[[DataFrame], DataFrame]
) -> DataFrame | None:
    """node and root of every key that links with another; None if none does.

    posted: gram, key, own (how many postings the key shares with none) and what near() needs, a row for each posting of a key. near(a, b): whether the rows of these aliases may link. sketches: key and what
    alike() needs; alike(a, b), asked after the first round within the join, so that pairs that it rules out are not made. judged(pairs):
    those of the pairs (a, b) that link, as a written table.
    """
    labels = tried = closed = None
    reach, columns = 0.0, posted.columns
    place = (F.xxhash64("key").cast("double") / 2.0**64) + 0.5
    while True:
        rows = posted.withColumn("label", F.col("key"))
        if labels is not None:
            rows = posted.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("root", "key")).drop("root")
        first = F.min(F.struct("own", place.alias("place"), "key")).alias("first")
        if labels is None:
            grams = rows.groupBy("gram").agg(F.count("*").alias("c"), first).where("c > 1")
        else:
            by_label = rows.groupBy("gram", "label").agg(F.count("*").alias("c"), first)
            grams = by_label.groupBy("gram").agg(F.sum("c").alias("c"), F.count("*").alias("labels"), F.min("first").alias("first")).where("labels > 1")
        live = materialise(rows.join(grams.select("gram", "c", F.col("first.key").alias("first")), "gram"), "postings")
        discard(closed)
        posted, closed = live.select(*columns), live  # a posting of one label stays one
        largest = live.agg(F.max("c")).first()[0]
        if largest is not None:
            leads = (F.col("key") == F.col("first")) if not reach else (place * F.col("c") < reach)
            known = live.join(sketches, "key") if reach else live
            l, r = known.where(leads).alias("l"), known.alias("r")
            apart = (F.col("l.gram") == F.col("r.gram")) & (F.col("l.label") != F.col("r.label")) & near("l", "r")
            met = l.join(r, apart & alike("l", "r") if reach else apart)
            if not reach:
                often = met.groupBy(F.col("r.key").alias("of"), F.col("l.key").alias("leader")).count()
                met = often.groupBy("of").agg(F.max(F.struct("count", "leader")).alias("best")).select("of", "best.leader")
            else:
                met = met.select(F.col("r.key").alias("of"), F.col("l.key").alias("leader"))
            pairs = met.select(F.least("of", "leader").alias("a"), F.greatest("of", "leader").alias("b")).distinct()
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = materialise(pairs, "pairs")
            found = None if pairs.isEmpty() else judged(pairs)
            # A link between labels is one between their roots: what is known already comes in as one edge a node.
            if found is not None and not found.isEmpty():
                joined = found if labels is None else found.unionByName(labels.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
                old, labels = labels, materialise(components(joined), "labels")
                discard(old)
            discard(found)
            if tried is None:
                tried = pairs
            else:
                both = materialise(tried.unionByName(pairs), "tried")
                discard(tried, pairs)
                tried = both
        if largest is None or reach >= largest:
            discard(tried, live)
            return labels
        reach = reach * GROWTH or float(GROWTH)
