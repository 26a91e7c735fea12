"""The nearest of two sets of places on a sphere, and intervals that overlap: joins on cells and blocks, with no pair looked at that they rule out."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightline.functions.materialise import discard, materialise

#: Places of the searched set that a cell may have; a finer grid is taken while one has more.
FULL_CELL = 64
FINEST = 24

#: Points in time that a block holds, as a power of two; and the blocks a task has, while that leaves them that large.
LEAST_BITS, MOST_BITS = 6, 12
BLOCKS_A_TASK = 8


def _on_sphere(lat: str, lon: str) -> list[Column]:
    """Coordinates on a sphere of radius 1: there is no seam at 180 degrees and no pole."""
    a, b = F.radians(lat), F.radians(lon)
    return [(F.cos(a) * F.cos(b)).alias("x_"), (F.cos(a) * F.sin(b)).alias("y_"), F.sin(a).alias("z_")]


def _cells(level: int) -> list[Column]:
    return [F.floor((F.col(c) + 1) * 2.0 ** (level - 1)).alias(f"{c}c") for c in ("x_", "y_", "z_")]


def nearest(places: DataFrame, among: DataFrame, place: str, other: str, k: int = 1) -> DataFrame:
    """place, other, rank and chord (distance through a sphere of radius 1; arc = 2 asin(chord / 2)) of the k nearest rows of `among` to each place, ties to the
    smaller other; all, if there are fewer. Both have lat and lon in degrees; place and other are their keys, of different names.

    Places are joined with what lies in their cell of a grid in space or in one beside it. Whatever is nearer than a cell's side is among
    that, so k found within it are proven; places without them go on to a grid of cells twice as wide. The first grid is as fine as the crowd needs.
    """
    p = places.where("lat is not null and lon is not null").select(F.col(place), *_on_sphere("lat", "lon"))
    o = among.where("lat is not null and lon is not null").select(F.col(other), *_on_sphere("lat", "lon"))
    n = o.count()
    level = min(FINEST, max(0, math.ceil(math.log2(n) / 2))) if n else 0
    while n and level < FINEST:
        at = _cells(level)
        most = o.groupBy(*at).count().agg(F.max("count")).first()[0]
        if most <= max(FULL_CELL, 4 * k):
            break
        level += 2
    level, found, left = min(level, FINEST), [], p
    o = o.select(other, *(F.col(c).alias(f"{c}o") for c in ("x_", "y_", "z_")), "x_", "y_", "z_")
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    while True:
        side = 2.0 ** (1 - level)
        posted = o.select("*", *_cells(level))
        for c in ("x_", "y_", "z_"):
            posted = posted.withColumn("d", F.explode(steps)).withColumn(f"{c}c", F.col(f"{c}c") + F.col("d")).drop("d")
        met = left.select("*", *_cells(level)).join(posted.drop("x_", "y_", "z_"), ["x_c", "y_c", "z_c"])
        square = sum(((F.col(c) - F.col(f"{c}o")) ** 2 for c in ("y_", "z_")), (F.col("x_") - F.col("x_o")) ** 2)
        met = met.select(place, other, F.sqrt(square).alias("chord"))
        best = met.withColumn("rank", F.row_number().over(Window.partitionBy(place).orderBy("chord", other))).where(F.col("rank") <= k)
        last = level == -1  # cells of side 4: all of the sphere is in one or beside it
        proven = best.withColumn("sure", F.count_if(F.col("chord") <= side).over(Window.partitionBy(place)) >= k)
        proven = materialise(proven if last else proven.where("sure"), "nearest")
        found.append(proven.select(place, other, "rank", "chord"))
        if last:
            break
        rest = materialise(left.join(proven.select(place).distinct(), place, "left_anti"), "not-nearest")
        if left is not p:
            discard(left)
        left, level = rest, level - 1
        if rest.isEmpty():
            discard(rest)
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _halved(df: DataFrame, most: int, **sought: tuple[Column, Callable[[Column], Column]]) -> DataFrame:
    """df with a column for each array sought in: how many numbers of it, `most` at the most, the condition holds for. It holds for the array's beginning only.

    Conditions on these columns must not reach the optimiser, which would carry them down and write each step out twice in the next: hence explode_outer below.
    """
    df = df.withColumns({name: F.lit(0) for name in sought})
    for step in (2**k for k in reversed(range(most.bit_length()))):
        df = df.withColumns({n: F.when(holds(F.get(of, F.col(n) + (step - 1))), F.col(n) + step).otherwise(F.col(n)) for n, (of, holds) in sought.items()})
    return df


def _held(intervals: DataFrame, points: DataFrame, interval: str, point: str, own_begin: bool) -> DataFrame:
    """Pairs of keys of intervals (from_s, to_s) and of the points (at) in them: from from_s on, or, without own_begin, after it.

    Points are packed in order of time, in blocks of equal numbers however they crowd. An interval finds by halving the blocks that it meets and, in each, the
    first and the last of its points: what lies between is told as it stands, so that the work for a pair is to write it.
    """
    tasks, n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), points.count()
    bits = min(max((n // (BLOCKS_A_TASK * tasks)).bit_length() - 1, LEAST_BITS), MOST_BITS)
    ranges = min(max(n >> MOST_BITS, 1), tasks)
    placed = points.repartitionByRange(ranges, "at", point).sortWithinPartitions("at", point).withColumn("n", F.monotonically_increasing_id())  # the range above 33 bits
    packed = placed.groupBy(F.shiftright("n", 33).alias("cell"), F.shiftright("n", bits).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", point))).alias("rows"))
    at = F.col("rows.at")
    blocks = materialise(packed.select("cell", "block", at[0].alias("lo"), F.element_at(at, -1).alias("hi"), at.alias("ats"), F.col(f"rows.{point}").alias("points")), "points")
    cells = blocks.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("cell").collect()  # no more than tasks
    before = lambda t: t < F.col("from_s") if own_begin else t <= F.col("from_s")
    begun = lambda t: t <= F.col("to_s")
    ids, los, his = (F.lit([c[k] for c in cells]).cast("array<bigint>") for k in ("cell", "lo", "hi"))
    there = F.slice(ids, F.col("first") + 1, F.col("last") - F.col("first"))
    met = _halved(intervals, len(cells), first=(his, before), last=(los, begun)).withColumn("cell", F.explode_outer(there))
    met = met.join(F.broadcast(blocks.select("cell", "block", "lo", "hi")), "cell").where(~before(F.col("hi")) & begun(F.col("lo")))
    met = met.select(interval, "from_s", "to_s", "block").repartition(tasks, "block")
    both = met.join(blocks.select("block", "ats", "points").repartition(tasks, "block").hint("merge"), "block")
    both = _halved(both, 2**bits, first=(F.col("ats"), before), last=(F.col("ats"), begun))
    some = F.slice("points", F.col("first") + 1, F.col("last") - F.col("first"))
    some = F.when(F.col("last") - F.col("first") == F.size("points"), F.col("points")).otherwise(some)
    return both.select(interval, F.posexplode_outer(some).alias("place", point)).where("place is not null").select(interval, point)


def overlapping(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Pairs of keys of intervals [from_s, to_s] (whole numbers, ends included) of a and b that have a time in common.

    Of two that overlap, the later begins within the other: a pair is told where the beginning of b's lies in a's or, if a's is later, that of a's in b's.
    Empty intervals (to_s before from_s) have no times.
    """

    def sides(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        rows = df.where("from_s <= to_s").select(key, F.col("from_s").cast("long"), F.col("to_s").cast("long"))
        return rows, rows.select(key, F.col("from_s").alias("at"))

    (left, begins_a), (right, begins_b) = sides(a, key_a), sides(b, key_b)
    later_a = _held(right.where("from_s < to_s"), begins_a, key_b, key_a, False)
    return _held(left, begins_b, key_a, key_b, True).unionByName(later_a)
