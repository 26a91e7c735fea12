"""Joins of polygons, and of points and discs with them, without comparing all with all.

Cells form a quadtree over longitudes -180 to 180 and latitudes -90 to 90: level n has 2**n by 2**n. A polygon belongs to the level whose cells are as large as its
bounds, of which these touch four at most. Two polygons meet at the coarser of their levels: each is dealt to its cells there, and a pair
is told in one cell, that of the south-west corner of what their bounds share. In a cell, pairs are judged block by block (blocks.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightline.functions.materialise import materialise
from brightline.operators import blocks
from brightline.operators.blocks import paired, streamed
from brightline.operators.passes import tallied
from brightline.operators.planar import discs_covered, polygons_meet

FINEST = 22
#: Grids on the sphere: 2**i columns and half as many rows, i from the first to the last; and how many cells bounds touch in one, on average, at most.
GRIDS, TOUCHED = (3, 9), 2.5


def level_of(width: Column, height: Column) -> Column:
    """The finest level whose cells are as wide and as high as bounds, so that bounds touch four at most."""
    size = F.greatest(width, height * 2, F.lit(1e-6))
    return F.least(F.greatest(F.floor(F.log2(360.0 / size)), F.lit(0)), F.lit(FINEST)).cast("int")


def span(low: Column, high: Column, level: Column, whole: float) -> Column:
    """The columns (whole 360) or rows (whole 180) of cells of a level that an interval touches."""
    last = (F.pow(F.lit(2.0), level) - 1).cast("long")
    at = lambda v: F.least(F.greatest(F.floor((v + whole / 2) / whole * F.pow(F.lit(2.0), level)), F.lit(0)), last)
    return F.sequence(at(low), at(high))


def bounds(of: Column) -> list[Column]:
    ends = lambda c: F.concat(F.transform(of, lambda e: e[f"{c}1"]), F.transform(of, lambda e: e[f"{c}2"]))
    return [F.array_min(ends("x")), F.array_min(ends("y")), F.array_max(ends("x")), F.array_max(ends("y"))]


def intersecting(a: DataFrame, b: DataFrame, key_a: list[str], key_b: list[str], edges: str = "edges") -> DataFrame:
    """Pairs of keys of polygons of a and b that have a point in common; both have edges, in longitudes from -180 to 180. Keys must differ in name."""

    def bounded(df: DataFrame, key: list[str]) -> DataFrame:
        box = F.struct(*(c.alias(n) for c, n in zip(bounds(F.col(edges)), ("w_", "s_", "e_", "n_"), strict=True)))
        # Shapes that are alike come one after the other, and are judged once.
        rows = df.select(*key, F.col(edges).alias("edges_"), F.xxhash64(edges).alias("like_"), F.inline(F.array(box))).where("w_ is not null")
        return rows.withColumn("own", level_of(F.col("e_") - F.col("w_"), F.col("n_") - F.col("s_")))

    l, r = bounded(a, key_a), bounded(b, key_b)
    levels = lambda df: F.array(*(F.lit(x.own) for x in df.select("own").distinct().collect())).cast("array<int>")  # noqa: E731  23 at most

    def dealt(df: DataFrame, others: Column, first: bool) -> DataFrame:
        """Rows in their cells: at their own level (turn 0 of a, 1 of b), and for the other turn at levels in use there that are coarser, or for b also equal."""
        at_own = F.struct(F.lit(0 if first else 1).alias("turn"), F.col("own").alias("level"))
        coarser = F.filter(others, lambda v: (v < F.col("own")) if first else (v <= F.col("own")))
        at = F.concat(F.array(at_own), F.transform(coarser, lambda v: F.struct(F.lit(1 if first else 0).alias("turn"), v.alias("level"))))
        rows = df.select("*", F.inline(at)).drop("own")
        rows = rows.select("*", F.posexplode(span(F.col("w_"), F.col("e_"), F.col("level"), 360.0)).alias("ix", "x"))
        rows = rows.select("*", F.posexplode(span(F.col("s_"), F.col("n_"), F.col("level"), 180.0)).alias("iy", "y"))
        return rows.withColumn("fx_", F.col("ix") == 0).withColumn("fy_", F.col("iy") == 0).drop("ix", "iy")

    weight = 1 + F.size("edges_") / 32
    return paired(dealt(l, levels(r), True), dealt(r, levels(l), False), ["turn", "level", "x", "y"], (weight, weight), polygons_meet(), key_a, key_b, ("s_", "w_"), "like_")


def spherical_bounds(line: Column, turns: Column, pole: Column) -> Column:
    """West, south, east and north (w, s, e, n) of a ring of great circles in unwrapped longitudes; west to east may be more than 360 degrees apart
    or go past 180. A great circle rises above its ends by no more than the sagitta of its chord, which is added to both sides."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    south, north = F.array_min(ys), F.array_max(ys)
    widest = F.array_max(F.zip_with(F.slice(xs, F.lit(2), F.size(xs) - 1), F.slice(xs, F.lit(1), F.size(xs) - 1), lambda x, y: F.abs(x - y)))
    # Of an edge of d degrees of longitude between latitudes up to b: tan(top) <= tan(b) / cos(d / 2).
    reach = lambda b: F.degrees(F.atan(F.tan(F.radians(b)) / F.cos(F.radians(F.least(widest, F.lit(178.0)) / 2))))
    top, bottom = F.when(north > 0, reach(north)).otherwise(north), F.when(south < 0, reach(south)).otherwise(south)
    round_it = turns != 0
    return F.struct(
        F.when(round_it, -180.0).otherwise(F.array_min(xs)).alias("w"), F.when(pole < 0, -90.0).otherwise(bottom).alias("s"),
        F.when(round_it, 180.0).otherwise(F.array_max(xs)).alias("e"), F.when(pole > 0, 90.0).otherwise(top).alias("n"),
    )


def outlines(shape: Column) -> Column:
    return F.concat(F.array(shape["outer"]["line"]), F.transform(shape["holes"], lambda h: h["line"]))


def of_shape(shape: Column) -> Column:
    return spherical_bounds(shape["outer"]["line"], shape["outer"]["turns"], shape["outer"]["pole"])


def _columns(box: Column, i: int) -> Column:
    """Columns of grid i that bounds touch, across 180 degrees too."""
    at = lambda v: F.floor((v + 180.0) / 360.0 * (1 << i))
    return F.array_distinct(F.transform(F.sequence(at(box["w"]), at(box["e"])), lambda x: F.pmod(x, F.lit(1 << i).cast("long"))))


def _rows(box: Column, i: int) -> Column:
    return span(box["s"], box["n"], F.lit(i - 1), 180.0)


def _place(i: int) -> list[Column]:
    last = F.lit((1 << (i - 1)) - 1).cast("long")
    row = F.least(F.greatest(F.floor((F.col("lat") + 90.0) / 180.0 * (1 << (i - 1))), F.lit(0)), last)
    return [F.pmod(F.floor((F.col("lon") + 180.0) / 360.0 * (1 << i)), F.lit(1 << i).cast("long")).alias("x"), row.alias("y")]


def _grid(boxes: DataFrame) -> int:
    """The finest grid in which bounds (arrays `boxes`) touch few cells, on average: one for all, so that a place is in one cell."""
    low, high = GRIDS
    touched = lambda i: F.aggregate("boxes", F.lit(0).cast("long"), lambda n, b: n + (F.size(_columns(b, i)) * F.size(_rows(b, i))).cast("long"))
    found = boxes.agg(*(F.avg(touched(i)).alias(str(i)) for i in range(low, high + 1))).first()
    return max((i for i in range(low, high + 1) if (found[str(i)] or 0) <= TOUCHED), default=low)


def _at_cells(df: DataFrame, boxes: str, i: int) -> DataFrame:
    cells = lambda b: F.flatten(F.transform(_columns(b, i), lambda x: F.transform(_rows(b, i), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return df.select("*", F.inline(F.array_distinct(F.flatten(F.transform(boxes, cells)))))


def covering(discs: DataFrame, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of discs and polygons (without shape and keys), the polygon of which covers the disc on the sphere. discs: lat, lon and radius (an angle); polygons: shape,
    of an outer ring and holes as unwrapped lines. keys: equal in both. A polygon is dealt to the cells of a grid that it touches, a disc's centre to its own."""
    d, more = discs.dropna(subset=["lat", "lon", "radius"]), [c for c in polygons.columns if c not in (*keys, "shape")]
    p = polygons.select(*keys, *more, F.array(of_shape(F.col("shape"))).alias("boxes"), outlines(F.col("shape")).alias("lines_")).where("boxes[0].w is not null and boxes[0].s is not null")
    p = materialise(p, "bounded")
    i = _grid(p)
    d, p = d.select("*", *_place(i)), _at_cells(p, "boxes", i).select("*", *(F.col("boxes")[0][c].alias(f"{c}_") for c in "wsen")).drop("boxes")
    size = F.aggregate("lines_", F.lit(1.0), lambda s, r: s + F.size(r) / 32)
    return paired(d, p, [*keys, "x", "y"], (F.lit(1.0), size), discs_covered, [c for c in discs.columns if c not in keys], more)


def covered_later(discs: DataFrame, passes: DataFrame, keys: list[str], key: str, other: str, times: tuple[str, str], within: int) -> DataFrame:
    """key of each disc that passes cover, on the sphere and later than its own time by `within` at most; how many (n) and the first of them (first; ties to the smaller).

    discs: lat, lon, radius (an angle); passes: shapes, arrays of an outer ring and holes as unwrapped lines; a pass covers what one of its shapes does. keys: equal in both.
    key and other, of discs and of passes, are whole numbers, as are their times. Passes are told for each place once, and counted for its discs by their
    times: pairs of discs and passes are not written.
    """
    t, u = times
    d = discs.select(*keys, F.col(key).cast("long").alias("id_"), F.col(t).cast("long").alias("t_"), "lat", "lon", "radius").dropna()
    p = passes.select(
        *keys, F.col(other).cast("long").alias("id_"), F.col(u).cast("long").alias("t_"), F.filter(F.transform("shapes", of_shape), lambda b: b["w"].isNotNull() & b["s"].isNotNull()).alias("boxes"),
        F.transform("shapes", outlines).alias("lines_"),
    )
    p = materialise(p.dropna().where("size(boxes) > 0 and size(boxes) = size(lines_)"), "bounded")
    ends = d.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("t_").alias("since"), F.max("t_").alias("until")).first()
    if ends.s is None:
        ends = d.sparkSession.createDataFrame([(0.0, 0.0, 0, 0)], "s double, n double, since long, until long").first()
    p = p.where((F.col("t_") > ends.since) & (F.col("t_") <= ends.until + within) & F.exists("boxes", lambda b: (b["s"] <= ends.n) & (b["n"] >= ends.s)))
    i = _grid(p)
    d, cell = d.select("*", *_place(i)), [*keys, "x", "y"]
    # As many rows as there are cells with discs: of a key no more than the finest grid has.
    held = d.groupBy(*cell).agg(
        F.ceil(F.count("*") / blocks.BLOCK / 8).alias("of_a"), F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("t_").alias("since"), F.max("t_").alias("until")
    )
    there = F.exists("boxes", lambda b: (b["s"] <= F.col("n")) & (b["n"] >= F.col("s")))
    met = _at_cells(p, "boxes", i).join(F.broadcast(held), cell).where(there & (F.col("t_") > F.col("since")) & (F.col("t_") <= F.col("until") + within)).drop("s", "n", "since", "until")
    crowded = met.groupBy(*cell, "of_a").agg(F.ceil(F.count("*") / blocks.STREAM).alias("of_b"))
    met = met.drop("of_a").withColumn("s_", F.array_min(F.transform("boxes", lambda b: b["s"]))).withColumn("slab_", F.floor(F.col("t_") / within))
    d = d.withColumn("s_", F.col("lat")).withColumn("slab_", F.lit(0).cast("long"))
    found = streamed(d, met, cell, crowded, ["slab_", "s_"], ["id_"]).mapInArrow(tallied(within), "id long, n long, at long, first long")
    return found.groupBy(F.col("id").alias(key)).agg(F.sum("n").alias("n"), F.min_by("first", F.struct("at", "first")).alias("first"))
