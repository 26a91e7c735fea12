"""Spatial extents of catalogue items: their JSON, its reader, and footprints on the map made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightline.functions import rings
from brightline.functions.clipping import clipped_arrow
from brightline.functions.states import first_of
from brightline.sources.tables import table

_RING = "struct<Points:array<struct<Longitude:double,Latitude:double>>>"
_BOX = "struct<WestBoundingCoordinate:double,SouthBoundingCoordinate:double,EastBoundingCoordinate:double,NorthBoundingCoordinate:double>"
_POLYGON = f"struct<Boundary:{_RING},ExclusiveZone:struct<Boundaries:array<{_RING}>>>"
SCHEMA = f"struct<HorizontalSpatialDomain:struct<Geometry:struct<GPolygons:array<{_POLYGON}>,BoundingRectangles:array<{_BOX}>>>>"
POLYGONS = f"array<array<array<{rings.POINT}>>>"
#: The most points of a ring and of an extent.
MOST_RING, MOST_EXTENT = 20_000, 50_000


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """footprint_id, satellite, at_s and the JSON of a spatial extent for each part: rectangles, polygons convex, concave, with a hole, or around a
    pole, all of their own place and size; and such as are refused: two encodings at once, open, of a step of 180 degrees, or crossing themselves."""
    k = F.col("p_partkey")
    lon0, lat0 = (k * 79 % 3600) / 10.0 - 180.0, (k * 31 % 1400) / 10.0 - 70.0
    w, h = F.lit(2.0) + F.col("p_size") / 10.0, F.lit(2.0) + (k * 7 % 50) / 10.0
    wrap = lambda x: F.pmod(x + 180.0, F.lit(360.0)) - 180.0
    at = lambda x, y: F.struct(wrap(lon0 + x).alias("Longitude"), (lat0 + y).alias("Latitude"))
    quad = [at(-w, -h * 0.8), at(w * 0.9, -h), at(w, h * 0.7), at(-w * 0.8, h)]
    arrow = [at(-w, -h), at(w, -h), at(w * 0.2, h * 0.0), at(w, h), at(-w, h)]
    bow = [at(-w, -h), at(w, h), at(w, -h), at(-w, h * 0.9)]
    sign = F.when(k % 20 < 10, 1.0).otherwise(-1.0)
    around = lambda turn, lat: F.struct(wrap(lon0 + sign * turn).alias("Longitude"), (sign * (F.lit(lat) + h)).alias("Latitude"))
    cap = [around(0.0, 60.0), around(80.0, 64.0), around(170.0, 58.0), around(260.0, 66.0)]
    step = [F.struct(F.lit(-90.0).alias("Longitude"), lat0.alias("Latitude")), F.struct(F.lit(90.0).alias("Longitude"), (lat0 + h).alias("Latitude")), F.struct(F.lit(90.0).alias("Longitude"), (lat0 - h).alias("Latitude"))]
    inner = [at(-w * 0.3, -h * 0.3), at(-w * 0.2, h * 0.4), at(w * 0.4, h * 0.2)]
    closed = lambda points: F.array(*points, points[0])
    kind = k % 10
    outer = F.when(kind == 2, closed(arrow)).when(kind == 3, closed(cap)).when(kind == 5, F.array(*quad)).when(kind == 6, closed(step)).when(kind == 9, closed(bow)).otherwise(closed(quad))
    hole = F.when(kind == 4, F.struct(F.array(F.struct(closed(inner).alias("Points"))).alias("Boundaries")))
    polygons = F.when(~kind.isin(0), F.array(F.struct(F.struct(outer.alias("Points")).alias("Boundary"), hole.alias("ExclusiveZone"))))
    box = F.struct(wrap(lon0 - w).alias("WestBoundingCoordinate"), (lat0 - h).alias("SouthBoundingCoordinate"), wrap(lon0 + w).alias("EastBoundingCoordinate"), (lat0 + h).alias("NorthBoundingCoordinate"))
    boxes = F.when(kind.isin(0, 1), F.array(box))
    geometry = F.struct(F.struct(F.struct(polygons.alias("GPolygons"), boxes.alias("BoundingRectangles")).alias("Geometry")).alias("HorizontalSpatialDomain"))
    # The table is a small file, its extents are not: dealt before they are made, by a count that adaptive execution leaves alone.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select(
        k.alias("footprint_id"), F.concat(F.lit("S"), (k % 3).cast("string")).alias("satellite"), (k * 1800 % 5_000_000 + 1_704_000_000).alias("at_s"), F.to_json(geometry).alias("extent")
    )


def read_extents(rows: DataFrame, extent: str = "extent") -> DataFrame:
    """rows with source (the encoding), reason (why there is no footprint; empty if there is one) and shapes: of each polygon its outer ring and holes as
    unwrapped lines. An extent in two encodings, or with a part that can't be told, has no shapes: no part of it is guessed."""
    geometry = F.from_json(F.col(extent), SCHEMA)["HorizontalSpatialDomain"]["Geometry"]
    # Parsed once: what is below refers to the parsed column, and the generator keeps the optimizer from putting it in the place of each reference.
    rows = rows.select("*", F.inline(F.array(F.struct(geometry.alias("geometry")))))
    to_ring = lambda r: F.transform(F.coalesce(r["Points"], F.array()), lambda p: rings.point(p["Longitude"], p["Latitude"]))
    corner = lambda b, x, y: rings.point(b[f"{x}BoundingCoordinate"], b[f"{y}BoundingCoordinate"])

    def of_polygon(p: Column) -> Column:
        holes = F.transform(F.coalesce(p["ExclusiveZone"]["Boundaries"], F.array()), to_ring)
        return F.struct(to_ring(p["Boundary"]).alias("outer"), holes.alias("holes"))

    def of_box(b: Column) -> Column:
        """The box as a line that goes east from its western side, past 180 degrees if need be."""
        west, east = b["WestBoundingCoordinate"], b["EastBoundingCoordinate"]
        far = lambda y: rings.point(F.when(east < west, east + 360).otherwise(east), b[f"{y}BoundingCoordinate"])
        line = F.array(corner(b, "West", "South"), far("South"), far("North"), corner(b, "West", "North"), corner(b, "West", "South"))
        good = (b["NorthBoundingCoordinate"] > b["SouthBoundingCoordinate"]) & (west != east)
        none = F.array().cast(f"array<{rings.LINE}>")
        return F.when(good, F.struct(F.struct(line.alias("line"), F.lit(0).alias("turns"), F.lit(None).cast("double").alias("pole")).alias("outer"), none.alias("holes")))

    rows = rows.withColumn("read", F.transform("geometry.GPolygons", of_polygon))
    every = F.flatten(F.transform("read", lambda p: F.concat(F.array(p["outer"]), p["holes"])))
    lines = F.transform("read", lambda p: F.struct(rings.unwrapped(p["outer"]).alias("outer"), F.transform(p["holes"], rings.unwrapped).alias("holes")))
    boxes = F.transform("geometry.BoundingRectangles", of_box)
    rows = rows.withColumn("rings", F.coalesce(every, F.array())).select("*", F.inline(F.array(F.struct(F.coalesce(lines, boxes).alias("shapes")))))
    first, last = lambda r: F.get(r, F.lit(0)), lambda r: F.element_at(r, -1)
    shape = lambda test: F.coalesce(F.exists("shapes", test), F.lit(False))
    bad = lambda line: line.isNull()
    wrong_way = lambda s: s["outer"]["pole"] != s["outer"]["turns"] * 90.0
    other_pole = lambda s: F.exists(s["holes"], lambda h: h["pole"].isNotNull() & ~h["pole"].eqNullSafe(s["outer"]["pole"]))
    tangled = lambda line: rings.crosses_itself(line["line"]) & (line["turns"] == 0)
    flat = lambda line: (F.abs(rings.area(line["line"])) <= rings.EPSILON) & (line["turns"] == 0)
    any_line = lambda test: shape(lambda s: test(s["outer"]) | F.exists(s["holes"], test))
    points = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r))
    reason = first_of([
        (F.col("geometry").isNull(), "unreadable"), (F.col("geometry.GPolygons").isNotNull() & F.col("geometry.BoundingRectangles").isNotNull(), "mixed-encodings"),
        (F.coalesce(F.size("shapes"), F.lit(0)) < 1, "no-geometry"), ((points > MOST_EXTENT) | F.exists("rings", lambda r: F.size(r) > MOST_RING), "too-many-points"),
        (F.exists("rings", lambda r: (F.size(r) < 4) | ~first(r).eqNullSafe(last(r))), "open-ring"), (F.exists("rings", lambda r: F.size(F.array_distinct(r)) < 3), "few-points"),
        (shape(bad) | any_line(bad), "no-way-round"), (shape(wrong_way), "winding"), (shape(other_pole), "other-pole"), (any_line(tangled), "self-crossing"), (any_line(flat), "flat"),
    ], "")
    source = F.when(F.col("geometry.GPolygons").isNotNull(), "gpolygon").when(F.col("geometry.BoundingRectangles").isNotNull(), "bounding-rectangle")
    out = rows.select("*", source.alias("source"), F.inline(F.array(F.struct(reason.alias("reason")))))
    return out.withColumn("shapes", F.when(F.col("reason") == "", F.col("shapes"))).drop("geometry", "read", "rings")


def footprints(rows: DataFrame) -> DataFrame:
    """Rows of read_extents() with polygons: the footprint in longitudes from -180 to 180, cut where it crosses 180 degrees and closed over a pole that it
    goes round. Rings that cross each other are refused then. Only the cutting, which joins pieces of rings anew, is Python."""
    cut = F.arrow_udf(clipped_arrow, POLYGONS)
    out = rows.withColumn("polygons", cut(F.col("shapes")))
    return out.withColumn("reason", F.when((F.col("reason") == "") & F.col("polygons").isNull(), "rings-cross").otherwise(F.col("reason")))
