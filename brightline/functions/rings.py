"""Rings and polygons as column expressions. A ring is an array of struct(x, y) that ends where it begins; a polygon is an array of rings, the
first its outer one; edges are an array of struct(x1, y1, x2, y2). Everything stays in the JVM: higher-order functions over a row's own arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightline.functions import geo

#: Areas and gaps below are none, and coordinates that were computed have so many decimals.
EPSILON = 1e-9
DECIMALS = 12
POINT = "struct<x:double,y:double>"
LINE = f"struct<line:array<{POINT}>,turns:int,pole:double>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring_edges(ring: Column) -> Column:
    n = F.size(ring) - 1
    pair = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), pair)


def edges(rings: Column) -> Column:
    """The edges of all rings of a polygon."""
    return F.flatten(F.transform(rings, ring_edges))


def contains(of: Column, x: Column, y: Column) -> Column:
    """Whether a place lies within edges, by the parity of those to its right; holes are out."""
    right = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(of, right)) % 2 == 1


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def meet(e: Column, f: Column) -> Column:
    """Whether two edges have a point in common, ends included."""
    side = lambda s, x, y: cross(s["x2"] - s["x1"], s["y2"] - s["y1"], x - s["x1"], y - s["y1"])
    overlap = [
        (F.greatest(e[f"{c}1"], e[f"{c}2"]) >= F.least(f[f"{c}1"], f[f"{c}2"])) & (F.greatest(f[f"{c}1"], f[f"{c}2"]) >= F.least(e[f"{c}1"], e[f"{c}2"])) for c in "xy"
    ]
    apart = lambda s, t: F.signum(side(s, t["x1"], t["y1"])) * F.signum(side(s, t["x2"], t["y2"])) > 0
    return overlap[0] & overlap[1] & ~apart(e, f) & ~apart(f, e)


def any_meet(of: Column, other: Column) -> Column:
    return F.exists(of, lambda e: F.exists(other, lambda f: meet(e, f)))


def intersect(of: Column, other: Column) -> Column:
    """Whether two polygons, given by their edges, have a point in common."""
    first = lambda a: (F.get(a, F.lit(0))["x1"], F.get(a, F.lit(0))["y1"])
    return any_meet(of, other) | contains(of, *first(other)) | contains(other, *first(of))


def crosses_itself(ring: Column) -> Column:
    """Whether two edges of a ring meet that don't follow each other."""
    e = ring_edges(ring)
    later = lambda i: F.filter(e, lambda _, j: (j > i + 1) & ~((i == 0) & (j == F.size(e) - 1)))
    return F.size(F.filter(e, lambda a, i: F.exists(later(i), lambda b: meet(a, b)))) > 0


def box_edges(west: Column, south: Column, east: Column, north: Column) -> Column:
    corners = F.array(point(west, south), point(east, south), point(east, north), point(west, north), point(west, south))
    return ring_edges(corners)


def area(ring: Column) -> Column:
    """Signed area, positive if the ring turns against the clock; summed from the first point, so that places far away lose no digits."""
    p = F.get(ring, F.lit(0))
    parts = F.transform(ring_edges(ring), lambda e: cross(e["x1"] - p["x"], e["y1"] - p["y"], e["x2"] - p["x"], e["y2"] - p["y"]))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / 2


def distance_to_origin(of: Column) -> Column:
    """The least distance of the origin from the edges."""

    def from_edge(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        length = dx * dx + dy * dy
        t = F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.greatest(-(e["x1"] * dx + e["y1"] * dy) / length, F.lit(0.0)), F.lit(1.0)))
        return F.hypot(e["x1"] + t * dx, e["y1"] + t * dy)

    return F.array_min(F.transform(of, from_edge))


def unwrapped(ring: Column) -> Column:
    """struct(line, turns, pole) of a closed ring of longitudes and latitudes; null if it can't be told.

    Longitudes follow each other by the shorter way, with a point of the great circle where that way passes a meridian of 180. A step of exactly
    180 degrees has no shorter way. A ring that goes round the world once must stay north or south of the equator, and has that pole.
    """
    first = F.get(ring, F.lit(0))
    start = F.struct(F.array(point(first["x"], first["y"])).alias("line"), first["x"].alias("x"), first["y"].alias("y"), first["x"].alias("lon"), F.lit(False).alias("lost"))

    def step(done: Column, q: Column) -> Column:
        raw = q["x"] - done["lon"]
        delta = F.when(raw > 180, raw - 360).when(raw < -180, raw + 360).otherwise(raw)
        x = done["x"] + delta
        low, high = F.least(done["x"], x), F.greatest(done["x"], x)
        seam = F.ceil((low - 180) / 360) * 360.0 + 180.0
        passes = (F.abs(raw) > 180) & (seam > low + EPSILON) & (seam < high - EPSILON)
        at = F.round(geo.antimeridian_lat(done["y"], done["lon"], q["y"], q["x"]), DECIMALS)
        between = F.when(passes, F.array(point(seam, at))).otherwise(F.array().cast(f"array<{POINT}>"))
        lost = done["lost"] | (F.abs(raw) == 180) | (passes & at.isNull()) | raw.isNull()
        return F.struct(F.concat(done["line"], between, F.array(point(x, q["y"]))).alias("line"), x.alias("x"), q["y"].alias("y"), q["x"].alias("lon"), F.coalesce(lost, F.lit(True)).alias("lost"))

    def finish(done: Column) -> Column:
        turn = (done["x"] - first["x"]) / 360
        turns = F.round(turn).cast("int")
        lats = F.transform(ring, lambda p: p["y"])
        pole = F.when(F.array_min(lats) > 0, F.lit(90.0)).when(F.array_max(lats) < 0, F.lit(-90.0))
        good = ~done["lost"] & (F.abs(turn - turns) * 360 <= EPSILON) & (F.abs(turns) <= 1) & ((turns == 0) | pole.isNotNull())
        return F.when(good, F.struct(done["line"].alias("line"), turns.alias("turns"), F.when(turns != 0, pole).alias("pole")))

    return F.aggregate(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), start, step, finish)


def gnomonic(ring: Column, lat: Column, lon: Column) -> Column:
    """A ring of longitudes and latitudes on the plane that touches a sphere of radius 1 at (lat, lon), where great circles are straight; null if a
    point of it is on the other half of the sphere."""
    cos_a, sin_a = F.cos(F.radians(lat)), F.sin(F.radians(lat))

    def project(p: Column) -> Column:
        b, turn = F.radians(p["y"]), F.radians(p["x"] - lon)
        c = sin_a * F.sin(b) + cos_a * F.cos(b) * F.cos(turn)
        return F.when(c > EPSILON, point(F.cos(b) * F.sin(turn) / c, (cos_a * F.sin(b) - sin_a * F.cos(b) * F.cos(turn)) / c))

    out = F.transform(ring, project)
    return F.when(~F.exists(out, lambda p: p.isNull()), out)


def covers_disc(plane: Column, radius: Column) -> Column:
    """Whether a polygon on the sphere covers the disc of a radius (as an angle) around a place, given by its rings on the gnomonic plane of that place, where the
    disc is a disc. A ring that crosses itself, has no area or reaches the other half of the sphere covers nothing."""
    sound = ~F.exists(plane, lambda r: r.isNull() | crosses_itself(r) | (F.abs(area(r)) <= 1e-18))
    of, zero = edges(plane), F.lit(0.0)
    return F.coalesce(contains(of, zero, zero) & (distance_to_origin(of) >= F.tan(radius)) & sound, F.lit(False))
