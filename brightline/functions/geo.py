"""Geodesy and the web-map grid as column expressions; distances in kilometres on a sphere of radius 6371."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: The equator's radius in metres of the web map, and the latitude at which the web-map square ends.
EQUATOR_M = 6378137.0
MERCATOR_LIMIT = 85.05112878


def lon_delta(a: Column, b: Column) -> Column:
    """Shortest difference of longitudes b - a in degrees, in [-180, 180)."""
    return F.pmod(b - a + 540.0, F.lit(360.0)) - 180.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon_delta(lon1, lon2))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360); null for coincident and antipodal points."""
    dlon = F.radians(lon_delta(lon1, lon2))
    a, b = F.radians(lat1), F.radians(lat2)
    y, x = F.sin(dlon) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dlon)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(dlon / 2), 2)
    return F.when((x * x + y * y > 1e-24) & (1 - h > 1e-15), F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0)))


def destination(lat: Column, lon: Column, degrees: Column, km: Column) -> tuple[Column, Column]:
    """Latitude and longitude reached from a place."""
    d, t, a = km / EARTH_KM, F.radians(degrees), F.radians(lat)
    b = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    turn = F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(b))
    return F.degrees(b), F.pmod(lon + F.degrees(turn) + 540.0, F.lit(360.0)) - 180.0


def compass(degrees: Column) -> Column:
    """One of eight compass points."""
    points = F.array(*[F.lit(p) for p in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.get(points, F.pmod(F.floor(degrees / 45.0 + 0.5), F.lit(8)).cast("int"))


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * n), F.lit(0)), F.lit(n - 1)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    r = F.radians(F.least(F.greatest(lat, F.lit(-MERCATOR_LIMIT)), F.lit(MERCATOR_LIMIT)))
    y = (1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n
    return F.least(F.greatest(F.floor(y), F.lit(0)), F.lit(n - 1)).cast("long")


def cell_key(lat: Column, lon: Column, zoom: int) -> Column:
    return F.concat_ws("/", F.lit("wm"), F.lit(str(zoom)), tile_x(lon, zoom).cast("string"), tile_y(lat, zoom).cast("string"))


def tile_lat(y: Column, zoom: int) -> Column:
    """Latitude of the upper edge of a row of tiles."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * y / float(1 << zoom)))))


def tile_lon(x: Column, zoom: int) -> Column:
    return x / float(1 << zoom) * 360.0 - 180.0


def support_radius_m(scan: Column, track: Column) -> Column:
    """Half the diagonal, in metres, of a pixel of scan by track kilometres."""
    return F.sqrt(scan * scan + track * track) * 500.0


def normal_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def haversine_plain(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance without care for the antimeridian, for places that are near each other."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def on_segment(lat: Column, lon: Column, lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> tuple[Column, Column, Column]:
    """The point of a short segment nearest to a place, on a plane scaled by the place's latitude, and its share t of the way."""
    scale = F.cos(F.radians(lat))
    ax, bx, ay, by = lon_delta(lon, lon_a) * scale, lon_delta(lon, lon_b) * scale, lat_a - lat, lat_b - lat
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.greatest(-(ax * dx + ay * dy) / length, F.lit(0.0)), F.lit(1.0)))
    return lat_a + (lat_b - lat_a) * t, normal_lon(lon_a + lon_delta(lon_a, lon_b) * t), t


# What a wedge reaches at its sides and in the middle beyond that, as shares of its length.
TAPER_SIDE, TAPER_MIDDLE = 0.38, 0.62


def taper(offset: Column, half: Column) -> Column:
    """How far a wedge reaches at an angle off its axis, as a share of its length."""
    return TAPER_SIDE + TAPER_MIDDLE * F.cos(F.abs(offset) / half * (math.pi / 2))


def midpoint(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    return (lat1 + lat2) / 2, normal_lon(lon1 + lon_delta(lon1, lon2) / 2)


def adaptive_zoom(lat: Column, span_m: float = 18000.0, low: int = 7, high: int = 11) -> Column:
    """The zoom at which a cell is about span_m wide."""
    circumference = 2 * math.pi * EQUATOR_M
    return F.least(F.greatest(F.floor(F.log2(F.lit(circumference) * F.cos(F.radians(lat)) / span_m)), F.lit(low)), F.lit(high)).cast("int")


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring, an array of struct(x, y): positive if it turns against the clock."""
    after = F.slice(ring, F.lit(2), F.size(ring) - 1)
    cross = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2


def antimeridian_lat(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Latitude at which the great circle through two places meets the 180th meridian; null if it runs along a meridian."""
    a, b = F.radians(lat1), F.radians(lat2)
    turn = F.sin(F.radians(lon2 - lon1))
    rise = F.tan(a) * F.sin(F.radians(lon2 - 180.0)) + F.tan(b) * F.sin(F.radians(180.0 - lon1))
    return F.when(F.abs(turn) > 1e-12, F.degrees(F.atan(rise / turn)))
