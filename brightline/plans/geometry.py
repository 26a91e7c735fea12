"""Places, segments, wedges, cells and rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightline.functions import geo
from brightline.plans.registry import per_row, query
from brightline.sources.tables import DETECTIONS_SQL, detections

LAT, LON = 38.98, 26.37
# A line of four places, latitude and longitude.
LINE = ((38.85, 26.20), (38.95, 26.30), (39.02, 26.45), (39.15, 26.60))

NORMAL_SQL = lambda x: f"(((({x}) + 180.0) % 360 + 360) % 360 - 180.0)"
DELTA_SQL = lambda a, b: NORMAL_SQL(f"({b}) - ({a})")


@per_row("geo_lon_norm", "det", "event_id", {"lon": f"round({NORMAL_SQL('glon * 3')}, 6)", "delta": f"round({DELTA_SQL('glon', str(LON))}, 6)"})
def geo_lon_norm():
    return {"lon": F.round(geo.normal_lon(F.col("glon") * 3), 6), "delta": F.round(geo.lon_delta(F.col("glon"), F.lit(LON)), 6)}


H_SQL = f"(pow(sin(radians({LAT} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({LAT})) * pow(sin(radians({LON} - lon) / 2), 2))"


@per_row("geo_haversine_plain", "det", "event_id", {"km": f"round(2 * 6371.0 * atan2(sqrt({H_SQL}), sqrt(1 - {H_SQL})), 6)"})
def geo_haversine_plain():
    return {"km": F.round(geo.haversine_plain(F.col("lat"), F.col("lon"), F.lit(LAT), F.lit(LON)), 6)}


def segment_sql(a, b) -> str:
    """Share of the way from a to b at which the segment is nearest to (lat, lon)."""
    ax, bx = f"(({a[1]} - lon) * cos(radians(lat)))", f"(({b[1]} - lon) * cos(radians(lat)))"
    ay, dx, dy = f"({a[0]} - lat)", f"(({b[1]} - {a[1]}) * cos(radians(lat)))", f"({b[0]} - {a[0]})"
    return f"least(greatest(-({ax} * {dx} + {ay} * {dy}) / ({dx} * {dx} + {dy} * {dy}), 0.0), 1.0)"


@per_row("geo_nearest_segment", "det", "event_id", {
    "at_lat": f"round({LINE[0][0]} + ({LINE[3][0]} - {LINE[0][0]}) * {segment_sql(LINE[0], LINE[3])}, 6)", "at_lon": f"round({LINE[0][1]} + ({LINE[3][1]} - {LINE[0][1]}) * {segment_sql(LINE[0], LINE[3])}, 6)",
})
def geo_nearest_segment():
    a, b = LINE[0], LINE[3]
    lat, lon, _ = geo.on_segment(F.col("lat"), F.col("lon"), *(F.lit(x) for x in (*a, *b)))
    return {"at_lat": F.round(lat, 6), "at_lon": F.round(lon, 6)}


def near_sql(i: int) -> str:
    a, b = LINE[i], LINE[i + 1]
    lat, lon = (f"({a[x]} + ({b[x]} - {a[x]}) * {segment_sql(a, b)})" for x in (0, 1))
    return f"SELECT event_id, {i} AS part, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lon} - lon) / 2), 2)))) AS km FROM det"


@query("geo_nearest_line", f"WITH {DETECTIONS_SQL}, p AS ({' UNION ALL '.join(near_sql(i) for i in range(3))}) SELECT event_id, round(min(km), 6) AS km FROM p GROUP BY event_id")
def geo_nearest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to a line of several places: the least of its segments', in one row each, without a join."""
    parts = []
    for a, b in zip(LINE, LINE[1:], strict=False):
        lat, lon, _ = geo.on_segment(F.col("lat"), F.col("lon"), *(F.lit(x) for x in (*a, *b)))
        parts.append(geo.haversine(F.col("lat"), F.col("lon"), lat, lon))
    return detections(spark, sf_dir).select("event_id", F.round(F.least(*parts), 6).alias("km"))


@per_row("geo_wedge", "det", "event_id", {
    "side_km": "round((2 + k / 10.0) * (0.38 + 0.62 * cos(pi() / 4)), 6)", "axis_km": "2 + k / 10.0",
})
def geo_wedge():
    """How far a wedge of 25 degrees to either side reaches half-way to its side, and on its axis."""
    length = F.lit(2.0) + F.col("k") / 10.0
    return {"side_km": F.round(length * geo.taper(F.lit(12.5), F.lit(25.0)), 6), "axis_km": length * geo.taper(F.lit(0.0), F.lit(25.0))}


@per_row("geo_midpoint", "det", "event_id", {"mid_lat": f"round((glat + {LAT}) / 2, 6)", "mid_lon": f"round({NORMAL_SQL(f'glon + {DELTA_SQL("glon", str(LON))} / 2')}, 6)"})
def geo_midpoint():
    lat, lon = geo.midpoint(F.col("glat"), F.col("glon"), F.lit(LAT), F.lit(LON))
    return {"mid_lat": F.round(lat, 6), "mid_lon": F.round(lon, 6)}


@per_row("geo_zoom", "det", "event_id", {"zoom": "CAST(least(greatest(floor(log2(2 * pi() * 6378137.0 * cos(radians(glat)) / 18000.0)), 7), 11) AS INTEGER)"})
def geo_zoom():
    return {"zoom": geo.adaptive_zoom(F.col("glat"))}


Y_SQL = "least(greatest(floor((1 - ln(tan(radians(glat)) + 1 / cos(radians(glat))) / pi()) / 2 * 128), 0), 127)"
X_SQL = "least(greatest(floor((glon + 180.0) / 360.0 * 128), 0), 127)"
EDGE_SQL = lambda y: f"degrees(atan((exp(pi() * (1 - 2 * ({y}) / 128.0)) - exp(-pi() * (1 - 2 * ({y}) / 128.0))) / 2))"


def cell_y():
    lat = F.radians("glat")
    return F.least(F.greatest(F.floor((1 - F.log(F.tan(lat) + 1 / F.cos(lat)) / F.pi()) / 2 * 128), F.lit(0)), F.lit(127)).cast("long")


def edge_lat(y):
    m = F.pi() * (1 - 2 * y / 128.0)
    return F.degrees(F.atan((F.exp(m) - F.exp(-m)) / 2))


@per_row("geo_cell_key", "det", "event_id", {"cell_key": f"'wm/7/' || CAST({X_SQL} AS INTEGER) || '/' || CAST({Y_SQL} AS INTEGER)", "x": f"CAST({X_SQL} AS INTEGER)", "valid": "TRUE"})
def geo_cell_key():
    """The canonical name of a cell, and its column read back from that name."""
    key = F.concat_ws("/", F.lit("wm"), F.lit("7"), geo.tile_x(F.col("glon"), 7).cast("string"), cell_y().cast("string"))
    return {"cell_key": key, "x": F.regexp_extract(key, r"^wm/(\d+)/(\d+)/(\d+)$", 2).cast("int"), "valid": key.rlike(r"^wm/(0|[1-9]\d?)/(0|[1-9]\d*)/(0|[1-9]\d*)$")}


@per_row("geo_cell_span", "det", "event_id", {"centre_lat": f"round(({EDGE_SQL(Y_SQL)} + {EDGE_SQL(Y_SQL + ' + 1')}) / 2, 6)", "span_km": f"round(({EDGE_SQL(Y_SQL)} - {EDGE_SQL(Y_SQL + ' + 1')}) * 111.195, 4)"})
def geo_cell_span():
    """The centre of a cell at the mean of its edges' latitudes, and its height."""
    north, south = edge_lat(cell_y()), edge_lat(cell_y() + 1)
    return {"centre_lat": F.round((north + south) / 2, 6), "span_km": F.round((north - south) * 111.195, 4)}


WEST_SQL, EAST_SQL = "glon", NORMAL_SQL("glon + k + 1")


@per_row("geo_bounds_mid", "det", "event_id", {"mid_lon": f"round({NORMAL_SQL(f'glon + (CASE WHEN {EAST_SQL} >= glon THEN {EAST_SQL} - glon ELSE {EAST_SQL} + 360 - glon END) / 2')}, 6)"})
def geo_bounds_mid():
    """The middle of bounds that may cross the antimeridian."""
    east = geo.normal_lon(F.col("glon") + F.col("k") + 1)
    width = F.when(east >= F.col("glon"), east - F.col("glon")).otherwise(east + 360 - F.col("glon"))
    return {"mid_lon": F.round(geo.normal_lon(F.col("glon") + width / 2), 6)}


@per_row("geo_rect_split", "det", "event_id", {
    "n_parts": f"CASE WHEN {EAST_SQL} >= glon THEN 1 ELSE 2 END", "first_east": f"CASE WHEN {EAST_SQL} >= glon THEN round({EAST_SQL}, 6) ELSE 180.0 END",
    "last_west": f"CASE WHEN {EAST_SQL} >= glon THEN round(glon, 6) ELSE -180.0 END",
})
def geo_rect_split():
    """A rectangle in one part, or in two if it crosses the antimeridian."""
    parts = rectangle_parts()
    return {"n_parts": F.size(parts), "first_east": F.get(F.get(parts, F.lit(0)), F.lit(1)), "last_west": F.get(F.element_at(parts, -1), F.lit(0))}


def rectangle_parts():
    """West and east of each part of the rectangle that is k + 1 degrees wide."""
    end = geo.normal_lon(F.col("glon") + F.col("k") + 1)
    west, east = F.round("glon", 6), F.round(end, 6)
    one, two = F.array(F.array(west, east)), F.array(F.array(west, F.lit(180.0)), F.array(F.lit(-180.0), east))
    return F.when(end >= F.col("glon"), one).otherwise(two)


@per_row("geo_ring_area", "det", "event_id", {"area": "round((1 + k / 10.0) * (2 + event_id % 7) * CASE WHEN k < 50 THEN 1 ELSE -1 END, 6)"})
def geo_ring_area():
    """Shoelace area of a rectangle's ring, drawn one way or the other."""
    w, h = F.lit(1.0) + F.col("k") / 10.0, (F.lit(2) + F.col("event_id") % 7).cast("double")
    at = lambda x, y: F.struct((F.col("lon") + x).alias("x"), (F.col("lat") + y).alias("y"))
    o = F.lit(0.0)
    ring = F.array(at(o, o), at(w, o), at(w, h), at(o, h), at(o, o))
    return {"area": F.round(geo.ring_area(F.when(F.col("k") < 50, ring).otherwise(F.reverse(ring))), 6)}


@per_row("geo_antimeridian", "det", "event_id", {
    "at_lat": "round(CASE WHEN abs(sin(radians(-170 - (170.0 + k / 20.0)))) > 1e-12 THEN degrees(atan((tan(radians(glat)) * sin(radians(-170 - 180.0)) + tan(radians(glat / 2)) * sin(radians(180.0 - (170.0 + k / 20.0)))) / sin(radians(-170 - (170.0 + k / 20.0))))) END, 6)",
})
def geo_antimeridian():
    """Where the way from a place west of the antimeridian to one east of it crosses."""
    return {"at_lat": F.round(geo.antimeridian_lat(F.col("glat"), F.lit(170.0) + F.col("k") / 20.0, F.col("glat") / 2, F.lit(-170.0)), 6)}


@per_row("geo_smoke", "det", "event_id", {"km": "round(least(greatest(frp * k / 60.0, 2.0), 18.0), 6)", "downwind": "(k * 3 + 180) % 360"})
def geo_smoke():
    """How far smoke has drifted, within bounds, and where to."""
    return {"km": F.round(F.least(F.greatest(F.col("frp") * F.col("k") / 60.0, F.lit(2.0)), F.lit(18.0)), 6), "downwind": F.pmod(F.col("k") * 3 + 180, F.lit(360))}


@query("flt_cell", f"WITH {DETECTIONS_SQL} SELECT event_id FROM det WHERE {X_SQL} = 40 AND {Y_SQL} BETWEEN 30 AND 100")
def flt_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of one column of cells: the longitude's bounds are plain comparisons, the cell's rows follow from the tile."""
    west, east = 40 / 128 * 360.0 - 180, 41 / 128 * 360.0 - 180
    d = detections(spark, sf_dir).where((F.col("glon") >= west) & (F.col("glon") < east))
    return d.where(cell_y().between(30, 100)).select("event_id")


@query("sink_geojson", f"WITH {DETECTIONS_SQL} SELECT event_id, CASE WHEN {EAST_SQL} >= glon THEN 'Polygon' ELSE 'MultiPolygon' END AS kind FROM det")
def sink_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of geometry that a cell's bounds are written as."""
    parts = rectangle_parts()
    return detections(spark, sf_dir).select("event_id", F.when(F.size(parts) == 1, "Polygon").otherwise("MultiPolygon").alias("kind"))
