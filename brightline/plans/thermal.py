"""Detections: filters, dedupe, gap sessions, pass summaries, grid aggregates and geodesy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightline.functions import geo, values
from brightline.operators.core import dedupe_first, gap_sessions, keyset_page, top_rows
from brightline.operators.selection import exact_medians
from brightline.plans.registry import query
from brightline.sources.tables import DELIVERIES_SQL, DETECTIONS_SQL, deliveries, detections

# The incident's place, box and radius, the clocks of the snapshot, and the gap that ends a pass.
LAT, LON, RADIUS_KM = 38.98, 26.37, 8.0
SOUTH, NORTH, WEST, EAST = 38.85, 39.15, 26.2, 26.6
AS_OF = 1705708800  # 2024-01-20T00:00:00Z
DAY, WEEK, GAP = 86400, 604800, 600

HAVERSINE_SQL = f"2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({LAT} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({LAT})) * pow(sin(radians({LON} - lon) / 2), 2))))"
BOX_SQL = f"lat BETWEEN {SOUTH} AND {NORTH} AND lon BETWEEN {WEST} AND {EAST}"
CODE_SQL = "CASE WHEN product = 'error' THEN 'u' WHEN k < 34 THEN 'l' WHEN k < 67 THEN 'n' ELSE 'h' END"


def in_box() -> Column:
    return F.col("lat").between(SOUTH, NORTH) & F.col("lon").between(WEST, EAST)


def code() -> Column:
    return F.when(F.col("product") == "error", "u").when(F.col("k") < 34, "l").when(F.col("k") < 67, "n").otherwise("h")


def distance() -> Column:
    return geo.haversine(F.col("lat"), F.col("lon"), F.lit(LAT), F.lit(LON))


def first_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_first(deliveries(spark, sf_dir), ["event_id"], [F.col("delivery")])


DEDUPED = DELIVERIES_SQL + ", one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY delivery) AS rn FROM deliv) WHERE rn = 1)"
SESSIONS = (
    DEDUPED + f""", boxed AS (SELECT *, {HAVERSINE_SQL} AS km, {CODE_SQL} AS code FROM one WHERE {BOX_SQL} AND acquired_s > {AS_OF - WEEK} AND acquired_s <= {AS_OF}),
  lagged AS (SELECT *, lag(acquired_s) OVER (PARTITION BY product, satellite ORDER BY acquired_s, event_id) AS before FROM boxed),
  marked AS (SELECT *, CASE WHEN before IS NULL OR acquired_s - before > {GAP} THEN acquired_s END AS start FROM lagged),
  sess AS (SELECT *, last_value(start IGNORE NULLS) OVER (PARTITION BY product, satellite ORDER BY acquired_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_start FROM marked)"""
)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_delivered(spark, sf_dir).where(in_box() & (F.col("acquired_s") > AS_OF - WEEK) & (F.col("acquired_s") <= AS_OF))
    rows = rows.withColumn("km", distance()).withColumn("code", code())
    return gap_sessions(rows, ["product", "satellite"], "acquired_s", GAP, ["event_id"])


@query("thermal_snapshot", f"""WITH {SESSIONS}
SELECT product, satellite, session_start, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE km <= {RADIUS_KM}) AS BIGINT) AS n_incident,
  CAST(count(*) FILTER (WHERE code = 'h') AS BIGINT) AS n_high, CAST(count(*) FILTER (WHERE code = 'n') AS BIGINT) AS n_nominal, CAST(count(*) FILTER (WHERE code = 'l') AS BIGINT) AS n_low,
  CAST(count(*) FILTER (WHERE code = 'u') AS BIGINT) AS n_unclassified, max(frp) AS max_frp, median(frp) AS median_frp, max(acquired_s) AS session_end
FROM sess GROUP BY product, satellite, session_start""")
def thermal_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes near the incident over a week: deduped deliveries, box, radius scope, gap sessions, confidence counts, FRP."""
    is_code = lambda c: F.count_if(F.col("code") == c)
    return sessions(spark, sf_dir).groupBy("product", "satellite", "session_start").agg(
        F.count("*").alias("n"), F.count_if(F.col("km") <= RADIUS_KM).alias("n_incident"), is_code("h").alias("n_high"), is_code("n").alias("n_nominal"), is_code("l").alias("n_low"),
        is_code("u").alias("n_unclassified"), F.max("frp").alias("max_frp"), F.median("frp").alias("median_frp"), F.max("acquired_s").alias("session_end"),
    )


@query("agg_summary", f"""WITH {SESSIONS}
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE km <= {RADIUS_KM}) AS BIGINT) AS n_incident, CAST(count(*) FILTER (WHERE km > {RADIUS_KM}) AS BIGINT) AS n_regional,
  CAST(count(DISTINCT CASE WHEN km <= {RADIUS_KM} THEN product || '::' || satellite || '::' || session_start END) AS BIGINT) AS passes_with_incident, max(acquired_s) AS latest_s FROM sess""")
def agg_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.col("km") <= RADIUS_KM
    pass_id = F.concat_ws("::", "product", "satellite", F.col("session_start").cast("string"))
    return sessions(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count_if(near).alias("n_incident"), F.count_if(~near).alias("n_regional"),
        F.countDistinct(F.when(near, pass_id)).alias("passes_with_incident"), F.max("acquired_s").alias("latest_s"),
    )


@query("win_gap_route", f"WITH {SESSIONS} SELECT event_id, product || '::' || satellite || '::' || session_start AS pass_id FROM sess")
def win_gap_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).select("event_id", F.concat_ws("::", "product", "satellite", F.col("session_start").cast("string")).alias("pass_id"))


@query("win_gap_canonical", f"""WITH {DETECTIONS_SQL}, l AS (SELECT *, lower(trim(product)) AS p, lower(trim(satellite)) AS s FROM det),
  m AS (SELECT *, lag(acquired_s) OVER (PARTITION BY p, s ORDER BY acquired_s, glat, glon, event_id) AS before FROM l)
SELECT p AS product, s AS satellite, CAST(count(*) AS BIGINT) AS n_passes, max(acquired_s) AS last_start FROM m WHERE before IS NULL OR acquired_s - before > {GAP} GROUP BY p, s""")
def win_gap_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections(spark, sf_dir).withColumn("product", F.lower(F.trim("product"))).withColumn("satellite", F.lower(F.trim("satellite")))
    rows = gap_sessions(rows, ["product", "satellite"], "acquired_s", GAP, ["glat", "glon", "event_id"])
    return rows.groupBy("product", "satellite").agg(F.countDistinct("session_start").alias("n_passes"), F.max("session_start").alias("last_start"))


@query("win_gap_archive", f"""WITH {DETECTIONS_SQL}, m AS (SELECT *, lag(acquired_s) OVER (PARTITION BY product ORDER BY acquired_s, event_id) AS before FROM det)
SELECT product, acquired_s AS session_start FROM m WHERE before IS NULL OR acquired_s - before > {GAP}""")
def win_gap_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_sessions(detections(spark, sf_dir), ["product"], "acquired_s", GAP, ["event_id"]).select("product", "session_start").distinct()


@query("flt_bbox", f"WITH {DETECTIONS_SQL} SELECT event_id, lat, lon FROM det WHERE {BOX_SQL}")
def flt_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where(in_box()).select("event_id", "lat", "lon")


@query("geo_radius", f"WITH {DETECTIONS_SQL} SELECT event_id, CASE WHEN {HAVERSINE_SQL} <= {RADIUS_KM} THEN 'incident' ELSE 'regional' END AS scope FROM det WHERE {BOX_SQL}")
def geo_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where(in_box()).select("event_id", F.when(distance() <= RADIUS_KM, "incident").otherwise("regional").alias("scope"))


def _window(name: str, low: int, closed_low: bool, high: int) -> None:
    op = ">=" if closed_low else ">"

    @query(name, f"WITH {DETECTIONS_SQL} SELECT event_id, acquired_s FROM det WHERE acquired_s {op} {low} AND acquired_s <= {high}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = F.col("acquired_s")
        return detections(spark, sf_dir, low, high).where(((at >= low) if closed_low else (at > low)) & (at <= high)).select("event_id", "acquired_s")


_window("flt_win_rolling", AS_OF - DAY, True, AS_OF)
_window("flt_win_day", AS_OF, True, AS_OF + DAY // 2)
_window("flt_win_7d_open", AS_OF - WEEK, False, AS_OF)
_window("flt_win_7d_closed", AS_OF - WEEK, True, AS_OF)


@query("flt_known_at", f"WITH {DETECTIONS_SQL} SELECT event_id FROM det WHERE greatest(acquired_s, retrieved_s, recorded_s) <= {AS_OF}")
def flt_known_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir, until=AS_OF).where(F.greatest("acquired_s", "retrieved_s", "recorded_s") <= AS_OF).select("event_id")


@query("flt_overlap", f"WITH {DETECTIONS_SQL} SELECT event_id FROM det WHERE retrieved_s >= {AS_OF - 3600} AND acquired_s <= {AS_OF}")
def flt_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals from acquisition to retrieval that meet the window, touching included."""
    return detections(spark, sf_dir, until=AS_OF).where((F.col("retrieved_s") >= AS_OF - 3600) & (F.col("acquired_s") <= AS_OF)).select("event_id")


@query("set_dedupe_first", f"WITH {DEDUPED} SELECT event_id, delivery FROM one")
def set_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_delivered(spark, sf_dir).select("event_id", "delivery")


@query("set_dedupe_last", f"WITH {DELIVERIES_SQL} SELECT event_id, max(delivery) AS delivery FROM deliv GROUP BY event_id")
def set_dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries(spark, sf_dir).groupBy("event_id").agg(F.max("delivery").alias("delivery"))


@query("set_union", f"WITH {DELIVERIES_SQL} SELECT event_id, delivery FROM deliv")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries(spark, sf_dir).select("event_id", "delivery")


@query("set_diff", f"WITH {DELIVERIES_SQL} SELECT event_id FROM deliv WHERE delivery = 1 EXCEPT SELECT event_id FROM deliv WHERE delivery = 0")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplemental detections: in the download and not in the area delivery."""
    d = deliveries(spark, sf_dir)
    return d.where("delivery = 1").select("event_id").join(d.where("delivery = 0").select("event_id"), "event_id", "left_anti").distinct()


@query("src_combine_deliveries", f"""WITH {DELIVERIES_SQL}, n AS (SELECT event_id, acquired_s, min(delivery) AS d FROM deliv GROUP BY event_id, acquired_s)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE d = 1) AS BIGINT) AS supplemental, max(acquired_s) - max(CASE WHEN d = 0 THEN acquired_s END) AS recovered_s FROM n""")
def src_combine_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = deliveries(spark, sf_dir).groupBy("event_id", "acquired_s").agg(F.min("delivery").alias("d"))
    return n.agg(F.count("*").alias("n"), F.count_if(F.col("d") == 1).alias("supplemental"), (F.max("acquired_s") - F.max(F.when(F.col("d") == 0, F.col("acquired_s")))).alias("recovered_s"))


@query("agg_fixed_hist", f"""WITH {DETECTIONS_SQL}, c AS (SELECT {CODE_SQL} AS code, count(*) AS n FROM det GROUP BY 1)
SELECT k.code, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (VALUES ('h'), ('n'), ('l'), ('u'), ('x')) AS k(code) LEFT JOIN c ON c.code = k.code""")
def agg_fixed_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for fixed keys, zeros kept."""
    counts = detections(spark, sf_dir).groupBy(code().alias("code")).count()
    keys = spark.createDataFrame([(c,) for c in "hnlux"], "code string")
    return keys.join(counts, "code", "left").select("code", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


@query("agg_median", f"WITH {DETECTIONS_SQL} SELECT product, satellite, median(frp) AS median_frp FROM det GROUP BY product, satellite")
def agg_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians by selection: no task has all of a group."""
    return exact_medians(detections(spark, sf_dir), ["product", "satellite"], "frp", "median_frp")


@query("agg_nearest_rank", f"""WITH {DETECTIONS_SQL}, r AS (SELECT product, retrieved_s - acquired_s AS lag_s, row_number() OVER (PARTITION BY product ORDER BY retrieved_s - acquired_s) AS rn, count(*) OVER (PARTITION BY product) AS n FROM det)
SELECT product, max(CASE WHEN rn = CAST(ceil(n * 0.5) AS BIGINT) THEN lag_s END) AS p50, max(CASE WHEN rn = CAST(ceil(n * 0.95) AS BIGINT) THEN lag_s END) AS p95, max(CASE WHEN rn = CAST(ceil(n * 0.99) AS BIGINT) THEN lag_s END) AS p99, max(lag_s) AS longest
FROM r GROUP BY product""")
def agg_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles: counts per value are summed in order, so that no group is gathered or numbered row by row."""
    by_value = detections(spark, sf_dir).groupBy("product", (F.col("retrieved_s") - F.col("acquired_s")).alias("lag_s")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("product")
    upto = by_value.withColumn("upto", F.sum("c").over(w.orderBy("lag_s"))).withColumn("n", F.sum("c").over(w))
    at = lambda share: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * share), F.col("lag_s")))
    return upto.groupBy("product").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("lag_s").alias("longest"))


@query("agg_filtered", f"WITH {DETECTIONS_SQL} SELECT product, CAST(count(*) FILTER (WHERE frp > 0) AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE NOT frp > 0) AS BIGINT) AS rejected FROM det GROUP BY product")
def agg_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).groupBy("product").agg(F.count_if(F.col("frp") > 0).alias("accepted"), F.count_if(~(F.col("frp") > 0)).alias("rejected"))


@query("agg_latest", f"WITH {DETECTIONS_SQL} SELECT satellite, max(acquired_s) AS latest_s FROM det GROUP BY satellite")
def agg_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).groupBy("satellite").agg(F.max("acquired_s").alias("latest_s"))


@query("agg_count_distinct", f"WITH {DETECTIONS_SQL} SELECT product, CAST(count(DISTINCT satellite) AS BIGINT) AS satellites, CAST(count(DISTINCT acquired_s) AS BIGINT) AS times FROM det GROUP BY product")
def agg_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).groupBy("product").agg(F.countDistinct("satellite").alias("satellites"), F.countDistinct("acquired_s").alias("times"))


@query("agg_collisions", f"WITH {DETECTIONS_SQL} SELECT acquired_s, satellite, CAST(count(DISTINCT event_id) AS BIGINT) AS n, min(event_id) AS first_id FROM det GROUP BY acquired_s, satellite HAVING count(DISTINCT event_id) > 1")
def agg_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that several detections share."""
    return detections(spark, sf_dir).groupBy("acquired_s", "satellite").agg(F.countDistinct("event_id").alias("n"), F.min("event_id").alias("first_id")).where("n > 1")


ZOOM = 8
CELL_SQL = f"""CAST(least(greatest(floor((glon + 180) / 360 * {1 << ZOOM}), 0), {(1 << ZOOM) - 1}) AS BIGINT) AS x,
  CAST(least(greatest(floor((1 - ln(tan(radians(least(greatest(glat, -85.05112878), 85.05112878))) + 1 / cos(radians(least(greatest(glat, -85.05112878), 85.05112878)))) / pi()) / 2 * {1 << ZOOM}), 0), {(1 << ZOOM) - 1}) AS BIGINT) AS y"""


@query("agg_cell_candidates", f"""WITH {DETECTIONS_SQL}, c AS (SELECT *, {CELL_SQL} FROM det)
SELECT 'wm/{ZOOM}/' || x || '/' || y AS cell_key, CAST(count(*) AS BIGINT) AS observations, CAST(count(DISTINCT satellite) AS BIGINT) AS sources, string_agg(DISTINCT product, ',' ORDER BY product) AS signal_kinds,
  min(acquired_s) AS first_s, max(acquired_s) AS latest_s, max(recorded_s) AS known_s FROM c GROUP BY x, y""")
def agg_cell_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse grid cells with counts, kinds of signal and clocks."""
    return detections(spark, sf_dir).groupBy(geo.cell_key(F.col("glat"), F.col("glon"), ZOOM).alias("cell_key")).agg(
        F.count("*").alias("observations"), F.countDistinct("satellite").alias("sources"), F.array_join(F.sort_array(F.collect_set("product")), ",").alias("signal_kinds"),
        F.min("acquired_s").alias("first_s"), F.max("acquired_s").alias("latest_s"), F.max("recorded_s").alias("known_s"),
    )


@query("geo_cell", f"WITH {DETECTIONS_SQL} SELECT event_id, {CELL_SQL} FROM det")
def geo_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("event_id", geo.tile_x(F.col("glon"), ZOOM).alias("x"), geo.tile_y(F.col("glat"), ZOOM).alias("y"))


@query("geo_cell_bounds", f"""WITH {DETECTIONS_SQL}, c AS (SELECT DISTINCT {CELL_SQL} FROM det)
SELECT x, y, round(x / {1 << ZOOM}.0 * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * y / {1 << ZOOM}.0)))), 6) AS north, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 0.5) / {1 << ZOOM}.0)))), 6) AS centre_lat FROM c""")
def geo_cell_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = geo_cell(spark, sf_dir).select("x", "y").distinct()
    return c.select(
        "x", "y", F.round(geo.tile_lon(F.col("x"), ZOOM), 6).alias("west"), F.round(geo.tile_lat(F.col("y"), ZOOM), 6).alias("north"),
        F.round(geo.tile_lat(F.col("y") + 0.5, ZOOM), 6).alias("centre_lat"),
    )


@query("geo_haversine", f"WITH {DETECTIONS_SQL} SELECT event_id, round({HAVERSINE_SQL}, 6) AS km FROM det")
def geo_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("event_id", F.round(distance(), 6).alias("km"))


@query("geo_bearing", f"""WITH {DETECTIONS_SQL}, t AS (SELECT event_id, sin(radians({LON} - lon)) * cos(radians({LAT})) AS y, cos(radians(lat)) * sin(radians({LAT})) - sin(radians(lat)) * cos(radians({LAT})) * cos(radians({LON} - lon)) AS x FROM det)
SELECT event_id, CASE WHEN x * x + y * y > 1e-24 THEN round((degrees(atan2(y, x)) + 360) % 360, 6) END AS degrees FROM t""")
def geo_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("event_id", F.round(geo.bearing(F.col("lat"), F.col("lon"), F.lit(LAT), F.lit(LON)), 6).alias("degrees"))


@query("geo_destination", f"""WITH {DETECTIONS_SQL}, d AS (SELECT event_id, radians(glat) AS a, glon, radians(event_id % 360) AS t, (event_id % 500) / 6371.0 AS s FROM det),
  b AS (SELECT *, asin(sin(a) * cos(s) + cos(a) * sin(s) * cos(t)) AS b FROM d)
SELECT event_id, round(degrees(b), 6) AS to_lat, round(glon + degrees(atan2(sin(t) * sin(s) * cos(a), cos(s) - sin(a) * sin(b))) + 540 - 360 * floor((glon + degrees(atan2(sin(t) * sin(s) * cos(a), cos(s) - sin(a) * sin(b))) + 540) / 360) - 180, 6) AS to_lon FROM b""")
def geo_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = geo.destination(F.col("glat"), F.col("glon"), (F.col("event_id") % 360).cast("double"), (F.col("event_id") % 500).cast("double"))
    return detections(spark, sf_dir).select("event_id", F.round(lat, 6).alias("to_lat"), F.round(lon, 6).alias("to_lon"))


@query("geo_compass", "SELECT event_id, (['N','NE','E','SE','S','SW','W','NW'])[CAST(floor((event_id % 360) / 45.0 + 0.5) AS INTEGER) % 8 + 1] AS point FROM events")
def geo_compass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("event_id", geo.compass((F.col("event_id") % 360).cast("double")).alias("point"))


@query("geo_support_radius", f"WITH {DETECTIONS_SQL} SELECT event_id, round(sqrt(scan * scan + track * track) * 500, 6) AS radius_m FROM det")
def geo_support_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("event_id", F.round(geo.support_radius_m(F.col("scan"), F.col("track")), 6).alias("radius_m"))


@query("geo_nearest", f"""WITH {DETECTIONS_SQL}, d AS (SELECT product, event_id, {HAVERSINE_SQL} AS km FROM det)
SELECT product, event_id, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY km, event_id) AS rn FROM d) WHERE rn = 1""")
def geo_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest detection of each product: a minimum of structs combines before the shuffle."""
    best = detections(spark, sf_dir).groupBy("product").agg(F.min(F.struct(distance().alias("km"), "event_id")).alias("b"))
    return best.select("product", "b.event_id", F.round("b.km", 6).alias("km"))


@query("join_cell", f"""WITH {DETECTIONS_SQL}, c AS (SELECT event_id, {CELL_SQL} FROM det), cells AS (SELECT x, y, CAST(count(*) AS BIGINT) AS in_cell FROM c GROUP BY x, y)
SELECT c.event_id, c.x, c.y, in_cell FROM c JOIN cells USING (x, y)""")
def join_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in all occupied cells, with the cell's count, as an equi-join on the tile."""
    c = geo_cell(spark, sf_dir)
    cells = c.groupBy("x", "y").agg(F.count("*").alias("in_cell"))
    return c.join(cells, ["x", "y"]).select("event_id", "x", "y", "in_cell")


KEY_SQL = "product || '|' || satellite || '|' || acquired_s || '|' || printf('%.4f', round(lat, 4)) || '|' || printf('%.4f', round(lon, 4)) || '|' || printf('%.3f', round(scan, 3)) || '|' || coalesce(printf('%.3f', round(CASE WHEN k > 5 THEN track END, 3)), 'null')"


@query("hash_natural_key", f"WITH {DETECTIONS_SQL} SELECT event_id, sha256({KEY_SQL}) AS natural_key FROM det")
def hash_natural_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product, satellite, time, place at four decimals and pixel size at three; what is unknown has the token null."""
    fixed = lambda c, n: F.coalesce(F.format_string(f"%.{n}f", F.when(c.isNotNull(), F.round(c, n))), F.lit("null"))
    track = F.when(F.col("k") > 5, F.col("track"))
    size = F.when(track.isNull(), "null").otherwise(fixed(track, 3))
    parts = ["product", "satellite", F.col("acquired_s").cast("string"), fixed(F.col("lat"), 4), fixed(F.col("lon"), 4), fixed(F.col("scan"), 3), size]
    return detections(spark, sf_dir).select("event_id", F.sha2(F.concat_ws("|", *parts), 256).alias("natural_key"))


PAGE = (1706000000, 5000)


@query("ord_keyset", f"""WITH {DETECTIONS_SQL}, p AS (SELECT acquired_s, event_id, row_number() OVER (ORDER BY acquired_s DESC, event_id DESC) AS rn FROM det WHERE acquired_s < {PAGE[0]} OR (acquired_s = {PAGE[0]} AND event_id < {PAGE[1]}))
SELECT acquired_s, event_id, (SELECT count(*) FROM p) > 100 AS has_more FROM p WHERE rn <= 100""")
def ord_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 100 after a key, newest first, with one row of look-ahead."""
    return keyset_page(detections(spark, sf_dir).select("acquired_s", "event_id"), [("acquired_s", True), ("event_id", True)], PAGE, 100)


@query("ord_keyset_asc", "SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier WHERE s_suppkey > 20) > 25 AS has_more FROM supplier WHERE s_suppkey > 20 ORDER BY s_suppkey LIMIT 25")
def ord_keyset_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyset_page(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name"), [("s_suppkey", False)], (20,), 25)


@query("ord_topk_group", f"WITH {DETECTIONS_SQL} SELECT product, event_id, frp FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY frp DESC, event_id) AS rn FROM det) WHERE rn <= 10")
def ord_topk_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_rows(detections(spark, sf_dir), ["product"], [F.desc("frp"), F.asc("event_id")], 10).select("product", "event_id", "frp")


@query("ord_topk", f"WITH {DETECTIONS_SQL} SELECT event_id, acquired_s FROM det ORDER BY acquired_s DESC, event_id LIMIT 16")
def ord_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).orderBy(F.desc("acquired_s"), "event_id").limit(16).select("event_id", "acquired_s")


@query("st_tumbling", f"WITH {DETECTIONS_SQL} SELECT product, acquired_s - acquired_s % 300 AS bucket_s, CAST(count(*) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k_sum FROM det GROUP BY 1, 2")
def st_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute buckets, as the streaming plan of brightline.streaming gives them."""
    return detections(spark, sf_dir).groupBy("product", (F.col("acquired_s") - F.col("acquired_s") % 300).alias("bucket_s")).agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"))


@query("dt_age_minutes", f"WITH {DETECTIONS_SQL} SELECT event_id, CAST(greatest(0, floor(({AS_OF} - acquired_s) / 60.0 + 0.5)) AS BIGINT) AS age_min FROM det")
def dt_age_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = values.js_round((F.lit(AS_OF) - F.col("acquired_s")) / 60.0)
    return detections(spark, sf_dir).select("event_id", F.greatest(F.lit(0), age.cast("long")).cast("long").alias("age_min"))


@query("dt_elapsed_label", f"""WITH {DETECTIONS_SQL}, m AS (SELECT event_id, CAST(floor(({AS_OF} - acquired_s) / 60.0) AS BIGINT) AS m FROM det)
SELECT event_id, CASE WHEN m < 0 THEN 'clock mismatch' WHEN m < 60 THEN m || ' min' WHEN m < 1440 THEN (m // 60) || ' h ' || (m % 60) || ' min' ELSE (m // 1440) || ' d ' || (m % 1440 // 60) || ' h' END AS label FROM m""")
def dt_elapsed_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("event_id", values.elapsed_label((F.lit(AS_OF) - F.col("acquired_s")) / 60.0).alias("label"))


@query("prj_confidence", f"WITH {DETECTIONS_SQL} SELECT event_id, {CODE_SQL} AS code FROM det")
def prj_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("product") == "error", F.col("k").cast("string")).when(F.col("k") < 34, "low").when(F.col("k") < 67, " Nominal").otherwise("H")
    return detections(spark, sf_dir).select("event_id", values.confidence_code(raw).alias("code"))


@query("prj_pressure", "SELECT l_orderkey, l_linenumber, l_partkey, floor(CASE WHEN l_quantity < 40 THEN l_quantity * 33.8639::DOUBLE ELSE l_quantity + 970 END * 10 + 0.5) / 10 AS hpa FROM lineitem")
def prj_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("l_quantity") < 40, F.col("l_quantity")).otherwise(F.col("l_quantity") + 970)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", values.pressure_hpa(raw).alias("hpa"))


@query("str_humanize", "SELECT DISTINCT event_type, upper(substr(replace(event_type, '_', ' '), 1, 1)) || substr(replace(event_type, '_', ' '), 2) AS label FROM events")
def str_humanize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", values.humanize(F.col("event_type")).alias("label")).distinct()
