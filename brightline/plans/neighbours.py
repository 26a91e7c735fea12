"""Nearest stations of detections, and passes that overlap request windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightline.functions.geo import EARTH_KM
from brightline.operators.nearest import nearest, overlapping
from brightline.plans.registry import query
from brightline.sources.tables import DETECTIONS_SQL, detections, table

_STATION = "s_suppkey AS station, CAST(-180 AS DOUBLE) + (s_suppkey * 997 % 36000) / CAST(100 AS DOUBLE) AS lon, CAST(-89 AS DOUBLE) + (s_suppkey * 613 % 17800) / CAST(100 AS DOUBLE) AS lat"
_KM = f"2 * {EARTH_KM} * asin(least(1.0, sqrt(pow(sin(radians(s.lat - glat) / 2), 2) + cos(radians(glat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - glon) / 2), 2))))"


@query("geo_nearest_stations", f"""WITH {DETECTIONS_SQL}, s AS (SELECT {_STATION} FROM supplier), d AS (SELECT event_id, station, {_KM} AS km FROM det, s),
  r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(km, 6), station) AS rank FROM d)
SELECT event_id, CAST(rank AS INTEGER) AS rank, station, round(km, 6) AS km FROM r WHERE rank <= 2""")
def geo_nearest_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two stations nearest to each detection, over the whole globe."""
    k = F.col("s_suppkey")
    stations = table(spark, sf_dir, "supplier").select(k.alias("station"), (F.lit(-180.0) + (k * 997 % 36000) / 100.0).alias("lon"), (F.lit(-89.0) + (k * 613 % 17800) / 100.0).alias("lat"))
    places = detections(spark, sf_dir).select("event_id", F.col("glat").alias("lat"), F.col("glon").alias("lon"))
    found = nearest(places, stations, "event_id", "station", 2)
    return found.select("event_id", "rank", "station", F.round(2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.col("chord") / 2)), 6).alias("km"))


@query("join_overlap", """WITH g AS (SELECT o_orderkey AS granule, epoch_us(o_orderdate) // 1000000 AS from_s, epoch_us(o_orderdate) // 1000000 + (o_orderkey * 37 % 900) AS to_s FROM orders),
  w AS (SELECT s_suppkey AS request, 788918400 + s_suppkey * 700001 % 200000000 AS from_s, 788918400 + s_suppkey * 700001 % 200000000 + CASE WHEN s_suppkey % 9 = 0 THEN 8000000 ELSE s_suppkey * 977 % 86400 END AS to_s FROM supplier)
SELECT request, granule FROM w JOIN g ON g.from_s <= w.to_s AND w.from_s <= g.to_s""")
def join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Granules whose time overlaps a request's window: most windows are hours, some a season."""
    at, k, s = F.unix_seconds(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey"), F.col("s_suppkey")
    granules = table(spark, sf_dir, "orders").select(k.alias("granule"), at.alias("from_s"), (at + k * 37 % 900).alias("to_s"))
    begins = F.lit(788918400) + s * 700001 % 200000000
    windows = table(spark, sf_dir, "supplier").select(s.alias("request"), begins.alias("from_s"), (begins + F.when(s % 9 == 0, 8000000).otherwise(s * 977 % 86400)).alias("to_s"))
    return overlapping(windows, granules, "request", "granule")
