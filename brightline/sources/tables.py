"""Tables and the relations that queries derive from them with whole-number arithmetic, alike in any engine."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts) -> F.Column:
    """Seconds since 1970 of a timestamp, rounded down; the session's zone is UTC."""
    return F.unix_seconds(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def instant(seconds: int) -> F.Column:
    """A literal to compare with the tables' timestamps, which have no zone, so that the bound reaches the scan."""
    return F.lit(datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def detections(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Point detections from events: product, satellite, clocks in epoch seconds, local (lat, lon) and global (glat, glon) places.

    since, until: seconds that bound acquired_s; given here they also prune what is read.
    """
    e = table(spark, sf_dir, "events")
    if since is not None:
        e = e.where(F.col("ts") >= instant(since))
    if until is not None:
        e = e.where(F.col("ts") < instant(until + 60))
    at = epoch_seconds("ts")
    return e.select(
        "event_id", F.col("event_type").alias("product"), F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("satellite"),
        (at - at % 60).alias("acquired_s"), (at + (F.col("event_id") % 180) * 60).alias("retrieved_s"), (at + (F.col("event_id") % 180) * 60 + 60).alias("recorded_s"),
        F.col("value").alias("frp"), F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.lit(38.80) + (F.col("event_id") * 37 % 400) / 1000.0).alias("lat"), (F.lit(26.15) + (F.col("event_id") * 73 % 500) / 1000.0).alias("lon"),
        (F.lit(-60.0) + (F.col("event_id") * 37 % 12000) / 100.0).alias("glat"), (F.lit(-180.0) + (F.col("event_id") * 73 % 36000) / 100.0).alias("glon"),
        (F.lit(0.3) + (F.col("event_id") % 20) / 20.0).alias("scan"), (F.lit(0.3) + (F.col("event_id") % 13) / 20.0).alias("track"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as two overlapping deliveries sent them, every one in one at least: delivery 0 (area) before 1 (download)."""
    d = detections(spark, sf_dir)
    area = d.where("frp IS NULL OR frp < 12").withColumn("delivery", F.lit(0))
    return area.unionByName(d.where("frp >= 5").withColumn("delivery", F.lit(1)))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision chains from lineitem: chain key, version from 1, ship time, and content."""
    from pyspark.sql import Window

    # Named before the window, so that what groups by chain afterwards needs no shuffle of its own.
    order = Window.partitionBy("chain").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "chain")
    return li.select(
        "chain", F.row_number().over(order).alias("version"), epoch_seconds("l_shipdate").alias("shipped_s"),
        "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("quantity"), "l_returnflag", "l_linestatus",
    )


#: The same relations in SQL.
DETECTIONS_SQL = """det AS (
  SELECT event_id, event_type AS product, 'S' || CAST(user_id % 3 AS VARCHAR) AS satellite,
         CAST(epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 60 AS BIGINT) AS acquired_s,
         CAST(epoch_us(ts) // 1000000 + (event_id % 180) * 60 AS BIGINT) AS retrieved_s, CAST(epoch_us(ts) // 1000000 + (event_id % 180) * 60 + 60 AS BIGINT) AS recorded_s,
         value AS frp, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         CAST(38.80 AS DOUBLE) + (event_id * 37 % 400) / CAST(1000 AS DOUBLE) AS lat, CAST(26.15 AS DOUBLE) + (event_id * 73 % 500) / CAST(1000 AS DOUBLE) AS lon,
         CAST(-60 AS DOUBLE) + (event_id * 37 % 12000) / CAST(100 AS DOUBLE) AS glat, CAST(-180 AS DOUBLE) + (event_id * 73 % 36000) / CAST(100 AS DOUBLE) AS glon,
         CAST(0.3 AS DOUBLE) + (event_id % 20) / CAST(20 AS DOUBLE) AS scan, CAST(0.3 AS DOUBLE) + (event_id % 13) / CAST(20 AS DOUBLE) AS track
  FROM events)"""
DELIVERIES_SQL = DETECTIONS_SQL + """, deliv AS (
  SELECT *, 0 AS delivery FROM det WHERE frp IS NULL OR frp < 12 UNION ALL SELECT *, 1 AS delivery FROM det WHERE frp >= 5)"""
REVISIONS_SQL = """rev AS (
  SELECT l_orderkey AS chain, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS version,
         CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) AS shipped_s, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS quantity, l_returnflag, l_linestatus
  FROM lineitem)"""
