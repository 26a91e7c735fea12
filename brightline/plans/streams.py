"""Queries that run as streams over tables until all files are read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightline.functions.materialise import shared_dir
from brightline.plans.registry import query
from brightline.streaming import harvest, steps
from brightline.streaming.sources import drained, drained_and_closed, stream_of

#: How far a row may be behind the latest one and still count: files may come in any order within it.
LATE = "60 days"


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, with their time as an instant."""
    return stream_of(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))


@query("st_dedupe_watermark", "SELECT event_id, event_type FROM events")
def st_dedupe_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries of the same events as one stream, each event once."""
    both = timed(spark, sf_dir).union(timed(spark, sf_dir))
    return drained(steps.without_repeats(both, ["event_id"], "at", LATE), "append", "dedupe").select("event_id", "event_type")


@query("st_tumbling_stream", "SELECT event_type, CAST(epoch_us(ts) // 300000000 * 300 AS BIGINT) AS start_s, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def st_tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of five minutes as a stream in update mode: the last batch that has a window tells its count."""
    out = drained(steps.tumbling_counts(timed(spark, sf_dir), ["event_type"], "at", "5 minutes", LATE), "update", "tumbling")
    return out.groupBy("event_type", "start_s").agg(F.max_by("n", "batch").alias("n"))


@query("st_session_stream", """WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
  s AS (SELECT user_id, t, sum(CASE WHEN t - before <= 600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, CAST(min(t) // 1000000 AS BIGINT) AS start_s, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, session""")
def st_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions of users as a stream; those still open when the files end are closed by a last watermark."""
    steps_ = lambda rows: steps.session_counts(rows, ["user_id"], "at", "600 seconds", LATE)
    return drained_and_closed(timed(spark, sf_dir), "at", steps_, "append", "sessions").where("user_id is not null").select("user_id", "start_s", "n")


@query("st_revision_state", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS version FROM events")
def st_revision_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its number in its user's chain, in order of time whatever the order of files."""
    steps_ = lambda rows: steps.numbered(rows, "user_id", "at", "event_id", LATE)
    return drained_and_closed(timed(spark, sf_dir), "at", steps_, "append", "chain").where("user_id is not null").select("user_id", "event_id", "version")


@query("st_dedupe_content", """WITH c AS (SELECT event_id, sha256(event_type || '|' || props) AS content FROM events UNION ALL SELECT event_id, sha256(CASE WHEN event_id % 7 = 0 THEN upper(event_type) ELSE event_type END || '|' || props) FROM events)
SELECT DISTINCT event_id, content FROM c""")
def st_dedupe_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries as one stream, some events changed in the second: identity and content together say what is a repeat."""

    def sent(kind: Column) -> DataFrame:
        e = stream_of(spark, sf_dir, "events")
        return e.select("event_id", F.col("ts").cast("timestamp").alias("at"), F.sha2(F.concat_ws("|", kind, F.col("props")), 256).alias("content"))

    kind = F.col("event_type")
    both = sent(kind).union(sent(F.when(F.col("event_id") % 7 == 0, F.upper(kind)).otherwise(kind)))
    return drained(steps.without_repeats(both, ["event_id", "content"], "at", LATE), "append", "content").select("event_id", "content")


@query("st_harvest", """WITH d AS (SELECT event_id, epoch_us(ts) // 1000000 AS at_s, event_type AS kind, value, 0 AS sent FROM events UNION ALL
    SELECT event_id, epoch_us(ts) // 1000000, CASE WHEN event_id % 5 = 0 THEN upper(event_type) ELSE event_type END, CASE WHEN event_id % 10 = 0 THEN value + 1 ELSE value END, 1 FROM events WHERE event_id % 3 <> 1),
  o AS (SELECT event_id, kind, value, min(at_s) AS at_s, min(sent) AS sent FROM d GROUP BY event_id, kind, value)
SELECT event_id, kind, value, CAST(row_number() OVER (PARTITION BY event_id ORDER BY sent) AS INTEGER) AS version FROM o""")
def st_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries of detections, the second with corrections, harvested one after the other and once more: a table of revisions, each once."""
    e = F.col("event_id")
    fields = ["event_id", "at", "kind", "value", "sent"]

    def delivery(sent: int) -> DataFrame:
        rows = stream_of(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).withColumn("sent", F.lit(sent)).withColumnRenamed("event_type", "kind")
        if sent:
            rows = rows.where(e % 3 != 1).withColumn("kind", F.when(e % 5 == 0, F.upper("kind")).otherwise(F.col("kind"))).withColumn("value", F.when(e % 10 == 0, F.col("value") + 1).otherwise(F.col("value")))
        return rows.select(*fields)

    path = f"{shared_dir(spark)}/brightline/harvest-{uuid.uuid4().hex}"
    both = delivery(0).union(delivery(1))
    harvest.harvest(both, path, ["event_id"], ["kind", "value"], "at")
    harvest.harvest(both, path, ["event_id"], ["kind", "value"], "at")  # nothing new: no effect
    schema = spark.createDataFrame([], "event_id long, at timestamp, kind string, value double, sent int, content_hash string, day string, batch long")
    return harvest.revisions(harvest.table(spark, path, schema), ["event_id"], ["sent"]).select("event_id", "kind", "value", "version")
