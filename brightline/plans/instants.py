"""Instants and dates: offsets, local days, buckets, ages, precisions, and date-only filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightline.functions import instants as t
from brightline.plans.registry import per_row, query
from brightline.sources.tables import DETECTIONS_SQL, detections, table

AS_OF = 1705708800  # 2024-01-20T00:00:00Z
ZONE = t.ZONE
WALL = 1698364800  # 2023-10-27T00:00:00Z: the days round the end of summer time

SHOWN_SQL = f"CAST(epoch(to_timestamp(acquired_s) AT TIME ZONE '{ZONE}') AS BIGINT)"
DATE_SQL = f"CAST(to_timestamp(acquired_s) AT TIME ZONE '{ZONE}' AS DATE)"
MIDNIGHT_SQL = f"CAST(epoch(CAST({DATE_SQL} AS TIMESTAMP) AT TIME ZONE '{ZONE}') AS BIGINT)"


@per_row("dt_offset", "det", "event_id", {"minutes": f"CAST(({SHOWN_SQL} - acquired_s) // 60 AS INTEGER)"})
def dt_offset():
    return {"minutes": t.offset_minutes(F.col("acquired_s"))}


@per_row("dt_local_date", "det", "event_id", {"day": f"CAST({DATE_SQL} AS VARCHAR)"})
def dt_local_date():
    return {"day": t.local_date(F.col("acquired_s")).cast("string")}


@per_row("dt_local_noon", "det", "event_id", {"noon_s": f"CAST(epoch((CAST({DATE_SQL} AS TIMESTAMP) + INTERVAL 12 HOUR) AT TIME ZONE '{ZONE}') AS BIGINT)"})
def dt_local_noon():
    return {"noon_s": t.local_day_start(t.local_date(F.col("acquired_s")), hours=12)}


WALL_SQL = f"({WALL} + event_id * 97 % 400000)"
FITS_SQL = lambda o: f"CAST(epoch(to_timestamp({WALL_SQL} - {o}) AT TIME ZONE '{ZONE}') AS BIGINT) = {WALL_SQL}"


@per_row("dt_wall_unique", "det", "event_id", {"at_s": f"CASE WHEN ({FITS_SQL(7200)}) <> ({FITS_SQL(10800)}) THEN CAST(CASE WHEN {FITS_SQL(7200)} THEN {WALL_SQL} - 7200 ELSE {WALL_SQL} - 10800 END AS BIGINT) END"})
def dt_wall_unique():
    """The instant of a wall time that the zone's clock shows once; null in the hour that it shows twice."""
    return {"at_s": t.wall_instant(F.lit(WALL) + F.col("event_id") * 97 % 400000)}


STAMP_SQL = "strftime(make_timestamp(acquired_s * 1000000), '%Y-%m-%dT%H:%M:%S')"
TEXT_SQL = f"CASE WHEN k < 30 THEN {STAMP_SQL} || 'Z' WHEN k < 60 THEN {STAMP_SQL} || '+02:00' WHEN k < 70 THEN {STAMP_SQL} || '-05:30' WHEN k < 80 THEN {STAMP_SQL} || '+15:00' WHEN k < 90 THEN {STAMP_SQL} WHEN k < 95 THEN '2024-02-30T00:00:00Z' ELSE CAST(acquired_s AS VARCHAR) END"
ZONED_SQL = f"CASE WHEN k < 30 THEN acquired_s WHEN k < 60 THEN acquired_s - 7200 WHEN k < 70 THEN acquired_s + 19800 END"


def stamped():
    stamp, k = F.date_format(F.timestamp_seconds("acquired_s"), "yyyy-MM-dd'T'HH:mm:ss"), F.col("k")
    suffix = F.when(k < 30, "Z").when(k < 60, "+02:00").when(k < 70, "-05:30").when(k < 80, "+15:00").otherwise("")
    return F.when(k < 90, F.concat(stamp, suffix)).when(k < 95, "2024-02-30T00:00:00Z").otherwise(F.col("acquired_s").cast("string"))


@per_row("dt_zoned", "det", "event_id", {"at_s": f"CAST({ZONED_SQL} AS BIGINT)"})
def dt_zoned():
    """Texts with a zone become instants; without one, with an offset beyond 14:00 or on no real date they don't."""
    return {"at_s": t.zoned_instant(stamped())}


@per_row("dt_mixed", "det", "event_id", {"at_s": f"CAST(CASE WHEN k >= 95 THEN acquired_s ELSE {ZONED_SQL} END AS BIGINT)"})
def dt_mixed():
    return {"at_s": t.mixed_instant(stamped())}


@per_row("dt_roundtrip", "det", "event_id", {"canonical": f"coalesce(strftime(try_strptime({TEXT_SQL}, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%dT%H:%M:%SZ') = {TEXT_SQL}, FALSE)"})
def dt_roundtrip():
    """Whether a text is the one that the instant it stands for is written as."""
    text, form = stamped(), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return {"canonical": F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit(form)), form) == text, F.lit(False))}


@query("dt_date_key", """SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 80 THEN strftime(ts, '%Y-%m-%d') END AS day FROM events""")
def dt_date_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts = F.get_json_object("props", "$.k").cast("int"), F.col("ts").cast("timestamp")
    text = F.when(k < 40, F.concat(F.lit("on "), F.date_format(ts, "yyyy-MM-dd"))).when(k < 80, F.date_format(ts, "d/M/yyyy")).otherwise("some day")
    return table(spark, sf_dir, "events").select("event_id", t.date_key(text).alias("day"))


@query("dt_ceil_ms", "SELECT event_id, CAST((epoch_us(ts) + 999) // 1000 AS BIGINT) AS up_ms, CAST(epoch_us(ts) // 1000 AS BIGINT) AS down_ms FROM events")
def dt_ceil_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks in whole milliseconds, on the safe side: up for what became known, down for what is asked."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.ceil(us / 1000).alias("up_ms"), F.floor(us / 1000).alias("down_ms"))


@per_row("dt_bucket", "det", "event_id", {
    "bucket_s": "acquired_s - acquired_s % 300", "ready_s": "(acquired_s - 60) - (acquired_s - 60) % 300", "left_s": "300 - acquired_s % 300",
})
def dt_bucket():
    """Five-minute buckets: the own one, the latest that is ready after a minute of grace, and the seconds to the next."""
    at = F.col("acquired_s")
    return {"bucket_s": t.bucket_start(at, 300), "ready_s": t.bucket_start(at, 300, 60), "left_s": 300 - F.pmod(at, F.lit(300))}


@per_row("dt_age_signed", "det", "event_id", {"minutes": f"CAST(CASE WHEN {AS_OF} >= acquired_s THEN floor(({AS_OF} - acquired_s) / 60.0) ELSE ceil(({AS_OF} - acquired_s) / 60.0) END AS BIGINT)"})
def dt_age_signed():
    age = (F.lit(AS_OF) - F.col("acquired_s")) / 60
    return {"minutes": F.when(age >= 0, F.floor(age)).otherwise(F.ceil(age))}


@per_row("dt_age_seconds", "det", "event_id", {"seconds": f"greatest({AS_OF} - acquired_s, 0)"})
def dt_age_seconds():
    return {"seconds": F.greatest(F.lit(AS_OF) - F.col("acquired_s"), F.lit(0))}


@per_row("dt_clamp", "det", "event_id", {"at_s": f"least(greatest(acquired_s, {AS_OF - 86400}), {AS_OF})", "live": f"acquired_s >= {AS_OF - 150}"})
def dt_clamp():
    """A time on a slider that ends at the clock: its last half step is live."""
    return {"at_s": F.least(F.greatest("acquired_s", F.lit(AS_OF - 86400)), F.lit(AS_OF)), "live": F.col("acquired_s") >= AS_OF - 150}


@query("dt_date_add", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CAST(o_custkey % 400 AS INTEGER) AS VARCHAR) AS due FROM orders")
def dt_date_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 400).cast("int")).cast("string").alias("due"))


@per_row("dt_present", "det", "event_id", {"label": f"strftime(to_timestamp(acquired_s) AT TIME ZONE '{ZONE}', '%d/%m/%Y %H:%M') || CASE WHEN {SHOWN_SQL} - acquired_s = 7200 THEN ' UTC+2' ELSE ' UTC+3' END"})
def dt_present():
    at = F.col("acquired_s")
    shown = F.date_format(F.from_utc_timestamp(F.timestamp_seconds(at), ZONE), "dd/MM/yyyy HH:mm")
    return {"label": F.concat(shown, F.lit(" UTC+"), (t.offset_minutes(at) / 60).cast("int").cast("string"))}


@per_row("dt_greatest_clock", "det", "event_id", {"known_s": "greatest(acquired_s, CASE WHEN k > 10 THEN retrieved_s END, CASE WHEN k > 50 THEN recorded_s END)"})
def dt_greatest_clock():
    """The latest of the clocks that are there."""
    return {"known_s": F.greatest("acquired_s", F.when(F.col("k") > 10, F.col("retrieved_s")), F.when(F.col("k") > 50, F.col("recorded_s")))}


@per_row("dt_precision_coalesce", "det", "event_id", {
    "at_s": f"CASE WHEN k < 30 THEN acquired_s WHEN k < 60 THEN {MIDNIGHT_SQL} WHEN k < 90 THEN retrieved_s END",
    "precision": "CASE WHEN k < 30 THEN 'exact' WHEN k < 60 THEN 'date' WHEN k < 90 THEN 'first-seen' ELSE 'unknown' END",
})
def dt_precision_coalesce():
    """The best time that is known of a thing: the exact one, else the start of its local day, else when it was first seen."""
    exact, k = F.when(F.col("k") < 30, F.col("acquired_s")), F.col("k")
    day = F.when(k.between(30, 59), t.local_day_start(t.local_date(F.col("acquired_s"))))
    seen = F.when(k.between(60, 89), F.col("retrieved_s"))
    return {"at_s": F.coalesce(exact, day, seen), "precision": F.when(exact.isNotNull(), "exact").when(day.isNotNull(), "date").when(seen.isNotNull(), "first-seen").otherwise("unknown")}


@per_row("dt_compare_precision", "det", "event_id", {
    "order_of": f"CASE WHEN k < 50 THEN CASE WHEN acquired_s < {AS_OF} THEN 'before' WHEN acquired_s > {AS_OF} THEN 'after' ELSE 'equal' END WHEN {MIDNIGHT_SQL} + 86399 < {AS_OF} THEN 'before' WHEN {MIDNIGHT_SQL} > {AS_OF} THEN 'after' ELSE 'indeterminate' END",
})
def dt_compare_precision():
    """A time that is known exactly or to the day, against an instant."""
    day = t.local_day_start(t.local_date(F.col("acquired_s")))
    low = F.when(F.col("k") < 50, F.col("acquired_s")).otherwise(day)
    high = F.when(F.col("k") < 50, F.col("acquired_s")).otherwise(day + 86399)
    return {"order_of": t.compare_spans(low, high, F.lit(AS_OF), F.lit(AS_OF))}


@query("flt_overlap_dateonly", f"WITH {DETECTIONS_SQL} SELECT event_id FROM det WHERE {MIDNIGHT_SQL} <= {AS_OF} AND CAST(epoch((CAST({DATE_SQL} AS TIMESTAMP) + INTERVAL 1 DAY) AT TIME ZONE '{ZONE}') AS BIGINT) > {AS_OF - 86400}")
def flt_overlap_dateonly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Things known to the local day whose day meets the window of a day before the clock."""
    day = t.local_date(F.col("acquired_s"))
    # The day can't meet the window if the instant is more than two days off: that much is known before dates are reckoned.
    near = detections(spark, sf_dir).where(F.col("acquired_s").between(AS_OF - 3 * 86400, AS_OF + 2 * 86400))
    return near.where((t.local_day_start(day) <= AS_OF) & (t.local_day_start(F.date_add(day, 1)) > AS_OF - 86400)).select("event_id")


@query("flt_recency", f"WITH {DETECTIONS_SQL} SELECT event_id FROM det WHERE CASE WHEN k < 50 THEN acquired_s >= {AS_OF} WHEN k < 90 THEN {DATE_SQL} >= DATE '2024-01-20' ELSE FALSE END")
def flt_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items since the start: exact ones by the clock, dated ones by the local calendar, undated ones never."""
    k, at = F.col("k"), F.col("acquired_s")
    return detections(spark, sf_dir).where(F.when(k < 50, at >= AS_OF).when(k < 90, t.local_date(at) >= F.lit("2024-01-20").cast("date")).otherwise(False)).select("event_id")


@query("flt_asof", f"WITH {DETECTIONS_SQL} SELECT event_id, 'live' AS mode FROM det UNION ALL SELECT event_id, 'historical' FROM det WHERE k >= 10 AND acquired_s <= {AS_OF}")
def flt_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live reads keep all, unknown times too; historical ones what is known to be at or before the cutoff."""
    d = detections(spark, sf_dir)
    known = F.when(F.col("k") >= 10, F.col("acquired_s"))
    return d.select("event_id", F.lit("live").alias("mode")).unionByName(d.where(known <= AS_OF).select("event_id", F.lit("historical").alias("mode")))


@per_row("prj_temporal_demote", "det", "event_id", {
    "start_s": f"CASE WHEN k < 50 AND acquired_s <= {AS_OF} THEN acquired_s END", "start_day": f"CASE WHEN k BETWEEN 50 AND 89 AND {MIDNIGHT_SQL} <= {AS_OF} THEN CAST({DATE_SQL} AS VARCHAR) END",
    "precision": f"CASE WHEN k < 50 AND acquired_s <= {AS_OF} THEN 'exact' WHEN k BETWEEN 50 AND 89 AND {MIDNIGHT_SQL} <= {AS_OF} THEN 'date' ELSE 'unknown' END",
})
def prj_temporal_demote():
    """A start by its precision; one that the cutoff can't know yet is unknown."""
    k, at = F.col("k"), F.col("acquired_s")
    day = t.local_date(at)
    exact, dated = (k < 50) & (at <= AS_OF), k.between(50, 89) & (t.local_day_start(day) <= AS_OF)
    return {"start_s": F.when(exact, at), "start_day": F.when(dated, day.cast("string")), "precision": F.when(exact, "exact").when(dated, "date").otherwise("unknown")}


@per_row("dt_acq_strict", "det", "event_id", {"minutes": "CASE WHEN k < 90 THEN CASE WHEN (k * 37 % 3000) % 100 < 60 AND (k * 37 % 3000) // 100 < 24 THEN CAST((k * 37 % 3000) // 100 * 60 + (k * 37 % 3000) % 100 AS INTEGER) END END"})
def dt_acq_strict():
    """Minutes of the day from one to four digits and nothing else."""
    raw = F.when(F.col("k") < 90, (F.col("k") * 37 % 3000).cast("string")).otherwise("12:30")
    four = F.lpad(raw, 4, "0")
    hour, minute = F.substring(four, 1, 2).try_cast("int"), F.substring(four, 3, 2).try_cast("int")
    return {"minutes": F.when(raw.rlike(r"^\d{1,4}$") & (hour < 24) & (minute < 60), hour * 60 + minute)}
