"""Rules and checks: states of sources and scans, gates, pixels, provenance, and violations as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightline.functions import states
from brightline.plans.registry import per_row, query
from brightline.sources.tables import DETECTIONS_SQL, REVISIONS_SQL, detections, revisions, table

AS_OF = 1705708800  # 2024-01-20T00:00:00Z
STALE = 10800

SCAN_SQL = f"CASE WHEN k < 10 THEN 'disabled' WHEN k < 20 THEN 'unconfigured' WHEN k < 70 AND acquired_s + {STALE * 60} >= {AS_OF} THEN 'complete_current' WHEN k < 70 THEN 'complete_stale' WHEN k < 85 THEN 'partial' ELSE 'unavailable' END"
RESULT_SQL = f"CASE WHEN frp > 20 THEN 'items' WHEN ({SCAN_SQL}) = 'complete_current' AND scan < 1 THEN 'valid-empty' WHEN ({SCAN_SQL}) LIKE 'complete%' THEN 'complete-not-eligible' ELSE {SCAN_SQL} END"


def scan_state():
    """Coverage of each detection's scan: complete below k = 70, at its acquisition."""
    k = F.col("k")
    return states.coverage(k >= 10, k >= 20, F.when(k < 70, F.col("acquired_s")), k < 85, AS_OF, STALE * 60)


def scan_result():
    return states.result_state(F.when(F.col("frp") > 20, 1).otherwise(0), F.col("scan") < 1, scan_state())


@per_row("rule_coverage", "det", "event_id", {"state": SCAN_SQL, "stale_at_s": f"acquired_s + {STALE}"})
def rule_coverage():
    return {"state": scan_state(), "stale_at_s": F.col("acquired_s") + STALE}


@per_row("rule_valid_empty", "det", "event_id", {"eligible": f"({SCAN_SQL}) = 'complete_current' AND scan < 1"})
def rule_valid_empty():
    return {"eligible": (scan_state() == "complete_current") & (F.col("scan") < 1)}


@per_row("rule_result_state", "det", "event_id", {"state": RESULT_SQL})
def rule_result_state():
    return {"state": scan_result()}


@query("rule_consistency", f"WITH {DETECTIONS_SQL} SELECT event_id, concat_ws(',', CASE WHEN k % 3 = 0 AND ({SCAN_SQL}) <> 'complete_current' THEN 'empty-without-coverage' END, CASE WHEN k % 3 = 0 AND frp > 20 THEN 'empty-with-items' END) AS reasons FROM det WHERE k % 3 = 0 AND (({SCAN_SQL}) <> 'complete_current' OR frp > 20)")
def rule_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that claim a valid empty result which their coverage or their items don't allow."""
    claims = F.col("k") % 3 == 0
    found = states.violation(detections(spark, sf_dir), (claims & (scan_state() != "complete_current"), "empty-without-coverage"), (claims & (F.col("frp") > 20), "empty-with-items"))
    return found.select("event_id", "reasons")


@query("rule_presentation", f"WITH {DETECTIONS_SQL} SELECT event_id, CASE ({RESULT_SQL}) WHEN 'items' THEN 1 WHEN 'complete-not-eligible' THEN 2 WHEN 'valid-empty' THEN 3 ELSE 4 END AS place FROM det")
def rule_presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place in which a state is shown: stale before valid-empty."""
    order = F.create_map(*[x for s, p in (("items", 1), ("complete-not-eligible", 2), ("valid-empty", 3)) for x in (F.lit(s), F.lit(p))])
    return detections(spark, sf_dir).select("event_id", F.coalesce(F.try_element_at(order, scan_result()), F.lit(4)).alias("place"))


@query("rule_freshness", f"""WITH {DETECTIONS_SQL}, h AS (SELECT satellite, product, max(acquired_s) FILTER (WHERE k < 60) AS ok_s, max(acquired_s) FILTER (WHERE k >= 60) AS bad_s, max(k) AS top FROM det WHERE acquired_s <= {AS_OF} GROUP BY 1, 2)
SELECT satellite, product, CASE WHEN product = 'click' THEN 'disabled' WHEN satellite = 'S2' AND product = 'view' THEN 'unconfigured' WHEN ok_s IS NULL THEN 'never' WHEN {AS_OF} - ok_s > {STALE} THEN 'stale' WHEN bad_s > ok_s THEN 'failed' ELSE 'healthy' END AS state FROM h""")
def rule_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness of each source in its eight states."""
    ok, bad = F.max(F.when(F.col("k") < 60, F.col("acquired_s"))), F.max(F.when(F.col("k") >= 60, F.col("acquired_s")))
    h = detections(spark, sf_dir).where(F.col("acquired_s") <= AS_OF).groupBy("satellite", "product").agg(ok.alias("ok_s"), bad.alias("bad_s"))
    unset = (F.col("satellite") == "S2") & (F.col("product") == "view")
    return h.select("satellite", "product", states.freshness(F.col("product") != "click", ~unset, F.lit(None).cast("string"), F.col("ok_s"), F.col("bad_s"), AS_OF, STALE).alias("state"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a scene from line items: class, quality word and geolocation flags."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 10).alias("mask_class"), (F.col("l_suppkey") % 256).alias("quality"), (F.col("l_partkey") % 16).alias("place"), "l_quantity")


PIXELS_SQL = "px AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 10 AS mask_class, l_suppkey % 256 AS quality, l_partkey % 16 AS place, l_quantity FROM lineitem)"


@query("flt_bitmask", f"WITH {PIXELS_SQL} SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM px WHERE (quality & 127) < 100 AND (place & 7) = 0 AND isfinite(l_quantity) AND l_quantity BETWEEN 0 AND 45 GROUP BY l_orderkey")
def flt_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels whose quality word, geolocation flags and value are fit, by scene."""
    fit = (F.col("quality").bitwiseAND(127) < 100) & (F.col("place").bitwiseAND(7) == 0) & ~F.isnan("l_quantity") & F.col("l_quantity").between(0, 45)
    return pixels(spark, sf_dir).where(fit).groupBy("l_orderkey").agg(F.count("*").alias("n"))


OUTCOME = f"""WITH {PIXELS_SQL}, s AS (SELECT l_orderkey, count(*) FILTER (WHERE mask_class >= 7) AS fire, count(*) FILTER (WHERE mask_class < 3) AS unknown, count(*) FILTER (WHERE mask_class IN (3, 5)) AS clear, count(*) AS n FROM px GROUP BY l_orderkey)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("mask_class")
    return pixels(spark, sf_dir).groupBy("l_orderkey").agg(F.count_if(c >= 7).alias("fire"), F.count_if(c < 3).alias("unknown"), F.count_if(c.isin(3, 5)).alias("clear"), F.count("*").alias("n"))


@query("rule_pixel_outcome", OUTCOME + " SELECT l_orderkey, CASE WHEN fire > 0 THEN 'fire_returned' ELSE 'indeterminate' END AS outcome, concat_ws(',', CASE WHEN fire = 0 AND unknown > 0 THEN 'unprocessed' END, CASE WHEN fire = 0 AND clear < n THEN 'not-all-clear' END) AS reasons FROM s")
def rule_pixel_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.col("fire") == 0
    why = states.reasons((none & (F.col("unknown") > 0), "unprocessed"), (none & (F.col("clear") < F.col("n")), "not-all-clear"))
    return scenes(spark, sf_dir).select("l_orderkey", F.when(none, "indeterminate").otherwise("fire_returned").alias("outcome"), F.concat_ws(",", why).alias("reasons"))


@query("rule_pixel_outcome_sql", OUTCOME + " SELECT l_orderkey, CASE WHEN fire > 0 THEN 'fire_returned' WHEN clear = n AND n >= 2 THEN 'no_firemask_class_candidate' ELSE 'indeterminate' END AS outcome, fire = 0 AND clear = n AS eligible FROM s")
def rule_pixel_outcome_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the outcome that all pixels are water or clear land and the scene is whole, and whether it is a candidate for it."""
    clear = F.col("clear") == F.col("n")
    outcome = states.first_of([(F.col("fire") > 0, "fire_returned"), (clear & (F.col("n") >= 2), "no_firemask_class_candidate")], "indeterminate")
    return scenes(spark, sf_dir).select("l_orderkey", outcome.alias("outcome"), ((F.col("fire") == 0) & clear).alias("eligible"))


@query("rule_assessment_shape", f"WITH {REVISIONS_SQL} SELECT chain, version, CASE WHEN version = 1 AND l_returnflag = 'R' THEN 'starts-unknown' ELSE 'reason-missing' END AS why FROM rev WHERE (version = 1 AND l_returnflag = 'R') OR (version > 1 AND l_returnflag = 'R' AND quantity > 40)")
def rule_assessment_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments that don't begin as awaited, or are unknown without a reason."""
    unknown = F.col("l_returnflag") == "R"
    first, bare = unknown & (F.col("version") == 1), unknown & (F.col("version") > 1) & (F.col("quantity") > 40)
    return revisions(spark, sf_dir).where(first | bare).select("chain", "version", F.when(first, "starts-unknown").otherwise("reason-missing").alias("why"))


AUTHORITY_SQL = "SELECT o_orderkey, c_mktsegment AS kind, CASE WHEN c_mktsegment = 'MACHINERY' AND o_orderstatus = 'O' AND c_acctbal > 0 THEN 'instruction' WHEN c_acctbal > 0 AND o_orderstatus <> 'P' THEN 'status' ELSE 'none' END AS authority FROM orders JOIN customer ON o_custkey = c_custkey"


def authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    trusted, active = F.col("c_acctbal") > 0, F.col("o_orderstatus") == "O"
    rule = states.first_of([((F.col("c_mktsegment") == "MACHINERY") & active & trusted, "instruction"), (trusted & (F.col("o_orderstatus") != "P"), "status")], "none")
    return o.select("o_orderkey", F.col("c_mktsegment").alias("kind"), rule.alias("authority"))


query("rule_authority", AUTHORITY_SQL)(authority)


@query("rule_dispatchable", f"WITH a AS ({AUTHORITY_SQL}) SELECT kind, CAST(count(*) FILTER (WHERE authority <> 'none' AND kind <> 'FURNITURE') AS BIGINT) AS dispatchable, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY kind")
def rule_dispatchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    may = (F.col("authority") != "none") & (F.col("kind") != "FURNITURE")
    return authority(spark, sf_dir).groupBy("kind").agg(F.count_if(may).alias("dispatchable"), F.count("*").alias("n"))


@query("sink_outbox", f"""WITH a AS ({AUTHORITY_SQL}) SELECT CASE authority WHEN 'instruction' THEN 'alerts' ELSE 'updates' END AS topic, CAST(o_orderkey AS VARCHAR) AS key, '{{"id":' || o_orderkey || ',"kind":"' || kind || '"}}' AS value FROM a WHERE authority <> 'none'""")
def sink_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by topic, with a key that keeps an incident in one partition: the columns of Spark's Kafka sink."""
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), "kind"))
    topic = F.when(F.col("authority") == "instruction", "alerts").otherwise("updates")
    return authority(spark, sf_dir).where("authority <> 'none'").select(topic.alias("topic"), F.col("o_orderkey").cast("string").alias("key"), body.alias("value"))


@per_row("rule_provenance", "det", "event_id", {"reasons": f"concat_ws(',', CASE WHEN product = 'click' THEN 'publisher_cannot_issue' END, CASE WHEN k < 30 THEN 'not_accepted' END, CASE WHEN retrieved_s > recorded_s THEN 'clock_order' END, CASE WHEN acquired_s + 604800 < {AS_OF} THEN 'expired' END)"})
def rule_provenance():
    """All reasons why a chain of evidence does not carry an instruction."""
    return {"reasons": F.concat_ws(",", states.reasons(
        (F.col("product") == "click", "publisher_cannot_issue"), (F.col("k") < 30, "not_accepted"), (F.col("retrieved_s") > F.col("recorded_s"), "clock_order"), (F.col("acquired_s") + 604800 < AS_OF, "expired"),
    ))}


@per_row("rule_temporal", "det", "event_id", {"state": f"CASE WHEN k < 3 OR retrieved_s < acquired_s THEN 'rejected' WHEN acquired_s > {AS_OF} + 300 THEN 'quarantined' ELSE 'accepted' END"})
def rule_temporal():
    """Times without a value, or out of order, are rejected; those more than five minutes ahead of the clock wait."""
    at = F.when(F.col("k") >= 3, F.col("acquired_s"))
    return {"state": states.first_of([(at.isNull() | (F.col("retrieved_s") < at), "rejected"), (at > AS_OF + 300, "quarantined")], "accepted")}


@query("rule_threshold_cross", f"""WITH {REVISIONS_SQL}, w AS (SELECT chain, version, quantity, lag(quantity) OVER (PARTITION BY chain ORDER BY version) AS before FROM rev)
SELECT chain, version, CASE WHEN quantity >= 45 THEN 45 WHEN quantity >= 35 THEN 35 ELSE 25 END AS level FROM w WHERE before IS NOT NULL AND quantity >= 25 AND CASE WHEN quantity >= 45 THEN 45 WHEN quantity >= 35 THEN 35 ELSE 25 END > CASE WHEN before >= 45 THEN 45 WHEN before >= 35 THEN 35 WHEN before >= 25 THEN 25 ELSE 0 END""")
def rule_threshold_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions that reach a higher threshold than the one before."""
    level = lambda c: F.when(F.col(c) >= 45, 45).when(F.col(c) >= 35, 35).when(F.col(c) >= 25, 25).otherwise(0)
    r = revisions(spark, sf_dir).withColumn("before", F.lag("quantity").over(Window.partitionBy("chain").orderBy("version")))
    return r.where(F.col("before").isNotNull() & (level("quantity") > level("before"))).select("chain", "version", level("quantity").alias("level"))


@query("val_time_shape", f"WITH {DETECTIONS_SQL} SELECT event_id, CASE WHEN k < 40 THEN 'exact-with-day' ELSE 'unknown-with-time' END AS why FROM det WHERE (k < 40 AND k > 30) OR k > 95")
def val_time_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times whose fields don't go with their precision: exact ones have an instant only, unknown ones nothing."""
    k = F.col("k")
    precision = F.when(k < 40, "exact").when(k < 80, "date").otherwise("unknown")
    at, day = F.when((k < 40) | (k > 95), F.col("acquired_s")), F.when(k.between(31, 79), F.lit("2024-01-20"))
    why = F.when((precision == "exact") & (at.isNull() | day.isNotNull()), "exact-with-day").when((precision == "date") & (at.isNotNull() | day.isNull()), "date-with-time").when((precision == "unknown") & (at.isNotNull() | day.isNotNull()), "unknown-with-time")
    return detections(spark, sf_dir).select("event_id", why.alias("why")).where("why is not null")


@query("val_complete_set", f"WITH {DETECTIONS_SQL}, s AS (SELECT acquired_s // 3600 AS hour, satellite, list_sort(list(DISTINCT product)) AS have FROM det GROUP BY 1, 2), every AS (SELECT list_sort(list(DISTINCT product)) AS want FROM det) SELECT CAST(hour AS BIGINT) AS hour, satellite, CAST(len(have) AS INTEGER) AS n FROM s, every WHERE have <> want")
def val_complete_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of a satellite in which a product is missing."""
    d = detections(spark, sf_dir)
    want = d.agg(F.array_sort(F.collect_set("product")).alias("want"))  # a row of a few names
    have = d.groupBy(F.floor(F.col("acquired_s") / 3600).alias("hour"), "satellite").agg(F.array_sort(F.collect_set("product")).alias("have"))
    return have.join(F.broadcast(want), F.col("have") != F.col("want")).select("hour", "satellite", F.size("have").alias("n"))


@query("val_twin_match", f"WITH {DETECTIONS_SQL}, a AS (SELECT event_id, frp, k, satellite FROM det), b AS (SELECT event_id, value AS frp, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k, 'S' || (user_id % 3) AS satellite FROM events) SELECT a.event_id, concat_ws(',', CASE WHEN a.frp IS DISTINCT FROM b.frp THEN 'frp' END, CASE WHEN a.k IS DISTINCT FROM b.k THEN 'k' END, CASE WHEN a.satellite IS DISTINCT FROM b.satellite THEN 'satellite' END) AS reasons FROM a JOIN b USING (event_id) WHERE a.frp IS DISTINCT FROM b.frp OR a.k IS DISTINCT FROM b.k OR a.satellite IS DISTINCT FROM b.satellite")
def val_twin_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that differ from their stored twins, null-safe, with the columns that do."""
    a = detections(spark, sf_dir).select("event_id", "frp", "k", "satellite").alias("a")
    e = table(spark, sf_dir, "events")
    b = e.select("event_id", F.col("value").alias("frp"), F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("int")).alias("k"), F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("satellite")).alias("b")
    rules = [(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in ("frp", "k", "satellite")]
    return states.violation(a.join(b, F.col("a.event_id") == F.col("b.event_id")), *rules).select("a.event_id", "reasons")


@query("val_change_chain", f"WITH {REVISIONS_SQL}, w AS (SELECT *, lag(l_partkey) OVER (PARTITION BY chain ORDER BY version) AS basis FROM rev) SELECT chain, version FROM w WHERE version > 1 AND basis > l_partkey")
def val_change_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes whose predecessor has the larger part number."""
    basis = F.lag("l_partkey").over(Window.partitionBy("chain").orderBy("version"))
    return revisions(spark, sf_dir).withColumn("basis", basis).where((F.col("version") > 1) & (F.col("basis") > F.col("l_partkey"))).select("chain", "version")


@query("val_item_window", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate OR l_shipdate > o_orderdate + INTERVAL 60 DAY")
def val_item_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items outside their run's window."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    late = F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")
    return j.where((F.col("l_shipdate") < F.col("o_orderdate")) | late).select("l_orderkey", "l_linenumber", "l_partkey")


@query("val_transition", f"WITH {REVISIONS_SQL}, w AS (SELECT *, lag(l_linestatus) OVER (PARTITION BY chain ORDER BY version) AS before FROM rev) SELECT chain, version, before || '-' || l_linestatus AS step FROM w WHERE before = 'F'")
def val_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from a state that is final."""
    before = F.lag("l_linestatus").over(Window.partitionBy("chain").orderBy("version"))
    return revisions(spark, sf_dir).withColumn("before", before).where("before = 'F'").select("chain", "version", F.concat_ws("-", "before", "l_linestatus").alias("step"))


@query("val_registry", "SELECT 'dangling' AS why, CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) UNION ALL SELECT 'duplicate', min(s_suppkey) FROM supplier GROUP BY s_name HAVING count(*) > 1 UNION ALL SELECT 'authority', s_suppkey FROM supplier WHERE s_acctbal < 0")
def val_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries that nothing refers to, that share a name, or that hold what their kind may not."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    unused = n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select(F.lit("dangling").alias("why"), F.col("n_nationkey").cast("long").alias("id"))
    twice = s.groupBy("s_name").agg(F.min("s_suppkey").alias("id"), F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("why"), "id")
    return unused.unionByName(twice).unionByName(s.where("s_acctbal < 0").select(F.lit("authority").alias("why"), F.col("s_suppkey").alias("id")))


@query("val_scan_shape", f"WITH {DETECTIONS_SQL} SELECT event_id FROM det WHERE (product = 'click') <> (k < 50)")
def val_scan_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses whose nulls don't go with their kind: clicks have a cursor, others none."""
    cursor = F.when(F.col("k") < 50, F.col("k"))
    return detections(spark, sf_dir).where((F.col("product") == "click") != cursor.isNotNull()).select("event_id")


@query("val_bundle_cutoff", "SELECT o_orderkey, CAST(count(*) AS BIGINT) AS late FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 90 DAY GROUP BY o_orderkey")
def val_bundle_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles with evidence that is later than their cutoff."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.where(F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 90 DAY")).groupBy("o_orderkey").agg(F.count("*").alias("late"))


@query("val_scan_complete", f"WITH {REVISIONS_SQL}, s AS (SELECT chain, count(*) AS n, max(version) AS top, count(*) FILTER (WHERE l_returnflag = 'R') AS rejects FROM rev GROUP BY chain) SELECT chain, n = top AND rejects = 0 AS complete FROM s")
def val_scan_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a scan is whole: as many pages as its last one's number, and no reject."""
    s = revisions(spark, sf_dir).groupBy("chain").agg(F.count("*").alias("n"), F.max("version").alias("top"), F.count_if(F.col("l_returnflag") == "R").alias("rejects"))
    return s.select("chain", ((F.col("n") == F.col("top")) & (F.col("rejects") == 0)).alias("complete"))


@query("val_page_chain", f"WITH {REVISIONS_SQL}, w AS (SELECT *, lag(shipped_s) OVER (PARTITION BY chain ORDER BY version) AS cursor, max(version) OVER (PARTITION BY chain) AS top FROM rev) SELECT chain, version FROM w WHERE (cursor IS NULL) <> (version = 1) OR (l_linestatus = 'F' AND version < top)")
def val_page_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose cursor isn't the one of the page before, or that say they are the last and aren't."""
    w = Window.partitionBy("chain")
    r = revisions(spark, sf_dir).withColumn("cursor", F.lag("shipped_s").over(w.orderBy("version"))).withColumn("top", F.max("version").over(w))
    return r.where((F.col("cursor").isNull() != (F.col("version") == 1)) | ((F.col("l_linestatus") == "F") & (F.col("version") < F.col("top")))).select("chain", "version")


@query("flt_envelope", f"WITH {DETECTIONS_SQL} SELECT event_id, lat BETWEEN 38.85 AND 39.15 AND lon BETWEEN 26.2 AND 26.6 AND acquired_s BETWEEN 1704844800 AND 1705708800 AS within FROM det")
def flt_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether rows lie in the box and dates of the request, as its text has them."""
    box = F.split(F.lit("26.2,38.85,26.6,39.15"), ",").cast("array<double>")
    first, last = (F.unix_seconds(F.to_timestamp(F.lit(d))) for d in ("2024-01-10", "2024-01-20"))
    within = F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]) & F.col("acquired_s").between(first, last)
    return detections(spark, sf_dir).select("event_id", within.alias("within"))


def public_view(df: DataFrame) -> DataFrame:
    """Rows that anyone may see: accepted, neither withdrawn nor made up."""
    return df.where((F.col("l_returnflag") != "R") & (F.col("quantity") > 1))


@query("flt_visibility", f"WITH {REVISIONS_SQL} SELECT chain, version FROM rev WHERE l_returnflag <> 'R' AND quantity > 1 AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal >= 0)")
def flt_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public revisions of sources that are open."""
    open_ = table(spark, sf_dir, "supplier").where("s_acctbal >= 0")
    return public_view(revisions(spark, sf_dir)).join(open_, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("chain", "version")


@query("txt_imperative", r"SELECT conv_id, turn, coalesce(regexp_matches(text, '(?i)\b(move away|evacuate now|stay ready|follow the instructions)\b'), FALSE) AS imperative FROM conversations")
def txt_imperative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts tell people what to do."""
    says = F.col("text").rlike(r"(?i)\b(move away|evacuate now|stay ready|follow the instructions)\b")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(says, F.lit(False)).alias("imperative"))


@query("txt_directive", r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?im)^\s*(leave|go|stay|move)\b') AND NOT regexp_matches(text, '(?i)\b(must|should|have to|need to)\b')")
def txt_directive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that neither order nor advise."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").where(~t.rlike(r"(?im)^\s*(leave|go|stay|move)\b") & ~t.rlike(r"(?i)\b(must|should|have to|need to)\b")).select("doc_id")


@per_row("txt_classify_merge", "det", "event_id", {"category": "CASE WHEN k < 50 AND k >= 20 THEN 'fire' WHEN k % 2 = 0 AND k % 4 = 0 THEN 'general' WHEN k % 2 = 0 THEN 'status' ELSE 'general' END"})
def txt_classify_merge():
    """The headline's category unless that is general; then the body's, but what the body says of leaving never counts."""
    k = F.col("k")
    headline = F.when(k.between(20, 49), "fire").otherwise("general")
    body = F.when(k % 2 == 0, F.when(k % 4 == 0, "evacuation").otherwise("status")).otherwise("general")
    return {"category": F.when(headline != "general", headline).when(body.isin("evacuation", "readiness"), "general").otherwise(body)}


@query("agg_status_lattice", f"WITH {DETECTIONS_SQL}, s AS (SELECT satellite, acquired_s // 86400 AS day, count(*) AS n, count(*) FILTER (WHERE product = 'error') AS bad FROM det GROUP BY 1, 2) SELECT satellite, CAST(day AS BIGINT) AS day, CASE WHEN bad = 0 THEN 'ok' WHEN bad < n THEN 'partial' ELSE 'upstream-error' END AS status FROM s")
def agg_status_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = detections(spark, sf_dir).groupBy("satellite", F.floor(F.col("acquired_s") / 86400).alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("product") == "error").alias("bad"))
    return s.select("satellite", "day", states.first_of([(F.col("bad") == 0, "ok"), (F.col("bad") < F.col("n"), "partial")], "upstream-error").alias("status"))


@query("agg_totals", "SELECT event_type, CAST(count(*) AS BIGINT) AS items, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS total FROM events GROUP BY event_type")
def agg_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("items"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("total"))


@query("agg_status_hist", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
def agg_status_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("agg_array_keyed", f"WITH {REVISIONS_SQL} SELECT chain, string_agg(version, ',' ORDER BY shipped_s DESC, version DESC) AS cursors FROM rev GROUP BY chain")
def agg_array_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a chain, newest first: a chain has a few."""
    rows = F.sort_array(F.collect_list(F.struct("shipped_s", "version")), asc=False)
    return revisions(spark, sf_dir).groupBy("chain").agg(F.concat_ws(",", F.transform(rows, lambda r: r["version"].cast("string"))).alias("cursors"))


@query("agg_string", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat_ws("|", F.sort_array(F.collect_list("n_name"))).alias("names"))
