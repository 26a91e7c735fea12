"""Named reads: pages, incidents, passes, digests, merges; and the orders, limits and queues that they are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightline.functions import geo, values
from brightline.operators.core import gap_sessions, dedupe_first, keyset_page, top_rows
from brightline.plans.geometry import X_SQL, Y_SQL, cell_y
from brightline.plans.ledger import CUT, LATER, ORDERS_SQL, orders
from brightline.plans.registry import per_row, query
from brightline.plans.thermal import CODE_SQL, SESSIONS, code, sessions
from brightline.sources.tables import DELIVERIES_SQL, DETECTIONS_SQL, REVISIONS_SQL, deliveries, detections, epoch_seconds, revisions, table

AS_OF = 1705708800  # 2024-01-20T00:00:00Z
DAY, WEEK = 86400, 604800
KNOWN_SQL = "greatest(acquired_s, retrieved_s, recorded_s)"
PAGE = 50


def known_at():
    return F.greatest("acquired_s", "retrieved_s", "recorded_s")


@query("thermal_anomalies_page", f"""WITH {DETECTIONS_SQL}, s AS (SELECT event_id, {KNOWN_SQL} AS known_s, frp FROM det WHERE {X_SQL} BETWEEN 10 AND 90 AND {Y_SQL} BETWEEN 20 AND 100 AND acquired_s > {AS_OF - WEEK} AND acquired_s <= {AS_OF} AND {KNOWN_SQL} <= {AS_OF} AND product <> 'error'),
  b AS (SELECT *, row_number() OVER (ORDER BY known_s DESC, event_id DESC) AS pos FROM s) SELECT event_id, known_s, frp, (SELECT count(*) FROM b) > {PAGE} AS has_more FROM b WHERE pos <= {PAGE}""")
def thermal_anomalies_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of detections of some cells and a week that the cutoff lets see, through an open gate, newest known first."""
    west, east = 10 / 128 * 360.0 - 180, 91 / 128 * 360.0 - 180
    d = detections(spark, sf_dir, AS_OF - WEEK, AS_OF).where((F.col("glon") >= west) & (F.col("glon") < east) & cell_y().between(20, 100))
    d = d.where((F.col("acquired_s") > AS_OF - WEEK) & (F.col("acquired_s") <= AS_OF) & (F.col("product") != "error"))
    d = d.withColumn("known_s", known_at()).where(F.col("known_s") <= AS_OF).select("event_id", "known_s", "frp")
    return keyset_page(d, [("known_s", True), ("event_id", True)], None, PAGE)


@query("thermal_anomalies_legacy", f"""WITH {DELIVERIES_SQL}, n AS (SELECT *, lead(delivery) OVER (PARTITION BY event_id ORDER BY delivery) AS later FROM deliv WHERE acquired_s > {AS_OF - WEEK} AND acquired_s <= {AS_OF}),
  b AS (SELECT event_id, delivery, row_number() OVER (ORDER BY acquired_s DESC, event_id DESC) AS pos FROM n WHERE later IS NULL) SELECT event_id, delivery, (SELECT count(*) FROM b) > {PAGE} AS has_more FROM b WHERE pos <= {PAGE}""")
def thermal_anomalies_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older page: the delivery of each detection that no later one replaces."""
    d = deliveries(spark, sf_dir).where((F.col("acquired_s") > AS_OF - WEEK) & (F.col("acquired_s") <= AS_OF))
    last = d.groupBy("event_id").agg(F.max("delivery").alias("delivery"), F.first("acquired_s").alias("acquired_s"))
    return keyset_page(last, [("acquired_s", True), ("event_id", True)], None, PAGE).select("event_id", "delivery", "has_more")


CANDIDATES_SQL = f"c AS (SELECT CAST({X_SQL} AS BIGINT) AS x, CAST({Y_SQL} AS BIGINT) AS y, CAST(count(*) AS BIGINT) AS n, max({KNOWN_SQL}) AS known_s FROM det WHERE {KNOWN_SQL} <= {AS_OF} GROUP BY 1, 2)"


def candidate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumn("known_s", known_at()).where(F.col("known_s") <= AS_OF)
    return d.groupBy(geo.tile_x(F.col("glon"), 7).alias("x"), cell_y().alias("y")).agg(F.count("*").alias("n"), F.max("known_s").alias("known_s"))


@query("explore_cells_page", f"WITH {DETECTIONS_SQL}, {CANDIDATES_SQL}, b AS (SELECT *, row_number() OVER (ORDER BY known_s DESC, x DESC, y DESC) AS pos FROM c) SELECT x, y, n, known_s, (SELECT count(*) FROM b) > {PAGE} AS has_more FROM b WHERE pos <= {PAGE}")
def explore_cells_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyset_page(candidate_cells(spark, sf_dir), [("known_s", True), ("x", True), ("y", True)], None, PAGE)


@query("ord_keyset_sentinel", f"WITH {DETECTIONS_SQL}, {CANDIDATES_SQL}, b AS (SELECT *, row_number() OVER (ORDER BY known_s DESC, x DESC, y DESC) AS pos FROM c) SELECT CAST(NULL AS BIGINT) AS x, CAST(NULL AS BIGINT) AS y, CAST(count(*) AS BIGINT) AS n FROM c UNION ALL SELECT x, y, n FROM b WHERE pos <= {PAGE}")
def ord_keyset_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page led by a row of its own that says how much there is, so that an empty page differs from none."""
    c = candidate_cells(spark, sf_dir)
    about = c.agg(F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("y"), F.count("*").alias("n"))
    return about.unionByName(keyset_page(c, [("known_s", True), ("x", True), ("y", True)], None, PAGE).select("x", "y", "n"))


@query("ord_nulls_first", f"WITH {DETECTIONS_SQL}, r AS (SELECT event_id, CASE WHEN k >= 5 THEN acquired_s END AS at_s FROM det) SELECT event_id, at_s FROM r ORDER BY at_s DESC NULLS FIRST, event_id LIMIT 500")
def ord_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hundred rows, newest first, those without a time before all: a top-k."""
    r = detections(spark, sf_dir).select("event_id", F.when(F.col("k") >= 5, F.col("acquired_s")).alias("at_s"))
    return r.orderBy(F.col("at_s").desc_nulls_first(), "event_id").limit(500)


@query("ord_desc", f"WITH {DETECTIONS_SQL} SELECT event_id, acquired_s FROM det ORDER BY acquired_s DESC, event_id")
def ord_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first; the key makes the order whole, as a sort over partitions isn't stable."""
    return detections(spark, sf_dir).select("event_id", "acquired_s").orderBy(F.col("acquired_s").desc(), "event_id")


@query("ord_multi", f"WITH {DETECTIONS_SQL} SELECT product, satellite, acquired_s, event_id FROM det ORDER BY product, satellite, acquired_s, event_id")
def ord_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("product", "satellite", "acquired_s", "event_id").orderBy("product", "satellite", "acquired_s", "event_id")


@query("ord_tier", f"WITH {DETECTIONS_SQL} SELECT event_id, acquired_s, CASE product WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS tier FROM det ORDER BY acquired_s DESC, tier, event_id LIMIT 200")
def ord_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two hundred newest, official ones first at equal times."""
    tier = F.when(F.col("product") == "purchase", 0).when(F.col("product") == "view", 1).otherwise(2)
    return detections(spark, sf_dir).select("event_id", "acquired_s", tier.alias("tier")).orderBy(F.col("acquired_s").desc(), "tier", "event_id").limit(200)


@query("ord_truncated", f"WITH {DETECTIONS_SQL}, g AS (SELECT satellite, product, least(count(*), 101) AS n FROM det WHERE acquired_s <= {AS_OF} GROUP BY 1, 2) SELECT satellite, product, CAST(least(n, 100) AS BIGINT) AS shown, n > 100 AS truncated, CASE WHEN n > 100 THEN 'at-least' ELSE 'exact' END AS relation FROM g")
def ord_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each source a page shows, and whether that is all."""
    g = detections(spark, sf_dir).where(F.col("acquired_s") <= AS_OF).groupBy("satellite", "product").agg(F.count("*").alias("n"))
    more = F.col("n") > 100
    return g.select("satellite", "product", F.least("n", F.lit(100)).alias("shown"), more.alias("truncated"), F.when(more, "at-least").otherwise("exact").alias("relation"))


@query("ord_bounded_scan", f"WITH {DETECTIONS_SQL}, s AS (SELECT event_id, k, row_number() OVER (ORDER BY acquired_s DESC, event_id DESC) AS pos FROM det), b AS (SELECT * FROM s WHERE pos <= 800), h AS (SELECT event_id, row_number() OVER (ORDER BY pos) AS place FROM b WHERE k > 90) SELECT event_id, (SELECT count(*) FROM b) = 800 AND (SELECT count(*) FROM h) < {PAGE} AS unproved FROM h WHERE place <= {PAGE}")
def ord_bounded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page from a scan of sixteen times its size: unproved if the scan's bound was met before the page was full."""
    newest = [F.col("acquired_s").desc(), F.col("event_id").desc()]
    scan = detections(spark, sf_dir).select("event_id", "acquired_s", "k").orderBy(*newest).limit(16 * PAGE)  # bounded, so the windows see that many rows
    everything = Window.partitionBy(F.lit(0))
    scan = scan.withColumn("seen", F.count("*").over(everything)).withColumn("hits", F.count_if(F.col("k") > 90).over(everything)).where("k > 90")
    page = scan.orderBy(*newest).limit(PAGE)
    return page.select("event_id", ((F.col("seen") == 16 * PAGE) & (F.col("hits") < PAGE)).alias("unproved"))


@query("ord_snapshot_guard", "SELECT r.r_name, sha256(string_agg(n_name, '|' ORDER BY n_name)) <> sha256(string_agg(n_name, '|' ORDER BY n_name DESC)) AS restart FROM nation JOIN region r ON n_regionkey = r_regionkey GROUP BY r.r_name")
def ord_snapshot_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a snapshot's digest is another than the one a reader began with."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = F.sort_array(F.collect_list("n_name"))
    digest = lambda a: F.sha2(F.concat_ws("|", a), 256)
    return n.groupBy("r_name").agg((digest(names) != digest(F.reverse(names))).alias("restart"))


@query("join_ordinality", "WITH ids AS (SELECT r_regionkey, unnest([r_regionkey + 10, r_regionkey, r_regionkey + 5]) AS id, unnest([0, 1, 2]) AS pos FROM region) SELECT r_regionkey, pos, n_name FROM ids JOIN nation ON n_nationkey = id")
def join_ordinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of ids against a table, with the place in the list."""
    k = F.col("r_regionkey")
    ids = table(spark, sf_dir, "region").select("r_regionkey", F.posexplode(F.array(k + 10, k, k + 5)).alias("pos", "id"))
    return ids.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("id")).select("r_regionkey", "pos", "n_name")


@query("join_lookup_strict", "SELECT s_suppkey, n_name, n_name IS NULL AS missing FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 3")
def join_lookup_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup that tells of the rows it has nothing for."""
    n = table(spark, sf_dir, "nation").where("n_regionkey <> 3")
    return table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", F.col("n_name").isNull().alias("missing"))


@query("agg_pass_summary", f"WITH {SESSIONS} SELECT product, satellite, session_start, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE km <= 8.0) AS BIGINT) AS n_incident, arg_min(event_id, (acquired_s, event_id)) AS first_event, max(frp) AS max_frp FROM sess GROUP BY ALL")
def agg_pass_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pass with its counts and the first detection's attributes."""
    first = F.min_by("event_id", F.struct("acquired_s", "event_id"))
    return sessions(spark, sf_dir).groupBy("product", "satellite", "session_start").agg(
        F.count("*").alias("n"), F.count_if(F.col("km") <= 8.0).alias("n_incident"), first.alias("first_event"), F.max("frp").alias("max_frp")
    )


@query("prj_detection", f"WITH {SESSIONS} SELECT event_id, product || '::' || satellite || '::' || session_start AS pass_id, ({AS_OF} - acquired_s) // 60 AS age_minutes, floor(km * 10 + 0.5) / 10 AS km, code, CASE WHEN km <= 8.0 THEN 'incident' ELSE 'regional' END AS scope FROM sess")
def prj_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection as it is shown: its pass, age, rounded distance, confidence and scope."""
    age = F.floor((F.lit(AS_OF) - F.col("acquired_s")) / 60)
    pass_id = F.concat_ws("::", "product", "satellite", F.col("session_start").cast("string"))
    return sessions(spark, sf_dir).select("event_id", pass_id.alias("pass_id"), age.alias("age_minutes"), values.js_round(F.col("km"), 1).alias("km"), "code", F.when(F.col("km") <= 8.0, "incident").otherwise("regional").alias("scope"))


@per_row("prj_candidate", "det", "event_id", {"cell": f"CAST({X_SQL} AS BIGINT) || '/' || CAST({Y_SQL} AS BIGINT)", "known_s": KNOWN_SQL, "code": CODE_SQL})
def prj_candidate():
    """What of a detection is public: its cell, not its place."""
    return {"cell": F.concat_ws("/", geo.tile_x(F.col("glon"), 7).cast("string"), cell_y().cast("string")), "known_s": known_at(), "code": code()}


MERGED = DELIVERIES_SQL + f""", m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY delivery DESC) AS rn FROM deliv) WHERE rn = 1),
  l AS (SELECT *, lag(acquired_s) OVER (PARTITION BY product, satellite ORDER BY acquired_s, event_id) AS before FROM m)
SELECT product, satellite, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE before IS NULL OR acquired_s - before > 600) AS BIGINT) AS passes, CAST(count(*) FILTER (WHERE delivery = 1) AS BIGINT) AS replaced FROM l GROUP BY 1, 2"""


@query("src_merge_days", "WITH " + MERGED)
def src_merge_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries merged, the last of each detection, clustered and summed anew."""
    last = dedupe_first(deliveries(spark, sf_dir), ["event_id"], [F.col("delivery").desc()])
    last = gap_sessions(last, ["product", "satellite"], "acquired_s", 600, ["event_id"])
    return last.groupBy("product", "satellite").agg(F.count("*").alias("n"), F.countDistinct("session_start").alias("passes"), F.count_if(F.col("delivery") == 1).alias("replaced"))


@query("set_replace", f"WITH {DETECTIONS_SQL}, live AS (SELECT product, max(event_id) AS event_id FROM det GROUP BY product) SELECT event_id, 0 AS place FROM live UNION ALL SELECT event_id, 1 FROM det WHERE event_id NOT IN (SELECT event_id FROM live)")
def set_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live item of each product in front, the others behind it, itself no longer among them."""
    d = detections(spark, sf_dir)
    live = d.groupBy("product").agg(F.max("event_id").alias("event_id")).select("event_id")
    return live.withColumn("place", F.lit(0)).unionByName(d.select("event_id").join(live, "event_id", "left_anti").withColumn("place", F.lit(1)))


@query("nearby_incidents", f"""WITH {ORDERS_SQL}, c AS (SELECT o_custkey, o_orderkey, effective_s, row_number() OVER (PARTITION BY o_custkey ORDER BY effective_s DESC, o_orderkey DESC) AS rn FROM ord WHERE effective_s <= {LATER}),
  p AS (SELECT c.o_custkey, c.o_orderkey, effective_s, c_nationkey FROM c JOIN customer ON c_custkey = o_custkey WHERE rn = 1 AND effective_s > {CUT} AND c_acctbal > 0)
SELECT o_custkey, o_orderkey, effective_s, first_value(o_orderkey) OVER (PARTITION BY c_nationkey ORDER BY effective_s DESC, o_orderkey) AS nearest FROM p""")
def nearby_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each incident that the cutoff lets see, if it is current and public, with its area's newest one."""
    latest = orders(spark, sf_dir).where(F.col("effective_s") <= LATER).groupBy("o_custkey").agg(F.max(F.struct("effective_s", "o_orderkey")).alias("o"))
    latest = latest.select("o_custkey", "o.o_orderkey", "o.effective_s").where(F.col("effective_s") > CUT)
    p = latest.join(table(spark, sf_dir, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"))
    area = p.groupBy("c_nationkey").agg(F.min_by("o_orderkey", F.struct((-F.col("effective_s")).alias("t"), "o_orderkey")).alias("nearest"))
    return p.join(area, "c_nationkey").select("o_custkey", "o_orderkey", "effective_s", "nearest")


PASSES_SQL = "ps AS (SELECT chain, max(version) AS version, arg_max(shipped_s, version) AS start_s FROM rev WHERE l_returnflag <> 'R' GROUP BY chain)"


def latest_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = revisions(spark, sf_dir).where("l_returnflag <> 'R'").groupBy("chain").agg(F.max(F.struct("version", "shipped_s")).alias("r"))
    return seen.select("chain", "r.version", F.col("r.shipped_s").alias("start_s"))


@query("passes_latest", f"WITH {REVISIONS_SQL}, {PASSES_SQL} SELECT chain, version, start_s FROM ps")
def passes_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_passes(spark, sf_dir)


@query("passes_for_cell", f"WITH {REVISIONS_SQL}, {PASSES_SQL}, {ORDERS_SQL} SELECT chain, version, n_name FROM ps JOIN ord ON o_orderkey = chain JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE start_s <= {LATER} AND start_s + 36 * 3600 >= {CUT}")
def passes_for_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest passes whose 36 hours meet the window, with the area that they go over."""
    p = latest_passes(spark, sf_dir).where((F.col("start_s") <= LATER) & (F.col("start_s") + 36 * 3600 >= CUT))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return p.join(o, F.col("chain") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("chain", "version", "n_name")


@query("scan_status", f"""WITH {DETECTIONS_SQL}, h AS (SELECT satellite, product, max(acquired_s) AS done_s, max(acquired_s) FILTER (WHERE k > 90) AS failed_s FROM det WHERE {KNOWN_SQL} <= {AS_OF} GROUP BY 1, 2)
SELECT satellite, product, done_s, failed_s, CASE WHEN done_s + 10800 >= {AS_OF} THEN 'complete_current' ELSE 'complete_stale' END AS state FROM h""")
def scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest completion and latest failure of each scan, in one pass, with its state."""
    h = detections(spark, sf_dir).where(known_at() <= AS_OF).groupBy("satellite", "product").agg(F.max("acquired_s").alias("done_s"), F.max(F.when(F.col("k") > 90, F.col("acquired_s"))).alias("failed_s"))
    return h.withColumn("state", F.when(F.col("done_s") + 10800 >= AS_OF, "complete_current").otherwise("complete_stale"))


@query("incident_observations", f"WITH {REVISIONS_SQL} SELECT o_custkey, chain, version, n_name FROM rev JOIN orders ON o_orderkey = chain JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_returnflag <> 'R' AND s_acctbal >= 0 AND shipped_s <= {LATER}")
def incident_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = revisions(spark, sf_dir).where((F.col("l_returnflag") != "R") & (F.col("shipped_s") <= LATER))
    s = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return r.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("chain") == F.col("o_orderkey")).select("o_custkey", "chain", "version", "n_name")


@query("incident_timeline", f"WITH {REVISIONS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY shipped_s DESC, version DESC) AS rn FROM rev WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = chain AND o_orderstatus <> 'P')) SELECT chain, version, shipped_s FROM t WHERE rn <= 3")
def incident_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest entries of each incident that is published."""
    published = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    r = revisions(spark, sf_dir).join(published, F.col("chain") == F.col("o_orderkey"), "left_semi")
    return top_rows(r, ["chain"], [F.col("shipped_s").desc(), F.col("version").desc()], 3).select("chain", "version", "shipped_s")


@query("incident_truth", f"WITH {ORDERS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY effective_s DESC, o_orderkey DESC) AS rn FROM ord WHERE effective_s <= {LATER}) SELECT o_custkey, o_orderkey, o_orderstatus FROM t WHERE rn = 1 AND o_orderstatus <> 'P'")
def incident_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest snapshot of each incident, if that one is published."""
    seen = orders(spark, sf_dir).where(F.col("effective_s") <= LATER).groupBy("o_custkey").agg(F.max(F.struct("effective_s", "o_orderkey", "o_orderstatus")).alias("o"))
    return seen.select("o_custkey", "o.o_orderkey", "o.o_orderstatus").where("o_orderstatus <> 'P'")


@query("incident_changes", f"WITH {REVISIONS_SQL}, w AS (SELECT *, lag(quantity) OVER (PARTITION BY chain ORDER BY version) AS before FROM rev) SELECT chain, version, quantity - before AS change FROM w WHERE before IS NOT NULL AND abs(quantity - before) >= 10 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = chain AND o_orderstatus <> 'P')")
def incident_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    r = revisions(spark, sf_dir).withColumn("before", F.lag("quantity").over(Window.partitionBy("chain").orderBy("version")))
    r = r.where(F.abs(F.col("quantity") - F.col("before")) >= 10)
    return r.join(published, F.col("chain") == F.col("o_orderkey"), "left_semi").select("chain", "version", (F.col("quantity") - F.col("before")).alias("change"))


@query("updates_digest", r"""WITH t AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, trim(regexp_replace(lower(strip_accents(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))), '[^a-z0-9α-ω]+', ' ', 'g')) AS title FROM pages),
  h AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id DESC) AS rn FROM t), u AS (SELECT min(page_id) AS page_id, title FROM h WHERE rn <= 3 GROUP BY title) SELECT page_id, title FROM u ORDER BY page_id DESC LIMIT 25""")
def updates_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 newest items: three of each host at most, the first of each folded title."""
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    t = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), values.title_key(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))
    few = top_rows(t, ["host"], [F.col("page_id").desc()], 3)
    return few.groupBy("title").agg(F.min("page_id").alias("page_id")).orderBy(F.col("page_id").desc()).limit(25).select("page_id", "title")


@query("wind_summary", "SELECT user_id, arg_max(CAST(json_extract(props, '$.k') AS INTEGER), (ts, event_id)) AS speed, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors FROM events GROUP BY user_id")
def wind_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest report of each station, and its errors."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("user_id").agg(F.max_by("k", F.struct("ts", "event_id")).alias("speed"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("src_metar_latest", "SELECT user_id, CAST(epoch_us(max(ts)) // 1000000 AS BIGINT) AS at_s, arg_max(CAST(json_extract(props, '$.k') AS INTEGER), (ts, event_id)) + 980 AS qnh FROM events GROUP BY user_id")
def src_metar_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest report of each station; the pressure is read from its text where no field has it."""
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.concat(F.lit("LGMT 010150Z VRB03KT Q"), (k + 980).cast("string"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", epoch_seconds("ts").alias("at_s"), "ts", F.regexp_extract(text, r"Q(\d{3,4})", 1).cast("int").alias("qnh"))
    return e.groupBy("user_id").agg(F.max("at_s").alias("at_s"), F.max_by("qnh", F.struct("ts", "event_id")).alias("qnh"))


@query("source_shadow_page", f"WITH h AS (SELECT user_id, max(ts) AS t FROM events GROUP BY 1), b AS (SELECT user_id, t, row_number() OVER (ORDER BY user_id) AS pos FROM h) SELECT user_id, CAST(epoch_us(t) // 1000000 AS BIGINT) AS latest_s, (SELECT count(*) FROM b) > {PAGE} AS has_more FROM b WHERE pos <= {PAGE}")
def source_shadow_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(epoch_seconds("ts")).alias("latest_s"))
    return keyset_page(h, [("user_id", False)], None, PAGE)


@query("st_watermark_plan", f"WITH {DETECTIONS_SQL}, s AS (SELECT DISTINCT acquired_s - acquired_s % 900 AS slot_s FROM det), w AS (SELECT slot_s, slot_s - 600 AS to_s, lag(slot_s - 600) OVER (ORDER BY slot_s) AS since_s FROM s) SELECT slot_s, since_s, to_s FROM w")
def st_watermark_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run asks for: from where the run before ended to ten minutes before its own slot."""
    slots = detections(spark, sf_dir).select((F.col("acquired_s") - F.col("acquired_s") % 900).alias("slot_s")).distinct()
    # The run before is at most a day earlier or there is none near: slots are paired within a day and the next, not in one window over all.
    day = F.floor(F.col("slot_s") / DAY)
    within = slots.withColumn("day", day).withColumn("before", F.lag("slot_s").over(Window.partitionBy("day").orderBy("slot_s")))
    last = within.groupBy("day").agg(F.max("slot_s").alias("last_s"))
    ends = last.withColumn("before_s", F.lag("last_s").over(Window.orderBy("day"))).select("day", "before_s")  # one row a day
    out = within.join(ends, "day").withColumn("since", F.coalesce("before", "before_s"))
    return out.select("slot_s", (F.col("since") - 600).alias("since_s"), (F.col("slot_s") - 600).alias("to_s"))


@query("st_sliding", f"WITH {DETECTIONS_SQL} SELECT product, w AS window_s, CAST(count(*) AS BIGINT) AS n FROM (SELECT product, unnest(range(acquired_s - acquired_s % 21600 - 64800, acquired_s - acquired_s % 21600 + 1, 21600)) AS w FROM det) GROUP BY product, w")
def st_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over windows of a day that begin every six hours."""
    w = F.window(F.timestamp_seconds("acquired_s"), "24 hours", "6 hours")
    return detections(spark, sf_dir).groupBy("product", w.alias("w")).agg(F.count("*").alias("n")).select("product", F.unix_seconds("w.start").alias("window_s"), "n")


@query("st_session", f"""WITH {DETECTIONS_SQL}, l AS (SELECT product, satellite, acquired_s, CASE WHEN acquired_s - lag(acquired_s) OVER w <= 600 THEN 0 ELSE 1 END AS new FROM det WINDOW w AS (PARTITION BY product, satellite ORDER BY acquired_s, event_id)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY product, satellite ORDER BY acquired_s ROWS UNBOUNDED PRECEDING) AS id FROM l) SELECT product, satellite, min(acquired_s) AS start_s, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY product, satellite, id""")
def st_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap sessions by Spark's own session window, the form that also runs as a stream."""
    w = F.session_window(F.timestamp_seconds("acquired_s"), "600 seconds")
    return detections(spark, sf_dir).groupBy("product", "satellite", w.alias("w")).agg(F.count("*").alias("n")).select("product", "satellite", F.unix_seconds("w.start").alias("start_s"), "n")


@query("st_fixed_window", "SELECT user_id, CAST(epoch_us(ts) // 60000000 AS BIGINT) AS minute, count(*) > 1 AS limited FROM events GROUP BY 1, 2")
def st_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients that ask more than once within a minute of the clock."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.floor(epoch_seconds("ts") / 60).alias("minute")).agg((F.count("*") > 1).alias("limited"))


@query("st_cancel", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND o_orderstatus = 'P' THEN 'dead' ELSE o_orderstatus END AS status FROM orders")
def st_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that wait for a thing that was retracted become dead."""
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("gone", F.lit(True))
    o = table(spark, sf_dir, "orders").join(gone, "o_orderkey", "left")
    return o.select("o_orderkey", F.when(F.col("gone") & (F.col("o_orderstatus") == "P"), "dead").otherwise(F.col("o_orderstatus")).alias("status"))
