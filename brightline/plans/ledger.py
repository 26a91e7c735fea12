"""The append-only ledger: revision chains, bitemporal reads, gates, joins, rules and violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightline.functions.values import title_key
from brightline.operators.core import as_of, chain_violations, top_rows, without_newer
from brightline.plans.registry import query
from brightline.sources.tables import REVISIONS_SQL, epoch_seconds, revisions, table

# Cutoffs of the bitemporal reads, in epoch seconds.
CUT = 820454400  # 1996-01-01T00:00:00Z
LATER = 852076800  # 1997-01-01T00:00:00Z

ORDERS_SQL = "ord AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS effective_s FROM orders)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", epoch_seconds("o_orderdate").alias("effective_s"))


@query("join_anti_newer", f"""WITH {REVISIONS_SQL} SELECT chain, version, quantity FROM rev r WHERE l_returnflag <> 'R' AND NOT EXISTS (SELECT 1 FROM rev n WHERE n.chain = r.chain AND n.version > r.version AND n.l_returnflag <> 'R')""")
def join_anti_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest publishable revision of each chain."""
    return without_newer(revisions(spark, sf_dir), ["chain"], "version", F.col("l_returnflag") != "R").select("chain", "version", "quantity")


@query("join_latest_then_cutoff", f"""WITH {REVISIONS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY version DESC) AS rn FROM rev) SELECT chain, version, shipped_s FROM t WHERE rn = 1 AND shipped_s <= {CUT}""")
def join_latest_then_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest revision of each chain, if it is within the cutoff: a chain that moved on disappears."""
    latest = revisions(spark, sf_dir).groupBy("chain").agg(F.max(F.struct("version", "shipped_s")).alias("r"))
    return latest.select("chain", "r.version", "r.shipped_s").where(F.col("shipped_s") <= CUT)


@query("join_asof_bitemporal", f"""WITH {REVISIONS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY version DESC) AS rn FROM rev WHERE shipped_s <= {CUT}) SELECT chain, version, shipped_s FROM t WHERE rn = 1""")
def join_asof_bitemporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest revision of each chain that the cutoff lets see."""
    seen = revisions(spark, sf_dir).where(F.col("shipped_s") <= CUT).groupBy("chain").agg(F.max(F.struct("version", "shipped_s")).alias("r"))
    return seen.select("chain", "r.version", "r.shipped_s")


@query("join_no_successor", f"""WITH {REVISIONS_SQL} SELECT chain, version FROM rev r WHERE shipped_s <= {LATER} AND NOT EXISTS (SELECT 1 FROM rev n WHERE n.chain = r.chain AND n.version = r.version + 1 AND n.shipped_s <= {LATER})""")
def join_no_successor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions known by the cutoff whose successor isn't."""
    w = Window.partitionBy("chain").orderBy("version")
    r = revisions(spark, sf_dir).withColumn("next_s", F.lead("shipped_s").over(w))
    return r.where((F.col("shipped_s") <= LATER) & (F.col("next_s").isNull() | (F.col("next_s") > LATER))).select("chain", "version")


@query("join_asof_effective", f"""WITH {ORDERS_SQL}, {REVISIONS_SQL}, q AS (SELECT chain, version, h.o_custkey, shipped_s FROM rev JOIN orders h ON h.o_orderkey = chain WHERE version = 1),
  j AS (SELECT q.*, o.o_orderkey, row_number() OVER (PARTITION BY q.chain ORDER BY o.effective_s DESC NULLS LAST, o.o_orderkey DESC) AS rn FROM q LEFT JOIN ord o ON o.o_custkey = q.o_custkey AND o.effective_s <= q.shipped_s)
SELECT chain, o_custkey, coalesce(o_orderkey, 0) AS asof_o_orderkey FROM j WHERE rn = 1""")
def join_asof_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chain's first revision with the dimension row that was in effect: union and carry forward, one shuffle; 0 where none was."""
    holder = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain"), "o_custkey")
    first = revisions(spark, sf_dir).where("version = 1").join(holder, "chain").select("chain", "o_custkey", "shipped_s")
    return as_of(first, orders(spark, sf_dir), ["o_custkey"], "shipped_s", "effective_s", ["o_orderkey"], ["o_orderkey"]).select("chain", "o_custkey", F.coalesce("asof_o_orderkey", F.lit(0)).alias("asof_o_orderkey"))


@query("join_left_top1", f"""WITH {ORDERS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY effective_s DESC, o_orderkey DESC) AS rn FROM ord) SELECT c_custkey, o_orderkey AS latest_order FROM customer LEFT JOIN t ON o_custkey = c_custkey AND rn = 1""")
def join_left_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = orders(spark, sf_dir).groupBy("o_custkey").agg(F.max(F.struct("effective_s", "o_orderkey")).alias("o"))
    return table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o.o_orderkey").alias("latest_order"))


@query("join_dim", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


GATE_SQL = "EXISTS (SELECT 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = l_suppkey AND s_acctbal >= 0 AND n_name <> 'CHINA')"


@query("flt_gate", f"WITH {REVISIONS_SQL} SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM rev WHERE {GATE_SQL} GROUP BY l_suppkey")
def flt_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions whose source and provider are open: semi-joins, with the aggregate on the narrow side."""
    open_regions = table(spark, sf_dir, "nation").where("n_name <> 'CHINA'")
    gate = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").join(open_regions, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return sums.join(gate, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")


@query("join_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return table(spark, sf_dir, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("join_provenance", """SELECT r_name, n_name, c_mktsegment, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p_size > 10 GROUP BY ALL""")
def join_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star from item to region."""
    li, o, c, s, p, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "part", "nation", "region"))
    star = li.join(p.where("p_size > 10"), F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    star = star.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return star.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("join_interval", f"""WITH {ORDERS_SQL}, w AS (SELECT s_suppkey, {CUT} + s_suppkey * 86400 AS from_s, {CUT} + (s_suppkey + 3) * 86400 AS to_s FROM supplier) SELECT s_suppkey, o_orderkey FROM w JOIN ord ON effective_s BETWEEN from_s AND to_s""")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in windows: windows are dealt to the days they meet, so the range join is an equi-join on the day."""
    w = table(spark, sf_dir, "supplier").select("s_suppkey", (F.lit(CUT) + F.col("s_suppkey") * 86400).alias("from_s"), (F.lit(CUT) + (F.col("s_suppkey") + 3) * 86400).alias("to_s"))
    w = w.withColumn("day", F.explode(F.sequence(F.floor(F.col("from_s") / 86400), F.floor(F.col("to_s") / 86400))))
    o = orders(spark, sf_dir).withColumn("day", F.floor(F.col("effective_s") / 86400))
    return w.join(o, "day").where("effective_s BETWEEN from_s AND to_s").select("s_suppkey", "o_orderkey")


@query("join_nearest_time", f"""WITH {ORDERS_SQL}, q AS (SELECT c_custkey, {CUT} AS t FROM customer), j AS (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(effective_s - t), o_orderkey) AS rn FROM q JOIN ord ON o_custkey = c_custkey)
SELECT c_custkey, o_orderkey FROM j WHERE rn = 1""")
def join_nearest_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = orders(spark, sf_dir).groupBy("o_custkey").agg(F.min(F.struct(F.abs(F.col("effective_s") - CUT).alias("d"), "o_orderkey")).alias("b"))
    return near.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_custkey").alias("c_custkey"), "b.o_orderkey")


@query("val_chain", """WITH l AS (SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) // 1000000 AS s, l_partkey FROM lineitem), w AS (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, s, l_partkey) AS before FROM l)
SELECT CAST(count(*) AS BIGINT) AS violations, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS chains FROM w WHERE coalesce(before, 0) + 1 <> l_linenumber""")
def val_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks in the numbering of raw chains."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", epoch_seconds("l_shipdate").alias("s"))
    found = chain_violations(rows, "l_orderkey", "l_linenumber", "s").where("reason = 'version-gap'")
    return found.agg(F.count("*").alias("violations"), F.countDistinct("l_orderkey").alias("chains"))


@query("val_alternate", f"""WITH {REVISIONS_SQL}, w AS (SELECT *, lag(l_returnflag) OVER (PARTITION BY chain ORDER BY version) AS before FROM rev) SELECT chain, version FROM w WHERE before = l_returnflag""")
def val_alternate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive actions of a chain that do not differ."""
    w = Window.partitionBy("chain").orderBy("version")
    return revisions(spark, sf_dir).withColumn("before", F.lag("l_returnflag").over(w)).where("before = l_returnflag").select("chain", "version")


@query("val_ordering", f"""WITH {REVISIONS_SQL}, w AS (SELECT *, lag(shipped_s) OVER (PARTITION BY chain ORDER BY version) AS before FROM rev) SELECT CAST(count(*) FILTER (WHERE shipped_s < before) AS BIGINT) AS out_of_order, CAST(count(*) AS BIGINT) AS n FROM w""")
def val_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("chain").orderBy("version")
    return revisions(spark, sf_dir).withColumn("before", F.lag("shipped_s").over(w)).agg(F.count_if(F.col("shipped_s") < F.col("before")).alias("out_of_order"), F.count("*").alias("n"))


@query("val_accounting", """WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS declared FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(n AS BIGINT) AS n, declared FROM l WHERE n <> declared""")
def val_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains whose number of rows isn't what they declare."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("declared")).where("n <> declared")


@query("val_regex", """SELECT doc_id, regexp_matches(source, '^src[0-9]{1,2}$') AS slug_ok, regexp_matches(lang, '^[a-z]{2}(-[A-Z]{2})?$') AS lang_ok FROM documents""")
def val_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").rlike("^src[0-9]{1,2}$").alias("slug_ok"), F.col("lang").rlike("^[a-z]{2}(-[A-Z]{2})?$").alias("lang_ok"))


@query("val_reference_closure", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 45)")
def val_reference_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that the manifest doesn't hold."""
    manifest = table(spark, sf_dir, "part").where("p_size <= 45")
    return table(spark, sf_dir, "lineitem").join(manifest, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("win_latest", f"WITH {ORDERS_SQL} SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY effective_s DESC, o_orderkey) AS rn FROM ord WHERE effective_s <= {CUT}) WHERE rn = 1")
def win_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order at or before the cutoff; the first of those that tie."""
    return top_rows(orders(spark, sf_dir).where(F.col("effective_s") <= CUT), ["o_custkey"], [F.desc("effective_s"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("win_is_latest", f"WITH {REVISIONS_SQL} SELECT chain, version, version = max(version) OVER (PARTITION BY chain) AS is_latest FROM rev")
def win_is_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions(spark, sf_dir).select("chain", "version", (F.col("version") == F.max("version").over(Window.partitionBy("chain"))).alias("is_latest"))


@query("win_current_status", f"WITH {REVISIONS_SQL} SELECT chain, arg_max(l_linestatus, version) AS status FROM rev WHERE l_returnflag <> 'R' GROUP BY chain")
def win_current_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions(spark, sf_dir).where("l_returnflag <> 'R'").groupBy("chain").agg(F.max_by("l_linestatus", "version").alias("status"))


@query("win_first_value", f"WITH {ORDERS_SQL} SELECT o_orderkey, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY effective_s, o_orderkey) AS first_priority FROM ord")
def win_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = orders(spark, sf_dir).groupBy("o_custkey").agg(F.min(F.struct("effective_s", "o_orderkey", "o_orderpriority")).alias("f"))
    return orders(spark, sf_dir).join(first, "o_custkey").select("o_orderkey", F.col("f.o_orderpriority").alias("first_priority"))


@query("win_revision_decision", f"""WITH {REVISIONS_SQL}, w AS (SELECT *, lag(l_partkey) OVER (PARTITION BY chain ORDER BY version) AS p, lag(quantity) OVER (PARTITION BY chain ORDER BY version) AS q FROM rev)
SELECT chain, version, CASE WHEN p IS NULL THEN 'first' WHEN p <> l_partkey THEN 'rebaseline' WHEN q <> quantity THEN 'correction' ELSE 'identical' END AS decision FROM w""")
def win_revision_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("chain").orderBy("version")
    r = revisions(spark, sf_dir).withColumn("p", F.lag("l_partkey").over(w)).withColumn("q", F.lag("quantity").over(w))
    decision = F.when(F.col("p").isNull(), "first").when(F.col("p") != F.col("l_partkey"), "rebaseline").when(F.col("q") != F.col("quantity"), "correction").otherwise("identical")
    return r.select("chain", "version", decision.alias("decision"))


@query("win_lineage", f"""WITH {REVISIONS_SQL} SELECT chain, version, min(shipped_s) OVER w AS covered_from, max(shipped_s) OVER w AS covered_to, CAST(count(*) OVER w AS BIGINT) AS depth FROM rev WINDOW w AS (PARTITION BY chain ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def win_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage inherited along a chain: kept from, advanced to, depth."""
    w = Window.partitionBy("chain").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    return revisions(spark, sf_dir).select("chain", "version", F.min("shipped_s").over(w).alias("covered_from"), F.max("shipped_s").over(w).alias("covered_to"), F.count("*").over(w).alias("depth"))


@query("sink_upsert_revisions", f"WITH {ORDERS_SQL}, {REVISIONS_SQL} SELECT o_orderkey, CAST(coalesce((SELECT max(version) FROM rev WHERE chain = o_orderkey), 0) + 1 AS INTEGER) AS next_version FROM ord")
def sink_upsert_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that a new revision of each chain gets."""
    last = revisions(spark, sf_dir).groupBy("chain").agg(F.max("version").alias("v"))
    return orders(spark, sf_dir).join(last, F.col("o_orderkey") == F.col("chain"), "left").select("o_orderkey", (F.coalesce("v", F.lit(0)) + 1).cast("int").alias("next_version"))


@query("sink_conflict_check", """SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT sha256(l_partkey || '|' || l_suppkey)) > 1""")
def sink_conflict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that came again with other content."""
    content = F.sha2(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), 256)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.countDistinct(content).alias("d")).where("d > 1").drop("d")


@query("sink_content_addr", "SELECT doc_id, sha256(text) AS digest, 'sha256/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS path FROM documents")
def sink_content_addr(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", digest.alias("digest"), F.concat(F.lit("sha256/"), F.substring(digest, 1, 2), F.lit("/"), digest).alias("path"))


@query("st_claim_queue", f"""WITH {ORDERS_SQL} SELECT o_orderkey FROM ord WHERE o_orderstatus = 'O' AND effective_s <= {LATER} ORDER BY o_orderpriority, effective_s, o_orderkey LIMIT 1""")
def st_claim_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next job due: a top-1, so no sort of the whole queue."""
    return orders(spark, sf_dir).where((F.col("o_orderstatus") == "O") & (F.col("effective_s") <= LATER)).orderBy("o_orderpriority", "effective_s", "o_orderkey").limit(1).select("o_orderkey")


@query("agg_array_ordered", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")
def agg_array_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("agg_pixel_classes", """SELECT l_partkey % 10 AS mask_class, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE (l_orderkey % 256) & 127 <> 0) AS BIGINT) AS not_nominal, CAST(count(*) FILTER (WHERE (l_orderkey % 256) & 7 = 7) AS BIGINT) AS bad_geolocation FROM lineitem GROUP BY 1""")
def agg_pixel_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.col("l_orderkey") % 256
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 10).alias("mask_class")).agg(
        F.count("*").alias("n"), F.count_if(word.bitwiseAND(F.lit(127)) != 0).alias("not_nominal"), F.count_if(word.bitwiseAND(F.lit(7)) == 7).alias("bad_geolocation"),
    )


@query("agg_health_rollup", """WITH h AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id) SELECT CASE WHEN last = 'error' THEN 'failed' ELSE 'online' END AS state, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY 1""")
def agg_health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.groupBy(F.when(F.col("last") == "error", "failed").otherwise("online").alias("state")).agg(F.count("*").alias("n"))


@query("json_get", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_type(props) = 'OBJECT' AS is_object FROM events")
def json_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"), F.col("props").startswith("{").alias("is_object"))


@query("hash_sha256", "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def hash_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("rule_publication_current", f"""WITH {REVISIONS_SQL} SELECT chain, arg_max(l_returnflag, version) = 'N' AS is_current FROM rev WHERE shipped_s <= {LATER} GROUP BY chain""")
def rule_publication_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the last action known by the cutoff is a publication."""
    return revisions(spark, sf_dir).where(F.col("shipped_s") <= LATER).groupBy("chain").agg((F.max_by("l_returnflag", "version") == "N").alias("is_current"))


@query("incidents_view", f"""WITH {ORDERS_SQL}, l AS (SELECT o_custkey, max(effective_s) AS last_s, CAST(count(*) AS BIGINT) AS n FROM ord GROUP BY 1) SELECT c_custkey, c_name, n_name, last_s, coalesce(n, 0) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN l ON o_custkey = c_custkey""")
def incidents_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = orders(spark, sf_dir).groupBy("o_custkey").agg(F.max("effective_s").alias("last_s"), F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "n_name", "last_s", F.coalesce("n", F.lit(0)).alias("n"))


@query("source_catalog", "SELECT s_suppkey, s_name, n_name, s_acctbal >= 0 AS enabled FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", "s_name", "n_name", (F.col("s_acctbal") >= 0).alias("enabled"))


@query("source_health_latest", "WITH h AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'error' GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, CAST(epoch_us(t) // 1000000 AS BIGINT) AS last_failure_s FROM u LEFT JOIN h USING (user_id)")
def source_health_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last failure of every source, null where there is none."""
    failed = F.when(F.col("event_type") == "error", epoch_seconds("ts"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(failed).alias("last_failure_s"))


@query("str_plain_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS plain FROM pages""")
def str_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightline.functions.values import plain_text

    return table(spark, sf_dir, "pages").select("page_id", plain_text(F.col("html")).alias("plain"))


@query("str_tag_extract", r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\s+href')) AS INTEGER) AS n_links FROM pages""")
def str_tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit(r"(?i)<a\s+href")).alias("n_links"))


@query("flt_url", r"SELECT page_id, regexp_matches(url, '(?i)^https?://[^/\s]+') AS safe, lower(regexp_extract(url, '(?i)^https?://([^/?#]+)', 1)) AS host FROM pages")
def flt_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").rlike(r"(?i)^https?://[^/\s]+").alias("safe"), F.lower(F.regexp_extract("url", r"(?i)^https?://([^/?#]+)", 1)).alias("host"))


@query("txt_relevance", r"SELECT doc_id, source FROM documents WHERE regexp_matches(lower(text), '\b(the|and|of)\b') AND regexp_matches(lower(text), '\b(license|licensed|token)\b')")
def txt_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, sf_dir, "documents").where(low.rlike(r"\b(the|and|of)\b") & low.rlike(r"\b(license|licensed|token)\b")).select("doc_id", "source")


@query("txt_classify", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') THEN 'notice' WHEN regexp_matches(text, '\+1 \(\d{3}\) \d{3}-\d{4}') THEN 'contact' WHEN regexp_matches(text, '(?i)token = ') THEN 'credential' ELSE 'other' END AS category FROM documents""")
def txt_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pattern rules."""
    t = F.col("text")
    category = F.when(t.rlike("(?i)license"), "notice").when(t.rlike(r"\+1 \(\d{3}\) \d{3}-\d{4}"), "contact").when(t.rlike("(?i)token = "), "credential").otherwise("other")
    return table(spark, sf_dir, "documents").select("doc_id", category.alias("category"))


FOLDED_SQL = r"trim(regexp_replace(lower(strip_accents(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))), '[^a-z0-9α-ω]+', ' ', 'g'))"


@query("set_dedupe_two_key", f"""WITH d AS (SELECT page_id, url, {FOLDED_SQL} AS title FROM pages), u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS ru FROM d),
  t AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN length(title) > 24 THEN title ELSE 'page ' || page_id END ORDER BY page_id) AS rt FROM u WHERE ru = 1) SELECT page_id, url, title FROM t WHERE rt = 1""")
def set_dedupe_two_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each URL, then of each folded title; a title of 24 characters or fewer says nothing."""
    title = title_key(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    one = table(spark, sf_dir, "pages").select("page_id", "url", title.alias("title")).groupBy("url").agg(F.min(F.struct("page_id", "title")).alias("p"))
    d = one.select("p.page_id", "url", "p.title")
    telling = F.when(F.length("title") > 24, F.col("title")).otherwise(F.concat(F.lit("page "), F.col("page_id").cast("string")))
    return d.groupBy(telling.alias("__title")).agg(F.min(F.struct("page_id", "url", "title")).alias("p")).select("p.*")
