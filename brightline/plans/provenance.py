"""What may be published: events followed through all that they rest on, each part with its own clock and nothing newer known; and what of it is current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightline.plans.registry import query
from brightline.sources.tables import epoch_seconds, table

# Clocks of the reads: when the action was taken, and until when what is known counts.
ACTION, KNOWN = 880000000, 900000000
DAY = 86400

#: Events are line items: one per line, its chain the order; what it asserts about a part is a chain per part and supplier, and its source revision the
#: order among the orders of its customer. Suppliers are sources, nations providers, regions endpoints, customers collection targets.
EVIDENCE_SQL = f"""line AS (SELECT l_orderkey AS chain, l_linenumber AS number, l_partkey, l_suppkey, l_returnflag, l_linestatus, epoch_us(l_shipdate) // 1000000 AS recorded_s, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem),
  event AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY number, recorded_s, l_partkey, l_suppkey) AS version, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY recorded_s, chain, number) AS assertion FROM line),
  source_revision AS (SELECT o_orderkey AS chain, o_custkey AS target, epoch_us(o_orderdate) // 1000000 AS retrieved_s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place, o_orderpriority FROM orders),
  publishable AS (SELECT e.chain, e.version, e.number, e.l_partkey, e.l_suppkey, e.l_returnflag, e.recorded_s, e.quantity, n_nationkey, r_name FROM event e JOIN source_revision sr ON sr.chain = e.chain
    JOIN customer ON c_custkey = sr.target JOIN supplier ON s_suppkey = e.l_suppkey JOIN part ON p_partkey = e.l_partkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
    WHERE e.l_returnflag <> 'R' AND e.recorded_s <= {ACTION} AND sr.retrieved_s <= {ACTION} AND sr.o_orderpriority <> '5-LOW' AND c_acctbal > -500 AND s_acctbal > -500 AND n_name <> 'CHINA' AND p_size > 2
      AND (e.number % 2 = 1 OR e.recorded_s + e.quantity * {100 * DAY} > {KNOWN}) AND (e.number % 3 = 0 OR (e.number % 3 = 1 AND e.recorded_s + {30 * DAY} <= {ACTION}) OR (e.number % 3 = 2 AND (e.recorded_s + {30 * DAY}) // {DAY} <= {ACTION} // {DAY}))
      AND NOT EXISTS (SELECT 1 FROM source_revision next WHERE next.target = sr.target AND next.place = sr.place + 6 AND next.retrieved_s <= {KNOWN})
      AND NOT EXISTS (SELECT 1 FROM event next WHERE next.l_partkey = e.l_partkey AND next.l_suppkey = e.l_suppkey AND next.assertion = e.assertion + 1 AND next.recorded_s <= {KNOWN})
      AND EXISTS (SELECT 1 FROM line l2 WHERE l2.l_suppkey = e.l_suppkey AND l2.l_linestatus = 'O' AND l2.recorded_s + {DAY} <= {ACTION})
      AND NOT EXISTS (SELECT 1 FROM event next WHERE next.chain = e.chain AND next.version = e.version + 1 AND next.recorded_s <= {KNOWN}))"""


def publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose evidence allows an action at ACTION, as far as is known at KNOWN.

    Successors are the next rows of chains, so NOT EXISTS is a look ahead in a window and no self-join; relevance is a semi-join with one row a source. The
    filters on each table come before its join.
    """
    at = epoch_seconds("l_shipdate")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("number"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", at.alias("recorded_s"), F.col("l_quantity").cast("long").alias("quantity")
    )
    unknown = lambda c: c.isNull() | (c > KNOWN)
    asserted = Window.partitionBy("l_partkey", "l_suppkey").orderBy("recorded_s", "chain", "number")
    told = Window.partitionBy("chain").orderBy("number", "recorded_s", "l_partkey", "l_suppkey")
    events = lines.withColumn("next_assertion_s", F.lead("recorded_s").over(asserted)).withColumn("version", F.row_number().over(told)).withColumn("next_event_s", F.lead("recorded_s").over(told))
    begins = F.col("recorded_s") + 30 * DAY
    effective = F.when(F.col("number") % 3 == 0, True).when(F.col("number") % 3 == 1, begins <= ACTION).otherwise(F.floor(begins / DAY) <= ACTION // DAY)
    unexpired = (F.col("number") % 2 == 1) | (F.col("recorded_s") + F.col("quantity") * (100 * DAY) > KNOWN)
    events = events.where((F.col("l_returnflag") != "R") & (F.col("recorded_s") <= ACTION) & unknown(F.col("next_assertion_s")) & unknown(F.col("next_event_s")) & effective & unexpired)
    asked = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    retrieved = epoch_seconds("o_orderdate")
    sources = table(spark, sf_dir, "orders").withColumn("next_s", F.lead(retrieved, 6).over(asked)).where((retrieved <= ACTION) & (F.col("o_orderpriority") != "5-LOW") & unknown(F.col("next_s")))
    relevant = lines.where((F.col("l_linestatus") == "O") & (F.col("recorded_s") + DAY <= ACTION)).select("l_suppkey").distinct()
    out = events.join(sources.select("o_orderkey", "o_custkey"), F.col("chain") == F.col("o_orderkey"))
    out = out.join(table(spark, sf_dir, "customer").where("c_acctbal > -500").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(table(spark, sf_dir, "part").where("p_size > 2").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    providers = table(spark, sf_dir, "nation").where("n_name <> 'CHINA'").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    enabled = table(spark, sf_dir, "supplier").where("s_acctbal > -500").join(providers, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey", "r_name")
    return out.join(enabled, F.col("l_suppkey") == F.col("s_suppkey")).join(relevant, "l_suppkey", "left_semi")


@query("join_provenance_gates", f"WITH {EVIDENCE_SQL} SELECT chain, CAST(version AS INTEGER) AS version, l_suppkey, n_nationkey, r_name FROM publishable")
def join_provenance_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with publishable evidence: the whole lineage, its gates and its clocks."""
    return publishable(spark, sf_dir).select("chain", "version", "l_suppkey", "n_nationkey", "r_name")


@query("rule_publication_evidence", f"""WITH {EVIDENCE_SQL}, p AS (SELECT chain, version, l_returnflag, row_number() OVER (PARTITION BY chain ORDER BY version DESC) AS n FROM event WHERE recorded_s <= {KNOWN})
SELECT p.chain, CAST(p.version AS INTEGER) AS version, p.l_returnflag = 'N' AND EXISTS (SELECT 1 FROM publishable b WHERE b.chain = p.chain AND b.version = p.version) AS is_current FROM p WHERE n = 1""")
def rule_publication_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the last action of each chain that is known, whether it is a publication whose evidence still holds."""
    at, told = epoch_seconds("l_shipdate"), Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    actions = table(spark, sf_dir, "lineitem").withColumn("version", F.row_number().over(told)).where(at <= KNOWN)
    last = actions.groupBy(F.col("l_orderkey").alias("chain")).agg(F.max(F.struct("version", "l_returnflag")).alias("a")).select("chain", "a.*")
    valid = publishable(spark, sf_dir).select("chain", "version", F.lit(True).alias("valid"))
    return last.join(valid, ["chain", "version"], "left").select("chain", "version", ((F.col("l_returnflag") == "N") & F.coalesce("valid", F.lit(False))).alias("is_current"))


@query("rule_authority_gates", f"""WITH {EVIDENCE_SQL} SELECT r_name, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE n_nationkey % 5 = 0 AND number % 2 = 0) AS BIGINT) AS protective, CAST(count(*) FILTER (WHERE n_nationkey % 5 IN (0, 1) AND l_returnflag = 'N') AS BIGINT) AS official FROM publishable GROUP BY r_name""")
def rule_authority_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what may be published, what an alert authority says that has an end and so may tell people what to do, and what a status authority says."""
    authority: Column = F.col("n_nationkey") % 5
    protective, official = (authority == 0) & (F.col("number") % 2 == 0), authority.isin(0, 1) & (F.col("l_returnflag") == "N")
    return publishable(spark, sf_dir).groupBy("r_name").agg(F.count("*").alias("n"), F.count_if(protective).alias("protective"), F.count_if(official).alias("official"))
