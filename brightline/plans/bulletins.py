"""Bulletins about incidents: relevance and category by rules on folded text, the digest of updates, and checks of chains with what they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightline.functions import states, values
from brightline.operators.core import top_rows
from brightline.plans.registry import per_row, query
from brightline.sources.tables import DETECTIONS_SQL, REVISIONS_SQL, detections, epoch_seconds, revisions, table

# Words of places and incidents, and the patterns of each category in the order in which they are tried; all on folded text.
PLACES = ["πλωμαρ", "plomari", "αγιου αντωνιου", "αγιος αντωνιος", "μεγαλοχωρι", "πλαγια", "αγιος ισιδωρος", "μελιντα", "μηλιες", "χαλκελι"]
INCIDENTS = ["φωτια", "πυρκαγ", "αναζωπυρ", "εστια", "φλογ", "καπν", "εκκεν", "απομακρυν", "112", "πυροσβεστ", "κατασβεσ", "μετωπο", "wildfire", "fire", "smoke", "evacuat"]
EVACUATION = ["(εκκεν|απομακρυν|evacuat)", "(112|πολιτικη προστασια|civil protection)"]
CATEGORIES = [
    ("readiness", "high", "(ετοιμοτητ|readiness|stay alert|παραμεινετε)"), ("road", "high", "(κυκλοφορ|κλειστ.*δρομ|εκτροπ|road clos|traffic)"),
    ("smoke", "medium", "(καπν|smoke|pm2\\.?5|αερολυ)"), ("rekindling", "medium", "(αναζωπυρ|διασπαρτ.*εστι|hotspot|rekindl)"),
    ("containment", "low", "(πληρη.*ελεγχ|μερικ.*ελεγχ|οριοθετ|χωρις ενεργο μετωπο|ληξη|contained|under control|all.clear)"),
    ("response", "low", "(πυροσβεστ|εναερι|επιχειρ|fire service|crew|aircraft)"),
]
NOW = 1705708800
RECENT_S = 7 * 86400
PER_SOURCE, DIGEST = 20, 60

_WORDS = [
    "Φωτιά", "ΠΥΡΚΑΓΙΆ", "Wildfire", "Δελτίο", "Καπνός", "smoke report", "Εκκένωση", "Evacuation notice", "Αναζωπύρωση", "Road closed", "Κλειστός ο δρόμος", "Νέα", "Ενημέρωση", "hotspot", "Πυροσβεστική",
    "Υπό μερικό έλεγχο", "all clear", "Ετοιμότητα", "Aircraft", "Εναέρια μέσα", "Air quality PM2.5", "Ανακοίνωση", "fire contained",
]
_WHERE = ["στο Πλωμάρι", "Plomari", "στα Μεγαλοχώρι", "Άγιος Ισίδωρος", "Μελίντα", "στη Χίο", "Athens", "", "Πλαγιά", "near MILIES", "στις Μηλιές", "village", "Χαλκέλι"]
_MORE = ["112", "Πολιτική Προστασία", "civil protection", "the fire service says", "χωρίς ενεργό μέτωπο", "traffic", "χάρτης", "παραμείνετε", "οριοθετήθηκε", "no news", "λήξη", "crew", "rekindling", "", "εκτροπή", "μέτωπο", "ﬁre", "fıre", "φωτιά"]
_SQL_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"

BULLETINS_SQL = f"""bul AS (SELECT o_orderkey AS id, o_custkey % 7 AS source, CASE WHEN o_custkey % 7 < 2 THEN 0 WHEN o_custkey % 7 < 5 THEN 1 ELSE 2 END AS tier, {NOW + 50000} - o_orderkey * 7919 % 1200000 AS published_s,
    {_SQL_LIST(_WORDS)}[o_orderkey % {len(_WORDS)} + 1] || ' ' || {_SQL_LIST(_WHERE)}[o_custkey % {len(_WHERE)} + 1] || ' ' || (o_orderkey % 400) AS headline,
    {_SQL_LIST(_MORE)}[o_orderkey // 3 % {len(_MORE)} + 1] || ': ' || {_SQL_LIST(_WHERE)}[o_orderkey // 7 % {len(_WHERE)} + 1] || ', ' || {_SQL_LIST(_WORDS)}[o_custkey // 2 % {len(_WORDS)} + 1] AS body, 'https://news.example/' || (o_orderkey % 4999) AS url FROM orders),
  folded AS (SELECT *, strip_accents(lower(headline)) AS fh, strip_accents(lower(body)) AS fb, strip_accents(lower(headline || ' ' || body)) AS fa FROM bul)"""


def bulletins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulletins, one an order: source, tier, time, headline, body and URL, in words of two languages and several spellings."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda words, at: F.get(F.array(*(F.lit(w) for w in words)), (at % len(words)).cast("int"))
    third = lambda c, n: F.floor(c / n)
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), (cust % 7).alias("source"), F.when(cust % 7 < 2, 0).when(cust % 7 < 5, 1).otherwise(2).alias("tier"), (F.lit(NOW + 50000) - key * 7919 % 1200000).alias("published_s"),
        F.concat_ws(" ", pick(_WORDS, key), pick(_WHERE, cust), (key % 400).cast("string")).alias("headline"),
        F.concat(pick(_MORE, third(key, 3)), F.lit(": "), pick(_WHERE, third(key, 7)), F.lit(", "), pick(_WORDS, third(cust, 2))).alias("body"), F.concat(F.lit("https://news.example/"), (key % 4999).cast("string")).alias("url"),
    )


def relevant(folded: Column) -> Column:
    """Whether a text names a place and an incident."""
    return folded.rlike("|".join(PLACES)) & folded.rlike("|".join(INCIDENTS))


def classified(folded: Column) -> Column:
    """struct(category, severity) of the first rule that a text meets."""
    out = F.when(folded.rlike(EVACUATION[0]) & folded.rlike(EVACUATION[1]), F.struct(F.lit("evacuation").alias("category"), F.lit("critical").alias("severity")))
    for category, severity, pattern in CATEGORIES:
        out = out.when(folded.rlike(pattern), F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity")))
    return out.otherwise(F.struct(F.lit("incident").alias("category"), F.lit("medium").alias("severity")))


def _class_sql(text: str, column: int) -> str:
    rules = [f"WHEN regexp_matches({text}, '{p}') THEN '{(c, s)[column]}'" for c, s, p in CATEGORIES]
    return f"CASE WHEN regexp_matches({text}, '{EVACUATION[0]}') AND regexp_matches({text}, '{EVACUATION[1]}') THEN '{('evacuation', 'critical')[column]}' {' '.join(rules)} ELSE '{('incident', 'medium')[column]}' END"


_RELEVANT_SQL = f"regexp_matches(fa, '{'|'.join(PLACES)}') AND regexp_matches(fa, '{'|'.join(INCIDENTS)}')"
_CATEGORY_SQL = [f"CASE WHEN {_class_sql('fh', 0)} <> 'incident' THEN {_class_sql('fh', i)} ELSE {_class_sql('fb', i)} END" for i in (0, 1)]


def judged(rows: DataFrame) -> DataFrame:
    """Relevant bulletins with category and severity: of the headline, where that tells more than that there is an incident, else of the body."""
    rows = rows.select("*", F.inline(F.array(F.struct(values.fold(F.col("headline")).alias("fh"), values.fold(F.col("body")).alias("fb")))))
    rows = rows.where(relevant(F.concat_ws(" ", "fh", "fb")))
    head = classified(F.col("fh"))
    return rows.withColumn("of", F.when(head["category"] != "incident", head).otherwise(classified(F.col("fb")))).select(*[c for c in rows.columns if c not in ("fh", "fb")], "of.*")


@query("txt_bulletin_category", f"WITH {BULLETINS_SQL} SELECT id, {_CATEGORY_SQL[0]} AS category, {_CATEGORY_SQL[1]} AS severity FROM folded WHERE {_RELEVANT_SQL}")
def txt_bulletin_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(bulletins(spark, sf_dir)).select("id", "category", "severity")


@query("updates_digest_chain", f"""WITH {BULLETINS_SQL}, r AS (SELECT *, {_CATEGORY_SQL[0]} AS category, {_CATEGORY_SQL[1]} AS severity FROM folded WHERE {_RELEVANT_SQL} AND published_s BETWEEN {NOW - RECENT_S} AND {NOW}),
  t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_s DESC, id) AS ns FROM r), u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY published_s DESC, id) AS nu FROM t WHERE ns <= {PER_SOURCE}),
  h AS (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(fh, '[^a-z0-9α-ω]+', ' ', 'g')) ORDER BY published_s DESC, id) AS nh FROM u WHERE nu = 1),
  o AS (SELECT *, row_number() OVER (ORDER BY tier, published_s DESC, id) AS rank FROM h WHERE nh = 1)
SELECT CAST(rank AS INTEGER) AS rank, id, source, category, severity, headline FROM o WHERE rank <= {DIGEST}""")
def updates_digest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest: relevant and recent bulletins, the newest of each source, each URL and title once, official ones first, a page of them."""
    newest = [F.col("published_s").desc(), F.col("id")]
    rows = judged(bulletins(spark, sf_dir).where(F.col("published_s").between(NOW - RECENT_S, NOW)))
    rows = top_rows(rows, ["source"], newest, PER_SOURCE)  # from here on as many rows as sources times PER_SOURCE
    rows = top_rows(top_rows(rows, ["url"], newest).withColumn("title", values.title_key(F.col("headline"))), ["title"], newest)
    page = rows.orderBy("tier", *newest).limit(DIGEST)
    return page.select(F.row_number().over(Window.orderBy("tier", *newest)).alias("rank"), "id", "source", "category", "severity", "headline")


@query("agg_health_states", """WITH s AS (SELECT c_custkey, max(CASE WHEN event_type = 'error' THEN ts END) AS bad, max(CASE WHEN event_type <> 'error' THEN ts END) AS good FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey)
SELECT c_mktsegment AS segment, CAST(count(*) FILTER (WHERE good IS NOT NULL AND (bad IS NULL OR bad <= good)) AS BIGINT) AS online, CAST(count(*) FILTER (WHERE bad IS NOT NULL AND (good IS NULL OR bad > good)) AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE bad IS NULL AND good IS NULL) AS BIGINT) AS unconfigured
FROM s JOIN customer USING (c_custkey) GROUP BY c_mktsegment""")
def agg_health_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are online, have failed last, or were never heard of."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", F.col("event_type") != "error")).alias("kind"))
    state = states.first_of([(F.col("kind").isNull(), "unconfigured"), (F.col("kind") == "error", "failed")], "online")
    c = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("user_id"), "left").select(F.col("c_mktsegment").alias("segment"), state.alias("state"))
    return c.groupBy("segment").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("online", "failed", "unconfigured")))


@per_row("str_tofixed_exact", "det", "event_id", {
    "fixed": "CASE WHEN x * 8 = floor(x * 8) THEN printf('%.2f', floor(x * 100 + 0.5) / 100) ELSE printf('%.2f', x) END".replace("x", "((event_id * 37 % 4000) / CAST(1000 AS DOUBLE) + CAST(0.005 AS DOUBLE))"),
    "signed": "regexp_replace(printf('%.1f', round((event_id % 41 - 20) / CAST(16 AS DOUBLE) - 0.0001, 4)), '^-0\\.0$', '0.0')",
})
def str_tofixed_exact():
    """Numbers with two decimals by their exact values: 1.005 is less than it says; of two equally near numbers the larger."""
    x = (F.col("event_id") * 37 % 4000) / 1000.0 + 0.005
    return {"fixed": values.fixed_decimals(x, 2), "signed": values.fixed_decimals(F.round((F.col("event_id") % 41 - 20) / 16.0 - 0.0001, 4), 1)}


_URL_SQL = "url || CASE page_id % 4 WHEN 0 THEN '?b=2&a=x%20y&a=1#top' WHEN 1 THEN '//x///y/?q=' || page_id || '+%C3%A9&&=z' WHEN 2 THEN '/?~=*' ELSE '' END"
_ENCODE = "replace(replace(replace(url_encode({}), '%20', '+'), '~', '%7E'), '%2A', '*')"


@query("str_canonical_https", rf"""WITH u AS (SELECT page_id, replace({_URL_SQL}, 'http://', 'https://') AS u FROM pages),
  s AS (SELECT page_id, lower(regexp_extract(u, '^https://([^/?#]+)', 1)) AS host, regexp_replace(regexp_extract(u, '^https://[^/?#]+([^?#]*)', 1), '/+', '/', 'g') AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS q FROM u),
  p AS (SELECT page_id, unnest(string_split(q, '&')) AS pair FROM s), d AS (SELECT page_id, url_decode(replace(split_part(pair, '=', 1), '+', ' ')) AS k, url_decode(replace(regexp_extract(pair, '^[^=]*=(.*)$', 1), '+', ' ')) AS v FROM p WHERE pair <> ''),
  j AS (SELECT page_id, string_agg({_ENCODE.format("k")} || '=' || {_ENCODE.format("v")}, '&' ORDER BY k, v) AS q FROM d GROUP BY page_id)
SELECT s.page_id, 'https://' || host || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE '/' END || coalesce('?' || j.q, '') AS canonical FROM s LEFT JOIN j USING (page_id)""")
def str_canonical_https(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages, with fragments, doubled slashes and parameters out of order, in canonical form."""
    n = F.col("page_id") % 4
    more = F.when(n == 0, "?b=2&a=x%20y&a=1#top").when(n == 1, F.concat(F.lit("//x///y/?q="), F.col("page_id").cast("string"), F.lit("+%C3%A9&&=z"))).when(n == 2, "/?~=*").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", values.canonical_url(F.regexp_replace(F.concat("url", more), "^http://", "https://")).alias("canonical"))


@query("val_change_evidence", f"""WITH {REVISIONS_SQL}, w AS (SELECT chain, version, l_linenumber, l_partkey, lag(l_partkey) OVER (PARTITION BY chain ORDER BY version) AS actual, lag(l_partkey) OVER (PARTITION BY chain ORDER BY l_linenumber, version) AS claimed,
  list(l_partkey) OVER (PARTITION BY chain ORDER BY l_linenumber, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS evidence FROM rev)
SELECT chain, version, concat_ws(',', CASE WHEN claimed IS DISTINCT FROM actual THEN 'other-predecessor' END, CASE WHEN actual IS NOT NULL AND NOT coalesce(list_contains(evidence, actual), FALSE) THEN 'basis-not-in-evidence' END) AS reasons
FROM w WHERE claimed IS DISTINCT FROM actual OR (actual IS NOT NULL AND NOT coalesce(list_contains(evidence, actual), FALSE))""")
def val_change_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that name another predecessor than the one they follow in time, or whose evidence, what was told before them, does not hold it."""
    told = Window.partitionBy("chain").orderBy("l_linenumber", "version")
    r = revisions(spark, sf_dir).withColumn("actual", F.lag("l_partkey").over(Window.partitionBy("chain").orderBy("version"))).withColumn("claimed", F.lag("l_partkey").over(told))
    r = r.withColumn("evidence", F.collect_list("l_partkey").over(told.rowsBetween(Window.unboundedPreceding, -1)))
    return states.violation(r, (~F.col("claimed").eqNullSafe(F.col("actual")), "other-predecessor"), (F.col("actual").isNotNull() & ~F.array_contains("evidence", F.col("actual")), "basis-not-in-evidence")).select("chain", "version", "reasons")


@query("win_lineage_reset", f"""WITH {REVISIONS_SQL}, g AS (SELECT *, count(*) FILTER (WHERE version = 1 OR l_returnflag = 'R') OVER (PARTITION BY chain ORDER BY version) AS lineage FROM rev)
SELECT chain, version, first_value(version) OVER w AS baseline, first_value(shipped_s) OVER w AS covered_from, max(shipped_s + quantity * 3600) OVER w AS covered_to, CAST(row_number() OVER w - 1 AS INTEGER) AS depth FROM g WINDOW w AS (PARTITION BY chain, lineage ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def win_lineage_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage along a chain of scans: a full scan begins a lineage of its own, others inherit its baseline and beginning and move its end."""
    w = Window.partitionBy("chain").orderBy("version")
    begins = (F.col("version") == 1) | (F.col("l_returnflag") == "R")
    r = revisions(spark, sf_dir).withColumn("of", F.last(F.when(begins, F.struct("version", "shipped_s")), ignorenulls=True).over(w))
    since = Window.partitionBy("chain", "of.version").orderBy("version")
    upto = since.rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("shipped_s") + F.col("quantity") * 3600
    return r.select("chain", "version", F.col("of.version").alias("baseline"), F.col("of.shipped_s").alias("covered_from"), F.max(end).over(upto).alias("covered_to"), (F.row_number().over(since) - 1).alias("depth"))


_DIGEST_SQL = "sum(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT)) FILTER (WHERE recorded_s <= {})"


@query("ord_snapshot_restart", f"""WITH {DETECTIONS_SQL}, s AS (SELECT product, satellite, acquired_s // 86400 AS day, count(*) FILTER (WHERE recorded_s <= {NOW}) AS n, {_DIGEST_SQL.format(NOW)} AS begun, {_DIGEST_SQL.format(NOW + 3600)} AS now FROM det WHERE acquired_s > {NOW} - 172800 GROUP BY 1, 2, 3)
SELECT product, satellite, CAST(day AS BIGINT) AS day, CAST(n AS BIGINT) AS n, begun IS DISTINCT FROM now AS restart FROM s""")
def ord_snapshot_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots, by day, whose rows are others an hour after a reader began to page through them: the pages must be read from the start. The digest is a sum of
    row digests, so that rows are combined before the shuffle and their order plays no part."""
    row = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long")
    known = lambda at: F.sum(F.when(F.col("recorded_s") <= at, row))
    d = detections(spark, sf_dir, since=NOW - 172860).where(F.col("acquired_s") > NOW - 172800)
    g = d.groupBy("product", "satellite", F.floor(F.col("acquired_s") / 86400).alias("day")).agg(F.count_if(F.col("recorded_s") <= NOW).alias("n"), known(NOW).alias("begun"), known(NOW + 3600).alias("now"))
    return g.select("product", "satellite", "day", "n", (~F.col("begun").eqNullSafe(F.col("now"))).alias("restart"))


@query("join_nearest_hour", """WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'error'), w AS (SELECT event_id AS layer, user_id, epoch_us(ts) // 1000000 AS u FROM events WHERE event_type = 'view'),
  j AS (SELECT e.event_id, layer, row_number() OVER (PARTITION BY e.event_id ORDER BY CASE WHEN u // 3600 = t // 3600 THEN 0 ELSE 1 END, CASE WHEN u // 3600 = t // 3600 THEN 0 ELSE abs(u - t) END, u, layer) AS n FROM e JOIN w USING (user_id))
SELECT e.event_id, layer FROM e LEFT JOIN j ON j.event_id = e.event_id AND n = 1""")
def join_nearest_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer for each detection: the first of the same hour, else the nearest in time, of two the earlier. One shuffle by key: layers are carried forwards
    and backwards over the merged order of time, so that neither side is multiplied."""
    e = table(spark, sf_dir, "events").where("event_type IN ('error', 'view')").select("event_id", "user_id", epoch_seconds("ts").alias("t"), (F.col("event_type") == "view").alias("layer"))
    at = F.when(F.col("layer"), F.struct("t", F.col("event_id").alias("id")))
    hour = Window.partitionBy("user_id", F.floor(F.col("t") / 3600))
    order = Window.partitionBy("user_id").orderBy("t", F.col("layer").desc(), "event_id")
    e = e.withColumn("same", F.min(at).over(hour)).withColumn("before", F.max(at).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    later = Window.partitionBy("user_id").orderBy(F.col("t").desc(), F.col("layer").asc(), F.col("event_id").desc())
    e = e.withColumn("after", F.min(at).over(later.rowsBetween(Window.unboundedPreceding, 0))).where("NOT layer")
    # Of layers at one time the first counts, also of those before.
    first = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("u"), epoch_seconds("ts").alias("at")).agg(F.min("event_id").alias("first"))
    gap = lambda c: F.abs(F.col(f"{c}.t") - F.col("t"))
    near = F.when(F.col("same").isNotNull(), F.col("same.t")).when(F.col("after").isNull() | (gap("before") <= gap("after")), F.col("before.t")).otherwise(F.col("after.t"))
    e = e.select("event_id", "user_id", near.alias("near"))
    return e.join(first, (F.col("user_id") == F.col("u")) & (F.col("near") == F.col("at")), "left").select("event_id", F.col("first").alias("layer"))


@per_row("dt_cutoff_grace", "det", "event_id", {"cutoff_s": "(recorded_s - 60) // 300 * 300", "wait_s": "300 - (recorded_s - 60) % 300"})
def dt_cutoff_grace():
    """The five-minute bucket that is published by a time, a minute after it closes, and how long until the next one is."""
    at = F.col("recorded_s") - 60
    return {"cutoff_s": at - F.pmod(at, F.lit(300)), "wait_s": 300 - F.pmod(at, F.lit(300))}
