"""Feeds, catalogue pages and linked data read as whole documents of many items; wedges with arcs; pages of rows checked."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightline.functions import geo, parsing, states
from brightline.plans.bulletins import BULLETINS_SQL, NOW, bulletins
from brightline.plans.footprints import EXTENTS_SQL
from brightline.plans.registry import query
from brightline.sources import extents
from brightline.sources.tables import DETECTIONS_SQL, detections

#: The most items that a feed is read for, and those that a catalogue page may have.
FEED_ITEMS, PAGE_ITEMS = 30, 40


@query("src_rss_items", f"""WITH {BULLETINS_SQL}, i AS (SELECT *, published_s // 86400 AS day, row_number() OVER (PARTITION BY source, published_s // 86400 ORDER BY id) - 1 AS pos FROM bul)
SELECT source, CAST(day AS BIGINT) AS day, CAST(pos AS INTEGER) AS pos, CASE WHEN id % 3 = 0 THEN url ELSE 'urn:' || id END AS guid, url AS link, headline || CASE WHEN id % 4 = 1 THEN ' & <b>' ELSE '' END AS title, body || CASE WHEN id % 2 = 1 THEN ' & co' ELSE '' END AS body, published_s
FROM i WHERE pos < {FEED_ITEMS}""")
def src_rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of RSS feeds, one feed a source and day: fields by tag, entities and CDATA decoded, the link for a missing guid, so many items of a feed at most."""
    rows = bulletins(spark, sf_dir)
    escaped = lambda c: F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    title = escaped(F.concat("headline", F.when(F.col("id") % 4 == 1, " & <b>").otherwise("")))
    body = F.when(F.col("id") % 2 == 1, F.concat(F.lit("<![CDATA["), "body", F.lit(" & co]]>"))).otherwise(escaped(F.col("body")))
    at = F.date_format(F.timestamp_seconds("published_s"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    guid = F.when(F.col("id") % 3 != 0, F.concat(F.lit('<guid isPermaLink="false"> urn:'), F.col("id").cast("string"), F.lit(" </guid>"))).otherwise("")
    item = F.concat(F.when(F.col("id") % 5 == 0, '<item rdf:about="x">').otherwise("<ITEM>"), tag("title", title), F.lit("\n"), tag("link", escaped(F.col("url"))), guid, tag("pubDate", at), tag("description", body), F.when(F.col("id") % 5 == 0, "</item>").otherwise("</ITEM>"))
    feeds = rows.groupBy("source", F.floor(F.col("published_s") / 86400).alias("day")).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", item.alias("item")))), lambda x: x["item"]).alias("items"))
    feeds = feeds.select("source", "day", F.concat(F.lit('<?xml version="1.0"?><rss><channel><title>news</title>'), F.array_join("items", "\n"), F.lit("</channel></rss>")).alias("xml"))
    # What was made above is a document now: from here on it is read.
    blocks = F.slice(F.regexp_extract_all("xml", F.lit(r"(?is)<item(?:\s[^>]*)?>(.*?)</item>"), F.lit(1)), 1, FEED_ITEMS)
    items = feeds.select("source", "day", F.posexplode(blocks).alias("pos", "block"))
    raw = lambda name: F.trim(F.regexp_extract("block", rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1))
    text = parsing.arrow(parsing.decoded, "string")
    items = items.select("source", "day", "pos", text(raw("title")).alias("title"), text(raw("link")).alias("link"), raw("guid").alias("guid"), text(raw("description")).alias("body"), F.unix_timestamp(F.substring(raw("pubDate"), 6, 20), "dd MMM yyyy HH:mm:ss").alias("published_s"))
    return items.withColumn("guid", F.when(F.col("guid") != "", F.col("guid")).otherwise(F.col("link")))


@query("src_jsonld_graph", f"""WITH {BULLETINS_SQL} SELECT id, CASE id % 6 WHEN 5 THEN NULL WHEN 4 THEN NULL ELSE headline END AS headline FROM bul""")
def src_jsonld_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline of the first article in linked data of several shapes: alone, in a graph, in lists within lists; none if there is no article or no JSON."""
    article = F.to_json(F.struct(F.when(F.col("id") % 2 == 0, F.array(F.lit("Thing"), F.lit("NewsArticle"))).otherwise(F.array(F.lit("ReportageNewsArticle"))).alias("@type"), "headline", "body"))
    n = F.col("id") % 6
    said = F.when(n == 0, article).when(n == 1, F.concat(F.lit('{"@graph":[{"@type":"WebSite","name":"x"},'), article, F.lit("]}"))).when(n == 2, F.concat(F.lit('[[],[{"@type":"Person"},['), article, F.lit("]]]")))
    said = said.when(n == 3, F.concat(F.lit('{"mainEntity":'), article, F.lit(',"about":{"@type":"Article","headline":"later"}}'))).when(n == 4, F.to_json(F.struct(F.lit("Person").alias("@type"), F.col("headline").alias("name")))).otherwise(F.concat(article, F.lit("}")))
    return bulletins(spark, sf_dir).select("id", parsing.arrow(parsing.article_headline, "string")(said).alias("headline"))


@query("src_catalog_pages", f"""WITH {EXTENTS_SQL}, i AS (SELECT k, kind, at_s, k // {PAGE_ITEMS} AS page, CASE k % 3 WHEN 0 THEN 'VNP14IMG_NRT' WHEN 1 THEN 'VJ114IMG_NRT' ELSE 'OTHER' END AS product FROM ext),
  j AS (SELECT *, concat_ws(',', CASE WHEN k % 3 = 2 THEN 'product-mismatch' END, CASE WHEN k % 13 = 4 THEN 'invalid-interval' END, CASE kind WHEN 1 THEN 'mixed-encodings' WHEN 5 THEN 'open-ring' WHEN 6 THEN 'no-way-round' WHEN 9 THEN 'self-crossing' END) AS reasons FROM i)
SELECT page, k AS item, product, CASE WHEN reasons = '' THEN at_s END AS from_s, CASE WHEN reasons = '' THEN at_s + 300 + k % 60 END AS to_s, reasons FROM j""")
def src_catalog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of catalogue items as JSON, each item judged by itself: its product, its interval, its footprint; a pass, or all reasons why not. A page with
    more items than allowed is an error."""
    rows = extents.extents(spark, sf_dir)
    k = F.col("footprint_id")
    product = F.when(k % 3 == 0, "VNP14IMG_NRT").when(k % 3 == 1, "VJ114IMG_NRT").otherwise("OTHER")
    stamp = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ends = F.when(k % 13 == 4, F.col("at_s") - 1).otherwise(F.col("at_s") + 300 + k % 60)
    item = F.concat(F.lit('{"meta":{"concept-id":"G'), k.cast("string"), F.lit('"},"umm":{"CollectionReference":{"ShortName":"'), product, F.lit('"},"TemporalExtent":{"RangeDateTime":{"BeginningDateTime":"'), stamp(F.col("at_s")), F.lit('","EndingDateTime":"'), stamp(ends), F.lit('"}},"SpatialExtent":'), F.col("extent"), F.lit("}}"))
    pages = rows.groupBy(F.floor(k / PAGE_ITEMS).alias("page")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    pages = pages.select("page", F.concat(F.lit('{"hits":'), F.size("items").cast("string"), F.lit(',"items":['), F.array_join("items", ","), F.lit("]}")).alias("json"))
    # From here on the pages are read.
    umm = "struct<CollectionReference:struct<ShortName:string>,TemporalExtent:struct<RangeDateTime:struct<BeginningDateTime:string,EndingDateTime:string>>,SpatialExtent:string>"
    read = F.from_json("json", f"struct<hits:long,items:array<struct<meta:struct<`concept-id`:string>,umm:{umm}>>>")
    pages = pages.select("page", F.inline(F.array(F.struct(read.alias("read")))))
    pages = pages.where(F.when(F.coalesce(F.size("read.items"), F.lit(PAGE_ITEMS + 1)) > PAGE_ITEMS, F.raise_error(F.lit("a page has more items than allowed"))).otherwise(True))
    items = pages.select("page", F.explode("read.items").alias("i")).select(
        "page", F.substring("i.meta.concept-id", 2, 30).cast("long").alias("item"), F.col("i.umm.CollectionReference.ShortName").alias("product"),
        F.unix_timestamp("i.umm.TemporalExtent.RangeDateTime.BeginningDateTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("begins"), F.unix_timestamp("i.umm.TemporalExtent.RangeDateTime.EndingDateTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ends"), F.col("i.umm.SpatialExtent").alias("extent"),
    )
    items = extents.read_extents(items)
    why = F.concat_ws(",", states.reasons((~F.col("product").isin("VNP14IMG_NRT", "VJ114IMG_NRT"), "product-mismatch"), (F.coalesce(F.col("ends") <= F.col("begins"), F.lit(True)), "invalid-interval")), F.when(F.col("reason") != "", F.col("reason")))
    items = items.select("page", "item", "product", "begins", "ends", F.inline(F.array(F.struct(why.alias("reasons")))))
    good = F.col("reasons") == ""
    return items.select("page", "item", "product", F.when(good, F.col("begins")).alias("from_s"), F.when(good, F.col("ends")).alias("to_s"), "reasons")


STEPS = 8
_REACH = "(frp + 1) / 6371.0 * (0.38 + 0.62 * cos(abs(o) / (20.0 + k / 5.0) * pi() / 2))"
_TURN = "radians(k * 3.6 + o)"


@query("geo_wedge_arc", f"""WITH {DETECTIONS_SQL}, p AS (SELECT event_id, glat, glon, i, (20.0 + k / 5.0) * (2.0 * i / {STEPS} - 1) AS o, frp, k FROM det, generate_series(0, {STEPS}) AS s(i)),
  d AS (SELECT *, {_REACH} AS d, {_TURN} AS a FROM p), q AS (SELECT event_id, asin(sin(radians(glat)) * cos(d) + cos(radians(glat)) * sin(d) * cos(a)) AS lat, radians(glat) AS lat0, glon, d, a FROM d),
  r AS (SELECT event_id, degrees(lat) AS lat, degrees(atan2(sin(a) * sin(d) * cos(lat0), cos(d) - sin(lat0) * sin(lat))) AS east FROM q)
SELECT event_id, CASE WHEN abs(any_value(glat)) < 59 THEN {STEPS + 3} END AS n_points, CASE WHEN abs(any_value(glat)) < 59 THEN round(sum(r.lat), 5) END AS lats, CASE WHEN abs(any_value(glat)) < 59 THEN round(sum(r.east), 5) END AS easts FROM r JOIN det USING (event_id) GROUP BY event_id""")
def geo_wedge_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring of a wedge that smoke may reach: from the place along an arc of directions, each as far as the taper allows, and back; none near the poles."""
    half, axis = F.lit(20.0) + F.col("k") / 5.0, F.col("k") * 3.6

    def at(i):
        offset = half * (i * 2.0 / STEPS - 1)
        lat, lon = geo.destination(F.col("glat"), F.col("glon"), axis + offset, (F.col("frp") + 1) * geo.taper(offset, half))
        return F.struct(lon.alias("x"), lat.alias("y"))

    place = F.struct(F.col("glon").alias("x"), F.col("glat").alias("y"))
    ring = F.when(F.abs("glat") < 59, F.concat(F.array(place), F.transform(F.sequence(F.lit(0), F.lit(STEPS)), at), F.array(place)))
    arc = F.slice("ring", 2, STEPS + 1)
    total = lambda f: F.round(F.aggregate(F.transform(arc, f), F.lit(0.0), lambda s, v: s + v), 5)
    d = detections(spark, sf_dir).select("event_id", "glon", F.inline(F.array(F.struct(ring.alias("ring")))))
    lons = total(lambda p: geo.lon_delta(F.col("glon"), p["x"]))
    return d.select("event_id", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("n_points"), total(lambda p: p["y"]).alias("lats"), lons.alias("easts"))


@query("val_page_rows", f"""WITH {DETECTIONS_SQL}, c AS (SELECT product, satellite || '/' || (k % 25) AS cell, max(acquired_s) AS latest_s, min(acquired_s) AS first_s FROM det GROUP BY 1, 2),
  r AS (SELECT product, cell, latest_s, first_s, row_number() OVER (PARTITION BY product ORDER BY latest_s - CASE WHEN cell LIKE '%/7' THEN 86400 ELSE 0 END DESC, cell) AS place FROM c),
  l AS (SELECT *, lag(latest_s) OVER w AS p, lag(cell) OVER w AS q FROM r WINDOW w AS (PARTITION BY product ORDER BY place))
SELECT product, cell, CAST(place AS INTEGER) AS place, concat_ws(',', CASE WHEN p < latest_s OR (p = latest_s AND q >= cell) THEN 'not-ordered' END, CASE WHEN latest_s > {NOW} THEN 'after-cutoff' END, CASE WHEN latest_s - first_s > 1700000 THEN 'window-too-long' END) AS reasons
FROM l WHERE p < latest_s OR (p = latest_s AND q >= cell) OR latest_s > {NOW} OR latest_s - first_s > 1700000""")
def val_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pages of candidate cells that break the rules of a page: order, cutoff, length of their window."""
    d = detections(spark, sf_dir).withColumn("cell", F.concat_ws("/", "satellite", (F.col("k") % 25).cast("string")))
    c = d.groupBy("product", "cell").agg(F.max("acquired_s").alias("latest_s"), F.min("acquired_s").alias("first_s"))
    late = F.when(F.col("cell").endswith("/7"), 86400).otherwise(0)
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("product").orderBy((F.col("latest_s") - late).desc(), "cell")))
    page = Window.partitionBy("product").orderBy("place")
    c = c.withColumn("p", F.lag("latest_s").over(page)).withColumn("q", F.lag("cell").over(page))
    unordered = (F.col("p") < F.col("latest_s")) | ((F.col("p") == F.col("latest_s")) & (F.col("q") >= F.col("cell")))
    rules = [(unordered, "not-ordered"), (F.col("latest_s") > NOW, "after-cutoff"), (F.col("latest_s") - F.col("first_s") > 1700000, "window-too-long")]
    return states.violation(c, *rules).select("product", "cell", "place", "reasons")
