"""Written outputs, read back."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from catloom.functions import normalize
from catloom.operators import metrics
from catloom.plans.registry import query
from catloom.shared import new_path
from catloom.sources import fixtures, sinks

P = f"WITH p AS ({fixtures.PARTS_SQL})"
URL = "'https://shop' || CAST(key % 3 AS VARCHAR) || '.example.com/p/' || CAST(key AS VARCHAR)"


def products(spark, sf):
    """``platform, name, price, url, images`` of the parts; every seventh has no price."""
    k = F.col("key")
    shop = F.concat(F.lit("shop"), (k % 3).cast("string"))
    return fixtures.priced_parts(spark, sf).select(
        shop.alias("platform"), "name", F.when(k % 7 != 0, F.col("price")).alias("price"), F.concat(F.lit("https://"), shop, F.lit(".example.com/p/"), k.cast("string")).alias("url"), F.array(F.lit("a.jpg"), F.lit('b "q".jpg')).alias("images")
    )


CSV = "CASE WHEN key % 7 <> 0 THEN CAST(price AS VARCHAR) END AS price"


@query("sink_csv", f"""{P} SELECT 'shop' || CAST(key % 3 AS VARCHAR) AS platform, name, {CSV}, {URL} AS url, '["a.jpg","b \\"q\\".jpg"]' AS images FROM p""")
def sink_csv(spark, sf):
    """CSV in a folder for each platform, lists as JSON text."""
    path = new_path(spark, "csv")
    sinks.write_csv(products(spark, sf), path, by_platform=True)
    schema = "name string, price string, url string, images string, platform string"
    return spark.read.schema(schema).option("header", True).csv(path).select("platform", "name", "price", "url", "images")


@query("sink_named", f"{P} SELECT 'shop' || CAST(key % 3 AS VARCHAR) || '.example.com' AS file, count(*) AS n, sum(CASE WHEN key % 7 <> 0 THEN price END) AS total FROM p GROUP BY key % 3")
def sink_named(spark, sf):
    """CSV named by the site of each URL."""
    path = new_path(spark, "named")
    sinks.write_named(products(spark, sf).select("name", "price", "url"), path, by="site")
    rows = spark.read.schema("name string, price decimal(18,2), url string, file string").option("header", True).csv(path)
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


@query("sink_envelope", f"{P} SELECT name, {CSV}, {URL} AS url, (SELECT count(*) FROM p) AS n, (SELECT round(100.0 * count(*) FILTER (key % 7 <> 0) / count(*), 6) FROM p) AS priced FROM p")
def sink_envelope(spark, sf):
    """Products as JSON lines with their summary beside them."""
    path, rows = new_path(spark, "envelope"), products(spark, sf)
    sinks.write_envelope(rows, rows.agg(F.count(F.lit(1)).alias("n"), F.round(metrics.percent(F.col("price").isNotNull()), 6).alias("priced")), path)
    found = spark.read.schema("name string, price string, url string").json(f"{path}/products")
    return found.join(F.broadcast(spark.read.schema("n long, priced double").json(f"{path}/metadata")))


@query("sink_lines", f"{P} SELECT name, {CSV}, {URL} AS url, 2 AS n_images FROM p")
def sink_lines(spark, sf):
    path = new_path(spark, "lines")
    sinks.write_lines(products(spark, sf), path)
    return spark.read.schema("name string, price string, url string, images array<string>").json(path).select("name", "price", "url", F.size("images").alias("n_images"))


@query("sink_report", f"{P} SELECT 'name: ' || name || ' | price: ' || coalesce(CASE WHEN key % 7 <> 0 THEN CAST(price AS VARCHAR) END, 'N/A') || ' | url: ' || {URL} AS line FROM p")
def sink_report(spark, sf):
    """A text report, a line for each product."""
    path = new_path(spark, "report")
    sinks.report_lines(products(spark, sf), ["name", "price", "url"], "url").write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("sink_preview", f"{P} SELECT CASE WHEN len(n) > 12 THEN left(n, 12) || '...' ELSE n END AS name, url FROM (SELECT name AS n, {URL} AS url FROM p) ORDER BY url LIMIT 5")
def sink_preview(spark, sf):
    """The first five, long names cut."""
    return sinks.preview(products(spark, sf), "url", 5, 12).select("name", "url")


@query("progress_counts", f"{P} SELECT count(*) AS rows, count(*) FILTER (key % 7 <> 0) AS succeeded FROM p")
def progress_counts(spark, sf):
    """What an observer of a writing job counted, without another job."""
    seen = Observation("written")
    rows = products(spark, sf).withColumn("ok", F.col("price").isNotNull())
    sinks.observed(rows, seen, "ok").select("name", normalize.shortened(F.col("url"), 40)).write.csv(new_path(spark, "progress"))
    return spark.createDataFrame([(seen.get["rows"], seen.get["succeeded"])], "rows long, succeeded long")


@query(
    "sitemap_loc_readers",
    """SELECT 'https://loja.example.com/sitemap-' || CAST(c_nationkey AS VARCHAR) || '.xml' AS url, count(*) + 1 AS by_pattern, count(*) + 1 AS by_xml, ' https://loja.example.com/sitemap.xml ' AS last_raw, 'https://loja.example.com/sitemap.xml' AS last_trimmed, CAST(0 AS BIGINT) AS elsewhere FROM customer GROUP BY c_nationkey
    UNION ALL SELECT 'https://loja.example.com/sitemap.xml', count(*), count(*), ' https://loja.example.com/sitemap-9.xml ', 'https://loja.example.com/sitemap-9.xml', 0 FROM nation""",
)
def sitemap_loc_readers(spark, sf):
    """Entries by pattern, as they are, and by XML, trimmed, namespaces dropped; those on another domain."""
    from catloom.sources import sitemaps

    raw, xml = sitemaps.locs_by_pattern(F.col("body")), sitemaps.locs_by_xml(sitemaps.repaired(F.col("body")))
    rows = fixtures.sitemap_bodies(spark, sf).select("url", raw.alias("raw"), xml.alias("xml"), F.size(sitemaps.locs_on_domain(F.col("body"), F.lit("other.example.org"))).cast("long").alias("elsewhere"))
    return rows.select("url", F.size("raw").cast("long").alias("by_pattern"), F.size("xml").cast("long").alias("by_xml"), F.element_at("raw", -1).alias("last_raw"), F.element_at("xml", -1).alias("last_trimmed"), "elsewhere")
