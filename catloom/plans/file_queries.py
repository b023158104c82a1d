"""Sources and sinks as files: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catloom.plans.registry import query, table
from catloom.shared import new_path
from catloom.sources import files, fixtures, sitemaps

PAGE = "'https://loja.example.com/' || CASE WHEN c_custkey % 3 = 0 THEN 'produto/' ELSE 'c/' END || 'x-' || CAST(c_custkey AS VARCHAR)"
NAME = "'sitemap-' || CAST(c_nationkey AS VARCHAR)"
DAY = "'2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0')"


@query(
    "sitemap_files",
    f"""SELECT 'sitemap' AS name, 'sitemap' AS kind, 'https://loja.example.com/sitemap-' || CAST(n_nationkey AS VARCHAR) || '.xml' AS loc FROM nation
    UNION ALL SELECT {NAME}, 'page', {PAGE} FROM customer""",
)
def sitemap_files(spark, sf):
    """Sitemaps as files, split at the closing tags of their entries; odd nations' are gzip."""
    path = new_path(spark, "sitemaps")
    fixtures.write_sitemaps(spark, sf, path)
    return files.read_locs(spark, path).select("name", "kind", "loc")


@query("sitemap_files_xml", f"SELECT {NAME} AS name, {PAGE} AS loc, {DAY} AS lastmod FROM customer")
def sitemap_files_xml(spark, sf):
    """The same pages by the XML source, with their days."""
    path = new_path(spark, "sitemaps")
    fixtures.write_sitemaps(spark, sf, path)
    return files.read_urls(spark, path, schema=f"{files.ENTRY}, name string").select("name", "loc", "lastmod")


@query(
    "gzip_files",
    f"""SELECT DISTINCT {NAME} AS name, CASE WHEN c_nationkey % 5 = 1 THEN NULL ELSE {PAGE} END AS loc FROM customer""",
)
def gzip_files(spark, sf):
    """Files by their first bytes; every fifth nation's are cut off and give nothing."""
    path = new_path(spark, "sitemaps")
    fixtures.write_sitemaps(spark, sf, path)
    raw = spark.read.format("binaryFile").load(path).where("name <> 'sitemap'").withColumn("k", F.struct("name", "path"))
    cut = F.substring_index("name", "-", -1).cast("int") % 5 == 1
    broken = F.when(F.col("path").endswith(".gz"), F.expr("substring(content, 1, octet_length(content) - 9)")).otherwise(F.expr("concat(x'1f8b', content)"))
    bodies = files.opened(raw.withColumn("content", F.when(cut, broken).otherwise(F.col("content"))), "k", piece=1 << 14)
    return bodies.select("key.name", F.explode_outer(F.when(F.col("body").isNotNull(), sitemaps.locs(F.col("body")))).alias("loc")).distinct()


@query(
    "url_list_files",
    "SELECT DISTINCT 'https://loja.example.com/' || lower(p_type) || '/' || CAST(p_partkey % 500 AS VARCHAR) AS url FROM part",
)
def url_list_files(spark, sf):
    """URL lists as text files: blank lines and comments left out, each URL once."""
    path = new_path(spark, "urls")
    url = F.concat(F.lit(fixtures.SHOP + "/"), F.lower("p_type"), F.lit("/"), (F.col("p_partkey") % 500).cast("string"))
    noise = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("# "), "p_name")).otherwise("   ")
    lines = table(spark, sf, "part").select(F.explode(F.array(F.concat(F.lit("  "), url, F.lit(" ")), noise)).alias("value"))
    lines.write.text(path)
    return files.read_url_list(spark, path)


@query("url_order", "SELECT 'https://loja.example.com/' || lower(p_type) || '/' || CAST(p_partkey AS VARCHAR) AS url, CAST(row_number() OVER (ORDER BY 'https://loja.example.com/' || lower(p_type) || '/' || CAST(p_partkey AS VARCHAR)) AS INT) AS position FROM part")
def url_order(spark, sf):
    """URLs in lexicographic order, numbered by ranges and not in one task."""
    from catloom.operators.ranks import global_positions

    url = F.concat(F.lit(fixtures.SHOP + "/"), F.lower("p_type"), F.lit("/"), F.col("p_partkey").cast("string"))
    return global_positions(table(spark, sf, "part").select(url.alias("url")), [F.col("url")])
