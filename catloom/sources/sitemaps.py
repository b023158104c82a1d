"""robots.txt and sitemaps: text and XML columns to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catloom.functions import urls

FALLBACKS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml")


def robots_sitemaps(body: Column, site: Column) -> Column:
    """Sitemap URLs of a robots.txt, with the twin without ``.gz``; the usual places if it names none."""
    found = F.transform(F.regexp_extract_all(body, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)), lambda u: urls.resolve(F.concat(site, F.lit("/")), u))
    twins = F.flatten(F.transform(found, lambda u: F.when(u.endswith(".gz"), F.array(u, F.regexp_replace(u, r"\.gz$", ""))).otherwise(F.array(u))))
    usual = F.array(*[F.concat(site, F.lit(p)) for p in FALLBACKS])
    return F.when(F.size(found) > 0, F.array_distinct(twins)).otherwise(usual)


def first_sitemap(body: Column, site: Column, own_host: bool = False) -> Column:
    """The first sitemap that robots.txt names; ``own_host`` asks for the site's host."""
    found = F.transform(F.regexp_extract_all(body, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)), lambda u: urls.resolve(F.concat(site, F.lit("/")), u))
    if own_host:
        found = F.filter(found, lambda u: F.coalesce(urls.authority(u) == urls.authority(site), F.lit(False)))
    return F.try_element_at(found, F.lit(1))


#: Where a site's sitemaps are looked for at first (fixed values).
STARTS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-products.xml", "/product-sitemap.xml", "/robots.txt")


def start_urls(site: Column) -> Column:
    """The first five places to look at."""
    return F.array(*[F.concat(site, F.lit(p)) for p in STARTS])


def robots_lines(body: Column) -> Column:
    """All sitemap lines of a robots.txt, as they are."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?i)Sitemap:\s*(.+)"), F.lit(1)), lambda u: F.trim(u))


def locs_on_domain(body: Column, domain: Column) -> Column:
    """The ``loc`` contents that hold a domain's name."""
    return F.filter(locs(body), lambda u: u.contains(domain))


def repaired(body: Column) -> Column:
    """Broken XML prologues put right, white space before it dropped."""
    return F.ltrim(F.replace(F.replace(body, F.lit("<? xml"), F.lit("<?xml")), F.lit("< ?xml"), F.lit("<?xml")))


def locs_by_pattern(body: Column) -> Column:
    """All ``loc`` contents that stand on one line, as they are."""
    return F.regexp_extract_all(body, F.lit(r"<loc>(.*?)</loc>"), F.lit(1))


def locs(body: Column) -> Column:
    """All ``loc`` contents, trimmed, with or without a namespace prefix, CDATA opened."""
    raw = F.regexp_extract_all(repaired(body), F.lit(r"(?s)<(?:\w+:)?loc\b[^>]*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:\w+:)?loc>"), F.lit(1))
    return F.filter(F.transform(raw, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))), lambda u: u != "")


def locs_by_xml(body: Column) -> Column:
    """The same by the XML reader; for well-formed bodies, namespaces dropped."""
    return F.transform(F.xpath(F.regexp_replace(body, r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), F.lit("//loc/text()")), lambda u: F.trim(u))


def is_index(body: Column) -> Column:
    return body.rlike(r"<(\w+:)?sitemapindex\b")


def edges(sitemaps: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """``src, dst, kind``: an index leads to sitemaps, a sitemap to pages."""
    # a body is read once; what stands beside an explode is worked out for each of its rows
    read = sitemaps.select(F.col(url).alias("src"), is_index(F.col(body)).alias("index"), locs(F.col(body)).alias("locs"))
    rows = read.select("src", "index", F.explode(F.array_distinct("locs")).alias("dst"))
    kind = F.when(F.col("index") | F.col("dst").rlike(r"\.xml(\.gz)?$"), F.lit("sitemap")).otherwise(F.lit("page"))
    return rows.select("src", "dst", kind.alias("kind"))


def one_level(sitemaps: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """``root, loc``: pages of a sitemap or of the children of an index.

    Children whose name has ``product`` give all their pages, the others only product forms.
    """
    own = edges(sitemaps, url, body)
    # the pages of a sitemap meet the links that lead to it, so that bodies are read once for both
    key = F.when(F.col("kind") == "sitemap", F.col("dst")).otherwise(F.col("src"))
    # structs, as a set of strings would drop a null URL
    above = F.collect_set(F.when(F.col("kind") == "sitemap", F.struct("src"))).over(Window.partitionBy("key"))
    pages = own.withColumn("key", key).withColumn("above", above).where("kind = 'page'")
    # (?i) and not lower(), whose tables of case take seconds to load
    keep = F.col("src").rlike("(?i)product") | F.col("dst").rlike(r"/p$|/produto|/p/")
    below = pages.where((F.size("above") == 0) | keep)
    roots = F.when(F.size("above") == 0, F.array(F.struct("src"))).otherwise(F.col("above"))
    return below.select(F.explode(roots).alias("root"), F.col("dst").alias("loc")).select("root.src", "loc").toDF("root", "loc").distinct()


def first_child(sitemaps: DataFrame, url: str = "url", body: str = "body", least_slashes: int = 4) -> DataFrame:
    """``root, loc``: pages of an index's first child, or of the sitemap itself; short URLs are no pages."""
    rows = sitemaps.select(F.col(url).alias("root"), is_index(F.col(body)).alias("index"), locs(F.col(body)).alias("locs"))
    child = rows.where("index").select("root", F.try_element_at("locs", F.lit(1)).alias("src"))
    own = rows.where("NOT index")
    below = child.join(own.select(F.col("root").alias("__r"), "locs"), F.col("src") == F.col("__r")).select("root", F.explode("locs").alias("loc"))
    direct = own.select("root", F.explode("locs").alias("loc"))
    return below.union(direct).where(urls.slash_count(F.col("loc")) >= least_slashes).distinct()


def product_children(sitemaps: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """``root, child``: an index's product sitemaps but the one numbered 0; without any, those numbered 1 to 3 that were captured."""
    rows = sitemaps.select(F.col(url).alias("root"), is_index(F.col(body)).alias("index"), locs(F.col(body)).alias("locs")).where("index")
    named = rows.select("root", F.filter("locs", lambda u: u.contains("/sitemap/") & u.contains("product") & ~u.contains("product-0")).alias("named"))
    own = named.select("root", F.explode("named").alias("child"))
    usual = named.where(F.size("named") == 0).select("root", F.explode(F.array(*[F.concat(F.regexp_extract("root", r"^[a-z]+://[^/?#]*", 0), F.lit(f"/sitemap/product-{i}.xml")) for i in (1, 2, 3)])).alias("child"))
    return own.union(usual.join(sitemaps.select(F.col(url).alias("child")), "child", "left_semi").select("root", "child")).distinct()


def is_gzip(path: Column, encoding: Column, head: Column) -> Column:
    """By name, by header, or by the first two bytes."""
    return path.endswith(".gz") | F.lower(F.coalesce(encoding, F.lit(""))).contains("gzip") | (F.hex(F.substring(head, 1, 2)) == "1F8B")
