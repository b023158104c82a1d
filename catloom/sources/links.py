"""Links of captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catloom.functions import classify, urls

#: Words of links that lead to no category (fixed values).
NO_CATEGORY = ("contato", "sobre", "login", "cart", "conta", "ajuda")
ANCHOR = r'(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>'


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, page_url, position, href, text, link``: anchors in order, with the resolved link."""
    hits = F.arrays_zip(*[F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(k)).alias(name) for k, name in ((1, "href"), (2, "text"))])
    rows = pages.select(key, F.col(url).alias("page_url"), F.posexplode(hits).alias("at", "a"))
    return rows.select(key, "page_url", (F.col("at") + 1).alias("position"), "a.href", F.trim(F.regexp_replace("a.text", r"<[^>]*>", "")).alias("text"), urls.resolve(F.col("page_url"), F.col("a.href")).alias("link"))


def same_host(links: DataFrame) -> DataFrame:
    return links.where(urls.authority(F.col("link")) == urls.authority(F.col("page_url")))


def first_of_each(links: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Ordered dedupe: the first row of each key."""
    return links.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def category_links(links: DataFrame, key: str = "page_id", scan: int = 100, most: int = 10) -> DataFrame:
    """Category links of a page: of its first ``scan`` anchors those on its host, 1 or 2 deep, with a fit text; the first ``most``."""
    fit = (F.length("text") >= 3) & ~classify.any_of(F.lower("text"), NO_CATEGORY)
    rows = same_host(links.where(F.col("position") <= scan).where(fit)).where(urls.depth(F.col("link")).between(1, 2))
    return _capped(first_of_each(rows, [key, "link"], ["position"]), key, most)


def category_products(links: DataFrame, key: str = "page_id", most: int = 100) -> DataFrame:
    """Links on the page's host that are 3 deep or more."""
    rows = same_host(links).where(urls.depth(F.col("link")) >= 3)
    return _capped(first_of_each(rows, [key, "link"], ["position"]), key, most)


def homepage_products(links: DataFrame, key: str = "page_id", most: int = 100) -> DataFrame:
    """Cleaned product links of a page that are deep and end in a long hyphenated part."""
    marked = F.col("href").contains("/produto/") | F.col("href").contains("/product/") | F.lower("href").contains("/p/")
    rows = links.where(marked).withColumn("link", urls.canonical(F.col("link"))).where(classify.homepage_product(F.col("link")))
    return _capped(first_of_each(rows, [key, "link"], ["position"]), key, most)


def _capped(rows: DataFrame, key: str, most: int | None) -> DataFrame:
    """The first ``most`` of each page; all if it is None."""
    if most is None:
        return rows
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("position"))).where(F.col("__r") <= most).drop("__r")


def shop_categories(links: DataFrame, key: str = "page_id", most: int = 10) -> DataFrame:
    """The first ``most`` shop category links of a page, with their page size."""
    rows = links.withColumn("link", shop_category(F.col("link"))).where("link IS NOT NULL")
    return _capped(first_of_each(rows, [key, "link"], ["position"]), key, most)


def url_lines(lines: DataFrame, marker: str | None = "/produto/", most: int | None = None, order: str = "line") -> DataFrame:
    """``line, url``: the URLs of a list of lines (``line, value``) that hold the marker, the first ``most``."""
    rows = lines.select(order, F.trim("value").alias("url")).where(F.col("url") != "")
    rows = rows.where(F.col("url").contains(marker)) if marker else rows
    return rows.orderBy(order).limit(most) if most else rows


def shop_category(href: Column) -> Column:
    """Category link with its page size."""
    return F.when(href.contains("/shop/"), F.concat(urls.canonical(href), F.lit("?PS=100")))


def ends_in_p(href: Column) -> Column:
    return href.rlike(r"/p(\?.*)?$")


def numbered_lines(text: Column, site_only: bool = True) -> Column:
    """URLs of a report's lines: numbering dropped, product pages only."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^\d+\.\s*", ""))
    return F.filter(lines, lambda x: x.startswith("http") & (x.contains("/produto") | F.lit(not site_only)) & ~x.rlike(r"/produtos?/?$"))
