"""Finding product links: shop pages with their categories, list pages, learned forms, checked samples.

Frames have a row for each link; a shop is a key like any other, so all shops
run in one job. Ranks are over one shop's pages or links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catloom.functions import classify, urls
from catloom.functions.html import anchors, around, bound, with_tags

#: Category pages that are asked when a shop's home page has too few products, in this order (fixed values).
CATEGORY_PATHS = ("/ferramentas/", "/casa/", "/cozinha/", "/banheiro/", "/construcao/", "/eletrica/", "/hidraulica/")
#: Link words and class words of navigation, and the elements it stands in (fixed values).
NAV_PATTERNS = ("categoria", "categorias", "/c/", "/cat/", "category", "produto", "produtos", "ver-tudo", "ver%20mais")
NAV_CLASSES = r"(?i)(nav|menu|categoria|category|cat|sidebar|list|menu__|menu-)"
NAV_TAGS = ("nav", "header", "aside", "footer")
#: The wide rule's words of links and texts that fit, and of links that never do (fixed values).
WIDE_PATHS = ("/categoria", "/cat", "/c/", "category")
WIDE_WORDS = ("categoria", "móveis", "decoração", "brinquedos", "beleza", "ferramentas", "utilidades")
UTILITY_PATHS = ("/login", "/register", "/account", "/cart", "/checkout", "/politica", "/termos", "/contato", "/sobre")
#: Forms of product URLs; the first that ``SHARE`` of a shop's links have is its form (fixed values).
FORMS = ((r"/produto/[^/]+-\d+/?$", "number"), (r"/produto/[^/]+/?$", "slug"), (r"/p/[^/]+/\d+", "p"), (r"/[^/]+/[^/]+-\d+/?$", "level2"))
SHARE = 0.7


def product_href(href: Column) -> Column:
    return href.contains("/produto/") | href.contains("/product/") | F.lower(href).contains("/p/")


def page_rank(path: Column) -> Column:
    """0 for a home page, 1 to 7 for the category pages, null for others."""
    out = F.when(path.isin("", "/"), 0)
    for k, p in enumerate(CATEGORY_PATHS):
        out = out.when(path == p, k + 1)
    return out


def shop_products(links: DataFrame, site: str = "site", most: int = 100) -> DataFrame:
    """``site, link``: cleaned product links of a shop's home page, and of its category pages in order while there are fewer than ``most``.

    ``links`` has ``site, page_url, position, href, link``. Links that are no
    real product are dropped at the end, and the first ``most`` stay.
    """
    rank = page_rank(urls.path(F.col("page_url")))
    rows = links.where(product_href(F.col("href"))).select(site, rank.alias("rank"), "position", urls.canonical(F.col("link")).alias("link")).where("rank IS NOT NULL")
    first = rows.groupBy(site, "link").agg(F.min(F.struct("rank", "position")).alias("at"))
    counts = first.groupBy(site, "at.rank").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(site).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    asked = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < most).select(site, "rank")
    kept = first.select(site, "link", "at.rank", "at.position").join(asked, [site, "rank"]).where(classify.homepage_product(F.col("link")))
    turn = F.row_number().over(Window.partitionBy(site).orderBy("rank", "position"))
    return kept.withColumn("turn", turn).where(F.col("turn") <= most).select(site, "link", "turn")


def category_pages(links: DataFrame, site: str = "site", most: int = 5) -> DataFrame:
    """The first ``most`` category links of each shop's home page, with the anchor's text or ``Produto``."""
    rows = links.where(page_rank(urls.path(F.col("page_url"))) == 0).where(classify.category_like(urls.path(F.col("link"))) & ~product_href(F.col("href")))
    first = rows.groupBy(site, "link").agg(F.min("position").alias("position"), F.min_by("text", "position").alias("text"))
    turn = F.row_number().over(Window.partitionBy(site).orderBy("position"))
    return first.withColumn("turn", turn).where(F.col("turn") <= most).select(site, "link", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("Produto")).alias("name"))


def navigation_links(pages: DataFrame, key: str, url: str = "url", html: str = "html", rule: str = "words") -> DataFrame:
    """``page, link, position``: links on the page's host that may lead to categories.

    ``words``: links that stand in navigation, have its class or id, or a
    category's words. ``wide``: besides, short paths that end in a slash and
    texts of one to four words, but no utility, numbered or deep links.
    """
    lists = with_tags(pages.select(F.col(key).alias("page"), F.col(url).alias("page_url"), F.col(html).alias("__html")), "__html").drop("__html")
    rows = anchors(lists).withColumn("href", F.trim("href"))
    rows = rows.withColumn("link", urls.resolve(F.col("page_url"), F.col("href"))).where(urls.authority(F.col("link")) == urls.authority(F.col("page_url")))
    href, text = F.lower("href"), F.lower(F.trim("text"))
    known = F.exists("inside", lambda a: a.isin(*NAV_TAGS)) | F.col("class_id").rlike(NAV_CLASSES)
    if rule == "words":
        kept = known | classify.any_of(href, NAV_PATTERNS) | classify.any_of(text, NAV_PATTERNS)
    elif rule == "wide":
        parts = F.size(F.split(F.regexp_replace("href", "^/+|/+$", ""), "/"))
        short = F.when(text != "", F.size(F.split(text, r"\s+"))).otherwise(0)
        fits = (F.col("href").endswith("/") & (parts <= 2)) | ((short <= 4) & (F.length(text) > 3)) | classify.any_of(href, WIDE_PATHS) | classify.any_of(text, WIDE_WORDS)
        kept = (known | fits) & ~(classify.any_of(href, UTILITY_PATHS) | F.col("href").rlike(r"/\d+/") | (parts > 4))
    else:
        raise ValueError(rule)
    return rows.where(kept).groupBy("page", "link").agg(F.min("pos").alias("position"))


def list_page(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """``page, link, label, priority``: product links of a list page, and its first link to a next page."""
    tags = with_tags(pages.select(F.col(key).alias("page"), F.col(url).alias("url"), F.col(html).alias("__html")), "__html")
    links = F.filter("tags", lambda t: (t["tag"] == "a") & t["attrs"]["href"].isNotNull())

    def classed(t: Column, word: str) -> Column:
        return F.array_contains(F.split(F.coalesce(t["attrs"]["class"], F.lit("")), r"\s+"), word)

    def labelled(lists: Column, t: Column) -> Column:
        following = (F.coalesce(t["attrs"]["rel"], F.lit("")) == "next") | classed(t, "next-page") | (classed(t, "next") & (F.size(around(lists, t)) > 0))
        label = F.when(t["attrs"]["href"].contains("/produto/"), "product").when(following, "list")
        return F.struct(label.alias("label"), t["pos"].alias("pos"), t["attrs"]["href"].alias("href"))

    found = bound(F.filter("tags", lambda t: classed(t, "pagination")), lambda lists: F.transform(links, lambda t: labelled(lists, t)))
    rows = tags.select("page", "url", F.inline(found)).where("label IS NOT NULL")
    rows = rows.select("page", "label", "pos", urls.resolve(F.col("url"), F.col("href")).alias("link"))
    first = rows.where("label = 'list'").groupBy("page").agg(F.min_by("link", "pos").alias("link")).select("page", "link", F.lit("list").alias("label"), F.lit(10).alias("priority"))
    return rows.where("label = 'product'").select("page", "link", "label", F.lit(5).alias("priority")).distinct().union(first)


def triage(href: Column) -> Column:
    """``product``, ``category`` (a path on the same site) or ``other``."""
    return F.when(href.contains("/produto/"), "product").when(href.startswith("/"), "category").otherwise("other")


def shop_form(links: DataFrame, site: str = "site", url: str = "url", least: int = 5) -> DataFrame:
    """``site, form``: the first of ``FORMS`` that 70 % of a shop's links have; shops of fewer than ``least`` links have none."""
    counts = links.groupBy(site).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(url).rlike(p)).alias(f"h{k}") for k, (p, _) in enumerate(FORMS)])
    form = F.coalesce(*[F.when(F.col(f"h{k}") >= F.col("n") * SHARE, name) for k, (_, name) in enumerate(FORMS)])
    return counts.where(F.col("n") >= least).select(site, form.alias("form")).where("form IS NOT NULL")


def discovered(links: DataFrame, site: str = "site", url: str = "url", markers: tuple[str, ...] = ("/produto/", "/product/", "/p/")) -> DataFrame:
    """``links`` with ``kind`` by shop: in a shop with a form the links that have it are products; else links 3 deep or with a marker are, and those 1 or 2 deep categories."""
    forms = shop_form(links, site, url).withColumnRenamed("form", "__form")
    rows = links.join(forms, site, "left")
    hit = F.lit(False)
    for pattern, name in FORMS:
        hit = F.when(F.col("__form") == name, F.col(url).rlike(pattern)).otherwise(hit)
    depth = urls.depth(F.col(url))
    marked = classify.any_of(F.lower(url), markers)
    plain = F.when((depth >= 3) | marked, "product").when(depth >= 1, "category").otherwise("other")
    return rows.withColumn("kind", F.when(F.col("__form").isNotNull(), F.when(hit, "product").otherwise("other")).otherwise(plain)).drop("__form")


def real_slug(url: Column) -> Column:
    """A product page by its slug: hyphens, a digit or over 15 characters, and several words in its last part."""
    slug = F.trim(F.regexp_extract(url, r"/produto/([^?#]*)", 1), F.lit("/"))
    long = slug.rlike(r"\d") | (F.length(slug) > 15)
    return url.contains("/produto/") & slug.contains("-") & long & F.element_at(F.split(slug, "/"), -1).contains("-")


def unprefixed(url: Column) -> Column:
    """A URL without its product prefixes; corrected URLs meet their samples on it."""
    out = url
    for p in ("/produto/", "/product/", "/p/"):
        out = F.replace(out, F.lit(p), F.lit("/"))
    return out


def corrected(samples: DataFrame, checked: DataFrame, url: str = "url") -> DataFrame:
    """``url, checked_url``: samples that were found under a product prefix they lack."""
    own = checked.select(F.col(url).alias("checked_url")).where(product_href(F.col("checked_url"))).withColumn("__key", unprefixed(F.col("checked_url")))
    return samples.select(F.col(url).alias("url")).distinct().join(own, F.col("url") == F.col("__key")).select("url", "checked_url").distinct()


def with_verdicts(links: DataFrame, cache: DataFrame, url: str = "url") -> DataFrame:
    """``links`` with ``known, valid, final_url`` from a cache of verdicts ``(url, valid, corrected)``, the latest of each URL by ``seen``."""
    latest = cache.groupBy(F.col("url").alias("__u")).agg(F.max_by(F.struct("valid", "corrected"), "seen").alias("__v"))
    rows = links.join(latest, F.col(url) == F.col("__u"), "left")
    return rows.select(*links.columns, F.col("__v").isNotNull().alias("known"), F.col("__v.valid").alias("valid"), F.coalesce("__v.corrected", url).alias("final_url"))
