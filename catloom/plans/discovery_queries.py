"""Discovery of product links, sitemap rules, queues with retries, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catloom.functions import classify, normalize
from catloom.operators import consolidate, discovery, requests, structured
from catloom.plans.registry import query, table
from catloom.sources import fixtures, links, sitemaps

L = f"WITH l AS ({fixtures.ddb(fixtures.SHOP_LINKS_SQL)})"
CLEAN = "rtrim(split_part(split_part(link, '?', 1), '#', 1), '/')"
RANK = "CASE path WHEN '/' THEN 0 WHEN '/ferramentas/' THEN 1 WHEN '/casa/' THEN 2 WHEN '/cozinha/' THEN 3 END"


def shop_links(spark, sf):
    return fixtures.discovery_links(spark, sf)


def _shop_products(most):
    return f"""{L}, m AS (SELECT site, {RANK} AS rank, position, {CLEAN} AS link FROM l WHERE contains(href, '/produto/') AND {RANK} IS NOT NULL),
    f AS (SELECT site, link, min(rank * 1000 + position) AS place FROM m GROUP BY site, link), c AS (SELECT site, CAST(floor(place / 1000) AS INT) AS rank, count(*) AS n FROM f GROUP BY ALL),
    b AS (SELECT site, rank, coalesce(sum(n) OVER (PARTITION BY site ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
    k AS (SELECT f.site, link, place FROM f JOIN b ON f.site = b.site AND CAST(floor(place / 1000) AS INT) = b.rank WHERE before < {most} AND len(string_split(link, '/')) >= 5 AND contains(string_split(link, '/')[-1], '-') AND len(string_split(link, '/')[-1]) > 10)
    SELECT site, link, CAST(row_number() OVER (PARTITION BY site ORDER BY place) AS INT) AS turn FROM k QUALIFY turn <= {most}"""


@query("shop_discovery", _shop_products(12))
def shop_discovery(spark, sf):
    """Home page, then category pages while there are fewer than 12 products."""
    return discovery.shop_products(shop_links(spark, sf), most=12)


@query("homepage_products", f"""{L}, m AS (SELECT site, {CLEAN} AS link, min(position) AS position FROM l WHERE contains(href, '/produto/') GROUP BY ALL)
    SELECT site, link, position FROM m WHERE len(string_split(link, '/')) >= 5 AND contains(string_split(link, '/')[-1], '-') AND len(string_split(link, '/')[-1]) > 10 QUALIFY row_number() OVER (PARTITION BY site ORDER BY position) <= 8""")
def homepage_products(spark, sf):
    return links.homepage_products(shop_links(spark, sf), "site", most=8).select("site", "link", "position")


@query("category_products", f"""{L}, m AS (SELECT site, CASE WHEN p_partkey % 3 = 0 THEN 'https://other.example.org/a/b/c' ELSE replace(link, '/produto/', '/a/b/') END AS link, position FROM l),
    d AS (SELECT site, link, min(position) AS position FROM m WHERE link LIKE 'https://shop%' AND len(list_filter(string_split(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) >= 3 GROUP BY ALL)
    SELECT site, link, position FROM d QUALIFY row_number() OVER (PARTITION BY site ORDER BY position) <= 10""")
def category_products(spark, sf):
    link = F.when(F.col("p_partkey") % 3 == 0, "https://other.example.org/a/b/c").otherwise(F.expr("replace(link, '/produto/', '/a/b/')"))
    return links.category_products(shop_links(spark, sf).withColumn("link", link), "site", most=10).select("site", "link", "position")


@query("shop_category_pages", f"{L}, f AS (SELECT site, link, min(position) AS position, arg_min(text, position) AS text FROM l WHERE path = '/' AND contains(lower(href), '/categoria/') GROUP BY site, link) SELECT site, link, CASE WHEN trim(text) = '' THEN 'Produto' ELSE text END AS name FROM f QUALIFY row_number() OVER (PARTITION BY site ORDER BY position) <= 5")
def shop_category_pages(spark, sf):
    return discovery.category_pages(shop_links(spark, sf))


LIST = "WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS t FROM part)"
HOST = "'https://loja.example.com"


@query("navigation_links", f"{LIST} SELECT k AS page, unnest([{HOST}/a-' || t, {HOST}/b-' || t, {HOST}/categoria/' || t, {HOST}/produto/n-' || t]) AS link FROM p")
def navigation_links(spark, sf):
    return discovery.navigation_links(fixtures.list_pages(spark, sf), "key").select("page", "link")


@query(
    "navigation_links_wide",
    f"""WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS t FROM part)
    SELECT k AS page, link FROM (
      SELECT k, unnest(list_concat(
        [{HOST}/n-' || t, {HOST}/f-' || t, {HOST}/s-' || t || '/', {HOST}/w-' || t, {HOST}/cat-x/deep/path/' || t, {HOST}/u-' || t],
        CASE k % 3 WHEN 0 THEN [{HOST}/a/b-' || t || '/'] WHEN 1 THEN [] ELSE [{HOST}/m-' || t] END)) AS link FROM p)""",
)
def navigation_links_wide(spark, sf):
    """Navigation and short links, without utility, numbered and deep ones."""
    return discovery.navigation_links(fixtures.menu_pages(spark, sf), "key", rule="wide").select("page", "link")


@query(
    "list_page_routes",
    f"""{LIST} SELECT k AS page, {HOST}/produto/n-' || t AS link, 'product' AS label, 5 AS priority FROM p
    UNION ALL SELECT k, CASE k % 4 WHEN 0 THEN {HOST}/list/' || t || '?page=2' WHEN 1 THEN {HOST}/list/2' ELSE {HOST}/list/3' END, 'list', 10 FROM p WHERE k % 4 < 3""",
)
def list_page_routes(spark, sf):
    return discovery.list_page(fixtures.list_pages(spark, sf), "key")


@query(
    "link_triage",
    f"{L} SELECT kind, count(*) AS n, count(DISTINCT href) AS links FROM (SELECT href, CASE WHEN contains(href, '/produto/') THEN 'product' WHEN href LIKE '/%' THEN 'category' ELSE 'other' END AS kind FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN '#top' ELSE href END AS href FROM l)) GROUP BY kind",
)
def link_triage(spark, sf):
    href = F.when(F.col("p_partkey") % 9 == 0, "#top").otherwise(F.col("href"))
    rows = shop_links(spark, sf).select(href.alias("href"), discovery.triage(href).alias("kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("href").alias("links"))


FORM = r"""c AS (SELECT site, count(*) AS n, count(*) FILTER (regexp_matches(url, '/produto/[^/]+-\d+/?$')) AS a, count(*) FILTER (regexp_matches(url, '/produto/[^/]+/?$')) AS b, count(*) FILTER (regexp_matches(url, '/p/[^/]+/\d+')) AS d, count(*) FILTER (regexp_matches(url, '/[^/]+/[^/]+-\d+/?$')) AS e FROM u GROUP BY site),
 f AS (SELECT site, CASE WHEN a >= 0.7 * n THEN 'number' WHEN b >= 0.7 * n THEN 'slug' WHEN d >= 0.7 * n THEN 'p' WHEN e >= 0.7 * n THEN 'level2' END AS form FROM c WHERE n >= 5)"""
MADE_URL = "CASE WHEN CAST(floor(p_partkey / 40) AS INT) % 4 = 0 THEN link WHEN CAST(floor(p_partkey / 40) AS INT) % 4 = 1 THEN replace(link, '/produto/', '/casa/') WHEN CAST(floor(p_partkey / 40) AS INT) % 4 = 2 THEN replace(link, '/produto/', '/p/') || '/' || CAST(p_partkey AS STRING) ELSE replace(link, '/produto/', '/a/b/') END"


@query(
    "discovery_by_form",
    rf"""{L}, u AS (SELECT site, p_partkey, {MADE_URL} AS url FROM l), {FORM}
    SELECT p_partkey, f.form, CASE WHEN f.form IS NOT NULL THEN CASE WHEN CASE f.form WHEN 'number' THEN regexp_matches(url, '/produto/[^/]+-\d+/?$') WHEN 'slug' THEN regexp_matches(url, '/produto/[^/]+/?$') WHEN 'p' THEN regexp_matches(url, '/p/[^/]+/\d+') ELSE regexp_matches(url, '/[^/]+/[^/]+-\d+/?$') END THEN 'product' ELSE 'other' END
     WHEN d >= 3 OR regexp_matches(lower(url), '/produto/|/product/|/p/') THEN 'product' WHEN d >= 1 THEN 'category' ELSE 'other' END AS kind
    FROM (SELECT *, len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS d FROM u) AS u LEFT JOIN f ON u.site = f.site""",
)
def discovery_by_form(spark, sf):
    rows = shop_links(spark, sf).select("site", "p_partkey", F.expr(MADE_URL).alias("url"))
    forms = discovery.shop_form(rows)
    return discovery.discovered(rows).join(forms, "site", "left").select("p_partkey", "form", "kind")


@query(
    "real_slugs",
    rf"""{L}, s AS (SELECT p_partkey, link, trim(regexp_extract(link, '/produto/([^?#]*)', 1), '/') AS slug FROM l)
    SELECT p_partkey, contains(link, '/produto/') AND contains(slug, '-') AND (regexp_matches(slug, '\d') OR len(slug) > 15) AND contains(string_split(slug, '/')[-1], '-') AS real FROM s""",
)
def real_slugs(spark, sf):
    return shop_links(spark, sf).select("p_partkey", discovery.real_slug(F.col("link")).alias("real"))


@query("corrected_samples", f"{L}, s AS (SELECT DISTINCT replace(link, '/produto/', '/') AS url FROM l WHERE p_partkey % 2 = 0), c AS (SELECT DISTINCT link AS checked_url FROM l WHERE p_partkey % 3 = 0 AND contains(link, '/produto/')) SELECT url, checked_url FROM s JOIN c ON replace(checked_url, '/produto/', '/') = url")
def corrected_samples(spark, sf):
    rows = shop_links(spark, sf)
    samples = rows.where("p_partkey % 2 = 0").select(F.expr("replace(link, '/produto/', '/')").alias("url"))
    return discovery.corrected(samples, rows.where("p_partkey % 3 = 0").select(F.col("link").alias("url")))


@query(
    "cached_verdicts",
    f"""{L}, c AS (SELECT link AS url, arg_max(p_partkey % 2 = 0, p_partkey) AS valid, arg_max(CASE WHEN p_partkey % 4 = 0 THEN 'https://new.example.com/' || CAST(p_partkey AS VARCHAR) ELSE '' END, p_partkey) AS corrected FROM l WHERE p_partkey % 3 <> 0 GROUP BY link)
    SELECT p_partkey, c.url IS NOT NULL AS known, valid, CASE WHEN coalesce(corrected, '') = '' THEN link ELSE corrected END AS final_url FROM l LEFT JOIN c ON link = c.url""",
)
def cached_verdicts(spark, sf):
    rows = shop_links(spark, sf)
    k = F.col("p_partkey")
    cache = rows.where("p_partkey % 3 <> 0").select(F.col("link").alias("url"), (k % 2 == 0).alias("valid"), F.when(k % 4 == 0, F.concat(F.lit("https://new.example.com/"), k.cast("string"))).alias("corrected"), k.alias("seen"))
    return discovery.with_verdicts(rows, cache, "link").select("p_partkey", "known", "valid", "final_url")


@query("url_lists", "SELECT p_partkey AS line, 'https://loja.example.com/produto/' || CAST(p_partkey AS VARCHAR) AS url FROM part WHERE p_partkey % 3 = 0")
def url_lists(spark, sf):
    k = F.col("p_partkey")
    value = F.when(k % 3 == 0, F.concat(F.lit("  https://loja.example.com/produto/"), k.cast("string"), F.lit(" "))).when(k % 3 == 1, "https://loja.example.com/sobre").otherwise("")
    return links.url_lines(table(spark, sf, "part").select(k.alias("line"), value.alias("value")))


@query("report_urls", "SELECT p_partkey AS key, 1 + CAST(p_partkey % 2 = 0 AS INT) AS n, 'https://loja.example.com/produto/a-' || CAST(p_partkey AS VARCHAR) AS first FROM part")
def report_urls(spark, sf):
    k = F.col("p_partkey").cast("string")
    other = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("12. https://loja.example.com/produtos/b-"), k)).otherwise("12. https://loja.example.com/produtos/")
    text = F.concat(F.lit("Report\n 1. https://loja.example.com/produto/a-"), k, F.lit("\nhttps://loja.example.com/sobre\n"), other)
    found = links.numbered_lines(text)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.size(found).alias("n"), F.try_element_at(found, F.lit(1)).alias("first"))


@query(
    "shop_page_links",
    f"{L}, c AS (SELECT site, CASE WHEN p_partkey % 2 = 0 THEN rtrim(split_part(replace(link, '/produto/', '/shop/'), '?', 1), '/') || '?PS=100' END AS link, position, regexp_matches(href, '/p(\\?.*)?$') AS in_p FROM l), f AS (SELECT site, link, min(position) AS position FROM c WHERE contains(link, '/shop/') GROUP BY site, link) SELECT site, link FROM f QUALIFY row_number() OVER (PARTITION BY site ORDER BY position) <= 10",
)
def shop_page_links(spark, sf):
    rows = shop_links(spark, sf).withColumn("link", F.when(F.col("p_partkey") % 2 == 0, F.expr("replace(link, '/produto/', '/shop/')")))
    return links.shop_categories(rows, "site").select("site", "link")


@query("ending_in_p", "SELECT p_partkey AS key, p_partkey % 4 < 2 AS product FROM part")
def ending_in_p(spark, sf):
    tail = F.element_at(F.array(F.lit("/x/p"), F.lit("/x/p?sku=1"), F.lit("/x/p/1"), F.lit("/xp")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), links.ends_in_p(tail).alias("product"))


INDEX = "'<sitemapindex>' || {} || '</sitemapindex>'"


def index_bodies(spark, sf):
    """``url, body``: an index for each supplier, its children, and product sitemaps that no index names."""
    k = F.col("s_suppkey").cast("string")
    site = F.concat(F.lit("https://s"), k, F.lit(".example.com"))
    loc = lambda u: F.concat(F.lit("<loc>"), u, F.lit("</loc>"))
    s = table(spark, sf, "supplier")
    named = F.when(F.col("s_suppkey") % 3 == 0, F.concat(loc(F.concat(site, F.lit("/sitemap/product-0.xml"))), loc(F.concat(site, F.lit("/sitemap/product-1.xml"))), loc(F.concat(site, F.lit("/sitemap/product-7.xml"))), loc(F.concat(site, F.lit("/sitemap/pages.xml"))))).otherwise(
        F.concat(loc(F.concat(site, F.lit("/pages.xml"))), loc(F.concat(site, F.lit("/other.xml"))))
    )
    index = s.select(F.concat(site, F.lit("/sitemap.xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), named, F.lit("</sitemapindex>")).alias("body"))
    leaf = lambda path: s.select(F.concat(site, F.lit(path)).alias("url"), F.concat(F.lit("<urlset>"), loc(F.concat(site, F.lit(path), F.lit("/x-"), k)), loc(site), F.lit("</urlset>")).alias("body"))
    return index.union(leaf("/pages.xml")).union(leaf("/other.xml")).union(leaf("/sitemap/product-2.xml")).union(leaf("/sitemap/product-0.xml"))


SITE = "'https://s' || CAST(s_suppkey AS VARCHAR) || '.example.com'"


@query("sitemap_product_children", f"SELECT {SITE} || '/sitemap.xml' AS root, {SITE} || '/sitemap/product-' || unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['1', '7'] ELSE ['2'] END) || '.xml' AS child FROM supplier")
def sitemap_product_children(spark, sf):
    return sitemaps.product_children(index_bodies(spark, sf))


@query(
    "sitemap_first_child",
    f"""WITH r AS (SELECT {SITE} AS site, CAST(s_suppkey AS VARCHAR) AS k, s_suppkey FROM supplier),
    l AS (SELECT site, k, s_suppkey, unnest(['/pages.xml', '/other.xml', '/sitemap/product-2.xml', '/sitemap/product-0.xml']) AS path FROM r)
    SELECT site || path AS root, site || path || '/x-' || k AS loc FROM l UNION ALL SELECT site || '/sitemap.xml', site || '/pages.xml/x-' || k FROM r WHERE s_suppkey % 3 <> 0 UNION ALL SELECT site || '/sitemap.xml', site || '/sitemap/product-0.xml/x-' || k FROM r WHERE s_suppkey % 3 = 0""",
)
def sitemap_first_child(spark, sf):
    return sitemaps.first_child(index_bodies(spark, sf))


@query("sitemap_starts", f"""SELECT s_suppkey AS key, {SITE} || unnest(['/sitemap.xml', '/sitemap_index.xml', '/sitemap-products.xml', '/product-sitemap.xml', '/robots.txt']) AS url, 2 AS in_robots, 1 AS on_domain FROM supplier""")
def sitemap_starts(spark, sf):
    k = F.col("s_suppkey").cast("string")
    site = F.concat(F.lit("https://s"), k, F.lit(".example.com"))
    robots = F.concat(F.lit("User-agent: *\nSitemap: "), site, F.lit("/a.xml \nsitemap:  /b.xml"))
    body = F.concat(F.lit("<loc>"), site, F.lit("/x</loc><loc>https://cdn.example.org/y</loc>"))
    counts = F.size(sitemaps.robots_lines(robots)).alias("in_robots"), F.size(sitemaps.locs_on_domain(body, F.substring_index(site, "//", -1))).alias("on_domain")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.explode(sitemaps.start_urls(site)).alias("url"), *counts)


QUEUE = """WITH q AS (SELECT o_custkey AS url, arg_min(o_orderkey % 3, o_orderkey) AS p, min(o_orderkey) AS s FROM orders GROUP BY o_custkey),
  t AS (SELECT url, p, s, unnest(range(0, 4)) AS attempt FROM q), o AS (SELECT *, (url + attempt * 7) % 5 = 0 AS ok FROM t),
  d AS (SELECT url, min(attempt) AS done FROM o WHERE ok GROUP BY url), r AS (SELECT o.*, ok OR attempt = 3 AS last FROM o LEFT JOIN d ON o.url = d.url WHERE attempt <= least(coalesce(done, 3), 3))"""


def queue(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("url"), (F.col("o_orderkey") % 3).alias("p"), F.col("o_orderkey").alias("s"))
    outcomes = orders.select("url").distinct().select("url", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt")).withColumn("ok", (F.col("url") + F.col("attempt") * 7) % 5 == 0)
    return requests.retried_queue(orders, outcomes, "url", "p", "s", 3)


@query("queue_with_retries", f"{QUEUE} SELECT url, attempt, ok, last, CAST(row_number() OVER (ORDER BY p DESC, attempt, s) AS INT) AS turn FROM r")
def queue_with_retries(spark, sf):
    return queue(spark, sf).select("url", "attempt", "ok", "last", "turn")


@query("queue_counters", f"{QUEUE} SELECT count(*) FILTER (ok) AS completed, count(*) FILTER (NOT ok AND last) AS failed, count(*) FILTER (NOT ok AND NOT last) AS retried FROM r")
def queue_counters(spark, sf):
    return requests.queue_counters(queue(spark, sf))


@query(
    "batch_summaries",
    """WITH r AS (SELECT user_id, event_id, event_type <> 'error' AS ok, CAST(event_id % 1000 AS BIGINT) AS size, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 10) AS INT) AS batch FROM events),
    s AS (SELECT user_id, batch, count(*) AS requests, count(*) FILTER (ok) AS succeeded, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY ALL) SELECT *, CAST(sum(bytes) OVER (PARTITION BY user_id ORDER BY batch) AS BIGINT) AS total_bytes FROM s""",
)
def batch_summaries(spark, sf):
    log = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 1000).cast("long").alias("size"))
    return requests.batch_summaries(log, ["user_id"], ["event_id"], "size")


@query(
    "text_forms",
    """SELECT p_partkey AS key, CASE p_partkey % 5 WHEN 0 THEN '1.234,56' WHEN 1 THEN '1234,5' WHEN 2 THEN '12,50' WHEN 3 THEN '1.234' END AS kept, CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS filled, '12.3%' AS share, CAST(p_size AS INT) AS quantity FROM part""",
)
def text_forms(spark, sf):
    k = F.col("p_partkey")
    raw = F.element_at(F.array(*map(F.lit, ("R$ 1.234,56", "1234,5", "R$12.50", "1.234", "free"))), (k % 5 + 1).cast("int"))
    filled = normalize.first_filled(F.when(k % 3 == 0, "a").otherwise("  "), F.when(k % 3 == 1, "b").when(k % 3 == 2, ""))
    return table(spark, sf, "part").select(k.alias("key"), normalize.kept_price_text(raw).alias("kept"), filled.alias("filled"), normalize.percent_text(F.lit(12.34)).alias("share"), normalize.whole_quantity(F.concat(F.col("p_size").cast("string"), F.lit(",0"))).alias("quantity"))


@query("page_frameworks", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Next.js,React' WHEN 1 THEN 'Vue.js' WHEN 2 THEN 'Angular,jQuery' ELSE '' END AS frameworks FROM pages")
def page_frameworks(spark, sf):
    marks = F.element_at(F.array(*map(F.lit, ('<div data-reactroot></div><script id="__NEXT_DATA__">', "<p data-v-1></p>", '<app ng-version="1"><script src="jquery-3.min.js"></script>', ""))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", F.array_join(classify.frameworks(F.concat(F.col("html"), marks)), ",").alias("frameworks"))


@query("isolated_platforms", "SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN repeat('e', 100) END AS error, s_suppkey % 3 <> 0 AS succeeded FROM supplier")
def isolated_platforms(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 3 == 0, F.repeat(F.lit("e"), 150)).alias("error"))
    return consolidate.isolated(rows)


@query("dropped_failures", "SELECT s_suppkey AS key FROM supplier WHERE s_suppkey % 3 <> 0")
def dropped_failures(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 3 == 0, "e").alias("error"))
    return consolidate.without_failures(rows).select("key")


@query("api_shapes", "SELECT p_partkey AS key, CASE p_partkey % 5 WHEN 0 THEN 'shopify' WHEN 1 THEN 'vtex' WHEN 2 THEN 'woocommerce' WHEN 3 THEN 'magento' END AS shape, CAST(ceil(800.0 / (1 + p_size)) AS INT) AS pages FROM part")
def api_shapes(spark, sf):
    bodies = ('{"products":[{"variants":[]}]}', '[{"productId":"1","items":[]}]', '[{"prices":{}}]', '{"data":{"products":{"items":[]}}}', "<html>")
    body = F.element_at(F.array(*map(F.lit, bodies)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), structured.api_shape(body).alias("shape"), structured.pages_needed(F.lit(800), 1 + F.col("p_size")).alias("pages"))


@query("api_offer_path", "SELECT p_partkey AS key, p_name AS name, CAST(p_retailprice AS DECIMAL(18,2)) AS price, CASE WHEN p_partkey % 3 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) + 50 AS DECIMAL(18,2)) END AS listed, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS stock_qty FROM part")
def api_offer_path(spark, sf):
    """The nested offer of a catalogue's search response, with missing list prices and quantities."""
    price = F.col("p_retailprice").cast("decimal(18,2)")
    offer = F.struct(price.alias("Price"), F.when(F.col("p_partkey") % 3 == 0, (price + F.lit(50)).cast("decimal(18,2)")).alias("ListPrice"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("AvailableQuantity"))
    body = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("name"), F.array(F.struct(offer.alias("commertialOffer"))).alias("sellers"))).alias("items")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), structured.api_product(body).alias("r")).select("key", "r.name", "r.price", "r.listed", "r.stock_qty")
