"""URL and link queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catloom.functions import classify, urls
from catloom.plans.registry import query, table
from catloom.sources import fixtures, links

SAMPLES = f"WITH u AS ({fixtures.ddb(fixtures.URLS_SQL)})"
#: Authority, path and segments of an oracle's ``url``.
AUTH = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
SEGS = f"list_filter(string_split({PATH}, '/'), lambda s: s <> '')"
TITLE = r"coalesce(list_aggregate(list_transform(regexp_extract_all(lower({x}), '(\p{{L}}+|[^\p{{L}}]+)'), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ''), '')"


def samples(spark, sf):
    return fixtures.url_samples(spark, sf)


@query("url_canonical", f"{SAMPLES} SELECT pos, rtrim(split_part(split_part(url, '?', 1), '#', 1), '/') AS canonical, lower(rtrim(trim(url), '/')) AS compare_key, rtrim(split_part(url, '?', 1), '/') AS no_query FROM u")
def url_canonical(spark, sf):
    return samples(spark, sf).select("pos", urls.canonical(F.col("url")).alias("canonical"), urls.compare_key(F.col("url")).alias("compare_key"), urls.canonical(F.col("url"), cut_fragment=False).alias("no_query"))


@query("url_host_depth", f"{SAMPLES} SELECT pos, {AUTH} AS host, CAST(len({SEGS}) AS INT) AS depth, CAST(len(url) - len(replace(url, '/', '')) AS INT) AS slashes FROM u")
def url_host_depth(spark, sf):
    u = F.col("url")
    return samples(spark, sf).select("pos", urls.authority(u).alias("host"), urls.depth(u).alias("depth"), urls.slash_count(u).alias("slashes"))


@query(
    "url_slug_name",
    f"""{SAMPLES}, n AS (SELECT pos, string_split(url, '/') AS parts FROM u)
    SELECT pos, {TITLE.format(x="replace(parts[-1], '-', ' ')")} AS name,
           {TITLE.format(x="replace(CASE WHEN parts[-1] = 'p' THEN parts[-2] ELSE parts[-1] END, '-', ' ')")} AS name_before_p,
           {TITLE.format(x="replace(CASE WHEN len(parts[-2]) >= 3 THEN parts[-2] ELSE parts[-1] END, '-', ' ')")} AS name_second_last
    FROM n""",
)
def url_slug_name(spark, sf):
    u = F.col("url")
    return samples(spark, sf).select("pos", urls.slug_name(u).alias("name"), urls.slug_name(u, "before_p").alias("name_before_p"), urls.slug_name(u, "second_last").alias("name_second_last"))


@query("url_trailing_id", rf"{SAMPLES} SELECT pos, nullif(regexp_extract(url, '(\d+)/?$', 1), '') AS trailing_id, nullif(regexp_extract(url, '-(\d+)$', 1), '') AS hyphen_id FROM u")
def url_trailing_id(spark, sf):
    return samples(spark, sf).select("pos", urls.trailing_id(F.col("url")).alias("trailing_id"), urls.hyphen_id(F.col("url")).alias("hyphen_id"))


@query(
    "url_next_page",
    rf"""{SAMPLES}, p AS (SELECT pos, url, try_cast(nullif(regexp_extract(url, '[?&]page=(\d+)', 1), '') AS INT) AS page FROM u)
    SELECT pos, CASE WHEN page IS NOT NULL THEN regexp_replace(url, '([?&]page=)\d+', '\1' || CAST(page + 1 AS VARCHAR)) END AS next_page,
           array_to_string(list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(url, '[?&]page=(\d+)', 1), regexp_extract_all(url, '/p/(\d+)', 1)), lambda x: CAST(x AS BIGINT)))), ',') AS pages FROM p""",
)
def url_next_page(spark, sf):
    u = F.col("url")
    return samples(spark, sf).select("pos", urls.next_page(u).alias("next_page"), F.array_join(urls.page_numbers(u).cast("array<string>"), ",").alias("pages"))


@query(
    "url_variations",
    f"""{SAMPLES}, v AS (SELECT pos, url, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS root, ltrim({PATH}, '/') AS rest FROM u),
    l AS (SELECT pos, list_value(url, root || '/produto/' || rest, root || '/product/' || rest, root || '/p/' || rest) AS all_urls FROM v),
    e AS (SELECT pos, unnest(all_urls) AS variation, generate_subscripts(all_urls, 1) AS k FROM l)
    SELECT pos, variation, CAST(row_number() OVER (PARTITION BY pos ORDER BY min(k)) AS INT) AS turn FROM e GROUP BY pos, variation""",
)
def url_variations(spark, sf):
    return samples(spark, sf).select("pos", F.posexplode(urls.variations(F.col("url"))).alias("turn", "variation")).withColumn("turn", F.col("turn") + 1)


@query(
    "url_prefix",
    f"""{SAMPLES} SELECT pos, CASE WHEN contains({PATH}, '/produto/') THEN url ELSE regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/produto' || {PATH} END AS fixed FROM u""",
)
def url_prefix(spark, sf):
    return samples(spark, sf).select("pos", urls.with_prefix(F.col("url"), F.lit("produto")).alias("fixed"))


@query(
    "url_crawlable",
    rf"""{SAMPLES} SELECT pos, {AUTH} = 'loja.example.com' AND NOT contains(url, '#') AND NOT regexp_matches(lower(url), '\.(jpg|png|pdf|zip|css|js)$')
    AND NOT regexp_matches(lower(url), 'login|cadastro|cart|checkout|conta|minha-conta') AS crawlable FROM u""",
)
def url_crawlable(spark, sf):
    return samples(spark, sf).select("pos", urls.crawlable(F.col("url"), F.lit("loja.example.com")).alias("crawlable"))


LINKS = r"""WITH raw AS (SELECT page_id, url AS page_url, regexp_extract_all(html, '(?s)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>', 1) AS hrefs,
    regexp_extract_all(html, '(?s)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>', 2) AS texts FROM pages),
  one AS (SELECT page_id, page_url, unnest(hrefs) AS href, unnest(texts) AS text, generate_subscripts(hrefs, 1) AS position FROM raw),
  l AS (SELECT page_id, page_url, CAST(position AS INT) AS position, href, trim(regexp_replace(text, '<[^>]*>', '', 'g')) AS text,
    CASE WHEN href LIKE '%://%' THEN href WHEN href LIKE '/%' THEN regexp_extract(page_url, '^[a-z]+://[^/?#]*', 0) || href
         WHEN href = '' THEN page_url WHEN href LIKE '#%' THEN split_part(page_url, '#', 1) || href
         ELSE regexp_extract(page_url, '^[a-z]+://[^?#]*/', 0) || href END AS link FROM one),
  s AS (SELECT *, regexp_extract(link, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(page_url, '^[a-z]+://([^/?#]*)', 1) AS page_host,
    CAST(len(list_filter(string_split(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS INT) AS depth FROM l)"""


def page_links_of(spark, sf):
    return links.page_links(table(spark, sf, "pages"))


@query("page_links", f"{LINKS} SELECT page_id, position, href, text, link FROM s")
def page_links(spark, sf):
    return page_links_of(spark, sf).drop("page_url")


@query("page_links_same_host", f"{LINKS} SELECT page_id, position, link FROM s WHERE host = page_host")
def page_links_same_host(spark, sf):
    return links.same_host(page_links_of(spark, sf)).select("page_id", "position", "link")


@query("links_dedupe_first", f"{LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, position) AS r FROM s) SELECT link, page_id, position FROM r WHERE r = 1")
def links_dedupe_first(spark, sf):
    return links.first_of_each(page_links_of(spark, sf), ["link"], ["page_id", "position"]).select("link", "page_id", "position")


@query(
    "links_examples_by_depth",
    f"""{LINKS}, d AS (SELECT DISTINCT depth, link FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY link) AS r, count(*) OVER (PARTITION BY depth) AS n FROM d)
    SELECT depth, max(n) AS links, string_agg(link, ' ' ORDER BY link) AS examples FROM r WHERE r <= 5 GROUP BY depth""",
)
def links_examples_by_depth(spark, sf):
    d = page_links_of(spark, sf).select(urls.depth(F.col("link")).alias("depth"), "link").distinct()
    from pyspark.sql import Window

    own = Window.partitionBy("depth")
    r = d.withColumn("r", F.row_number().over(own.orderBy("link"))).withColumn("n", F.count(F.lit(1)).over(own))
    return r.where("r <= 5").groupBy("depth").agg(F.max("n").alias("links"), F.array_join(F.array_sort(F.collect_list("link")), " ").alias("examples"))


@query(
    "site_summary",
    f"""{LINKS}, p AS (SELECT {AUTH} AS site, count(DISTINCT rtrim(split_part(split_part(url, '?', 1), '#', 1), '/')) AS pages FROM pages GROUP BY 1),
    k AS (SELECT page_host AS site, count(*) AS links, count(*) FILTER (host = page_host) AS inner_links, count(*) FILTER (regexp_matches(lower(link), '/produto/|/product/|/produtos/|/item/|/p/')) AS product_links, max(depth) AS deepest FROM s GROUP BY 1)
    SELECT p.site, pages, coalesce(links, 0) AS links, coalesce(inner_links, 0) AS inner_links, coalesce(product_links, 0) AS product_links, deepest FROM p LEFT JOIN k ON p.site = k.site""",
)
def site_summary(spark, sf):
    p = table(spark, sf, "pages").groupBy(urls.authority(F.col("url")).alias("site")).agg(F.countDistinct(urls.canonical(F.col("url"))).alias("pages"))
    rows = page_links_of(spark, sf).withColumn("s", urls.authority(F.col("page_url")))
    k = rows.groupBy("s").agg(F.count(F.lit(1)).alias("links"), F.count_if(urls.authority(F.col("link")) == F.col("s")).alias("inner_links"), F.count_if(classify.product_marker(F.col("link"))).alias("product_links"), F.max(urls.depth(F.col("link"))).alias("deepest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return p.join(k, p.site == k.s, "left").select("site", "pages", zero("links"), zero("inner_links"), zero("product_links"), "deepest")


@query(
    "category_links",
    f"""{LINKS}, c AS (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY position) AS r FROM s WHERE position <= 100 AND len(text) >= 3
      AND NOT regexp_matches(lower(text), 'contato|sobre|login|cart|conta|ajuda') AND host = page_host AND depth BETWEEN 1 AND 2),
    t AS (SELECT page_id, position, link, text, row_number() OVER (PARTITION BY page_id ORDER BY position) AS k FROM c WHERE r = 1) SELECT page_id, position, link, text FROM t WHERE k <= 10""",
)
def category_links(spark, sf):
    return links.category_links(page_links_of(spark, sf)).select("page_id", "position", "link", "text")
