"""Classification, pattern learning, planning and page-kind queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catloom.functions import classify
from catloom.operators import patterns
from catloom.plans.registry import query, table
from catloom.plans.url_queries import AUTH, PATH, SAMPLES, samples
from catloom.sources import fixtures

SHOPS = f"WITH l AS ({fixtures.ddb(fixtures.SHOPS_SQL)})"


#: The oracles' own statement of the rules (fixed values), so that a wrong value in the engine shows.
CATEGORY = (
    r"/categoria|/category|/collection|/colecao|/busca|/search|/c/|/produtos|/products|/shop|/brincos|/aneis|/colares|/pulseiras|/ouro|/prata|"
    r"/pedras|/feminino|/masculino|/infantil|/lancamento|/promocao|/outlet"
)
NO_PRODUCT = (
    r"/carrinho|/cart|/checkout|/conta|/account|/login|/blog|/contato|/contact|/sobre|/about|/faq|/ajuda|/help|/politica|/termos|/privacy|"
    r"/categoria|/category|/collection|/colecao|/c/|/busca|/search|/produtos|/products|/shop|/automotivo|/casa|/ferramentas|/eletrica|/hidraulica"
)
DENIED = (
    r"/categoria|/category|/busca|/search|/institucional|/sobre|/contato|/ajuda|/carrinho|/cart|/checkout|/login|/account|/conta|/perfil|"
    r"/wishlist|\.pdf|\.jpg|\.png|\.gif|\.css|\.js"
)
INSTITUTIONAL = (
    r"/atendimento|/quemsomos|/contato|/politica|/termos|/duvidas|/trocas|/entrega|/compra|/pagamento|/receita|/carrinho|/checkout|/login|"
    r"/cadastro|/conta|/pedidos|/favoritos|/home-|/dia-|/outlet|/frete|/formas|/nossos"
)
KEYWORDS = (
    ("Brinquedos", "brinquedo|jogo|boneca|carrinho"),
    ("Beleza e Cuidado Pessoal", "beleza|cabelo|unha|cuidado"),
    ("Casa e Decoração", "casa|cozinha|decoracao|movel"),
    ("Ferramentas", "ferramenta|chave|martelo"),
)
FIRST = (
    (r"/produtos?/[^/]+-\d+/?$", 0.25),
    (r"/p(roduto)?/[^/]+/\d+", 0.5),
    (r"^https?://[^/]+/[^/]+/[^/]+/[^/]+/?$", 0.15),
)
BEST = (
    (r"/produtos?/[^/]+-\d+/?$", 0.25),
    (r"/p(roduto)?/[^/]+/\d+", 0.5),
    (r"/[^/]+-p-\d+", 0.5),
    (r"/produto/[^/]+\.html", 0.5),
    (r"/[^/]+/p/\d+", 0.5),
    (r"\.com\.br/[^/]+-\d+/", 0.5),
    (r"^https?://[^/]+/[^/]+/[^/]+/[^/]+/?$", 0.15),
    (r"^https?://[^/]+/[^/]+/[^/]+/[^/]+/[^/]+/?", 0.1),
)


@query("category_like", f"{SAMPLES} SELECT pos, regexp_matches(lower(url), '{CATEGORY}') AS category_like FROM u")
def category_like(spark, sf):
    return samples(spark, sf).select("pos", classify.category_like(F.col("url")).alias("category_like"))


@query(
    "product_like",
    rf"""{SAMPLES} SELECT pos, NOT regexp_matches(lower(url), '{NO_PRODUCT}') AND contains(rtrim({PATH}, '/'), '/')
    AND (regexp_matches(rtrim({PATH}, '/'), '\d{{6,}}') OR regexp_matches(rtrim({PATH}, '/'), '/p/\d+|/produto/|/product/|/item/|/look-\d+')) AS product_like FROM u""",
)
def product_like(spark, sf):
    return samples(spark, sf).select("pos", classify.product_like(F.col("url")).alias("product_like"))


@query(
    "product_rule_variants",
    rf"""{SAMPLES} SELECT pos,
      regexp_matches(lower(url), '/produtos?/|/products?/|/p/|-\d{{3,}}') AND NOT regexp_matches(lower(url), '/(categoria|category|blog|contato|contact|carrinho|cart|busca|search|login|account)/')
        AND NOT regexp_matches(lower(url), '^https?://[^/]+/?$') AS simple,
      contains({AUTH}, 'example.com') AND (regexp_matches(lower(url), '/produto/|/product/|/p/|/item/|/pd/|/dp/|-p-\d+|/[a-z0-9\-]+/p$') OR NOT regexp_matches(lower(url), '{DENIED}')) AS allowed,
      regexp_matches(lower(url), '/produto/|/product/|/produtos/|/item/|/p/') AS marker FROM u""",
)
def product_rule_variants(spark, sf):
    u = F.col("url")
    return samples(spark, sf).select("pos", classify.product_simple(u).alias("simple"), classify.product_allowed(u, F.lit("example.com")).alias("allowed"), classify.product_marker(u).alias("marker"))


@query(
    "keyword_category",
    f"""SELECT category, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS parts FROM (SELECT p_partkey, CASE
      {" ".join(f"WHEN regexp_matches(w, '{words}') THEN '{name}'" for name, words in KEYWORDS)} ELSE 'Utilidades Domésticas' END AS category
      FROM (SELECT p_partkey, lower(p_name) || CASE p_size % 5 WHEN 0 THEN '/jogo-casa' WHEN 1 THEN '/cabelo' WHEN 2 THEN '/cozinha' WHEN 3 THEN '/martelo' ELSE '' END AS w FROM part)) GROUP BY category""",
)
def keyword_category(spark, sf):
    size = F.col("p_size") % 5
    word = F.concat(F.lower("p_name"), F.when(size == 0, "/jogo-casa").when(size == 1, "/cabelo").when(size == 2, "/cozinha").when(size == 3, "/martelo").otherwise(""))
    rows = table(spark, sf, "part").select("p_partkey", classify.keyword_category(word).alias("category"))
    parts = F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: k.cast("string"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_join(parts, ",").alias("parts"))


@query(
    "category_candidates",
    rf"""{SAMPLES}, s AS (SELECT pos, url, list_filter(string_split({PATH}, '/'), lambda x: x <> '') AS seg FROM u)
    SELECT pos, len(seg) = 1 AND NOT regexp_matches(coalesce(seg[1], ''), '-\d+$') AND len(coalesce(seg[1], '')) < 30 AS candidate,
           regexp_matches(lower({PATH}), '{INSTITUTIONAL}') AS institutional FROM s""",
)
def category_candidates(spark, sf):
    u = F.col("url")
    return samples(spark, sf).select("pos", classify.category_candidate(u).alias("candidate"), classify.institutional(u).alias("institutional"))


def _scores(pats, take, skip, least, lone) -> str:
    hits = ", ".join(f"sum(CAST(regexp_matches(url, '{p}') AS INT)) AS h{k}" for k, (p, _) in enumerate(pats))
    rows = " UNION ALL ".join(f"SELECT site, total, n, {k} AS ord, '{p}' AS pattern, {t} AS least, h{k} / n AS ratio FROM c" for k, (p, t) in enumerate(pats))
    return f"""{SHOPS}, z AS (SELECT *, count(*) OVER (PARTITION BY site) AS total FROM l),
      c AS (SELECT site, max(total) AS total, count(*) AS n, {hits} FROM z WHERE CASE WHEN total > {least} THEN position > {skip} AND position <= {skip + take} ELSE position <= {lone} END GROUP BY site), r AS ({rows})"""


@query("pattern_pick_first", f"{_scores(FIRST, 50, 20, 70, 50)} SELECT site, arg_min(pattern, ord) AS pattern, min(ord) AS ord FROM r WHERE total >= 10 AND ratio >= least GROUP BY site")
def pattern_pick_first(spark, sf):
    return patterns.pick_first(fixtures.shop_links(spark, sf))


@query(
    "pattern_pick_best",
    f"{_scores(BEST, 100, 20, 20, 20)} SELECT site, pattern, ratio FROM r WHERE ratio >= least QUALIFY row_number() OVER (PARTITION BY site ORDER BY ratio DESC, ord) = 1",
)
def pattern_pick_best(spark, sf):
    return patterns.pick_best(fixtures.shop_links(spark, sf))


TEMPLATES = rf"""{SHOPS}, s AS (SELECT *, list_filter(string_split({PATH}, '/'), lambda x: x <> '') AS seg FROM l),
  t AS (SELECT *, array_to_string(list_transform(seg, lambda x: CASE WHEN regexp_matches(x, '\d{{3,}}') THEN '<NUM>' ELSE x END), '/') AS template FROM s),
  n AS (SELECT site, count(*) AS total FROM s GROUP BY site),
  learned AS (SELECT t.site, template, count(*) AS n FROM t JOIN n ON n.site = t.site GROUP BY t.site, template, total HAVING count(*) >= greatest(2, total * 0.2) AND total >= 3),
  g AS (SELECT site, segment, count(*) AS n FROM (SELECT site, unnest(seg) AS segment FROM s) WHERE NOT regexp_matches(segment, '^\d+$') GROUP BY site, segment),
  kept AS (SELECT g.site, segment, n FROM g JOIN n AS m ON m.site = g.site WHERE n >= greatest(2, total * 0.3) AND total >= 3 QUALIFY row_number() OVER (PARTITION BY g.site ORDER BY n DESC, segment) <= 5)"""


@query("template_learn", f"{TEMPLATES} SELECT site, 'template' AS kind, template AS value, n FROM learned UNION ALL SELECT site, 'segment', segment, n FROM kept")
def template_learn(spark, sf):
    rows = fixtures.shop_links(spark, sf)
    t = patterns.learn_templates(rows).select("site", F.lit("template").alias("kind"), F.col("template").alias("value"), "n")
    return t.union(patterns.learn_segments(rows).select("site", F.lit("segment"), "segment", "n"))


@query("template_apply", f"{TEMPLATES} SELECT p_partkey, (site, template) IN (SELECT (site, template) FROM learned) OR EXISTS (SELECT 1 FROM kept WHERE kept.site = t.site AND contains(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), segment)) AS matches FROM t")
def template_apply(spark, sf):
    rows = fixtures.shop_links(spark, sf)
    return patterns.apply_templates(rows, patterns.learn_templates(rows), patterns.learn_segments(rows)).select("p_partkey", "matches")


@query(
    "template_prefixes",
    f"""{SHOPS}, t AS (SELECT site, list_filter(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*\\d{{3,}}[^/]*', '<NUM>', 'g'), '/'), lambda x: x <> '') AS parts FROM l),
    p AS (SELECT site, level, array_to_string(parts[1:level], '/') AS prefix FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS level FROM t)),
    z AS (SELECT site, count(*) AS total FROM l GROUP BY site), c AS (SELECT site, level, prefix, count(*) AS n FROM p GROUP BY site, level, prefix)
    SELECT site, CAST(level AS INT) AS level, prefix, n FROM c JOIN z USING (site) WHERE n >= greatest(2, 0.2 * total) AND total >= 3""",
)
def template_prefixes(spark, sf):
    """The trie of each shop's path templates, counted level by level."""
    return patterns.learn_prefixes(fixtures.shop_links(spark, sf))


BUCKET = "CASE WHEN sl = 4 THEN 0 WHEN sl >= 5 THEN 1 WHEN sl = 3 THEN 2 ELSE 3 END"


@query("depth_priority", f"{SHOPS}, s AS (SELECT *, len(url) - len(replace(url, '/', '')) AS sl FROM l) SELECT site, p_partkey, {BUCKET} AS bucket, CAST(row_number() OVER (PARTITION BY site ORDER BY {BUCKET}, position) AS INT) AS turn FROM s")
def depth_priority(spark, sf):
    rows = fixtures.shop_links(spark, sf).withColumn("bucket", patterns.depth_bucket(F.col("url")))
    return patterns.positions(rows, ["bucket", "position"], ["site"], "turn").select("site", "p_partkey", "bucket", "turn")


@query(
    "adaptive_validation",
    rf"""{SHOPS}, v AS (SELECT site, position, p_partkey, p_size % 10 < 4 + 2 * CAST(right(site, 1) AS INT) AS valid, CASE WHEN site = 'shop0' THEN regexp_matches(url, '/produtos?/[^/]+-\d+/?$') END AS pattern_hit FROM l),
    a AS (SELECT *, sum(CAST(valid AND position <= 20 AS INT)) OVER w AS v20, sum(CAST(valid AND position <= 50 AS INT)) OVER w AS v50, sum(CAST(valid AND position <= 150 AS INT)) OVER w AS v150,
      least(count(*) OVER w, 50) AS n50, least(count(*) OVER w, 150) AS n150, count(pattern_hit) OVER w > 0 AS pat FROM v WINDOW w AS (PARTITION BY site)),
    m AS (SELECT *, CASE WHEN v20 >= 10 AND pat THEN 'pattern' WHEN v50 / n50 >= 0.8 THEN 'accept_50' WHEN v50 / n50 >= 0.5 AND v150 / n150 >= 0.7 THEN 'accept_150' WHEN v50 / n50 >= 0.5 THEN 'check_150' ELSE 'check_500' END AS mode FROM a)
    SELECT site, p_partkey, mode, CASE WHEN position <= CASE mode WHEN 'pattern' THEN 20 WHEN 'accept_50' THEN 50 WHEN 'accept_150' THEN 150 ELSE 500 END THEN valid
      WHEN mode = 'pattern' THEN coalesce(pattern_hit, false) ELSE mode LIKE 'accept%' END AS accepted FROM m""",
)
def adaptive_validation(spark, sf):
    rows = fixtures.shop_links(spark, sf)
    valid = F.col("p_size") % 10 < 4 + 2 * F.right("site", F.lit(1)).cast("int")
    hit = F.when(F.col("site") == "shop0", F.col("url").rlike(patterns.FIRST_PATTERNS[0][0]))
    return patterns.adaptive_validation(rows.withColumn("valid", valid).withColumn("pattern_hit", hit)).select("site", "p_partkey", "mode", "accepted")


@query(
    "discovery_planner",
    rf"""{SHOPS}, s AS (SELECT *, count(*) OVER (PARTITION BY site) AS total, len(url) - len(replace(url, '/', '')) >= 4 AS deep FROM l),
    m AS (SELECT *, bool_or(deep) OVER (PARTITION BY site) AS any_deep, sum(CAST(deep AS INT)) OVER (PARTITION BY site ORDER BY position) AS rank FROM s),
    k AS ({_scores(FIRST, 50, 20, 70, 50)} SELECT site, min(ord) AS o FROM r WHERE total >= 10 AND ratio >= least GROUP BY site),
    p AS (SELECT m.*, o, CASE WHEN total < 5000 AND o IS NOT NULL THEN 'pattern' WHEN total < 5000 AND any_deep THEN 'deep' WHEN total < 5000 THEN 'all' WHEN m.site = 'shop2' THEN 'categories' ELSE 'fallback' END AS plan FROM m LEFT JOIN k ON m.site = k.site)
    SELECT site, p_partkey, plan FROM p WHERE CASE plan WHEN 'pattern' THEN CASE o WHEN 0 THEN regexp_matches(url, '/produtos?/[^/]+-\d+/?$') WHEN 1 THEN regexp_matches(url, '/p(roduto)?/[^/]+/\d+') ELSE regexp_matches(url, '^https?://[^/]+/[^/]+/[^/]+/[^/]+/?$') END
      WHEN 'deep' THEN deep WHEN 'all' THEN true WHEN 'fallback' THEN deep AND rank <= 500 ELSE false END""",
)
def discovery_planner(spark, sf):
    categories = spark.createDataFrame([("shop2",)], "site string")
    return patterns.plan_discovery(fixtures.shop_links(spark, sf), categories).select("site", "p_partkey", "plan")


#: Pages with platform marks of several kinds, by size.
MARKED = "html || CASE page_id % 8 WHEN 0 THEN ' VTEX image' WHEN 1 THEN ' cdn.shopify.com' WHEN 2 THEN ' wp-content image' WHEN 3 THEN ' magento' WHEN 4 THEN ' nuvemshop vtex' WHEN 5 THEN ' recaptcha cloudflare' WHEN 6 THEN ' Comprar R$ 10,00 \"sku\"' ELSE '' END"


def marked(spark, sf):
    return table(spark, sf, "pages").selectExpr("page_id", "url", f"{MARKED} AS html")


@query(
    "platform_detect",
    f"""WITH p AS (SELECT page_id, lower({MARKED}) AS h FROM pages)
    SELECT page_id, CASE WHEN contains(h, 'vtex') THEN 'VTEX' WHEN contains(h, 'shopify') THEN 'SHOPIFY' WHEN regexp_matches(h, 'woocommerce|wp-content') THEN 'WOOCOMMERCE' WHEN contains(h, 'magento') THEN 'MAGENTO' WHEN contains(h, 'nuvemshop') THEN 'NUVEMSHOP' END AS first_match,
      CASE WHEN contains(h, 'nuvemshop') THEN 'NUVEMSHOP' WHEN contains(h, 'mage') THEN 'MAGENTO' WHEN regexp_matches(h, 'woocommerce|wp-content') THEN 'WOOCOMMERCE' WHEN contains(h, 'shopify') THEN 'SHOPIFY' WHEN contains(h, 'vtex') THEN 'VTEX' END AS last_match,
      array_to_string(list_filter([CASE WHEN contains(h, 'vtex') THEN 'VTEX' END, CASE WHEN contains(h, 'shopify') THEN 'SHOPIFY' END, CASE WHEN regexp_matches(h, 'woocommerce|wp-content') THEN 'WOOCOMMERCE' END, CASE WHEN contains(h, 'mage') THEN 'MAGENTO' END, CASE WHEN contains(h, 'nuvemshop') THEN 'NUVEMSHOP' END], lambda x: x IS NOT NULL), ',') AS evidence FROM p""",
)
def platform_detect(spark, sf):
    h = F.col("html")
    return marked(spark, sf).select("page_id", classify.platform(h).alias("first_match"), classify.platform(h, "last").alias("last_match"), F.array_join(classify.platform_evidence(h), ",").alias("evidence"))


ROUTES = [("://m.", "mobile"), ("://blog.", "blog"), (".example.org", "org"), ("://www.", "www")]


@query("reader_route", "SELECT page_id, CASE WHEN contains(lower(url), '://m.') THEN 'mobile' WHEN contains(lower(url), '://blog.') THEN 'blog' WHEN contains(lower(url), '.example.org') THEN 'org' WHEN contains(lower(url), '://www.') THEN 'www' ELSE 'generic' END AS reader FROM pages")
def reader_route(spark, sf):
    return table(spark, sf, "pages").select("page_id", classify.route(F.col("url"), ROUTES).alias("reader"))


@query(
    "page_static_score",
    r"""WITH p AS (SELECT page_id, html, list_slice(regexp_extract_all(html, '(?is)<script\b.*?</script>'), 1, 20) AS scripts FROM pages),
    q AS (SELECT page_id, coalesce(list_sum(list_transform(scripts, lambda s: CASE WHEN regexp_matches(lower(s), 'react|vue|angular|next|__next|nuxt|gatsby') THEN 2 ELSE 0 END + CASE WHEN contains(lower(s), 'hydrat') THEN 3 ELSE 0 END)), 0)
      + CASE WHEN regexp_matches(html, '(?i)<div[^>]*\bid=["''][^"'']*(root|app|__next)') THEN 2 ELSE 0 END
      + CASE WHEN regexp_matches(html, '(?i)R\$\s*[\d.,]+') OR regexp_matches(html, '(?i)itemprop=["'']price["'']') OR contains(html, 'application/ld+json') THEN 0 ELSE 3 END
      + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS score FROM p)
    SELECT page_id, CAST(score AS INT) AS score, CASE WHEN score >= 4 THEN 'dynamic' ELSE 'static' END AS kind, CASE WHEN score >= 4 THEN 3 ELSE 25 END AS workers FROM q""",
)
def page_static_score(spark, sf):
    seconds = F.when(F.col("page_id") % 3 == 0, 2.0).otherwise(0.5)
    s = table(spark, sf, "pages").select("page_id", classify.dynamic_score(F.col("html"), seconds).alias("score"))
    return s.select("page_id", "score", F.when(F.col("score") >= 4, "dynamic").otherwise("static").alias("kind"), F.when(F.col("score") >= 4, 3).otherwise(25).alias("workers"))


@query(
    "page_is_product",
    f"""WITH p AS (SELECT page_id, lower({MARKED}) AS h FROM pages)
    SELECT page_id, CAST(regexp_matches(h, 'adicionar|comprar|buy|add to cart') AS INT) + CAST(regexp_matches(h, '"price"|preco|preço|r\\$|brl') AS INT) + CAST(regexp_matches(h, 'product|produto|"sku"|item') AS INT) AS groups,
      CAST(contains(h, 'application/ld+json') AS INT) + CAST(contains(h, 'og:type') AS INT) + CAST(contains(h, 'product') AS INT) + CAST(contains(h, 'price') AS INT) + CAST(contains(h, 'add to cart') AS INT) + CAST(contains(h, 'buy now') AS INT) + CAST(contains(h, 'comprar') AS INT) AS indicators,
      groups >= 2 AS product_by_groups, indicators >= 2 AS product_by_indicators FROM p""",
)
def page_is_product(spark, sf):
    h = F.col("html")
    return marked(spark, sf).select(
        "page_id", classify.indicator_groups(h).alias("groups"), classify.indicators(h).alias("indicators"), classify.page_is_product(h).alias("product_by_groups"), classify.page_is_product(h, "indicators").alias("product_by_indicators")
    )


@query(
    "page_protection",
    f"""WITH p AS (SELECT page_id, lower({MARKED}) AS h FROM pages)
    SELECT page_id, contains(h, 'cloudflare') OR page_id % 10 = 0 AS cdn, contains(h, 'captcha') AS captcha, 0 AS fingerprint_scripts, page_id % 10 = 1 AS rate_limited,
      CASE WHEN page_id % 10 = 1 THEN 'paced-requests,dom,cascade' ELSE 'dom,cascade' END AS advice FROM p""",
)
def page_protection(spark, sf):
    rows = marked(spark, sf).withColumn("headers", F.when(F.col("page_id") % 10 == 0, "CF-RAY: 1").when(F.col("page_id") % 10 == 1, "Retry-After: 3").otherwise("x: y"))
    rows = rows.select("page_id", "html", classify.protection_flags(F.col("html"), F.col("headers")).alias("f"))
    advice = classify.recommendations(F.col("html").contains("application/ld+json"), F.lit(0), F.col("html").contains("__NEXT_DATA__"), F.col("f.rate_limited"))
    return rows.select("page_id", "f.*", F.array_join(advice, ",").alias("advice"))


@query("page_rendering", "SELECT doc_id, CASE WHEN len(trim(text)) > 1000 THEN 'SSR' ELSE 'CSR' END AS rendering, len(text) < 1000 AS too_small FROM documents")
def page_rendering(spark, sf):
    return table(spark, sf, "documents").select("doc_id", classify.rendering(F.length(F.trim("text"))).alias("rendering"), classify.too_small(F.col("text")).alias("too_small"))


@query("marker_shares", f"{SAMPLES} SELECT count(*) AS n, count(*) FILTER (contains(url, '/produto/')) AS produto, count(*) FILTER (contains(url, '/p')) AS p, count(*) FILTER (contains(url, '/categoria')) AS categoria, round(100.0 * count(*) FILTER (contains(url, '/produto/')) / count(*), 4) AS produto_percent FROM u")
def marker_shares(spark, sf):
    u = F.col("url")
    return samples(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(u.contains("/produto/")).alias("produto"), F.count_if(u.contains("/p")).alias("p"), F.count_if(u.contains("/categoria")).alias("categoria"), F.round(F.count_if(u.contains("/produto/")) * 100.0 / F.count(F.lit(1)), 4).alias("produto_percent")
    )


@query("hash_sample", f"{SAMPLES} SELECT pos, url FROM u QUALIFY row_number() OVER (ORDER BY md5('7:' || url), url) <= least(10, greatest(5, CAST(floor(count(*) OVER () * 0.01) AS INT)))")
def hash_sample(spark, sf):
    return patterns.hash_sample(samples(spark, sf)).select("pos", "url")


