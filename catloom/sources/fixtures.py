"""Captured pages and logs rendered from the driver tables, one form for each reader.

The SQL here is in the part of the language that Spark and DuckDB share, so an
oracle can build the same rows from the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHOP = "https://loja.example.com"

#: ``pos, url``: page URLs, and product, category and utility URLs made from parts.
URLS_SQL = """
SELECT page_id AS pos, url FROM {pages}
UNION ALL
SELECT 1000000 + p_partkey AS pos,
       'https://loja.example.com/' ||
       CASE p_partkey % 8 WHEN 0 THEN 'produto/' WHEN 1 THEN 'categoria/' WHEN 2 THEN 'produtos/' WHEN 3 THEN 'item/'
            WHEN 4 THEN 'conta/' WHEN 5 THEN 'casa/ferramentas/' WHEN 6 THEN '' ELSE 'p/' END ||
       replace(p_name, ' ', '-') ||
       CASE p_partkey % 5 WHEN 0 THEN '-12v' WHEN 1 THEN '-' || CAST(100000 + p_partkey AS STRING) WHEN 2 THEN '' WHEN 3 THEN '/p'
            ELSE '-' || CAST(p_partkey AS STRING) || '/' END ||
       CASE p_partkey % 7 WHEN 0 THEN '?page=' || CAST(p_partkey % 50 AS STRING) WHEN 1 THEN '#top' WHEN 2 THEN '?x=1&page=3#a' ELSE '' END AS url
FROM {part}
"""

#: ``site, position, url``: four shops that list the parts under different URL forms.
SHOPS_SQL = """
SELECT 'shop' || CAST(p_partkey % 4 AS STRING) AS site, CAST(row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) AS INT) AS position,
       'https://shop' || CAST(p_partkey % 4 AS STRING) || '.example.com/' ||
       CASE p_partkey % 4
            WHEN 0 THEN 'produtos/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS STRING)
            WHEN 1 THEN 'produto/' || replace(p_name, ' ', '-') || '/' || CAST(p_partkey AS STRING)
            WHEN 2 THEN CASE WHEN p_partkey % 12 < 4 THEN 'a/' || lower(p_type) || '/' || replace(p_name, ' ', '-') ELSE replace(p_name, ' ', '-') END
            ELSE CASE WHEN p_size % 10 = 0 THEN 'about' ELSE lower(p_type) || '/' || CAST(p_partkey AS STRING) END END AS url,
       p_partkey, p_size, p_type
FROM {part}
"""

#: ``ts, event_id, user_id, ok, limited, error, seconds``: a request log.
LOG_SQL = """
SELECT ts, event_id, user_id, event_type <> 'error' AND event_type <> 'click' AS ok, event_type = 'click' AND value > 30 AS limited,
       event_type = 'error' OR (event_type = 'click' AND value <= 30) AS error, value / 100 AS seconds
FROM {events}
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its files give fewer tasks: a page is far dearer to render and read than its row is to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in tables})


def url_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, URLS_SQL, "pages", "part")


def shop_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SHOPS_SQL, "part")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, LOG_SQL, "events")


def ddb(sql: str) -> str:
    """The same SQL over the views of the oracle."""
    return sql.format(pages="pages", part="part", events="events")


def priced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with exact prices: ``key, name, brand, type, size, price, listed, full``."""
    price = F.col("p_retailprice").cast("decimal(18,2)")
    return spread(read(spark, sf_dir, "part")).select(
        F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), price.alias("price"), (price + F.lit(50)).cast("decimal(18,2)").alias("listed"), F.expr(FULL_NAME).alias("full")
    )


PARTS_SQL = """SELECT p_partkey AS key, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size,
 CAST(p_retailprice AS DECIMAL(18,2)) AS price, CAST(CAST(p_retailprice AS DECIMAL(18,2)) + 50 AS DECIMAL(18,2)) AS listed FROM part"""


def local_text(price: Column) -> Column:
    """A decimal in Brazilian form."""
    s = F.format_string("%s", price.cast("string"))
    whole = F.regexp_replace(F.substring_index(s, ".", 1), r"(\d)(?=(\d{3})+$)", "$1.")
    return F.concat(whole, F.lit(","), F.substring_index(s, ".", -1))


def _page(head, body):
    return F.concat(F.lit("<!DOCTYPE html><html><head>"), head, F.lit("</head><body>"), body, F.lit("</body></html>"))


def _ld(node):
    return F.concat(F.lit('<script type="application/ld+json">'), F.to_json(node), F.lit("</script>"))


def product_pages(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """``key, url, html`` of the parts in one form."""
    return priced_parts(spark, sf_dir).select("key", F.concat(F.lit(SHOP + "/produto/x-"), F.col("key").cast("string")).alias("url"), page_of(form).alias("html"))


def mixed_forms(spark: SparkSession, sf_dir: str, forms: tuple[str, ...]) -> DataFrame:
    """``key, url, html`` of the parts, the form by the key's remainder."""
    html = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        html = F.when(F.col("key") % len(forms) == k, page_of(form)).otherwise(html)
    return priced_parts(spark, sf_dir).select("key", F.concat(F.lit(SHOP + "/produto/x-"), F.col("key").cast("string")).alias("url"), html.alias("html"))


def page_of(form: str) -> Column:
    """A page of a priced part; see the branches for the forms."""
    name, brand, price, listed = F.col("name"), F.col("brand"), F.col("price"), F.col("listed")
    text = price.cast("string")
    stock = F.when(F.col("size") % 3 == 0, "https://schema.org/OutOfStock").otherwise("https://schema.org/InStock")
    heading = F.concat(F.lit("<h1>"), name, F.lit("</h1>"))
    kind = lambda t: F.lit(t).alias("@type")
    offer = F.struct(kind("Offer"), text.alias("price"), F.lit("BRL").alias("priceCurrency"), stock.alias("availability"))
    base = [kind("Product"), name.alias("name"), F.struct(kind("Brand"), brand.alias("name")).alias("brand"), F.concat(F.lit("S"), F.col("key").cast("string")).alias("sku"), F.array(F.lit("a.jpg"), F.lit("b.jpg")).alias("image")]
    none = F.lit("")
    if form == "offer":
        html = _page(_ld(F.struct(*base, offer.alias("offers"))), heading)
    elif form == "aggregate":
        agg = F.struct(kind("AggregateOffer"), text.alias("lowPrice"), listed.cast("string").alias("highPrice"))
        html = _page(_ld(F.struct(*base[:2], brand.alias("brand"), agg.alias("offers"), F.lit("one.jpg").alias("image"))), heading)
    elif form == "list_offers":
        empty = F.struct(kind("Offer"), F.lit(None).cast("string").alias("price"))
        html = _page(_ld(F.struct(*base[:3], F.array(empty, F.struct(kind("Offer"), text.alias("price"))).alias("offers"))), heading)
    elif form == "capital_offers":
        html = _page(_ld(F.struct(*base[:3], F.struct(kind("Offer"), text.alias("price")).alias("Offers"))), heading)
    elif form == "graph":
        other = F.struct(kind("WebPage"), F.lit("page").alias("name"))
        node = F.concat(F.lit('{"@graph":['), F.to_json(other), F.lit(","), F.to_json(F.struct(*base, offer.alias("offers"))), F.lit("]}"))
        html = _page(F.concat(F.lit("<script type='application/ld+json'>not json</script><script data-x=1 type=application/ld+json>"), node, F.lit("</script>")), heading)
    elif form == "opengraph":
        head = F.concat(F.lit('<meta content="'), name, F.lit('" property="og:title"><meta property="og:price:amount" content=\''), text, F.lit("'><meta property=\"og:image\" content=\"i.jpg\"><meta property=\"og:availability\" content=\"instock\">"))
        html = _page(head, none)
    elif form == "meta":
        head = F.concat(F.lit('<meta name="twitter:title" content="'), name, F.lit('"><meta property="product:price:amount" content="'), text, F.lit('"><meta property="product:brand" content="'), brand, F.lit('">'))
        html = _page(head, none)
    elif form == "script":
        html = _page(F.concat(F.lit("<script>var produto_preco = "), text, F.lit(";</script>")), heading)
    elif form == "microdata":
        body = F.concat(F.lit('<div itemscope><h1 itemprop="name">'), name, F.lit('<p>open<span itemprop="brand">'), brand, F.lit('</span><meta itemprop="price" content="'), text, F.lit('"><img itemprop="image" data-original="l.jpg" src="s.jpg"></div>'))
        html = _page(none, body)
    elif form == "hydration":
        data = F.to_json(F.struct(F.struct(F.struct(F.struct(name.alias("productName"), text.alias("price"), F.col("key").alias("productId")).alias("product")).alias("pageProps")).alias("props")))
        html = _page(F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script>")), none)
    elif form == "cache":
        key = F.col("key").cast("string")
        entry = lambda k, v: F.concat(F.to_json(F.struct(k.alias("k"))).substr(F.lit(6), F.length(k) + 2), F.lit(":"), F.to_json(v))
        product = F.struct(name.alias("productName"), brand.alias("brand"), F.struct(F.concat(F.lit("$Range:"), key).alias("id")).alias("priceRange"), F.struct(F.array(F.concat(F.lit("/Casa/"), F.col("type"), F.lit("/"))).alias("json")).alias("categories"))
        rng = F.struct(F.struct(F.concat(F.lit("$Sell:"), key).alias("id")).alias("sellingPrice"), F.struct(F.concat(F.lit("$List:"), key).alias("id")).alias("listPrice"))
        parts = [entry(F.concat(F.lit("Product:"), key), product), entry(F.concat(F.lit("Product:"), key, F.lit(".items")), F.struct(F.lit(1).alias("x"))), entry(F.concat(F.lit("$Range:"), key), rng)]
        parts += [entry(F.concat(F.lit("$Sell:"), key), F.struct(price.alias("lowPrice")))]
        missing = F.when(F.col("key") % 5 == 0, "").otherwise(F.concat(F.lit(","), entry(F.concat(F.lit("$List:"), key), F.struct(listed.alias("lowPrice")))))
        html = F.concat(F.lit("<script>window.__STATE__ = {"), F.concat_ws(",", *parts), missing, F.lit("};</script>"))
    elif form == "from_to":
        html = _page(none, F.concat(heading, F.lit("<p>De R$ "), local_text(listed), F.lit(" por R$ "), local_text(price), F.lit(" ou 3x de R$ 19,90</p>")))
    elif form == "markup":
        html = _page(none, F.concat(heading, F.lit('<span class="old-price">R$ '), local_text(listed), F.lit('</span><b class="box-preco">R$ '), text, F.lit("</b>")))
    elif form == "item_list":
        item = F.struct(kind("Product"), name.alias("name"), F.concat(F.lit(SHOP + "/produto/"), F.col("key").cast("string")).alias("url"), F.struct(text.alias("price")).alias("offers"))
        other = F.struct(kind("Thing"), name.alias("name"), F.lit(SHOP).alias("url"), F.struct(text.alias("price")).alias("offers"))
        html = _page(_ld(F.struct(kind("ItemList"), F.array(item, other).alias("itemListElement"))), none)
    else:
        raise ValueError(form)
    return html


def sitemap_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url, body``: an index, a sitemap for each nation, pages for customers; one cycle, one odd prologue, one prefix."""
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    loc = lambda u: F.concat(F.lit("<loc> "), u, F.lit(" </loc>"))
    child = F.concat(F.lit(SHOP + "/sitemap-"), F.col("n_nationkey").cast("string"), F.lit(".xml"))
    index = n.groupBy(F.lit(SHOP + "/sitemap.xml").alias("url")).agg(
        F.concat(F.lit('<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<sitemap>"), loc(child), F.lit("</sitemap>")))), ""), F.lit("</sitemapindex>")).alias("body")
    )
    page = F.concat(F.lit(SHOP + "/"), F.when(F.col("c_custkey") % 3 == 0, "produto/").otherwise("c/"), F.lit("x-"), F.col("c_custkey").cast("string"))
    pages = c.groupBy(F.concat(F.lit(SHOP + "/sitemap-"), F.col("c_nationkey").cast("string"), F.lit(".xml")).alias("url")).agg(
        F.concat(F.lit("<? xml version='1.0'?><urlset>"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<url>"), loc(page), F.lit("</url>")))), ""), F.lit("<url>"), loc(F.lit(SHOP + "/sitemap.xml")), F.lit("</url></urlset>")).alias("body")
    )
    return index.union(pages)


def write_sitemaps(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Sitemap files in a folder ``name=...`` each, as many parts as there are tasks: an index, and a sitemap for each nation, those of odd ones gzip."""
    key = F.col("n_nationkey").cast("string")
    index = read(spark, sf_dir, "nation").select(F.lit("sitemap").alias("name"), F.concat(F.lit(SHOP + "/sitemap-"), key, F.lit(".xml")).alias("loc"))
    page = F.concat(F.lit(SHOP + "/"), F.when(F.col("c_custkey") % 3 == 0, "produto/").otherwise("c/"), F.lit("x-"), F.col("c_custkey").cast("string"))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"))
    pages = read(spark, sf_dir, "customer").select(F.concat(F.lit("sitemap-"), F.col("c_nationkey").cast("string")).alias("name"), page.alias("loc"), day.alias("lastmod"))
    odd = F.substring_index("name", "-", -1).cast("int") % 2 == 1

    def write(rows: DataFrame, root: str, row: str, **options: str) -> None:
        rows.write.format("xml").partitionBy("name").mode("append").options(rootTag=root, rowTag=row, **options).save(path)

    write(index, "sitemapindex", "sitemap")
    write(pages.where(~odd), "urlset", "url")
    write(pages.where(odd), "urlset", "url", compression="gzip")


#: Parts under a longer name, some with a brand that readers know.
FULL_NAME = "p_name || ' ' || p_brand || CASE WHEN p_partkey % 7 = 0 THEN ' Samsung' ELSE '' END"


def _blocks(*parts: Column) -> Column:
    """Elements one after another, with text between them."""
    return F.concat_ws(" . ", *[F.when(p != "", p) for p in parts])


def _either(value: Column, *options: Column | str) -> Column:
    """``options[value]``, the last one for all larger values."""
    out = options[-1] if isinstance(options[-1], Column) else F.lit(options[-1])
    for k, o in reversed(list(enumerate(options[:-1]))):
        out = F.when(value == k, o if isinstance(o, Column) else F.lit(o)).otherwise(out)
    return out


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def irregular_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, url, html``: product pages by markup alone, with missing, repeated, broken and misplaced fields by the key's remainders."""
    p = priced_parts(spark, sf_dir)
    k, full, kind, name = F.col("key"), F.col("full"), F.col("type"), F.col("name")
    price, listed = local_text(F.col("price")), local_text(F.col("listed"))
    head = _text(
        _either(k % 3, _text("<title>Loja | ", full, "</title>"), _text("<title>Loja | ", full, "</title>"), ""),
        _either(k % 2, _text('<meta name="description" content="About ', full, '">'), ""),
        F.when(k % 4 == 2, _text('<meta name="Category" content="', kind, '">')).otherwise(""),
    )
    crumbs = _either(
        k % 4,
        _text('<ul class="x Breadcrumb"><li><a href="/">Home</a></li><li><a href="/t">', kind, '</a></li><li><a href="/n">', name, "</a></li></ul>"),
        _text('<div id="breadcrumb"><span>Home</span><span>', kind, "</span><span>", kind, "</span><span>", name, "</span></div>"),
        _text('<nav aria-label="Breadcrumb"><span>Início</span><span>', kind, "</span></nav>"),
        '<a href="/categoria/a">Casa</a> <a href="/categoria/b">Jardim</a> <a href="/category/c">C</a> <a href="/categoria/d">D</a>',
    )
    prices = _either(
        k % 4,
        "",
        '<p id="valor-x">R$ 5,00</p>',
        _text('<b class="preco-atual">R$ <!-- now -->', price, "</b>"),
        _text("<s>R$ ", listed, '</s> . <b class="preco-atual">R$ ', price, "</b>"),
    )
    more = "".join(f'<img src="/img/product-x{j}.jpg">' for j in range(6))
    images = _text(
        '<img src="/img/product-1.jpg?v=1"><img src="/img/product-1.jpg?v=2"><img src="/i/logo-product.png"><img src="">',
        _either(k % 2, more, ""),
        _either(k % 3, '<img class="product" data-src="lazy.jpg">', ""),
    )
    about = _either(k % 3, _text('<div class="Product-Description">A sturdy ', name, " for every home.</div>"), _text("<p>", F.repeat(F.lit("long "), 25), "</p>"), '<div class="desc">short</div>')
    body = _blocks(
        _either(k % 5, "", "<h1>Loja</h1>", _text("<h1>Loja</h1> . <h1>", full, "</h1>")),
        crumbs, prices, images, about,
        F.when(k % 5 == 2, F.lit("<p>12 unidades</p>")).when(k % 5 == 3, F.lit('<p class="Estoque-x">Sob consulta</p>')).otherwise(""),
        _either(k % 2, "", _text("<i>Codigo: A", k.cast("string"), "</i>")),
        F.when(k % 3 == 1, F.lit("<p>Marca: Philips.</p>")).otherwise(""),
        F.when(k % 6 == 0, F.lit("<p>Produto indisponível</p>")).otherwise(""),
    )
    return p.select("key", F.concat(F.lit(SHOP + "/produto/x-"), k.cast("string")).alias("url"), _page(head, body).alias("html"))


def mixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, html, api``: JSON-LD, OpenGraph, hydration data, headings and a captured API response, each missing, empty or broken for some keys."""
    p = priced_parts(spark, sf_dir)
    k, name, price, listed = F.col("key"), F.col("name"), F.col("price").cast("string"), F.col("listed").cast("string")
    kind = F.lit("Product").alias("@type")
    whole = F.struct(kind, name.alias("name"), F.struct(price.alias("price")).alias("offers"), F.array(F.lit("j.jpg")).alias("image"))
    some = F.struct(kind, F.when(k % 8 == 1, "").otherwise(name).alias("name"), F.array(F.lit("j.jpg")).alias("image"))
    ld = _either(k % 4, _ld(whole), _ld(some), '<script type="application/ld+json">{"@type":"Product","name":</script>', "")
    og = F.when(k % 2 == 1, _text('<meta property="og:title" content="O ', name, '"><meta property="og:price:amount" content="', listed, '"><meta property="og:image" content="i.jpg">')).otherwise("")
    data = F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("H "), name).alias("productName"), listed.alias("price")).alias("product")).alias("pageProps").alias("props")))
    hydration = F.when(k % 3 == 0, _text('<script id="__NEXT_DATA__" type="application/json">', data, "</script>")).otherwise("")
    marks = F.when(k % 5 != 0, _text("<h1>M ", name, '</h1><b class="price">R$ ', local_text(F.col("price")), "</b>")).otherwise("")
    api = F.when(k % 6 == 0, F.to_json(F.struct(F.struct(F.concat(F.lit("A "), name).alias("title"), F.array(F.struct(price.alias("price"))).alias("variants")).alias("product")))).when(k % 6 == 1, "{}").when(k % 6 == 2, "not json")
    return p.select("key", _page(_text(ld, og, hydration), marks).alias("html"), api.alias("api"))


#: ``site, path, page_url, position, href, link, text, p_partkey``: links of shops of 40 parts each, on a home page, category pages and another page.
SHOP_LINKS_SQL = """
SELECT site, path, 'https://' || site || '.example.com' || path AS page_url, position, href, 'https://' || site || '.example.com' || href AS link, text, p_partkey FROM (
SELECT p_partkey, 'shop' || CAST(CAST(floor(p_partkey / 40) AS INT) AS STRING) AS site, CAST(p_partkey % 40 AS INT) AS position,
 CASE WHEN p_partkey % 40 < 6 THEN '/' WHEN p_partkey % 40 < 16 THEN '/ferramentas/' WHEN p_partkey % 40 < 26 THEN '/casa/' WHEN p_partkey % 40 < 36 THEN '/cozinha/' ELSE '/sobre/' END AS path,
 CASE WHEN p_partkey % 7 = 0 THEN '/categoria/' || lower(p_type) WHEN p_partkey % 7 = 1 THEN '/produto/p-' || CAST(p_partkey % 10 AS STRING)
  WHEN p_partkey % 7 = 2 THEN '/produto/' || replace(p_name, ' ', '-') || '-9' ELSE '/produto/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS STRING) || CASE p_partkey % 3 WHEN 0 THEN '?utm=1' WHEN 1 THEN '/' ELSE '' END END AS href,
 CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS text FROM {part}) AS t
"""


def discovery_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SHOP_LINKS_SQL, "part")


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, url, html``: list pages with navigation, categories, products, foreign links and next pages of several forms."""
    k = F.col("p_partkey").cast("string")
    following = _either(F.col("p_partkey") % 4, '<div class="x pagination"><a class="next" href="?page=2">2</a></div>', '<a class="next" href="?page=9">9</a><a rel="next" href="/list/2">2</a>', '<a class="a next-page" href="/list/3">3</a><a rel="next" href="/list/4">4</a>', "")
    body = _text(
        '<nav><a href="/a-', k, '">Home</a></nav><div><a class="Menu-item" href="/b-', k, '">B</a></div><a href="/categoria/', k, '">C</a><a href="https://other.example.org/categoria">D</a>',
        '<p><a href="/x-', k, '">plain</a></p>', following, '<a href="/produto/n-', k, '">P</a><a href="/produto/n-', k, '">again</a><a name="top">T</a>',
    )
    return spread(read(spark, sf_dir, "part")).select(F.col("p_partkey").alias("key"), _text(SHOP + "/list/", k).alias("url"), _page(F.lit(""), body).alias("html"))


def menu_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, url, html``: pages whose links may lead to categories by place, path, text or word, and some that never do."""
    k = F.col("p_partkey")
    t = k.cast("string")
    long_text = "a text of many more words than four"
    some = _either(
        k % 3,
        _text('<a href="/a/b-', t, '/">', long_text, "</a>"),
        _text('<a href="/a/b/c-', t, '/">', long_text, '</a><a href="/m-', t, '">abc</a>'),
        _text('<a href="/m-', t, '">', long_text, ' com decoração</a><a href="/a/b/c/d/e-', t, '">Deep</a>'),
    )
    body = _text(
        '<nav><ul><li><a href="/n-', t, '">', long_text, '</a></li></ul><a href="/login">In</a></nav><footer><div><a href="/f-', t, '"><b>', long_text, "</b></a></div></footer>",
        '<a href=" /s-', t, '/ ">', long_text, '</a><p><a href="/w-', t, '">two <i>words</i></a></p><a href="/cat-x/deep/path/', t, '">', long_text, "</a>",
        '<a href="/x/', t, '/y">Casa</a><a href="/minha/cart-', t, '">Cart</a><a href="https://other.example.org/categoria">Casa</a><a href="/z-', t, '">abc</a><a href="/q-', t, '">', long_text, "</a>",
        '<a class="Top-Menu" href="/u-', t, '">abc</a>', some,
    )
    return spread(read(spark, sf_dir, "part")).select(k.alias("key"), _text(SHOP + "/").alias("url"), _page(F.lit(""), body).alias("html"))
