"""Markup heuristics and the cascades of single readers, over pages with missing, repeated and broken fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from catloom.functions import html as tags
from catloom.functions import markup, normalize
from catloom.operators import cascade, structured
from catloom.plans.registry import query, table
from catloom.sources import fixtures

P = f"WITH p AS (SELECT p_partkey AS k, p_name AS name, p_type AS type, {fixtures.FULL_NAME} AS full_name, CAST(p_retailprice AS DECIMAL(18,2)) AS price, CAST(CAST(p_retailprice AS DECIMAL(18,2)) + 50 AS DECIMAL(18,2)) AS listed FROM part)"
#: A price of the oracle in local form.
LOCAL = "CASE WHEN {x} >= 1000 THEN CAST(CAST(floor({x} / 1000) AS INT) AS VARCHAR) || '.' || lpad(CAST(CAST(floor({x}) AS INT) % 1000 AS VARCHAR), 3, '0') ELSE CAST(CAST(floor({x}) AS INT) AS VARCHAR) END || ',' || right(CAST({x} AS VARCHAR), 2)"
PRICE, LISTED = LOCAL.format(x="price"), LOCAL.format(x="listed")
NAME_BY_HEADING = "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Loja' ELSE full_name END"


def irregular(spark, sf):
    """Tags, page and URL of the irregular pages."""
    return tags.with_tags(fixtures.irregular_pages(spark, sf))


@query(
    "markup_second_heading",
    f"""{P} SELECT k AS key, {NAME_BY_HEADING} AS name, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '5,00' WHEN 2 THEN {PRICE} ELSE {LISTED} END AS price_raw,
     CASE k % 2 WHEN 0 THEN 5 ELSE 3 END AS n_images, CASE k % 2 WHEN 1 THEN 'A' || CAST(k AS VARCHAR) END AS sku FROM p""",
)
def markup_second_heading(spark, sf):
    found = irregular(spark, sf).select("key", markup.second_heading(F.col("tags"), F.col("html")).alias("r"))
    return found.select("key", "r.name", "r.price_raw", F.size("r.images").alias("n_images"), "r.sku")


@query(
    "markup_advanced",
    f"""{P} SELECT k AS key, CASE WHEN k % 5 >= 2 THEN full_name WHEN k % 3 <> 2 THEN full_name WHEN k % 5 = 1 THEN 'Loja' END AS name,
     CASE WHEN k % 4 >= 2 THEN price END AS price, CASE WHEN k % 4 = 3 THEN listed END AS price_original, CASE k % 2 WHEN 0 THEN 5 ELSE 2 END AS n_images,
     CAST(k AS VARCHAR) AS sku, CASE k % 3 WHEN 1 THEN 'Philips' ELSE 'Não informado' END AS brand, k % 6 <> 0 AS available FROM p""",
)
def markup_advanced(spark, sf):
    found = irregular(spark, sf).select("key", markup.advanced(F.col("tags"), F.col("html"), F.col("url")).alias("r"))
    return found.select("key", "r.name", "r.price", "r.price_original", F.size("r.images").alias("n_images"), "r.sku", "r.brand", "r.available")


@query(
    "markup_generic",
    f"""{P} SELECT k AS key, CASE WHEN k % 5 <> 0 THEN 'Loja' WHEN k % 3 <> 2 THEN 'Loja | ' || full_name END AS name,
     CASE WHEN k % 4 >= 2 THEN price WHEN k % 4 = 1 THEN CAST(5 AS DECIMAL(18,2)) END AS price,
     CASE k % 3 WHEN 0 THEN 'https://loja.example.com/produto/lazy.jpg' END AS image, CASE k % 2 WHEN 0 THEN 'About ' || full_name END AS description FROM p""",
)
def markup_generic(spark, sf):
    return irregular(spark, sf).select("key", markup.generic(F.col("tags"), F.col("url")).alias("r")).select("key", "r.*")


@query(
    "markup_details",
    f"""{P}, n AS (SELECT *, CASE WHEN k % 5 >= 2 THEN CASE WHEN k % 3 <> 2 THEN 'Loja | ' || full_name END WHEN k % 3 <> 2 THEN 'Loja | ' || full_name END AS title,
      CASE k % 4 WHEN 0 THEN type || ' > ' || name WHEN 1 THEN type || ' > ' || name WHEN 2 THEN type ELSE 'Casa | Jardim | C' END AS path FROM p)
     SELECT k AS key, title AS name, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'R$ 5,00' WHEN 2 THEN regexp_extract('R$ ' || {PRICE}, 'R\\$\\s*\\d+[.,]\\d{{2}}') ELSE regexp_extract('R$ ' || {LISTED}, 'R\\$\\s*\\d+[.,]\\d{{2}}') END AS price_text,
     path AS category, CASE k % 3 WHEN 0 THEN 'A sturdy ' || name || ' for every home.' WHEN 1 THEN rtrim(repeat('long ', 25)) END AS description,
     CASE WHEN k % 2 = 0 THEN 4 WHEN k % 3 = 0 THEN 3 ELSE 2 END AS n_images, CASE k % 5 WHEN 2 THEN '12 unidades' WHEN 3 THEN 'Sob consulta' END AS stock,
     CASE WHEN k % 7 = 0 AND title IS NOT NULL THEN 'Samsung' END AS brand, CASE k % 4 WHEN 3 THEN 'Casa e Jardim' END AS main_category FROM n""",
)
def markup_details(spark, sf):
    found = irregular(spark, sf).select("key", "tags", "url", markup.long_name(F.col("tags")).alias("name"), markup.category_path(F.col("tags")).alias("category"))
    return found.select(
        "key", "name", markup.plain_price(markup.page_text(F.col("tags"))).alias("price_text"), "category", markup.description(F.col("tags")).alias("description"),
        F.size(markup.product_images(F.col("tags"), F.col("url"))).alias("n_images"), markup.stock_text(F.col("tags")).alias("stock"), markup.known_brand(F.col("name")).alias("brand"),
        markup.main_category(F.col("category")).alias("main_category"),
    )


@query(
    "markup_breadcrumb",
    f"""{P} SELECT k AS key, CASE k % 4 WHEN 0 THEN type || ' | ' || type || ' | ' || name || ' | ' || name WHEN 2 THEN type END AS path,
     CASE k % 4 WHEN 0 THEN name WHEN 2 THEN type END AS category, CASE k % 4 WHEN 0 THEN name END AS subcategory FROM p""",
)
def markup_breadcrumb(spark, sf):
    return irregular(spark, sf).select("key", normalize.breadcrumb(markup.crumb_texts(F.col("tags"))).alias("r")).select("key", "r.*")


@query(
    "heading_rules",
    f"""{P} SELECT k AS key, CASE WHEN k % 5 >= 2 AND len(full_name) > 20 THEN full_name WHEN k % 5 >= 1 THEN 'Loja' END AS longest, CASE WHEN k % 5 >= 2 THEN full_name END AS second_only,
     CASE WHEN k % 5 >= 1 THEN 'Loja' WHEN k % 3 <> 2 THEN full_name END AS heading_or_title, CASE k % 4 WHEN 2 THEN {PRICE} WHEN 1 THEN '5,00' WHEN 3 THEN {PRICE} END AS selected FROM p""",
)
def heading_rules(spark, sf):
    """The longest telling heading, the second alone, heading before title, and a price by selectors in order."""
    heads = tags.headings(F.col("tags"))
    price = markup.by_selectors(F.col("tags"), [markup.has("class", "^price$"), markup.has("class", "preco-atual"), markup.has("id", "valor")])
    return irregular(spark, sf).select(
        "key", normalize.longest_heading(heads).alias("longest"), tags.heading(F.col("tags"), "second_only").alias("second_only"),
        F.coalesce(tags.heading(F.col("tags")), normalize.title_part(markup.title(F.col("tags")), "last")).alias("heading_or_title"), markup.found(price, r"[\d.,]+").alias("selected"),
    )


FIELDS = ["name", "price", "image"]
MONEY = normalize.MONEY


def readers(spark, sf):
    """What each reader finds in the mixed pages, worked out in the row of the page."""
    h, none, no_price = F.col("html"), F.lit(None).cast("string"), F.lit(None).cast(MONEY)
    ld, og, payload, api = structured.product_in_row(h, "name", "price", "images"), structured.opengraph(h), structured.payload_fields(structured.hydration(h)), structured.api_product(F.col("api"))
    heading = F.nullif(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1), F.lit(""))
    price = normalize.clean_price(F.nullif(F.regexp_extract(h, markup.TAGGED_PRICE, 1), F.lit("")))

    def record(name, price, image=none):
        return F.struct(name.alias("name"), F.coalesce(price, no_price).alias("price"), image.alias("image"))

    first = lambda x: F.try_element_at(x, F.lit(1))
    return fixtures.mixed_pages(spark, sf).select(
        "key",
        record(ld["name"], ld["price"], first(ld["images"])).alias("jsonld"),
        record(og["name"], normalize.clean_price(og["price_raw"]), first(og["images"])).alias("og"),
        record(payload["name"], normalize.clean_price(payload["price_raw"])).alias("hydration"),
        record(api["name"], api["price"], api["image"]).alias("api"),
        record(heading, price).alias("html"),
    )


#: The oracle's readers: name and price of each, and its image where it has one.
R = """WITH p AS (SELECT p_partkey AS k, p_name AS name, CAST(p_retailprice AS DECIMAL(18,2)) AS price, CAST(CAST(p_retailprice AS DECIMAL(18,2)) + 50 AS DECIMAL(18,2)) AS listed FROM part),
r AS (SELECT k, name AS own, CASE WHEN k % 4 = 0 OR (k % 4 = 1 AND k % 8 <> 1) THEN name END AS jn, CASE WHEN k % 4 = 0 THEN price END AS jp, CASE WHEN k % 4 < 2 THEN 'j.jpg' END AS ji,
 CASE WHEN k % 2 = 1 THEN 'O ' || name END AS gn, CASE WHEN k % 2 = 1 THEN listed END AS gp, CASE WHEN k % 2 = 1 THEN 'i.jpg' END AS gi,
 CASE WHEN k % 3 = 0 THEN 'H ' || name END AS hn, CASE WHEN k % 3 = 0 THEN listed END AS hp, CASE WHEN k % 6 = 0 THEN 'A ' || name END AS an, CASE WHEN k % 6 = 0 THEN price END AS ap,
 CASE WHEN k % 5 <> 0 THEN 'M ' || name END AS mn, CASE WHEN k % 5 <> 0 THEN price END AS mp FROM p)"""


@query(
    "cascade_early",
    f"""{R} SELECT k AS key, CASE WHEN jn IS NOT NULL AND jp IS NOT NULL THEN jn ELSE coalesce(gn, jn, mn, 'link ' || CAST(k AS VARCHAR)) END AS name,
     CASE WHEN jn IS NOT NULL AND jp IS NOT NULL THEN jp ELSE coalesce(gp, jp, mp) END AS price, CASE WHEN jn IS NOT NULL AND jp IS NOT NULL THEN ji ELSE coalesce(gi, ji) END AS image FROM r""",
)
def cascade_early(spark, sf):
    link = F.concat(F.lit("link "), F.col("key").cast("string"))
    return readers(spark, sf).select("key", cascade.early(F.col("jsonld"), F.col("og"), F.col("html"), link, FIELDS).alias("r")).select("key", "r.*")


@query(
    "cascade_replacing",
    f"""{R} SELECT k AS key, CASE WHEN jn IS NOT NULL THEN jn WHEN hn IS NOT NULL THEN hn ELSE mn END AS name, CASE WHEN jn IS NOT NULL THEN jp WHEN hn IS NOT NULL THEN coalesce(hp, jp) ELSE mp END AS price,
     CASE WHEN jn IS NOT NULL OR hn IS NOT NULL THEN ji END AS image FROM r""",
)
def cascade_replacing(spark, sf):
    return readers(spark, sf).select("key", cascade.replacing(F.col("jsonld"), F.col("hydration"), F.col("html"), FIELDS).alias("r")).select("key", "r.*")


@query("cascade_updated", f"{R} SELECT k AS key, CASE WHEN jn IS NOT NULL THEN jn ELSE mn END AS name, CASE WHEN jn IS NOT NULL THEN jp ELSE mp END AS price, ji AS image FROM r")
def cascade_updated(spark, sf):
    return readers(spark, sf).select("key", cascade.updated(F.col("jsonld"), F.col("html"), FIELDS, ["name", "price"]).alias("r")).select("key", "r.*")


@query(
    "cascade_repaired",
    f"""{R} SELECT k AS key, CASE WHEN (jp IS NULL OR k % 8 = 4) AND hn IS NOT NULL THEN hn WHEN k % 8 = 4 THEN 'Ferramentas' ELSE jn END AS name, CASE WHEN jp IS NULL THEN hp ELSE jp END AS price, CASE WHEN k % 16 = 0 THEN 'own' END AS brand FROM r""",
)
def cascade_repaired(spark, sf):
    base = F.struct(F.when(F.col("key") % 8 == 4, "Ferramentas").otherwise(F.col("jsonld.name")).alias("name"), F.col("jsonld.price").alias("price"), F.when(F.col("key") % 16 == 0, "own").alias("brand"))
    payload = F.struct(F.col("hydration.name").alias("name"), F.col("hydration.price").alias("price"), F.lit(None).cast("string").alias("brand"))
    rows = readers(spark, sf).select("key", base.alias("b"), payload.alias("p"))
    return rows.select("key", cascade.repaired(F.col("b"), F.col("p"), ["name", "price", "brand"]).alias("r")).select("key", "r.*")


@query(
    "cascade_hybrid",
    f"""{R} SELECT source, count(*) AS n, sum(price) AS total FROM (SELECT CASE WHEN an IS NOT NULL THEN 'api' WHEN jn IS NOT NULL AND jp IS NOT NULL THEN 'json-ld' WHEN hn IS NOT NULL THEN 'json' WHEN mn IS NOT NULL THEN 'html' ELSE 'none' END AS source,
     CASE WHEN an IS NOT NULL THEN ap WHEN jn IS NOT NULL AND jp IS NOT NULL THEN jp WHEN hn IS NOT NULL THEN hp WHEN mn IS NOT NULL THEN mp END AS price FROM r) GROUP BY source""",
)
def cascade_hybrid(spark, sf):
    chain = [("api", F.col("api")), ("json-ld", F.col("jsonld")), ("json", F.col("hydration")), ("html", F.col("html"))]
    return readers(spark, sf).select(cascade.first_valid(chain, FIELDS).alias("v")).groupBy("v.source").agg(F.count(F.lit(1)).alias("n"), F.sum("v.price").alias("total"))


@query("jsonld_any_depth", "SELECT p_partkey AS key, p_name AS name, CAST(p_partkey % 7 AS INT) + CASE WHEN p_partkey % 7 > 0 THEN 1 ELSE 0 END AS level FROM part")
def jsonld_any_depth(spark, sf):
    """Products nested up to 14 objects and lists deep."""
    k = F.col("p_partkey") % 7
    node = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name")))
    body = F.when(k == 0, node).otherwise(F.concat(F.lit('{"a":'), F.expr("repeat('[', CAST(p_partkey % 7 AS INT))"), node, F.expr("repeat(']', CAST(p_partkey % 7 AS INT))"), F.lit("}")))
    pages = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>")).alias("html"))
    found = structured.nested_products(pages, "key")
    return found.select("key", structured.text_at(F.col("node"), "$.name").alias("name"), "level")
