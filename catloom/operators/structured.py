"""Structured data in pages: JSON-LD, meta tags, script variables, hydration payloads, entity caches.

JSON is held as VARIANT, so a field that is a text, an object or a list by turn
needs no schema. What does not parse is null, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catloom.functions import normalize, urls
from catloom.functions.html import bound

PRODUCT_TYPES = ("Product", "IndividualProduct", "ProductGroup")


def text_at(v: Column, *paths: str) -> Column:
    """The first non-empty text among paths of a variant; objects and lists don't count."""
    found = [F.try_variant_get(v, p, "string") for p in paths]
    return F.coalesce(*[F.when((t != "") & ~t.rlike(r"^[\[{]"), t) for t in found])


def json_scripts(html: Column, kind: str = r"application/ld\+json") -> Column:
    """Bodies of the scripts of a type, in order, quotes and attribute order free."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<script\b[^>]*\btype\s*=\s*[\"']?{kind}[\"']?[^>]*>(.*?)</script>"), F.lit(1))


def jsonld_items(pages: DataFrame, key: str, html: str = "html", graph: bool = True) -> DataFrame:
    """``key, script, item, node``: each object of each script; lists and ``@graph`` are opened one level."""
    bodies = pages.select(key, F.posexplode(json_scripts(F.col(html))).alias("script", "body"))
    parsed = bodies.select(key, "script", F.try_parse_json(F.trim("body")).alias("v")).where("v IS NOT NULL")
    inner = F.try_variant_get("v", "$['@graph']", "array<variant>") if graph else F.lit(None).cast("array<variant>")
    nodes = F.coalesce(inner, F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return parsed.select(key, "script", F.posexplode(nodes).alias("item", "node"))


def is_product(node: Column, types: tuple[str, ...] = ("Product",)) -> Column:
    """``@type`` is a product, alone or in a list."""
    one, many = F.try_variant_get(node, "$['@type']", "string"), F.try_variant_get(node, "$['@type']", "array<string>")
    return F.coalesce(one.isin(*types), F.lit(False)) | F.coalesce(F.arrays_overlap(many, F.array(*map(F.lit, types))), F.lit(False))


def offer_price(node: Column) -> Column:
    """Price text: an aggregate's low, else high price; an offer's price; of a list, the first there is."""
    single = F.coalesce(
        F.when(text_at(node, "$.offers['@type']", "$.Offers['@type']") == "AggregateOffer", text_at(node, "$.offers.lowPrice", "$.Offers.lowPrice", "$.offers.highPrice", "$.Offers.highPrice")),
        text_at(node, "$.offers.price", "$.Offers.price"),
    )
    many = F.coalesce(F.try_variant_get(node, "$.offers", "array<variant>"), F.try_variant_get(node, "$.Offers", "array<variant>"))
    prices = F.filter(F.transform(many, lambda o: F.try_variant_get(o, "$.price", "string")), lambda p: p.isNotNull() & (p != ""))
    return F.coalesce(single, F.try_element_at(prices, F.lit(1)))


def images(node: Column) -> Column:
    """Images as a list, from a list, a text or an object with ``url``."""
    many = F.try_variant_get(node, "$.image", "array<string>")
    one = text_at(node, "$.image", "$.image.url")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def product_columns(node: Column, *names: str) -> list[Column]:
    """The fields of a product node: those named, all if none is."""
    first = F.coalesce(F.try_element_at(F.try_variant_get(node, "$.offers", "array<variant>"), F.lit(1)), F.try_variant_get(node, "$.offers", "variant"))
    low, high = text_at(first, "$.lowPrice", "$.price"), text_at(first, "$.highPrice")
    price, top = normalize.clean_price(low), normalize.clean_price(high)
    stock = text_at(first, "$.availability")
    level = F.try_variant_get(first, "$.inventoryLevel.value", "double")
    fields = {
        "name": text_at(node, "$.name"),
        "brand": text_at(node, "$.brand.name", "$.brand"),
        "sku": text_at(node, "$.sku", "$.mpn"),
        "ean": text_at(node, "$.gtin13", "$.gtin", "$.gtin14", "$.gtin8"),
        "price": normalize.clean_price(offer_price(node)),
        "price_raw": offer_price(node),
        "price_original": normalize.original_price(price, top),
        "currency": F.coalesce(text_at(first, "$.priceCurrency"), F.lit("BRL")),
        "available": normalize.availability(stock),
        "stock_qty": level.cast("int"),
        "stock_level": text_at(first, "$.inventoryLevel.value", "$.inventoryLevel"),
        "images": images(node),
        "description": text_at(node, "$.description"),
        "category": text_at(node, "$.category"),
        "own_url": text_at(node, "$.url", "$.offers.url", "$.mainEntityOfPage['@id']", "$.mainEntityOfPage"),
        "offer_url": text_at(node, "$.offers.url"),
    }
    return [fields[n].alias(n) for n in names or fields]


def product_fields(node: Column, *names: str) -> Column:
    """The same as one struct. A struct is worked out whole where two of its fields are used; columns are not."""
    return F.struct(*product_columns(node, *names))


def jsonld_products(pages: DataFrame, key: str, html: str = "html", types: tuple[str, ...] = PRODUCT_TYPES) -> DataFrame:
    """``key, script, item`` and the fields of every product of a page."""
    found = jsonld_items(pages, key, html).where(is_product(F.col("node"), types))
    return found.select(key, "script", "item", *product_columns(F.col("node")))


def opened(v: Column, graph: bool = True) -> Column:
    """What a script's value holds: the objects of its ``@graph``, of a list, or itself."""
    inner = [F.try_variant_get(v, "$['@graph']", "array<variant>")] if graph else []
    return F.coalesce(*inner, F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def nodes_in_row(html: Column, graph: bool = True) -> Column:
    """The objects of all scripts of a page, in order, as in ``jsonld_items``."""
    parsed = F.transform(json_scripts(html), lambda b: F.try_parse_json(F.trim(b)))
    return F.flatten(F.transform(F.filter(parsed, lambda v: v.isNotNull()), lambda v: opened(v, graph)))


def products_in_row(html: Column, types: tuple[str, ...] = PRODUCT_TYPES) -> Column:
    """The product nodes of a page's JSON-LD, in order."""
    return F.filter(nodes_in_row(html), lambda n: is_product(n, types))


def product_in_row(html: Column, *names: str) -> Column:
    """Fields of the first product of a page's JSON-LD, worked out inside the row; null without one. Only those named, all if none is."""
    return F.try_element_at(F.transform(F.slice(products_in_row(html), 1, 1), lambda n: product_fields(n, *names)), F.lit(1))


def first_product(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key`` and the fields of the first product of each page; pages without one are left out.

    A page is read once, and only the fields that are asked for are worked out:
    a test on what was read would read it again, and a lambda works out all.
    """
    found = pages.select(key, F.explode(F.slice(products_in_row(F.col(html)), 1, 1)).alias("node"))
    return found.select(key, *product_columns(F.col("node")))


def matched_product(pages: DataFrame, key: str, url: str = "url", html: str = "html", types: tuple[str, ...] = PRODUCT_TYPES) -> DataFrame:
    """``key, match_rank`` and the fields of the product that stands for each page; pages without one are left out.

    Ranks: offer URL, own URL, SKU among the URL's digits, else the first; of equal ranks the first in the page counts.
    """
    same = lambda own, key: F.coalesce(urls.compare_key(own) == key, F.lit(False))

    def ranked(n: Column, i: Column, page: Column) -> Column:
        def rank(p: Column) -> Column:
            return F.when(same(p["offer_url"], page["key"]), 1).when(same(p["own_url"], page["key"]), 2).when(F.coalesce(p["sku"] == page["id"], F.lit(False)), 3).otherwise(4)

        return F.struct(bound(product_fields(n, "offer_url", "own_url", "sku"), rank).alias("match_rank"), i.alias("at"))

    def best(nodes: Column, page: Column) -> Column:
        least = F.array_min(F.transform(nodes, lambda n, i: ranked(n, i, page)))
        return bound(least, lambda b: F.transform(F.slice(nodes, b["at"] + 1, 1), lambda n: F.struct(b["match_rank"].alias("match_rank"), n.alias("node"))))

    page = F.struct(urls.compare_key(F.col(url)).alias("key"), urls.trailing_id(F.col(url)).alias("id"))
    one = bound(products_in_row(F.col(html), types), lambda nodes: bound(page, lambda own: best(nodes, own)))
    found = pages.select(key, F.explode(one).alias("m"))
    return found.select(key, "m.match_rank", *product_columns(F.col("m.node")))


def members(v: Column) -> Column:
    """The values in an object or list, none for others."""
    return F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def walk(start: Column, most: Column, condition: Callable[[Column], Column]) -> Column:
    """``level, node`` of everything at or below the variants of the array ``start`` that meets ``condition``, level by level.

    Inside the row, in one expression: at most ``most`` levels are opened, and
    nothing is done once a level is empty. Objects, lists and their values are
    looked at once each.
    """

    def found(nodes: Column, level: Column) -> Column:
        return F.transform(F.filter(nodes, condition), lambda n: F.struct(level.alias("level"), n.alias("node")))

    def step(state: Column, _: Column) -> Column:
        def down(nodes: Column) -> Column:
            level = state["level"] + 1
            return F.struct(nodes.alias("nodes"), level.alias("level"), F.concat(state["found"], found(nodes, level)).alias("found"))

        return F.when(F.size(state["nodes"]) == 0, state).otherwise(bound(F.flatten(F.transform(state["nodes"], members)), down))

    first = F.struct(start.alias("nodes"), F.lit(0).alias("level"), found(start, F.lit(0)).alias("found"))
    # a descending sequence would not be empty
    levels = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, first, step, lambda s: s["found"])


def nesting(json: Column) -> Column:
    """A bound for the depth of a JSON text: the number of its opening signs."""
    return F.length(F.regexp_replace(json, r"[^\[{]", ""))


def nested_products(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key, node, level``: every product at any depth of a page's JSON-LD."""

    def of(body: Column) -> Column:
        v = F.try_parse_json(F.trim(body))
        return F.when(v.isNotNull(), bound(opened(v, graph=False), lambda own: walk(own, nesting(body), lambda n: is_product(n))))

    rows = pages.select(key, F.explode(F.flatten(F.filter(F.transform(json_scripts(F.col(html)), of), lambda x: x.isNotNull()))).alias("f"))
    return rows.select(key, "f.node", "f.level")


def item_list(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Products of an ``ItemList``, entries with a name and a URL: ``key, position, name, url, image, price_raw``."""
    lists = jsonld_items(pages, key, html).where(F.try_variant_get("node", "$['@type']", "string") == "ItemList")
    entries = lists.select(key, F.posexplode(F.try_variant_get("node", "$.itemListElement", "array<variant>")).alias("position", "e"))
    inner = F.coalesce(F.try_variant_get("e", "$.item", "variant"), F.col("e"))
    rows = entries.select(key, "position", inner.alias("e")).where(is_product(F.col("e")))
    out = rows.select(key, "position", text_at(F.col("e"), "$.name").alias("name"), text_at(F.col("e"), "$.url", "$.offers.url").alias("url"), text_at(F.col("e"), "$.image", "$.image.url").alias("image"), offer_price(F.col("e")).alias("price_raw"))
    return out.where("name IS NOT NULL AND url IS NOT NULL")


def in_stock_products(pages: DataFrame, key: str, html: str = "html", brand: str | None = None) -> DataFrame:
    """Products of a page with a name, a price above 0 and stock; a default brand."""
    found = jsonld_products(pages, key, html).where("name IS NOT NULL AND price > 0 AND available")
    return found.withColumn("brand", F.coalesce("brand", F.lit(brand))) if brand else found


def meta(html: Column, name: str) -> Column:
    """Content of the first ``meta`` tag of a property or name, attributes in any order."""
    safe = name.replace(".", r"\.")
    tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\b(?:property|name)\s*=\s*[\"']{safe}[\"'][^>]*>", 0)
    value = F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*(?:\"([^\"]*)\"|'[^']*')", 1)
    single = F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*'([^']*)'", 1)
    return F.when(tag != "", F.coalesce(F.nullif(value, F.lit("")), F.nullif(single, F.lit(""))))


def metas(html: Column, name: str) -> Column:
    """Contents of all ``meta`` tags of a property, in order."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)<meta\b[^>]*\b(?:property|name)\s*=\s*[\"']{name}[\"'][^>]*>"), F.lit(0))
    return F.transform(tags, lambda t: F.regexp_extract(t, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1))


def opengraph(html: Column) -> Column:
    """OpenGraph fields as a struct."""
    stock = F.lower(meta(html, "og:availability"))
    return F.struct(
        meta(html, "og:title").alias("name"),
        meta(html, "og:price:amount").alias("price_raw"),
        meta(html, "og:price:currency").alias("currency"),
        metas(html, "og:image").alias("images"),
        stock.contains("instock").alias("available"),
        meta(html, "og:description").alias("description"),
    )


def product_meta(html: Column) -> Column:
    """``product:`` and ``twitter:`` meta fields."""
    return F.struct(
        F.coalesce(meta(html, "og:title"), meta(html, "twitter:title")).alias("name"),
        meta(html, "product:price:amount").alias("price_raw"),
        meta(html, "product:brand").alias("brand"),
        meta(html, "twitter:image").alias("image"),
    )


def script_price(html: Column, variable: str = "produto_preco") -> Column:
    """Number of an inline script variable."""
    found = F.regexp_extract(html, rf"var {variable}\s*=\s*([\d.]+)", 1)
    return F.when(found != "", found)


def hydration(html: Column) -> Column:
    """The hydration payload as a variant: the data script, else the initial state."""
    data = F.regexp_extract(html, r"(?is)<script\b[^>]*\bid=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>", 1)
    state = F.regexp_extract(html, r"(?s)window\.__INITIAL_STATE__\s*=\s*(\{.*?\});", 1)
    return F.try_parse_json(F.coalesce(F.nullif(data, F.lit("")), F.nullif(state, F.lit(""))))


def assigned_json(html: Column, name: str) -> Column:
    """What a script assigns to ``name``, as a variant: the text after the first ``=``, without the last ``;``."""
    body = F.regexp_extract(html, rf"(?s){name}\s*=\s*(.*?);?\s*</script>", 1)
    return F.try_parse_json(F.nullif(F.trim(body), F.lit("")))


def payload_fields(payload: Column) -> Column:
    """Name, price, SKU and EAN by pattern over the re-serialised payload."""
    blob = F.to_json(payload)

    def at(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(blob, pattern, 1), F.lit(""))

    return F.struct(
        at(r'(?i)"(?:name|title|productName)"\s*:\s*"([^"]+)"').alias("name"),
        at(r'(?i)"(?:price|sellingPrice)"\s*:\s*"?(?:R\$\s*)?([\d.,]+)"?').alias("price_raw"),
        at(r'(?i)"(?:sku|productId|itemId)"\s*:\s*"?(\d+)"?').alias("sku"),
        at(r'(?i)"(?:ean|gtin|gtin13)"\s*:\s*"?(\d+)"?').alias("ean"),
    )


def payload_products(frame: DataFrame, key: str, payload: str, levels: int = 3) -> DataFrame:
    """Objects down to ``levels`` that look like a product (a name and a price of any alias): ``key, level, name, price_raw``."""
    name = lambda v: text_at(v, "$.name", "$.productName", "$.title")
    price = lambda v: text_at(v, "$.price", "$.sellingPrice", "$.finalPrice")
    start = F.when(F.col(payload).isNotNull(), F.array(payload))
    rows = frame.select(key, F.explode(walk(start, F.lit(levels), lambda v: name(v).isNotNull() & price(v).isNotNull())).alias("f"))
    return rows.select(key, "f.level", name(F.col("f.node")).alias("name"), price(F.col("f.node")).alias("price_raw"))


def cache_nodes(frame: DataFrame, key: str, payload: str) -> DataFrame:
    """Entity cache as rows ``key, entity, node``."""
    return frame.sparkSession.sql(f"SELECT t.{key}, e.key AS entity, e.value AS node FROM {{t}} AS t, LATERAL variant_explode(t.{payload}) AS e", t=frame)


def cached_products(frame: DataFrame, key: str, payload: str) -> DataFrame:
    """Products of an entity cache with their price range, selling price and list price looked up by reference.

    Entities are looked up in a map inside the row. A reference without its
    node stands for itself, so prices written in it count; else they are null.
    """
    nodes = F.try_variant_get(payload, "$", "map<string,variant>")

    def looked_up(v: Column) -> Column:
        return F.coalesce(nodes[F.try_variant_get(v, "$.id", "string")], v)

    def low(v: Column) -> Column:
        return F.try_variant_get(looked_up(v), "$.lowPrice", MONEY_TYPE)

    def product(e: Column) -> Column:
        p = e["value"]
        span = looked_up(F.try_variant_get(p, "$.priceRange", "variant"))
        price, listed = low(F.try_variant_get(span, "$.sellingPrice", "variant")), low(F.try_variant_get(span, "$.listPrice", "variant"))
        paths = F.filter(F.split(F.try_variant_get(p, "$.categories.json[0]", "string"), "/"), lambda s: s != "")
        return F.struct(
            e["key"].alias("entity"),
            text_at(p, "$.productName").alias("name"),
            text_at(p, "$.brand").alias("brand"),
            price.alias("price"),
            normalize.original_price(price, listed).alias("price_original"),
            F.try_element_at(paths, F.lit(-1)).alias("category"),
        )

    own = F.filter(F.map_entries(nodes), lambda e: e["key"].startswith("Product:") & ~e["key"].contains("."))
    return frame.select(key, F.inline(F.transform(own, product)))


def priced_entities(frame: DataFrame, key: str, payload: str, part: str = "price") -> DataFrame:
    """``key, entity, node`` of the entities whose key holds ``part``."""
    return cache_nodes(frame, key, payload).where(F.lower("entity").contains(part))


MONEY_TYPE = normalize.MONEY


def api_product(body: Column) -> Column:
    """Product responses of several shop interfaces: the first path that has a value wins."""
    v = F.try_parse_json(body)
    return F.struct(
        text_at(v, "$.product.title", "$.items[0].name", "$.name", "$.productName", "$.title").alias("name"),
        normalize.clean_price(
            text_at(v, "$.product.variants[0].price", "$.items[0].price_range.minimum_price.final_price.value", "$.items[0].sellers[0].commertialOffer.Price", "$.price", "$.finalPrice", "$.sellingPrice")
        ).alias("price"),
        normalize.clean_price(text_at(v, "$.product.variants[0].compare_at_price", "$.items[0].sellers[0].commertialOffer.ListPrice", "$.listPrice", "$.originalPrice")).alias("listed"),
        text_at(v, "$.product.vendor", "$.brand.name", "$.brand").alias("brand"),
        text_at(v, "$.product.variants[0].sku", "$.items[0].sku", "$.sku").alias("sku"),
        text_at(v, "$.product.image.src", "$.items[0].image.url", "$.image").alias("image"),
        F.try_variant_get(v, "$.items[0].sellers[0].commertialOffer.AvailableQuantity", "int").alias("stock_qty"),
    )


def api_shape(body: Column) -> Column:
    """Kind of a catalogue response by its shape."""
    v = F.try_parse_json(body)
    has = lambda p: F.try_variant_get(v, p, "variant").isNotNull()
    return (
        F.when(has("$.products[0].variants"), "shopify").when(has("$[0].productId") & has("$[0].items"), "vtex").when(has("$[0].prices"), "woocommerce").when(has("$.data.products.items"), "magento")
    )


def pages_needed(products: Column, page_size: Column) -> Column:
    """Pages of a catalogue interface that hold so many products."""
    return F.ceil(products / page_size).cast("int")


def inventory(html: Column) -> Column:
    """Counts of structured data in a page, and its OpenGraph names."""
    names = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*property=[\"'](og:[^\"']+)[\"']"), F.lit(1))
    return F.struct(F.size(json_scripts(html)).alias("jsonld"), F.array_sort(F.array_distinct(names)).alias("og"), html.contains("__NEXT_DATA__").alias("next_data"))
