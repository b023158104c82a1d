"""Heuristic readers of product markup, over the tag rows of one page (``html.tag_lists``).

Every reader works inside its row: filters over the page's array of tags, no
shuffle. A field that a page doesn't have is null, an image list empty; of
several fitting elements the first in the page counts. Empty and null pages
have no tags, and so no fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from catloom.functions import normalize, urls
from catloom.functions.html import Condition, bound, first, first_text, heading, headings, inside, text_of, texts

#: Patterns and words of the readers (fixed values).
TAGGED_PRICE = r"(?s)R\$\s*(?:<!--.*?-->)?\s*([\d.,]+)"
ELEMENT_PRICES = (r"(?i)R\$\s*[\d.,]+", r"(?i)BRL\s*[\d.,]+", r"(?i)[\d.,]+\s*reais?")
PLAIN_PRICES = (r"R\$\s*\d+[.,]\d{2}", r"\$\s*\d+[.,]\d{2}", r"€\s*\d+[.,]\d{2}")
SKU_IN_PAGE = r"""(?i)(?:sku|codigo|SKU)["']?\s*:?\s*["']?([A-Z0-9\-]+)"""
SKU_IN_URL = r"-(\d+)$"
BRAND_IN_TEXT = r"(?i)marca[:\s]*([A-Z][A-Za-z]+)"
STOCK_TEXTS = (r"(?i)\d+\s*em\s*estoque", r"(?i)\d+\s*disponível", r"(?i)estoque:\s*\d+", r"(?i)\d+\s*unidades")
KNOWN_BRANDS = ("nadir", "samsung", "apple", "flash limp", "philips", "electrolux", "brastemp")
MAIN_CATEGORIES = ((("utilidades domésticas",), "Utilidades Domésticas"), (("eletrônicos",), "Eletrônicos"), (("casa", "jardim"), "Casa e Jardim"))
UNKNOWN_BRAND = "Não informado"


def attr(tag: Column, name: str) -> Column:
    return F.coalesce(tag["attrs"][name], F.lit(""))


def has(name: str, pattern: str) -> Condition:
    """Tags whose attribute matches, in any case."""
    return lambda t: attr(t, name).rlike(f"(?i){pattern}")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def longer(text: Column, least: int) -> Column:
    """The text if it has more than ``least`` characters."""
    return bound(text, lambda x: F.when(F.length(x) > least, x))


def texts_in(tags: Column, elements: Column) -> Column:
    return F.transform(elements, lambda t: text_of(tags, t))


def filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def page_text(tags: Column) -> Column:
    """The text of the page's body, or of its first element."""
    body = F.coalesce(first(tags, lambda t: t["tag"] == "body"), F.try_element_at(tags, F.lit(1)))
    return bound(body, lambda e: text_of(tags, e))


def title(tags: Column) -> Column:
    return filled(first_text(tags, lambda t: t["tag"] == "title"))


def source(tag: Column) -> Column:
    """Source of an image, plain or lazy."""
    return F.coalesce(filled(tag["attrs"]["src"]), filled(tag["attrs"]["data-src"]))


def capped_images(images: Column, most: int = 5, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """The first ``most`` images, each ``key`` once."""
    keys = F.transform(images, key)
    return F.slice(F.filter(images, lambda x, i: F.array_position(keys, key(x)) == i + 1), 1, most)


def second_heading(tags: Column, html: Column) -> Column:
    """``name, price_raw, images, sku``: the second heading, else the first; the first price; five images with a telling source."""
    named = F.filter(tags, lambda t: (t["tag"] == "img") & t["attrs"]["src"].isNotNull())
    telling = F.filter(F.transform(named, source), lambda s: F.lower(s).rlike("product|image"))
    return F.struct(
        filled(heading(tags, "second")).alias("name"),
        found(html, TAGGED_PRICE, 1).alias("price_raw"),
        F.slice(telling, 1, 5).alias("images"),
        found(html, SKU_IN_PAGE, 1).alias("sku"),
    )


def advanced(tags: Column, html: Column, url: Column) -> Column:
    """``name, price, price_original, images, sku, brand, available``.

    A short name gives way to the last part of the title; the two highest
    prices above 10 are original and price; images count once without their
    query; the brand stands in the text.
    """
    name = filled(heading(tags, "second"))
    parts = F.split(title(tags), r"\|")
    tail = F.when(F.size(parts) >= 2, F.trim(F.element_at(parts, -1)))
    prices = F.transform(F.regexp_extract_all(html, F.lit(TAGGED_PRICE), F.lit(1)), lambda p: normalize.local_price(p))
    two = normalize.top_two(prices)
    images = F.filter(F.transform(F.filter(tags, lambda t: t["tag"] == "img"), lambda t: attr(t, "src")), lambda s: F.lower(s).rlike("produto|product"))
    text = page_text(tags)
    return F.struct(
        F.when(name.isNull() | (F.length(name) < 10), F.coalesce(tail, name)).otherwise(name).alias("name"),
        two["price"].alias("price"),
        two["original"].alias("price_original"),
        capped_images(images, key=lambda s: F.substring_index(s, "?", 1)).alias("images"),
        found(url, SKU_IN_URL, 1).alias("sku"),
        F.coalesce(found(text, BRAND_IN_TEXT, 1), F.lit(UNKNOWN_BRAND)).alias("brand"),
        (~F.lower(F.coalesce(text, F.lit(""))).contains("indisponível")).alias("available"),
    )


def generic(tags: Column, url: Column) -> Column:
    """``name, price, image, description``: heading or title; a price in the first element of each telling class, id and itemprop."""

    def priced(element: Column) -> Column:
        return bound(element, lambda text: F.coalesce(*[found(text, p) for p in ELEMENT_PRICES]))

    places = (has("class", "price|preco|valor"), has("id", "price|preco|valor"), lambda t: t["attrs"]["itemprop"] == "price")
    image = F.coalesce(
        first(tags, lambda t: (t["tag"] == "img") & has("class", "product|produto")(t)), first(tags, lambda t: (t["tag"] == "img") & (t["attrs"]["itemprop"] == "image"))
    )
    return F.struct(
        F.coalesce(filled(F.try_element_at(headings(tags), F.lit(1))), title(tags)).alias("name"),
        normalize.clean_price(F.coalesce(*[priced(first_text(tags, p)) for p in places])).alias("price"),
        urls.resolve(url, source(image)).alias("image"),
        first(tags, lambda t: (t["tag"] == "meta") & (t["attrs"]["name"] == "description"))["attrs"]["content"].alias("description"),
    )


def long_name(tags: Column) -> Column:
    """The first over 5 characters of: heading, element with a product title's class, with its id, title."""
    titled = "product.*title|title.*product"
    options = [F.try_element_at(headings(tags), F.lit(1)), first_text(tags, has("class", titled)), first_text(tags, has("id", titled)), title(tags)]
    return F.coalesce(*[longer(o, 5) for o in options])


def plain_price(text: Column) -> Column:
    """The first price text that is not zero; patterns are tried in order."""
    all_found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PLAIN_PRICES]))
    return F.try_element_at(F.filter(all_found, lambda p: normalize.clean_price(p) > 0), F.lit(1))


def crumb_texts(tags: Column) -> Column:
    """Texts of the links, spans and items of the page's breadcrumb, found by class, type or label."""
    places = (
        has("class", "breadcrumb"),
        lambda t: t["attrs"]["itemtype"] == "http://schema.org/BreadcrumbList",
        lambda t: t["attrs"]["typeof"] == "BreadcrumbList",
        lambda t: (t["tag"] == "nav") & has("aria-label", "breadcrumb")(t),
    )
    element = F.coalesce(*[first(tags, p) for p in places])
    return bound(element, lambda e: texts_in(tags, F.filter(inside(tags, e), lambda t: t["tag"].isin("a", "span", "li"))))


def category_path(tags: Column) -> Column:
    """Category: links of a breadcrumb or navigation, else its other texts; a meta tag; the first three category links."""

    useful = lambda x: ~x.isin("Início", "Home", "")

    def joined(names: Column) -> Column:
        return F.when(F.size(names) > 0, F.array_join(names, " > "))

    def path(e: Column) -> Column:
        own = inside(tags, e)
        links = F.filter(texts_in(tags, F.filter(own, lambda t: t["tag"] == "a")), useful)
        # a tag that stops behind itself has no other in it
        leaves = F.filter(own, lambda t: (t["stop"] == t["pos"] + 1) | t["text"].isNotNull())
        names = bound(leaves, lambda x: F.when(F.size(x) > 0, texts_in(tags, x)).otherwise(F.array(text_of(tags, e))))
        told = F.when(F.length(text_of(tags, e)) > 5, joined(F.filter(F.array_distinct(names), useful)))
        return F.when(e.isNotNull(), F.coalesce(joined(links), told))

    places = (has("class", "breadcrumb"), has("id", "breadcrumb"), has("class", "navigation|nav"))
    named = first(tags, lambda t: (t["tag"] == "meta") & has("name", "category")(t))["attrs"]["content"]
    menu = F.slice(F.filter(tags, lambda t: (t["tag"] == "a") & has("href", "categoria|category")(t)), 1, 3)
    menu = F.filter(texts_in(tags, menu), lambda x: x != "")
    return F.coalesce(*[bound(first(tags, p), path) for p in places], filled(named), F.when(F.size(menu) > 0, F.array_join(menu, " | ")))


def description(tags: Column) -> Column:
    """Text over 20 characters of the first element with a telling class, or id; else the first paragraph over 100."""
    words = "description|desc|details|sobre"
    options = [longer(first_text(tags, has(a, words)), 20) for a in ("class", "id")]
    paragraph = F.try_element_at(F.filter(texts(tags, lambda t: t["tag"] == "p"), lambda x: F.length(x) > 100), F.lit(1))
    return F.coalesce(*options, paragraph)


def product_images(tags: Column, url: Column) -> Column:
    """Of the first five images of a telling class, then id, then source, each once and resolved, those that are no icons."""
    images = F.filter(tags, lambda t: t["tag"] == "img")
    groups = [F.filter(images, c) for c in (has("class", "product|main|primary"), has("id", "product|main|primary"), has("src", "product|thumb|gallery"))]
    sources = F.filter(F.transform(F.flatten(F.array(*groups)), source), lambda s: s.isNotNull())
    resolved = F.slice(F.array_distinct(F.transform(sources, lambda s: urls.resolve(url, s))), 1, 5)
    return F.filter(resolved, lambda s: ~s.rlike("(?i)icon|logo|btn|button"))


def stock_text(tags: Column) -> Column:
    """A count beside a stock word, else the text of the first element with a stock class."""
    counted = bound(page_text(tags), lambda text: F.coalesce(*[found(text, p) for p in STOCK_TEXTS]))
    return F.coalesce(counted, filled(first_text(tags, has("class", "stock|estoque|disponib"))))


def known_brand(name: Column, brands: tuple[str, ...] = KNOWN_BRANDS) -> Column:
    """The first known brand in a title, in title form."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.contains(b), F.lit(b.title())) for b in brands])


def main_category(path: Column) -> Column:
    """Main category that a category's words stand for."""
    low = F.lower(path)
    out = F.lit(None).cast("string")
    for words, name in reversed(MAIN_CATEGORIES):
        every = low.contains(words[0])
        for w in words[1:]:
            every = every & low.contains(w)
        out = F.when(every, F.lit(name)).otherwise(out)
    return out


def by_selectors(tags: Column, selectors: list[Condition]) -> Column:
    """Text of the first element of the first selector that has one with text."""
    return F.coalesce(*[filled(first_text(tags, s)) for s in selectors])
