"""Prices, availability, names and texts in one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


MONEY = "decimal(18,2)"
#: A price as shops of the region write it (fixed value).
LOCAL_PRICE = r"R\$\s*(\d{1,3}(?:\.\d{3})*(?:,\d{2}))"
FROM_TO = r"(?i)de\s+R\$\s*(\d{1,3}(?:\.\d{3})*(?:,\d{2}))\s+(?:por|para)\s+R\$\s*(\d{1,3}(?:\.\d{3})*(?:,\d{2}))"
#: Price texts with a currency sign (fixed values).
PRICE_TEXTS = (r"R\$\s*\d+[.,]\d{2}", r"\$\s*\d+[.,]\d{2}", r"€\s*\d+[.,]\d{2}", r"\d+[.,]\d{2}\s*R\$")
#: Signals in lower-case page text; the negative ones are asked first (fixed values).
OUT_OF_STOCK = ("indisponível", "esgotado", "out of stock", "sem estoque", "produto esgotado", "unavailable", "discontinued", "descontinuado")
IN_STOCK = ("in stock", "em estoque", "disponível", "available", "comprar", "adicionar ao carrinho", "add to cart")
#: Words of a breadcrumb that are no category (fixed values).
NO_CRUMBS = ("Início", "Home", "OFF", "Shop", "", ">", "»", "/")


def clean_price(text: Column, kind: str = MONEY) -> Column:
    """Digits with ``.`` and ``,``: both mean Brazilian form, a comma alone is the decimal sign.

    A dot alone stays the decimal sign, so ``1.234`` is 1.234; what is no number is null.
    """
    kept = F.regexp_replace(text, r"[^\d.,]", "")
    local = F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return (
        F.when(kept.contains(",") & kept.contains("."), local).when(kept.contains(","), F.replace(kept, F.lit(","), F.lit("."))).otherwise(kept)
    ).try_cast(kind)


def local_price(text: Column, kind: str = MONEY) -> Column:
    """Always Brazilian form: dots dropped, comma to dot."""
    return F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast(kind)


def comma_price(text: Column, kind: str = MONEY) -> Column:
    """Comma to dot only."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast(kind)


def kept_price_text(text: Column) -> Column:
    """Digits with ``.`` and ``,`` as a text: one dot before two last digits becomes a comma, all else stays."""
    kept = F.nullif(F.regexp_replace(text, r"[^\d,.]", ""), F.lit(""))
    return F.when(~kept.contains(",") & kept.rlike(r"\.\d{2}$"), F.replace(kept, F.lit("."), F.lit(","))).otherwise(kept)


def percent_text(share: Column) -> Column:
    return F.concat(F.round(share, 1).cast("decimal(5,1)").cast("string"), F.lit("%"))


def whole_quantity(quantity: Column) -> Column:
    """A quantity such as 3.0 as a whole number."""
    return F.replace(quantity.cast("string"), F.lit(","), F.lit(".")).try_cast("double").cast("int")


def local_prices(html: Column) -> Column:
    """All prices of a page in Brazilian form, in order, as decimals."""
    found = F.regexp_extract_all(html, F.lit(LOCAL_PRICE), F.lit(1))
    return F.transform(found, lambda p: local_price(p))


def from_to(html: Column) -> Column:
    """``de R$ X por R$ Y`` as ``(original, price)``."""
    old, new = F.regexp_extract(html, FROM_TO, 1), F.regexp_extract(html, FROM_TO, 2)
    return F.struct(local_price(old).alias("original"), local_price(new).alias("price"))


#: Two prices of a page, patterns tried in order, and one alone (fixed values).
PAIR_RULES = {
    "near": (r"(?is)de\s+R\$\s*([\d.,]+).*?por.*?R\$\s*([\d.,]+)", r"(?is)de\s+R\$\s*([\d.,]+).*?R\$\s*([\d.,]+)"),
    "any": (r"(?is)de\s+R\$\s*([\d.,]+).*?por.*?R\$\s*([\d.,]+)", r"(?s)R\$\s*([\d.,]+).*?R\$\s*([\d.,]+)"),
}
ANY_PRICE = r"R\$\s*([\d.,]+)"


def price_pair(html: Column, rule: str = "near") -> Column:
    """``(original, price)`` as they stand: a price after ``de`` and one after ``por``, else, by ``near``, any price after that of ``de``, by ``any``, the first two of all; else the first price alone."""
    found = [F.struct(F.regexp_extract(html, p, 1).alias("a"), F.regexp_extract(html, p, 2).alias("b")) for p in PAIR_RULES[rule]]
    pair = F.coalesce(*[F.when(x["b"] != "", x) for x in found])
    return F.struct(local_price(pair["a"]).alias("original"), local_price(F.coalesce(pair["b"], F.nullif(F.regexp_extract(html, ANY_PRICE, 1), F.lit("")))).alias("price"))


def first_two(prices: Column) -> Column:
    """The first two prices: the larger is the original; one price has no original, equal ones neither."""
    two = F.slice(prices, 1, 2)
    hi, lo = F.array_max(two), F.array_min(two)
    return F.struct(F.when((F.size(two) == 2) & (hi > lo), hi).alias("original"), lo.alias("price"))


def top_two(prices: Column, least: float = 10) -> Column:
    """The two highest distinct prices above ``least``: original and price."""
    own = F.sort_array(F.array_distinct(F.filter(prices, lambda p: p > least)), asc=False)
    one, two = F.try_element_at(own, F.lit(1)), F.try_element_at(own, F.lit(2))
    return F.struct(F.when(two.isNotNull(), one).alias("original"), F.coalesce(two, one).alias("price"))


def lowest(prices: Column, above: float = 0) -> Column:
    return F.array_min(F.filter(prices, lambda p: p > above))


def price_text(text: Column) -> Column:
    """The first price text with a currency sign that is not zero; patterns are tried in order."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PRICE_TEXTS]))
    return F.try_element_at(F.filter(found, lambda p: clean_price(p) > 0), F.lit(1))


def original_price(price: Column, listed: Column) -> Column:
    """A list price counts as the original only above the price."""
    return F.when(listed > price, listed)


def money_text(price: Column) -> Column:
    return F.concat(F.lit("R$ "), price.cast(MONEY).cast("string"))


def availability(text: Column) -> Column:
    """Tail of an availability URL: in stock, out of stock or discontinued, else null."""
    tail = F.lower(F.element_at(F.split(text, "/"), -1))
    return F.when(tail == "instock", True).when(tail.isin("outofstock", "discontinued"), False)


def stock_in_text(text: Column) -> Column:
    """Availability from page text; negative signals are asked first."""
    low = F.lower(text)
    return F.when(low.rlike("|".join(OUT_OF_STOCK)), False).when(low.rlike("|".join(IN_STOCK)), True)


def tri_state(flag: Column) -> Column:
    return F.when(flag, "Sim").when(~flag, "Não").otherwise("Desconhecido")


def stock_quantity(text: Column) -> Column:
    """Number before or after a stock word; the pattern is a fixed value."""
    found = F.regexp_extract(text, r"(?i)(\d+)\s*(?:em\s*estoque|disponível|unidades)|estoque:\s*(\d+)", 0)
    return F.regexp_extract(found, r"\d+", 0).try_cast("int")


def clean_name(name: Column) -> Column:
    """Without a count in parentheses."""
    return F.trim(F.regexp_replace(name, r"\s*\(\s*\d+\s*\)", ""))


def shortened(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])


def breadcrumb(items: Column) -> Column:
    """Path, category and subcategory from the texts of a breadcrumb."""
    own = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: ~x.isin(*NO_CRUMBS))
    return F.struct(
        F.when(F.size(own) > 0, F.array_join(own, " | ")).alias("path"),
        F.try_element_at(own, F.lit(-1)).alias("category"),
        F.try_element_at(own, F.lit(-2)).alias("subcategory"),
    )


def title_part(title: Column, which: str = "first") -> Column:
    """The part of a title before the first ``|`` or after the last."""
    parts = F.split(title, r"\|")
    return F.trim(F.element_at(parts, 1 if which == "first" else -1))


def longest_heading(headings: Column) -> Column:
    """The longest heading over 20 characters that has a digit and no seller words; else the first."""
    good = F.filter(headings, lambda h: (F.length(h) > 20) & h.rlike(r"\d") & ~F.lower(h).rlike("vendido|entregue"))
    best = F.array_max(F.transform(good, lambda h: F.struct(F.length(h).alias("n"), h.alias("h"))))["h"]
    return F.coalesce(best, F.try_element_at(headings, F.lit(1)))


def chunks(text: Column, size: int = 245_000) -> Column:
    """Consecutive pieces of ``size`` characters."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def placeholder_name(position: Column) -> Column:
    return F.format_string("Produto %d", position)


