"""Merging what several readers found for a page, by priority.

``overwrite``: a later reader replaces fields it has, if the record still
lacks a needed field. ``fill_null``: a later reader fills null fields.
``fill_missing``: it fills only fields that no earlier reader had at all, a
present null blocks (presence is a flag, not the value). ``first_valid``: the
first reader with both name and price gives the whole record. ``early``,
``replacing``, ``updated`` and ``repaired`` are the mixed rules of single readers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill_null(readers: list[Column], fields: list[str]) -> Column:
    """Each field from the first reader that has it."""
    return F.struct(*[F.coalesce(*[r[f] for r in readers]).alias(f) for f in fields])


def fill_missing(readers: list[tuple[Column, Column]], fields: list[str]) -> Column:
    """``readers`` are ``(fields, present)``; ``present`` is an array of the names that a reader returned."""
    out = []
    for f in fields:
        value = F.lit(None)
        for found, present in reversed(readers):
            value = F.when(F.array_contains(present, f), found[f]).otherwise(value)
        out.append(value.alias(f))
    return F.struct(*out)


def first_valid(readers: list[tuple[str, Column]], fields: list[str]) -> Column:
    """Record of the first reader with name and price, and its ``source``; ``none`` if there is none."""
    source, values = F.lit("none"), {f: F.lit(None) for f in fields}
    for name, r in reversed(readers):
        good = r["name"].isNotNull() & r["price"].isNotNull()
        source = F.when(good, F.lit(name)).otherwise(source)
        values = {f: F.when(good, r[f]).otherwise(v) for f, v in values.items()}
    return F.struct(source.alias("source"), *[v.alias(f) for f, v in values.items()])


def _updated(now: dict[str, Column], later: Column, when: Column, has: tuple[str, ...]) -> dict[str, Column]:
    return {f: F.when(when & later[f].isNotNull(), later[f]).otherwise(c) if f in has else c for f, c in now.items()}


def overwrite(jsonld: Column, script: Column, og: Column, html: Column, fields: tuple[str, ...] = ("name", "price", "image")) -> Column:
    """JSON-LD; the script price if name or price is missing; OpenGraph and then markup if the name is missing."""
    now = {f: jsonld[f] for f in fields}
    now = _updated(now, script, now["name"].isNull() | now["price"].isNull(), ("price",))
    now = _updated(now, og, now["name"].isNull(), fields)
    now = _updated(now, html, now["name"].isNull(), ("name", "price"))
    return F.struct(*[c.alias(f) for f, c in now.items()])


def filled(value: Column) -> Column:
    """Whether a name or price is there and no empty text."""
    return F.coalesce(value.cast("string") != "", F.lit(False))


def early(jsonld: Column, og: Column, html: Column, link_name: Column, fields: list[str]) -> Column:
    """JSON-LD alone if it has name and price; else OpenGraph overwrites it, markup adds fields, and the link's text is the last name."""
    done = filled(jsonld["name"]) & filled(jsonld["price"])
    merged = {f: F.when(done, jsonld[f]).otherwise(F.coalesce(og[f], jsonld[f], html[f])) for f in fields}
    merged["name"] = F.coalesce(F.when(filled(merged["name"]), merged["name"]), link_name)
    return F.struct(*[c.alias(f) for f, c in merged.items()])


def replacing(jsonld: Column, hydration: Column, html: Column, fields: list[str]) -> Column:
    """JSON-LD; without a name, hydration data overwrites it; still without one, markup stands for the whole record."""
    overwritten = {f: F.coalesce(hydration[f], jsonld[f]) for f in fields}
    named, later = filled(jsonld["name"]), filled(overwritten["name"])
    return F.struct(*[F.when(named, jsonld[f]).when(later, overwritten[f]).otherwise(html[f]).alias(f) for f in fields])


def updated(jsonld: Column, html: Column, fields: list[str], html_fields: list[str]) -> Column:
    """JSON-LD; without a name, every field that markup reads is markup's, null too."""
    named = filled(jsonld["name"])
    return F.struct(*[(F.when(named, jsonld[f]).otherwise(html[f]) if f in html_fields else jsonld[f]).alias(f) for f in fields])


def repaired(base: Column, payload: Column, fields: list[str], generic: tuple[str, ...] = ("materiais", "ferramentas")) -> Column:
    """Pages drawn by scripts: without a price, or with a shop's name and no brand, the payload fills fields and always gives the name."""
    shop = F.coalesce(F.lower(base["name"]).rlike("|".join(generic)), F.lit(False))
    needed = ~filled(base["price"]) | (shop & ~filled(base["brand"]))
    own = lambda f: needed & filled(payload[f]) & (F.lit(f == "name") | ~filled(base[f]))
    return F.struct(*[F.when(own(f), payload[f]).otherwise(base[f]).alias(f) for f in fields])


def source_names(readers: list[tuple[str, Column]]) -> Column:
    """Names of all readers that found a name or a price, joined."""
    return F.concat_ws("+", *[F.when(r["name"].isNotNull() | r["price"].isNotNull(), F.lit(n)) for n, r in readers])
