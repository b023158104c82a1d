"""Registry of readers: a name, and a transformation of pages into product rows.

A reader takes pages with ``url`` and ``body`` and gives ``url, name, price``
and whatever else it finds; ``jsonld``, ``opengraph`` and ``hydration`` are
there from the start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.functions import normalize
from catloom.operators import structured
from catloom.operators.consolidate import union_ragged

Reader = Callable[[DataFrame], DataFrame]
_readers: dict[str, Reader] = {}


def reader(name: str) -> Callable[[Reader], Reader]:
    """Register a reader."""

    def put(fn: Reader) -> Reader:
        _readers[name] = fn
        return fn

    return put


def get(name: str, default: str | None = None) -> Reader:
    """The reader of a name; the default's, or one that passes rows through, where it is not there."""
    if name in _readers:
        return _readers[name]
    return _readers[default] if default in _readers else (lambda pages: pages)


def read_all(pages: DataFrame, label: str, names: list[str], default: str | None = None) -> DataFrame:
    """Each page through the reader of its label; labels without a reader go to the default."""
    return read_sites(pages, {n: n for n in names}, label, default)


def read_sites(pages: DataFrame | Callable[[list[str] | None], DataFrame], routes: dict[str, str], site: str = "site", default: str | None = None) -> DataFrame:
    """Each page through the reader that ``routes`` names for its site; other sites, and pages without one, go to the default.

    ``pages`` may be a source that loads the pages of a list of sites (all for
    None); then a reader's branch reads no other folders than its own sites'.
    """
    source = pages if callable(pages) else lambda own: pages
    groups: dict[str, list[str]] = {}
    for own, name in routes.items():
        groups.setdefault(name, []).append(own)
    frames = [source(own).where(F.col(site).isin(*own)).transform(get(name, default)) for name, own in groups.items()]
    known = F.coalesce(F.col(site).isin(*routes), F.lit(False))
    frames.append(source(None).where(~known).transform(get(default or "", default)))
    return union_ragged(frames)


@reader("jsonld")
def jsonld(pages: DataFrame) -> DataFrame:
    found = pages.withColumn("__p", structured.product_in_row(F.col("body"), "name", "price"))
    return found.select(*_others(pages), F.col("__p.name").alias("name"), F.col("__p.price").alias("price"))


@reader("opengraph")
def opengraph(pages: DataFrame) -> DataFrame:
    found = pages.withColumn("__p", structured.opengraph(F.col("body")))
    return found.select(*_others(pages), F.col("__p.name").alias("name"), normalize.clean_price(F.col("__p.price_raw")).alias("price"))


@reader("hydration")
def hydration(pages: DataFrame) -> DataFrame:
    found = pages.withColumn("__p", structured.payload_fields(structured.hydration(F.col("body"))))
    return found.select(*_others(pages), F.col("__p.name").alias("name"), normalize.clean_price(F.col("__p.price_raw")).alias("price"))


def _others(pages: DataFrame) -> list[str]:
    return [c for c in pages.columns if c != "body"]
