"""Written outputs: CSV, JSON lines, text reports, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catloom.functions import urls
from catloom.functions.normalize import shortened
from catloom.operators.consolidate import ordered


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str, by_platform: bool = False) -> None:
    """CSV with a header, leading columns first; a folder for each platform if asked for."""
    out = flat(ordered(df)).write.option("header", True)
    (out.partitionBy("platform") if by_platform else out).csv(path)


def write_envelope(products: DataFrame, metrics: DataFrame, path: str) -> None:
    """Products as JSON lines beside a one-row summary."""
    products.write.json(f"{path}/products")
    metrics.coalesce(1).write.json(f"{path}/metadata")


def write_named(df: DataFrame, path: str, url: str = "url", by: str = "url") -> None:
    """CSV in a folder ``file=...`` named by each URL, or with ``by="site"`` by its site.

    A folder for each URL is for a few captured addresses; sites are what a
    large table is split by. A site's rows may be written by many tasks.
    """
    own = F.coalesce(urls.authority(F.col(url)), F.lit("")) if by == "site" else F.col(url)
    flat(df).withColumn("file", safe_name(own)).write.option("header", True).partitionBy("file").csv(path)


def observed(df: DataFrame, progress: Observation, ok: str) -> DataFrame:
    """The rows, counted while they pass: ``rows, succeeded``. For progress without another job."""
    return df.observe(progress, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(ok)).alias("succeeded"))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def report_lines(products: DataFrame, fields: list[str], order: str) -> DataFrame:
    """``value``: one line for each record, ``N/A`` for what is missing."""
    parts = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit("N/A"))) for f in fields]
    return products.orderBy(order).select(F.concat_ws(" | ", *parts).alias("value"))


def preview(products: DataFrame, order: str, rows: int = 5, width: int = 40) -> DataFrame:
    """The first rows, long names cut."""
    return products.orderBy(order).limit(rows).withColumn("name", shortened(F.col("name"), width))


def safe_name(url: Column) -> Column:
    """A file name from a URL."""
    return F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"[^A-Za-z0-9._-]+", "_")
