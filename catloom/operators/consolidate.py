"""Bringing the readers' results into one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that lead a written table; the others follow by name (fixed values).
LEADING = ("platform", "name", "price", "price_original", "brand", "url", "category", "available")


def union_ragged(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ordered(df: DataFrame, leading: tuple[str, ...] = LEADING) -> DataFrame:
    """Leading columns first, the others by name."""
    first = [c for c in leading if c in df.columns]
    return df.select(*first, *sorted(c for c in df.columns if c not in first))


def exploded(results: DataFrame, products: str = "products") -> DataFrame:
    """A row for each product of each platform result, with the platform."""
    return results.select("platform", F.explode(products).alias("p")).select("platform", "p.*")


def isolated(results: DataFrame, message: str = "error", most: int = 100) -> DataFrame:
    """One status row for each platform; long messages are cut."""
    return results.withColumn(message, F.left(message, F.lit(most))).withColumn("succeeded", F.col(message).isNull())


def without_failures(products: DataFrame, error: str = "error") -> DataFrame:
    """``on_error='drop'``: failed rows go."""
    return products.where(F.col(error).isNull())


def with_alternate(rows: DataFrame, responses: DataFrame, url: str = "url") -> DataFrame:
    """Response of each URL; where ``…/p`` was not found, that of the URL without ``/p``."""
    alt = F.when(F.col(url).endswith("/p"), F.expr(f"left({url}, length({url}) - 2)"))
    a = responses.select(F.col("url").alias("__u"), F.col("status").alias("__s"), F.col("body").alias("__b"))
    b = responses.select(F.col("url").alias("__u2"), F.col("status").alias("__s2"), F.col("body").alias("__b2"))
    both = rows.withColumn("__alt", alt).join(a, F.col(url) == F.col("__u"), "left").join(b, F.col("__alt") == F.col("__u2"), "left")
    swap = (F.col("__s") == 404) & F.col("__s2").isNotNull()
    return both.select(*[F.col(c) for c in rows.columns], F.when(swap, F.col("__s2")).otherwise(F.col("__s")).alias("status"), F.when(swap, F.col("__b2")).otherwise(F.col("__b")).alias("body"))
