"""Counts, rates, completeness and choices over results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(results: DataFrame, ok: str, items: str) -> DataFrame:
    """Successes, failures and items of the successes."""
    good = F.col(ok)
    return results.agg(F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.when(good, F.col(items))), F.lit(0)).alias("items"))


def throughput(items: Column, seconds: Column) -> Column:
    """Items a second; 0 without time."""
    return F.coalesce(F.try_divide(items, seconds), F.lit(0.0))


def percent(flag: Column) -> Column:
    return F.avg(flag.cast("int")) * 100


def completeness(products: DataFrame, fields: list[str], error: str = "error") -> DataFrame:
    """Filled fields over the rows without an error."""
    good = products.where(F.col(error).isNull())
    return good.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f).isNotNull()).alias(f"with_{f}") for f in fields])


def best_config(runs: DataFrame, name: str, speed: str, rate: str, least: float = 90.0) -> DataFrame:
    """The fastest run of the least rate; else the one of the highest rate."""
    good = F.max_by(name, F.when(F.col(rate) >= least, F.col(speed)))
    return runs.agg(F.coalesce(good, F.max_by(name, rate)).alias("best"))


def first_reaching(runs: DataFrame, name: str, order: str, rate: str, levels: tuple[float, ...] = (100.0, 90.0, 70.0)) -> DataFrame:
    """The first run that reaches the highest level that any run reaches."""
    return runs.agg(F.coalesce(*[F.min_by(name, F.when(F.col(rate) >= v, F.col(order))) for v in levels]).alias("first"))


def extrapolated(seconds: Column, done: Column, target: int = 800) -> Column:
    return F.try_divide(seconds, done) * target
