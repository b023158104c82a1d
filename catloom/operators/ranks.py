"""Positions over a whole table without one big task, and cutting lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catloom.shared import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


#: Rows that are broadcast to a larger frame (some tens of MB); more are joined by a shuffle.
FEW = 200_000


def join_few(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner", most: int = FEW) -> DataFrame:
    """``rows`` joined with a frame that should be small: worked out once, counted, and broadcast up to ``most`` rows.

    So a key that holds a large share of ``rows`` stays where it is. Beyond
    ``most`` rows the keys are many, and the join is left to the planner.
    """
    held = cut(few)
    return rows.join(F.broadcast(held) if held.count() <= most else held, on, how)


def global_positions(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """1-based positions by ``order``: ranges are dealt and numbered apart, a row for each range gives the offsets."""
    dealt = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    heads = sizes.select(F.col("__p").alias("q"), "n").select("q", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("head"))
    rows = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return rows.join(heads, F.col("__p") == F.col("q")).select(*df.columns, (F.col("head") + F.col("__r")).cast("int").alias(out))
