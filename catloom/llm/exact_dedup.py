"""Exact dedup: group by 128-bit content hash, keep one stable id, compare bytes inside the groups.

Native: hashes, grouping and the join stay in the JVM.

The content hash is MD5 (128 bits) of the text with A-Z lower-cased. The
grouping key is the hash together with the text itself, so two texts that
collide fall into two groups: the grouping compares their bytes. Copies are
combined in the map tasks before the shuffle, so a group that holds a third of
all rows leaves each map task as one row. Only groups of two rows or more are
joined back, by MD5 and SHA-256 of the text, without the text: those with more
than ``HOT`` of all rows, which are few, by broadcast, the others by a shuffle
that deals the rows of the hot ones evenly.

Defined cases: a null text counts as empty, and all empty texts are copies of
each other; a null id never wins over an id, and a group of null ids keeps
null; rows that repeat both id and text are one document and share its
verdict; texts of any length are compared whole; an empty table gives an empty
result; other columns are carried or
ignored whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import HOT, stash


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """All columns of ``docs`` under ``__row`` with ``__keep_id, __group_size, __kept, __sha256``.

    ``keep``: ``min`` or ``max``, which id of a group stays.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    best = F.min("i") if keep == "min" else F.max("i")
    groups = (
        docs.select(F.col(id_col).alias("i"), norm.alias("t"))
        .select("i", "t", F.md5(F.col("t").cast("binary")).alias("h"))
        .groupBy("h", "t")
        .agg(best.alias("__keep_id"), F.count(F.lit(1)).alias("__group_size"))
        .where("__group_size > 1")
        .select("h", F.sha2(F.col("t").cast("binary"), 256).alias("s"), "__keep_id", "__group_size")
    )
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), norm.alias("__t")).select(
        "__row", "__id", F.md5(F.col("__t").cast("binary")).alias("h"), F.sha2(F.col("__t").cast("binary"), 256).alias("s")
    )
    groups = stash(groups, "groups")
    least = docs.count() * HOT
    hot = groups.where(F.col("__group_size") > least).select(F.col("h").alias("hot_h"), F.col("s").alias("hot_s"), F.struct("__keep_id", "__group_size").alias("hot"))
    # at most 1 / HOT groups can be hot
    near = rows.join(F.broadcast(hot), (F.col("h") == F.col("hot_h")) & (F.col("s") == F.col("hot_s")), "left")
    # rows that have found their group are dealt by themselves and meet none
    near = near.withColumn("__at", F.when(F.col("hot").isNull(), F.col("h")).otherwise(F.concat(F.lit("-"), F.xxhash64("__row").cast("string"))))
    cold = groups.where(F.col("__group_size") <= least).select(F.col("h").alias("__at"), F.col("s"), F.struct("__keep_id", "__group_size").alias("cold"))
    found = near.join(cold, ["__at", "s"], "left").withColumn("__found", F.coalesce("hot", "cold"))
    multi = F.col("__found").isNotNull()
    return found.select(
        "__row",
        F.when(multi, F.col("__found.__keep_id")).otherwise(F.col("__id")).alias("__keep_id"),
        F.coalesce("__found.__group_size", F.lit(1)).cast("long").alias("__group_size"),
        F.when(multi, F.col("__id").eqNullSafe(F.col("__found.__keep_id"))).otherwise(True).alias("__kept"),
        F.col("s").alias("__sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    found = verdicts(docs, id_col, text_col, keep).where("__kept")
    return found.select("__row.*")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per document: id, ``keep_id, group_size, kept, text_sha256``."""
    slim = docs.select(F.col(id_col), F.col(text_col))
    return verdicts(slim, id_col, text_col, keep).select(
        F.col(f"__row.{id_col}").alias(id_col),
        F.col("__keep_id").alias("keep_id"),
        F.col("__group_size").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.col("__sha256").alias("text_sha256"),
    )


OP10_SQL = """
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")
