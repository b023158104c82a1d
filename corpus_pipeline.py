"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

Language ID drops what it can't identify, exact dedup and MinHash near-dedup
keep one document of each group, mixing puts the rest in the order of the
sources' target weights, and byte-level BPE encodes and decodes every text. The
result holds each document's ``position`` in the mixed order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catloom.llm import bottomk, byte_bpe, exact_dedup, langid, mixing
from catloom.llm.common import stash

#: The column that takes the position from mixing to the result, as files don't keep the order of rows.
PLACE = "__position"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is identified with a posterior of 0.5 or more.

    A null or empty text, or one without a letter, has no language and goes;
    ties go to the first language by name; repeated rows are judged each; an
    empty table stays empty; all columns stay, whatever their names.
    """
    return langid.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of equal texts.

    Null and empty texts are one group; a null id stays only where its group
    has no other; of rows that repeat id and text one stays; long texts count
    whole; an empty table stays empty; all columns stay, whatever their names.
    """
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies, that of the smallest id.

    Null and empty texts and rows without id link with nothing and stay; rows
    that repeat an id go together; long texts count whole; an empty table stays
    empty; all columns stay, whatever their names.
    """
    return bottomk.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, place_col: str | None = None) -> DataFrame:
    """Put the documents in Pfair order of their sources.

    A null source is a source; ids that are null or repeated are ranked as rows
    of their own; texts are not looked at; an empty table stays empty; all
    columns stay, and ``place_col`` must be none of them.
    """
    return mixing.mix_rows(docs, place_col=place_col)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes for each document, and its position where mixing left one.

    A null or empty text has no ids and decodes to no bytes; null ids stay;
    repeated rows are encoded each; texts of any length are encoded whole; an
    empty table gives an empty result; other columns are ignored.
    """
    return byte_bpe.digests(docs, place_col=PLACE if PLACE in docs.columns else None)


STAGES = [
    ("langid", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: The stages learn, sketch and fold; SQL can't say them. The tests hold run()'s rows, order, counts and digests
#: against plain Python and the tiktoken library; the languages, which are learnt, against the posterior of the model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir, **({"place_col": PLACE} if name == "mixing" else {}))
        if k + 1 < len(STAGES):
            docs = stash(docs, name)
    return docs
