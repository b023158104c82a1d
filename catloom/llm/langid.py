"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes one blank symbol, and
2-grams and 3-grams of code points are hashed into ``BUCKETS``. Training counts
them by language in the executors over a sample of the labelled rows that do
not belong to the held-out fold; at most ``languages * BUCKETS`` sums come to
the driver, where they become a matrix of log-probabilities. The matrix is
broadcast (``languages * 256 KB``) and batches are scored in numpy: gather by
bucket, sum by document.

``fit_rows`` (default 20,000) bounds the sample: rows are taken by a hash of
their id, in a share for each language: languages with few rows give all, the
others the same number. The priors come from all rows. Everything is scored.

Defined cases: a null text or one without letters is ``und`` with score 0; if
there is nothing to learn from every text is ``und``; null languages are not
learned; languages that tie go to the first in alphabetical order; repeated
rows are scored each; texts of any length count whole; an empty table gives an
empty result; other columns are
carried or ignored whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import give_back, giving_back, held_out
from catloom.shipping import ship_package

BUCKETS = 1 << 16
FIT_ROWS = 20_000
SMOOTH = 0.5
CHARS = 1 << 18
UND = "und"
_table: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: itself if it is a letter, else a blank."""
    if not _table:
        points = np.arange(0x110000, dtype=np.uint32)
        points[[i for i in range(0x110000) if not chr(i).isalpha()]] = 32
        _table.append(points)
    return _table[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, text)`` of each n-gram that is not all blank; n-grams don't cross texts."""
    lowered = [t.lower() for t in texts]
    joined = "".join([f" {t} " for t in lowered])
    points = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    sizes = np.array([len(t) for t in lowered], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes + 2)
    wide = points.astype(np.uint64)
    pair = wide[:-1] * np.uint64(0x1F0001) + wide[1:]
    solid = (points[:-1] != 32) | (points[1:] != 32)
    triple = pair[:-1] * np.uint64(0x1F0001) + wide[2:] + np.uint64(1 << 62)
    solid3 = solid[:-1] & (points[1:-1] != 32)

    def bucket(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(48)).astype(np.int64)

    two, three = np.flatnonzero(solid), np.flatnonzero(solid3)
    return np.concatenate([bucket(pair[two]), bucket(triple[three])]), np.concatenate([owner[two], owner[three]])


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHARS`` characters."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHARS:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, t`` to ``lang, bucket, n``: one row for each bucket seen in the task."""
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in slices(texts):
            buckets, owner = ngrams(texts[lo:hi])
            for lang in set(langs[lo:hi]):
                own = np.array([x == lang for x in langs[lo:hi]])
                sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                sums[lang] += np.bincount(buckets[own[owner]], minlength=BUCKETS)
                rows[lang] = rows.get(lang, 0) + int(own.sum())
    for lang, n in sums.items():
        seen = np.flatnonzero(n)
        # the number of rows stands at bucket -1
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(seen) + 1)), pa.array(np.append(seen, -1)), pa.array(np.append(n[seen], rows[lang]))], names=["lang", "bucket", "n"]
        )


@dataclass
class Model:
    """Languages in alphabetical order and their log-probabilities; scored on executors."""

    langs: list[str]
    prior: np.ndarray
    logp: np.ndarray

    def scored(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The most probable language of each text and its posterior probability."""
        whole = [t or "" for t in texts]
        best, score = np.full(len(whole), -1), np.zeros(len(whole))
        if self.langs:
            for lo, hi in slices(whole):
                buckets, owner = ngrams(whole[lo:hi])
                order = np.argsort(owner, kind="stable")
                buckets, owner = buckets[order], owner[order]
                present, first = np.unique(owner, return_index=True)
                if not len(present):
                    continue
                total = np.stack([np.add.reduceat(row[buckets], first) for row in self.logp], axis=1) + self.prior
                top = total.argmax(axis=1)
                score[lo + present] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                best[lo + present] = top
        return [self.langs[i] if i >= 0 else UND for i in best], score


def even_quota(sizes: list[int], most: int) -> float:
    """The rows that each language may give, so that ``most`` are taken together: small ones give all, others the same."""
    left = float(most)
    for k, n in enumerate(sorted(sizes)):
        even = left / (len(sizes) - k)
        if n > even:
            return even
        left -= n
    return float(max(sizes, default=1))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the labelled rows outside the held-out fold."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("i")))
    # one row a language comes to the driver, as in the model
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    quota = even_quota(list(sizes.values()), fit_rows)
    shares = F.from_json(F.lit(json.dumps({lang: quota / n for lang, n in sizes.items()})), "map<string,double>")
    draw = F.pmod(F.xxhash64(F.col("i")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = (
        rows.where(draw < F.element_at(shares, F.col("lang")))
        .select("lang", F.coalesce("t", F.lit("")).alias("t"))
        .mapInArrow(giving_back(_count), "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = np.array(counts.column("lang").to_pylist(), dtype=object)
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    langs = sorted(set(names))
    sums, prior = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = names == lang
        inner = own & (bucket >= 0)
        sums[k, bucket[inner]] = n[inner]
        prior[k] = sizes[lang]
    logp = np.log((sums + SMOOTH) / (sums.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS))
    return Model(langs, np.log(prior / max(prior.sum(), 1)), logp.astype(np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, Column]:
    """``docs`` with ``__lang``: a struct of ``lang_pred`` and ``score``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(texts):
        import pandas as pd

        pred, p = shared.value.scored([None if t is None or t != t else t for t in texts])
        give_back()
        return pd.DataFrame({"lang_pred": pred, "score": p})

    return docs.withColumn("__lang", score(F.col(text_col)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: id, ``held_out, lang_pred, score``."""
    model = fit(docs, id_col, text_col, lang_col, fit_rows)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return predict(slim, model, "t").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "__lang.lang_pred", "__lang.score")


def keep_identified(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` with a predicted language of posterior ``least`` or more."""
    found = predict(docs, fit(docs, **options), options.get("text_col", "text"))
    return found.where((F.col("__lang.lang_pred") != UND) & (F.col("__lang.score") >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_naive_bayes_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
