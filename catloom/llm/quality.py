"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A bounded sample of labelled rows outside the held-out fold is split by a hash
of the id. One part gives the two dictionaries; the other part gives the
calibration. Every text is cut into blocks of ``BLOCK`` bytes (all of them, so
that a dictionary counts in a long text as in a short one) and each block is
compressed once with either dictionary. The normalised compressed-size
difference ``(good - bad) / (good + bad)`` over the whole text becomes a
probability by logistic regression on the calibration part.

``fit_rows`` (default 6,000) bounds the sample for each label, taken by a hash
of the id; ``fit_blocks`` (default 12,000, some 25 MB) the blocks of a label's
dictionary, drawn by hash over all blocks of the sampled texts, whole ones
however long. Dictionaries and calibrating differences are worked out from
whole texts in the tasks; the driver gets blocks and pairs of numbers.

Defined cases: a null or empty text has the difference 0 and so the score of
that difference; without rows of both labels every score is the share of label
1, or 0.5 if there is none; an id with several labels counts by its larger one;
null labels are ignored; repeated rows are scored each; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import held_out
from catloom.shipping import ship_package

FIT_ROWS = 6_000
BLOCK = 2_048
FIT_BLOCKS = 12_000
DICTIONARY = 112_640
LEVEL = 3
_loaded: dict[int, tuple] = {}


def dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary of blocks; their tail as it is where training has too little to go on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def blocks(text: str) -> list[bytes]:
    """The bytes of a text, cut into blocks."""
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def _blocks(batches):
    import pyarrow as pa

    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = blocks(text.as_py())
            for at in range(0, len(raw), 4096):
                part = raw[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(part), pa.int32()), pa.array(part, pa.binary())], names=["y", "block"])


def compressors(good: bytes, bad: bytes) -> tuple:
    import zstandard

    out = []
    for raw in (good, bad):
        known = zstandard.ZstdCompressionDict(raw)
        known.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))
    return tuple(out)


def difference(text: str, pair: tuple) -> float:
    """Above 0 if the dictionary of bad text compresses a text better; 0 without any text."""
    raw = blocks(text)
    if not raw:
        return 0.0
    good, bad = (sum(len(c.compress(b)) for b in raw) for c in pair)
    return (good - bad) / (good + bad)


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    base: float
    ident: int = field(default_factory=lambda: int(np.random.SeedSequence().entropy % (1 << 62)))

    def differences(self, texts) -> np.ndarray:
        if self.ident not in _loaded:
            _loaded.clear()
            _loaded[self.ident] = compressors(self.good, self.bad)
        return np.array([difference(t or "", _loaded[self.ident]) for t in texts], dtype=float)

    def scores(self, texts) -> np.ndarray:
        if not self.good or not self.bad:
            return np.full(len(texts), 1 / (1 + np.exp(-self.base)))
        x = self.differences(texts)
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * x, -50, 50)))


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic curve by Newton's method, with Platt's smoothed targets."""
    if not len(x):
        return 0.0, 0.0
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        grad = z.T @ (p - target) + 1e-3 * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_blocks: int = FIT_BLOCKS) -> Model:
    """Learn from a bounded sample of ``labels(doc_id, quality)`` outside the held-out fold."""
    known = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("y"))
    )
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("y") == 1, F.lit(fit_rows / max(1, sizes.get(1, 0)))).otherwise(F.lit(fit_rows / max(1, sizes.get(0, 0))))
    # twice fit_rows ids at most on average, whatever the size of the tables
    sample = known.where(draw < share).withColumnRenamed("doc_id", "__id")
    spark = docs.sparkSession
    ship_package(spark)
    rows = (
        docs.select(F.col("doc_id"), F.col("text").alias("t"))
        .where(F.length("t") > 0)
        .join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
        .select("t", "y", F.pmod(F.xxhash64("__id", F.lit("part")), F.lit(2)).alias("part"))
    )
    made = rows.where("part = 0").select("y", "t").mapInArrow(_blocks, "y int, block binary")

    def chosen(label: int) -> list[bytes]:
        drawn = made.where(F.col("y") == label).orderBy(F.xxhash64("block"), "block").limit(fit_blocks).select("block").toArrow()
        return drawn.column("block").to_pylist()

    bad_blocks, good_blocks = chosen(0), chosen(1)
    total = sum(sizes.values())
    prior = (sizes.get(1, 0) + 1) / (total + 2)
    if not bad_blocks or not good_blocks:
        return Model(b"", b"", 0.0, float(np.log(prior / (1 - prior))))
    model = Model(dictionary(good_blocks), dictionary(bad_blocks), 0.0, 0.0)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def differences(texts):
        import pandas as pd

        return pd.Series(shared.value.differences(texts))

    pairs = rows.where("part = 1").select(differences("t").alias("x"), "y").toArrow()
    # the sums go by value, so that the order of tasks changes nothing
    found = sorted(zip(pairs.column("x").to_pylist(), pairs.column("y").to_pylist(), strict=True))
    shared.destroy()
    x, y = np.array([a for a, _ in found], dtype=float), np.array([b for _, b in found], dtype=int)
    model.slope, model.base = calibrated(x, y)
    return model


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(shared.value.scores([None if t is None or t != t else t for t in texts]))

    scored = docs.select(F.col("doc_id"), score(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_compression_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
