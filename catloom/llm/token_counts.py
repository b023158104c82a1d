"""Token counts; huge documents by overlapping chunks that are spliced at proven boundaries.

The tokenizer is a sentencepiece BPE model without normalisation (``Encoder``
checks the file). Its greedy merges have this property: no merge crossed the
ends of a run of tokens of an encoding, so the run encodes its own text, and a
row of tokens is the encoding of its text as soon as each adjacent pair is one.
So if the encodings of two overlapping chunks share one token, with the same
place, then the first chunk's tokens before it and the second's from it on are
the encoding of both together: every adjacent pair stands in one of the two.

Documents of more than ``chunk`` characters are written to the shared folder
and cut into overlapping chunks that are dealt over all tasks. Each chunk
returns its count and the tokens of its two overlaps with their offsets; a
window over the chunks of a document finds the shared token of each seam.
A document with a seam that shares none is cut anew with a wider overlap and
longer chunks, at last as one chunk, so every count is exact.

Shorter texts are encoded whole. Inside a text an encoder looks up units of
blanks and the word after them: no piece of the vocabulary goes on with a
blank after another letter (checked as well), so no merge crosses a unit's end.
The store of known units is bounded and emptied when full.

Defined cases: a null or empty text has no tokens and no bytes; strings that
look like special tokens are ordinary text, as the library has them; repeated
rows and rows without id are counted each; texts of any length are counted
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import array
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catloom.llm.common import discard, stash
from catloom.shipping import ship_package

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK = 1 << 16
OVERLAP = 1 << 8
KNOWN = 400_000
LONGEST = 64
#: What the library writes for a blank.
BLANK = "▁"
_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Encoder(dict):
    """Token ids by unit (blanks and the word after them)."""

    unit = re.compile(" +[^ ]*")

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        if self.library.encode("  a ﬁ  ", out_type=str)[0][0] != BLANK or self.library.decode(self.library.encode("  a ﬁ  ")) != "  a ﬁ  ":
            raise ValueError("the model normalises texts or has no blank in front")
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece goes on after a word's end")
        #: Characters that a token takes; bytes that go on with a character take none.
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.anchors = np.ones(n, dtype=bool)
        for i, p in enumerate(pieces):
            if self.library.is_byte(i):
                self.lengths[i], self.anchors[i] = not 0x80 <= int(p[3:5], 16) < 0xC0, False
            elif self.library.is_control(i) or self.library.is_unknown(i):
                self.anchors[i] = False
        super().__init__({" ": (self.library.piece_to_id(BLANK),)})

    def __missing__(self, unit: str) -> tuple[int, ...]:
        # the library sets a blank in front, which stands for the unit's first one
        own = tuple(self.library.encode(unit[1:]))
        if len(unit) <= LONGEST:
            self[unit] = own
        return own

    def units(self, text: str) -> list[str]:
        return self.unit.findall(" " + text.replace(BLANK, " ")) if text else []

    def count(self, text: str) -> int:
        return sum(map(len, map(self.__getitem__, self.units(text))))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(array.array("i", chain.from_iterable(map(self.__getitem__, self.units(text)))), dtype=np.int32)

    def trim(self) -> None:
        if len(self) > KNOWN:
            blank = self[" "]
            self.clear()
            self[" "] = blank


def _encoder(path: str) -> Encoder:
    """One for a worker process, whatever the number of its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            n = []
            for text in batch.column(2):
                n.append(encoder.count(text.as_py()))
                encoder.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def cuts(length: int, chunk: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """``(start, end, head_end, tail_start)`` of each chunk; neighbours share ``overlap`` characters."""
    out = []
    for start in range(0, length, chunk):
        end = min(length, start + chunk + overlap)
        out.append((start, end, start + overlap if start else 0, start + chunk if end < length else length))
        if end == length:
            break
    return out


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, scalar in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = scalar.as_py()
                for k, (start, end, head, tail) in enumerate(cuts(len(text), chunk, overlap)):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "row": pa.array([row], pa.int64()),
                            "k": pa.array([k], pa.int32()),
                            "start": pa.array([start], pa.int64()),
                            "head_end": pa.array([head], pa.int64()),
                            "tail_start": pa.array([tail], pa.int64()),
                            "part": pa.array([text[start:end]], pa.string()),
                        }
                    )

    return run


def _ends(path: str):
    """The count of each chunk, and the tokens in its overlaps as numbers of place and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            rows, ks, starts, heads, tails = (batch.column(i).to_pylist() for i in range(5))
            n, head_keys, tail_keys = [], [], []
            for i, scalar in enumerate(batch.column(5)):
                part = scalar.as_py()
                ids = encoder.ids(part)
                encoder.trim()
                took = encoder.lengths[ids]
                at = starts[i] - 1 + np.cumsum(took) - took
                keys = at * len(encoder.lengths) + ids
                known = encoder.anchors[ids] & (at >= starts[i])
                # what can be no anchor keeps its place in the lists and never matches
                head, tail = at < heads[i], at >= tails[i]
                n.append(len(ids))
                head_keys.append(np.where(known, keys, -1)[head])
                tail_keys.append(np.where(known, keys, -2)[tail])
            yield pa.RecordBatch.from_pydict(
                {
                    "row": pa.array(rows, pa.int64()),
                    "k": pa.array(ks, pa.int32()),
                    "n": pa.array(n, pa.int64()),
                    "head": pa.array(head_keys, pa.list_(pa.int64())),
                    "tail": pa.array(tail_keys, pa.list_(pa.int64())),
                }
            )

    return run


def spliced(ends: DataFrame) -> DataFrame:
    """``row, n_tokens`` for each row of chunks: null where a seam shares no token."""
    before = Window.partitionBy("row").orderBy("k")
    seams = ends.select("row", "n", "head", F.lag("tail").over(before).alias("left"), (F.col("k") > 0).alias("seam"))
    seams = seams.withColumn("shared", F.get(F.array_intersect("left", "head"), F.lit(0)))
    dropped = F.size("left") - F.array_position("left", F.col("shared")) + F.array_position("head", F.col("shared"))
    one = seams.select("row", "n", (F.col("seam") & F.col("shared").isNull()).alias("torn"), F.when(F.col("seam"), dropped).otherwise(0).alias("dropped"))
    return one.groupBy("row").agg(F.when(~F.max("torn"), F.sum(F.col("n") - F.col("dropped"))).cast("long").alias("n_tokens"))


def huge_counts(long_docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``row, n_tokens`` for documents ``row, text``, by chunks; rounds go on until every seam is spliced."""
    spark = long_docs.sparkSession
    ship_package(spark)
    pending, found = long_docs.select("row", "text"), []
    while True:
        chunks = pending.mapInArrow(_cut(chunk, overlap), "row long, k int, start long, head_end long, tail_start long, part string")
        dealt = chunks.repartition("row", "k")
        ends = dealt.mapInArrow(_ends(path), "row long, k int, n long, head array<long>, tail array<long>")
        counted = stash(spliced(ends), "spliced")
        found.append(counted.where("n_tokens IS NOT NULL"))
        if not counted.where("n_tokens IS NULL").head(1):
            break
        pending = long_docs.select("row", "text").join(counted.where("n_tokens IS NULL").select("row"), "row", "left_semi")
        chunk, overlap = chunk * 8, overlap * 16 if overlap * 16 < chunk else chunk * 4
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def token_counts(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row."""
    spark, path = docs.sparkSession, path or default_path()
    ship_package(spark)
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    short = slim.where(F.char_length("text") <= chunk).mapInArrow(_counts(path), f"doc_id {kind}, n_bytes long, n_tokens long")
    long_docs = stash(slim.where(F.char_length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "huge")
    if not long_docs.head(1):
        discard(long_docs)
        both = short
    else:
        found = huge_counts(long_docs, path, chunk, overlap)
        both = short.unionByName(long_docs.select("doc_id", "n_bytes", "row").join(found, "row").select("doc_id", "n_bytes", "n_tokens"))
    return both.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
