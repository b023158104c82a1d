"""Token ids as ORC: integer run-length encoded stripes, row indexes, Bloom filters on the id.

Rows are dealt by ranges of the id and sorted before they are encoded, so the
files and the rows in them stand in ascending order and the ids never cross a
shuffle. Each row holds its tokens' ids with its end id, the number of its
file and the number of ids before it in the file. ORC keeps integers in
run-length form, min and max of the id for each 10,000 rows, and a Bloom
filter on the id, so a reader skips stripes by metadata and stripes are read
in parallel.

The tokenizers library encodes each distinct run between blanks once for a
worker, by its letters and its signs where it has no more than these; the stores
of known ones are bounded and are emptied when full. That needs
a tokenizer that drops white space and never joins across it: one whose file
has the rules ``RULES``. Whole texts go to the library for any other.

Defined cases: a null or empty text has its end id alone; rows that repeat an
id stand next to each other, in the order of their texts; a null id comes
first; texts of any length are encoded whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catloom.llm.common import new_path
from catloom.shipping import ship_package

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
KNOWN = 300_000
STEMS = 600_000
LONGEST = 64
SLICE = 1 << 22
#: What an ``Encoder`` knows of the tokenizer: its normaliser, pre-tokenizer, post-processor and the model's settings (fixed values).
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}
_tokenizers: dict[str, object] = {}
_encoders: dict[str, Encoder | WholeTexts] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def byte_letters() -> dict[int, str]:
    """Byte-level form: the letter that stands for each byte, for ``str.translate`` over Latin-1 text."""
    out, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def has_rules(path: str) -> bool:
    """Whether the file's tokenizer works by ``RULES``, so that runs between blanks may be encoded apart."""
    own = json.loads(_tokenizer(path).to_str())
    plain = all(not t["content"].split() or t["content"].split() == [t["content"]] and not t["lstrip"] and not t["rstrip"] for t in own["added_tokens"])
    return plain and all(own[k] == v for k, v in RULES.items()) and all(own["model"].get(k) == v for k, v in MODEL.items())


class WholeTexts:
    """Encodes whole texts by the library."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)

    def ids(self, texts: list[str], end: tuple[int, ...] = ()) -> tuple[array.array, list[int]]:
        out, ends = array.array("i"), []
        for t in texts:
            out.extend([*self.tokenizer.encode(t, add_special_tokens=False).ids, *end])
            ends.append(len(out))
        return out, ends


class Encoder(dict):
    """Encodes whole texts by their runs between blanks; the dictionary holds the odd runs and signs met so far, as bytes of their ids.

    A run of plain Latin letters with a tail of plain signs is two pieces to
    the tokenizer's own pattern, so the letters go straight to its model, once
    for all tails and capitals; any other run goes through the whole tokenizer.
    """

    plain = "^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\\[-`{-~]*)$"
    #: Blank to ``str.split`` but not to the tokenizer.
    separators = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        super().__init__({"": b""})
        self.tokenizer, self.stems = _tokenizer(path), {}
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def __missing__(self, run: str) -> bytes:
        own = array.array("i", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()
        if len(run) <= LONGEST:
            self[run] = own
        return own

    def _stem(self, stem: str) -> bytes:
        own = self.stems.get(stem)
        if own is None:
            raw = stem.encode("utf-8").decode("latin-1").translate(self.letters)
            own = self.stems[stem] = array.array("i", [t.id for t in self.model.tokenize(raw)]).tobytes()
        return own

    def _runs(self, texts: list[str]) -> pa.LargeListArray:
        """The runs of each text."""
        if not any(map(self.separators.search, texts)):
            return pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        runs = [t.split() if self.separators.search(t) is None else t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        return pa.array(runs, pa.large_list(pa.large_string()))

    def ids(self, texts: list[str], end: tuple[int, ...] = ()) -> tuple[np.ndarray, list[int]]:
        """All ids, each text's followed by ``end``, and where each text ends.

        Arrow cuts the texts and numbers their runs, stems and tails, so each
        distinct one is looked up once; its ids are then copied to its places.
        """
        runs = self._runs(texts)
        cuts = runs.offsets.to_numpy() - runs.offsets[0].as_py()
        coded = runs.flatten().dictionary_encode()
        words = coded.dictionary
        parts = pc.extract_regex(pc.if_else(pc.less_equal(pc.utf8_length(words), LONGEST), words, None), self.plain)
        odd = pc.is_null(parts)
        stems = pc.utf8_lower(pc.struct_field(parts, "stem")).dictionary_encode()
        rest = pc.if_else(odd, words, pc.struct_field(parts, "tail")).dictionary_encode()
        # of the pieces number 0 has no ids and number 1 is the end; a run is a stem, or number 0, and the rest
        pieces = [b"", array.array("i", end).tobytes()]
        pieces += map(self._stem, stems.dictionary.to_numpy(zero_copy_only=False))
        behind = len(pieces)
        pieces += map(self.__getitem__, rest.dictionary.to_numpy(zero_copy_only=False))
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
        starts, values = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(pieces), dtype=np.int32)
        first = pc.fill_null(pc.add(stems.indices.cast(pa.int64()), 2), 0).to_numpy()
        second = rest.indices.to_numpy().astype(np.int64) + behind
        at = coded.indices.to_numpy()
        order = np.insert(np.stack([first[at], second[at]], axis=1).ravel(), 2 * cuts[1:], 1)
        wide = sizes[order]
        stops = np.cumsum(wide)
        places = np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(starts[order] - stops + wide, wide)
        if len(self) > KNOWN:
            self.clear()
        if len(self.stems) > STEMS:
            self.stems.clear()
        return values[places], stops[2 * cuts[1:] + np.arange(len(texts))].tolist()


def _encoder(path: str) -> Encoder | WholeTexts:
    """One for a worker process, whatever the number of its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path) if has_rules(path) else WholeTexts(path)
    return _encoders[path]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= SLICE):
                    held += len(texts[hi])
                    hi += 1
                flat, stops = encoder.ids(texts[lo:hi], (end_id,))
                ends = np.array(stops, dtype=np.int64)
                sizes = np.diff(ends, prepend=0)
                values = np.frombuffer(flat, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([part] * (hi - lo), pa.int32()), pa.array(before + ends - sizes), lists],
                    names=["doc_id", "part", "before", "ids"],
                )
                before += int(ends[-1])
                lo = hi

    return run


def write_tokens(docs: DataFrame, out: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write ``doc_id, part, before, ids`` as ORC in ascending order of the id."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "t")
    encoded = dealt.mapInArrow(_encode(path or default_path(), end_id), f"doc_id {dict(docs.dtypes)[id_col]}, part int, before long, ids array<int>")
    encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option(
        "orc.row.index.stride", "10000"
    ).option("orc.stripe.size", str(64 << 20)).option("compression", "zstd").orc(out)


def read_tokens(spark: SparkSession, out: str, id_type: str = "bigint") -> DataFrame:
    """The written rows."""
    return spark.read.schema(f"doc_id {id_type}, part int, before long, ids array<int>").orc(out)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "before", "n_tokens", "ids_crc32"],
        )


def token_offsets(written: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files. Only a row for each file crosses a task."""
    ship_package(written.sparkSession)
    rows = written.mapInArrow(_sums, f"doc_id {dict(written.dtypes)['doc_id']}, part int, before long, n_tokens long, ids_crc32 long")
    files = written.groupBy(F.col("part").alias("p")).agg(F.sum(F.size("ids")).alias("n"))
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    heads = files.select("p", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("head"))
    return rows.join(heads, F.col("part") == F.col("p")).select("doc_id", (F.col("head") + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op8_orc_tokens(spark, sf_dir: str) -> DataFrame:
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "tokens")
    write_tokens(docs, out)
    return token_offsets(read_tokens(spark, out))
