"""Byte-level BPE encoding and decoding by Spark higher-order functions.

1. Texts are cut by the pattern of the rank file, block by block of about
   ``BLOCK_BYTES``. A block is one row: its documents, its distinct pieces and,
   for each piece of its texts, a number in that list.
2. A distinct piece is folded: over its bytes, the leftmost adjacent pair of the
   lowest rank is merged again and again, ranks looked up in a literal rank map.
   (Spark goes through a map to find a key, so the literal is an array of small
   maps and a hash of the key picks the one to look in. It stands in the two
   plans that fold and in no other, as its megabytes are part of a plan's text.)
3. The pieces that most blocks hold, two blocks at least and ``CACHE_BYTES``
   together at most, are folded once and broadcast. The others are folded in
   their block: once for the corpus if one block holds them, and once in each
   block if more do. No text and no list of pieces is shuffled but to count.
4. Decoding takes the byte strings of the ids and concatenates them.

The fold takes quadratic time in a piece. A longer piece is cut
into chunks, which are folded, and the bytes from the middle of each chunk to
the middle of the next are folded as well. Where such a seam begins and ends
with the very parts that its chunks have there, all adjacent parts are ones that
do not merge across their border, and a sequence of such parts is the encoding
of the whole. Pieces with a seam for which this does not hold take longer chunks
(``CHUNKS``), and at last are folded as they are.

Defined cases: a null or empty text has no ids and decodes to no bytes;
repeated rows are encoded each; null ids stay; an empty table gives an empty
result; columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from catloom.llm.common import discard, giving_back, stash
from catloom.shipping import ship_package

BLOCK_BYTES = 1 << 23
CACHE_BYTES = 3 << 23
CHUNKS = (32, 1024)
BUCKETS = 1 << 15
#: Tokens that a worker handles at once.
SLICE = 1 << 18
RANK_FILE = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def bucket(key: Column) -> Column:
    return F.pmod(F.hash(key), F.lit(BUCKETS))


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The literal rank map: ``array<map<string,int>>``, bytes in hexadecimal in the map of their bucket."""
    keys = [k.hex().upper() for k in ranks]
    table = spark.createDataFrame(pa.table({"k": pa.array(keys, pa.string())}))
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for k, rank, b in zip(keys, ranks.values(), table.select(bucket(F.col("k")).alias("b")).toArrow().column("b").to_pylist(), strict=True):
        maps[b][k] = rank
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")


def rank_of(word: Column, start: Column, end: Column, maps: Column) -> Column:
    """Rank of the bytes from ``start`` up to ``end`` (from 1), null if they have none."""
    return let(F.hex(F.substring(word, start, end - start)), lambda k: F.get(maps, bucket(k))[k])


def bounds(word: Column, maps: Column) -> Column:
    """Where the parts of a folded word start, and its end: ``array<int>`` from 1.

    ``ranks`` holds the rank of each adjacent pair.
    """
    size = F.octet_length(word)

    def step(s: Column, _: Column) -> Column:
        starts, ranks = s["starts"], s["ranks"]

        def merged(p: Column) -> Column:
            at = [F.get(starts, p + k) for k in (-2, -1, 1, 2)]
            new = F.array(rank_of(word, at[0], at[2], maps), rank_of(word, at[1], at[3], maps))
            has_left, has_right = (p > 1).cast("int"), (p < F.size(ranks)).cast("int")
            around = F.array(
                F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), F.slice(new, 2 - has_left, has_left + has_right), F.slice(ranks, p + 2, F.size(ranks))
            )
            return F.struct(F.array_remove(starts, F.get(starts, p)).alias("starts"), F.flatten(around).alias("ranks"))

        first = F.array_position(ranks, F.array_min(ranks)).cast("int")
        return F.when(F.exists(ranks, lambda r: r.isNotNull()), let(first, merged)).otherwise(s)

    pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda i: rank_of(word, i, i + 2, maps))
    first = F.struct(F.sequence(F.lit(1), size + 1).alias("starts"), pairs.alias("ranks"))
    return F.when(size < 2, F.array(F.lit(1), size + 1)).otherwise(F.aggregate(F.sequence(F.lit(2), size), first, step, lambda s: s["starts"]))


def ids_at(word: Column, starts: Column, maps: Column) -> Column:
    """Ids of the parts between ``starts``."""
    return F.transform(F.sequence(F.lit(1), F.size(starts) - 1), lambda i: rank_of(word, F.get(starts, i - 1), F.get(starts, i), maps))


def stitched(word: Column, chunk: int, maps: Column) -> Column:
    """Ids of a long word, folded in chunks and seams; null where a seam does not hold."""
    count = F.ceil(F.octet_length(word) / chunk).cast("int")

    def shifted(own: Column, by: Column) -> Column:
        return F.transform(own, lambda x: x + by)

    def part(i: Column) -> Column:
        def halved(own: Column) -> Column:
            cut = F.when(i == 0, 0).when(i == count - 1, F.size(own) - 1).otherwise(F.floor((F.size(own) - 1) / 2).cast("int"))
            return F.struct(own.alias("own"), cut.alias("cut"))

        return let(shifted(let(F.substring(word, i * chunk + 1, F.lit(chunk)), lambda c: bounds(c, maps)), i * chunk), halved)

    def seam(parts: Column, i: Column) -> Column:
        a, b = F.get(parts, i), F.get(parts, i + 1)
        start, end = F.get(a["own"], a["cut"]), F.get(b["own"], b["cut"])

        def checked(own: Column) -> Column:
            begins = (i == 0) | (F.get(own, F.lit(1)) == F.get(a["own"], a["cut"] + 1))
            ends = (i == count - 2) | (F.get(own, F.size(own) - 2) == F.get(b["own"], b["cut"] - 1))
            return F.struct(F.coalesce(begins & ends & (F.size(own) > 1), F.lit(False)).alias("ok"), own.alias("own"))

        return let(shifted(let(F.substring(word, start, end - start), lambda c: bounds(c, maps)), start - 1), checked)

    def joined(seams: Column) -> Column:
        starts = F.concat(F.flatten(F.transform(seams, lambda s: F.slice(s["own"], F.lit(1), F.size(s["own"]) - 1))), F.array(F.octet_length(word) + 1))
        return F.when(F.forall(seams, lambda s: s["ok"]), let(starts, lambda x: ids_at(word, x, maps)))

    many = let(
        F.transform(F.sequence(F.lit(0), count - 1), part), lambda parts: let(F.transform(F.sequence(F.lit(0), count - 2), lambda i: seam(parts, i)), joined)
    )
    return F.when(count > 1, many)


def folded(word: Column, maps: Column) -> Column:
    """Ids of a word of one byte or more; ``maps`` is the literal rank map."""

    def whole(w: Column) -> Column:
        return let(bounds(w, maps), lambda x: ids_at(w, x, maps))

    def long(w: Column) -> Column:
        return F.coalesce(*[stitched(w, chunk, maps) for chunk in CHUNKS], whole(w))

    # a variable of a lambda is at hand; a column would be copied out of its row at each use
    return let(word, lambda w: F.when(F.octet_length(w) <= CHUNKS[0], whole(w)).otherwise(long(w)))


class Codes(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = code = len(self)
        return code


def packed(codes: np.ndarray) -> bytes:
    """Codes by byte planes, compressed."""
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=4 * count, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, count).T).view("<u4").ravel()


def _split(pattern: str):
    """``d, t`` to blocks: ``docs, sizes, codes, words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        found = regex.compile(pattern)
        docs, sizes, codes, known, held = [], [], [], Codes(), 0

        def block() -> pa.RecordBatch:
            own = pa.concat_arrays(docs)
            columns = {
                "docs": pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                "sizes": pa.array([sizes], pa.list_(pa.int32())),
                "codes": pa.array([packed(np.concatenate(codes))], pa.binary()),
                "words": pa.array([[w.encode() for w in known]], pa.list_(pa.binary())),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for batch in batches:
            at = 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                # the matches of a long text are not held as strings all at once
                pieces = found.findall(text) if len(text) < SLICE else (m[0] for m in found.finditer(text))
                own = np.fromiter(map(known.__getitem__, pieces), dtype=np.int32)
                del pieces
                codes.append(own)
                sizes.append(len(own))
                held += len(text)
                if held >= BLOCK_BYTES:
                    docs.append(batch.column(0).take(np.arange(at, i + 1)))
                    yield block()
                    docs, sizes, codes, known, held, at = [], [], [], Codes(), 0, i + 1
            # a copy: a slice would keep the texts of the batch as well
            docs.append(batch.column(0).take(np.arange(at, batch.num_rows)))
        if sizes:
            yield block()

    return run


def _looked_up(shared):
    """Blocks with ``at``, the place of each word in the broadcast table or -1, and ``lacking``, the words without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                words = one.column(3)[0].values
                # one look-up a block: as an Arrow array the table takes a tenth of a dictionary's memory
                at = pc.index_in(words, value_set=known).fill_null(-1).to_numpy()
                lacking = words.take(pa.array(np.flatnonzero(at < 0)))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.array(at), lacking)]
                yield pa.RecordBatch.from_arrays([*one.columns[:3], *lists], names=["docs", "sizes", "codes", "at", "lacking"])

    return run


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the runs ``starts[i] .. starts[i] + sizes[i]``, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


def _as_ids(docs: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([docs, lists], names=["d", "ids"])


def _filled(shared, made=_as_ids):
    """Blocks with ``rare``, the ids of their ``lacking`` words, to what is ``made`` of documents and their lists of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, values = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                docs, sizes, codes, at, rare = (batch.column(c)[row] for c in ("docs", "sizes", "codes", "at", "rare"))
                at, rare = at.values.to_numpy(), rare.values
                lo, wide, cuts = starts[at], starts[at + 1] - starts[at], rare.offsets.to_numpy()
                lo[at < 0], wide[at < 0] = len(values) + cuts[:-1] - cuts[0], np.diff(cuts)
                pool = np.concatenate([values, rare.values.to_numpy()[cuts[0] : cuts[-1]]])
                sizes = sizes.values.to_numpy().astype(np.int64)
                codes, ends = unpacked(codes.as_py(), int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])
                a = 0
                while a < len(sizes):
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, side="right")) - 1)
                    own = codes[ends[a] : ends[b]]
                    ids = pool[_gather(lo[own], wide[own])]
                    totals = np.concatenate([[0], np.cumsum(wide[own])])[ends[a : b + 1] - ends[a]]
                    lists = pa.ListArray.from_arrays(pa.array(totals.astype(np.int32)), pa.array(ids))
                    yield made(docs.values.slice(a, b - a), lists)
                    a = b

    return run


def common_words(blocks: DataFrame, maps: Column, cache: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words that most blocks hold, within ``cache`` bytes, with starts and values of their ids.

    The least number of blocks comes from a histogram by steps of a power of
    two, so no more than the words that are kept come to the driver.
    """
    counts = stash(blocks.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "words")
    level = F.floor(F.log2("n") * 8)
    # a word has as many ids as bytes at most
    cost = 5 * F.octet_length("w").cast("long") + 16
    least, held = None, 0
    for r in counts.groupBy(level.alias("level")).agg(F.sum(cost).alias("bytes")).orderBy(F.desc("level")).collect():
        held += r["bytes"]
        if held > cache:
            break
        least = r["level"]
    kept = counts.where(level >= least) if least is not None else counts.limit(0)
    found = kept.select("w", let(maps, lambda m: folded(F.col("w"), m)).alias("ids")).toArrow()
    discard(counts)
    ids = found.column("ids").combine_chunks()
    known = found.column("w").combine_chunks()
    # one more end, for the words that are not known: number -1 has no ids
    starts = ids.offsets.to_numpy() if len(known) else np.zeros(1)
    return known, np.append(starts, starts[-1]).astype(np.int64), ids.values.to_numpy().astype(np.int32)


def _encoded(docs: DataFrame, made, kind: str, path: str | None, pattern: str | None, id_col: str, text_col: str, cache: int, place_col: str | None) -> DataFrame:
    """``made`` of every document's ids: ``d``, a struct of ``doc_id`` and ``position``, and columns of ``kind``."""
    spark = docs.sparkSession
    ship_package(spark)
    carried = [F.col(id_col).alias("doc_id"), *([F.col(place_col).alias("position")] if place_col else [])]
    rows = docs.select(F.struct(*carried).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    own = rows.schema["d"].dataType.simpleString()
    head = f"docs array<{own}>, sizes array<int>, codes binary"
    blocks = stash(rows.mapInArrow(giving_back(_split(pattern or default_pattern())), f"{head}, words array<binary>"), "blocks", "zstd")
    maps = rank_map(spark, read_ranks(path or default_path()))
    known, *table = common_words(blocks, maps, cache)
    words, ids = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast(table)
    found = blocks.mapInArrow(giving_back(_looked_up(words)), f"{head}, at array<int>, lacking array<binary>")
    rare = let(maps, lambda m: F.transform("lacking", lambda w: folded(w, m)))
    return found.select("docs", "sizes", "codes", "at", rare.alias("rare")).mapInArrow(giving_back(_filled(ids, made)), f"d {own}, {kind}")


def encode(
    docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE_BYTES, place_col: str | None = None
) -> DataFrame:
    """Id, ``ids``, the token ids of the whole text, and ``position`` if a column holds it."""
    return _encoded(docs, _as_ids, "ids array<int>", path, pattern, id_col, text_col, cache, place_col).select("d.*", "ids")


def _slices(lists: pa.ListArray) -> Iterator[tuple[int, pa.ListArray]]:
    """The rows from each position on whose lists hold about ``SLICE`` values together."""
    cuts, lo = lists.offsets.to_numpy(), 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + SLICE, side="right")) - 1)
        yield lo, lists.slice(lo, min(hi, len(lists)) - lo)
        lo = hi


def _joined(ids: pa.ListArray, table: pa.Array, between: bytes) -> pa.Array:
    """For each list of ids the byte strings of ``table``, concatenated."""
    cuts = ids.offsets.to_numpy()
    taken = table.take(ids.values.slice(cuts[0], cuts[-1] - cuts[0]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), taken), between)


def _decoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, ids in _slices(batch.column(batch.schema.get_field_index("ids"))):
                own = batch.slice(lo, len(ids))
                yield pa.RecordBatch.from_arrays([*own.columns, _joined(ids, shared.value, b"")], names=[*batch.schema.names, "decoded"])

    return run


def _byte_strings(spark: SparkSession, path: str | None):
    """The byte strings of all ids, broadcast."""
    ranks = read_ranks(path or default_path())
    table = [b""] * (max(ranks.values()) + 1)
    for raw, i in ranks.items():
        table[i] = raw
    return spark.sparkContext.broadcast(pa.array(table, pa.binary()))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the bytes of its ``ids``."""
    shared = _byte_strings(encoded.sparkSession, path)
    return encoded.mapInArrow(_decoded(shared), StructType([*encoded.schema.fields]).add("decoded", BinaryType()))


def _as_digests(shared):
    """Number and digests of ids, and the digest of their decoded bytes."""

    def made(docs: pa.Array, ids: pa.ListArray) -> pa.RecordBatch:
        names = pa.array([b"%d" % i for i in range(len(shared.value))], pa.binary())
        both = _joined(ids, names, b" "), _joined(ids, shared.value, b"")
        digests = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string()) for column in both]
        return pa.RecordBatch.from_arrays([docs, pc.list_value_length(ids).cast(pa.int64()), *digests], names=["d", "n_tokens", "ids_sha256", "decoded_sha256"])

    return made


def digests(
    docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE_BYTES, place_col: str | None = None
) -> DataFrame:
    """Id, ``n_tokens, ids_sha256, decoded_sha256``, and ``position`` if ``place_col`` names a column that holds it.

    Ids are those of ``encode`` and are decoded as in ``decode``, in the worker that makes them.
    """
    made = _as_digests(_byte_strings(docs.sparkSession, path))
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    found = _encoded(docs, made, kind, path, pattern, id_col, text_col, cache, place_col)
    return found.select("d.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["d.position"] if place_col else []))


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
