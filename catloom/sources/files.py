"""Captured files: sitemaps as text or XML, gzip bodies, URL lists and reports.

Sitemaps are read by Spark's own sources. ``read_locs`` takes each text up to a
closing ``</loc>`` for a record, so that one uncompressed file of any size is
split over many tasks and no task holds more than a record; broken prologues,
prefixes and CDATA do no harm. ``read_urls`` takes the XML source by row tag:
all fields, a task for each file, well-formed files only. Both open ``.gz``
files by their name.

``opened`` is for bodies whose name says nothing: it looks at the first bytes
and unpacks in pieces of bounded size.
"""

from __future__ import annotations

import codecs
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catloom.shipping import ship_package
from catloom.sources import sitemaps

#: Fields of an entry of a sitemap.
ENTRY = "loc string, lastmod string, changefreq string, priority string"
#: Bytes that are unpacked at once, and characters of a piece.
STEP = 1 << 16
PIECE = 1 << 22


def read_locs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, kind, loc`` of sitemap files, and the columns of their folders.

    ``kind``: ``sitemap`` for an entry of an index or a name that ends in
    ``.xml``, else ``page``. A file cut off inside an entry gives what there is
    of it; a file without entries has no rows.
    """
    rows = spark.read.option("lineSep", "</loc>").text(path)
    folders = [c for c in rows.columns if c != "value"]
    record = F.concat("value", F.lit("</loc>"))
    found = rows.select(F.col("_metadata.file_path").alias("file"), *folders, F.col("value").rlike(r"<(?:\w+:)?sitemap[\s>]").alias("listed"), F.explode(sitemaps.locs(record)).alias("loc"))
    kind = F.when(F.col("listed") | F.col("loc").rlike(r"\.xml(\.gz)?$"), F.lit("sitemap")).otherwise(F.lit("page"))
    return found.select("file", *folders, kind.alias("kind"), "loc")


def read_urls(spark: SparkSession, path: str, row_tag: str = "url", schema: str = ENTRY) -> DataFrame:
    """The fields of each ``row_tag`` element by the XML source, prefixes dropped, values trimmed; ``sitemap`` for an index."""
    rows = spark.read.format("xml").options(rowTag=row_tag, ignoreNamespace=True, ignoreSurroundingSpaces=True, mode="PERMISSIVE").schema(schema).load(path)
    return rows.where("loc <> ''")


def read_url_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``url``: the lines of text files that are not empty and no comment, trimmed, each once."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return lines.where((F.col("url") != "") & ~F.col("url").startswith("#")).distinct()


def _inflated(raw: bytes, step: int) -> Iterator[bytes]:
    """The bytes of a gzip body, of one member or several; raises where it is broken or cut off."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        reader = zlib.decompressobj(31)
        while not reader.eof:
            if at >= len(raw):
                raise EOFError("cut off")
            took = view[at : at + step]
            at += len(took)
            out = reader.decompress(took, step)
            while True:
                if out:
                    yield out
                if reader.eof or not reader.unconsumed_tail:
                    break
                out = reader.decompress(reader.unconsumed_tail, step)
        at -= len(reader.unused_data)
        # zeros behind the last member are padding
        if raw[at : at + 2] != b"\x1f\x8b":
            if raw[at:].strip(b"\0"):
                raise zlib.error("no gzip member")
            return


def pieces(raw: bytes, piece: int = PIECE, step: int = STEP) -> Iterator[str]:
    """The text of a body in pieces that end behind a closing tag, as far as there is one."""
    parts = _inflated(raw, step) if raw[:2] == b"\x1f\x8b" else (raw[i : i + step] for i in range(0, len(raw), step))
    decoder, held = codecs.getincrementaldecoder("utf-8")("ignore"), ""
    for part in parts:
        held += decoder.decode(part)
        if len(held) >= piece:
            end = held.find(">", held.rfind("</")) + 1 if "</" in held else 0
            if end:
                yield held[:end]
                held = held[end:]
    held += decoder.decode(b"", True)
    if held:
        yield held


def _open(piece: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column(1)[k]
                key, content, number = batch.column(0).slice(k, 1), raw.as_buffer().to_pybytes() if raw.is_valid else None, 0

                def row(n: int | None, body: str | None, key=key) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([key, pa.array([n], pa.int32()), pa.array([body], pa.string())], names=["key", "piece", "body"])

                try:
                    if content is None:
                        raise EOFError("no body")
                    if content[:2] == b"\x1f\x8b":
                        # a body that breaks at its end gives nothing at all
                        for _ in _inflated(content, step):
                            pass
                except (EOFError, zlib.error):
                    yield row(None, None)
                    continue
                for number, text in enumerate(pieces(content, piece, step)):
                    yield row(number, text)
                if not content:
                    yield row(0, "")

    return run


def opened(bodies: DataFrame, key: str, content: str = "content", piece: int = PIECE, step: int = STEP) -> DataFrame:
    """``key, piece, body``: binary bodies as text, unpacked where they start like gzip, in pieces of about ``piece`` characters.

    Pieces put together in order are the body. A null body, and one that is
    broken anywhere, is one row without piece and text; an empty one has an
    empty text; bytes that are no UTF-8 are left out.
    """
    ship_package(bodies.sparkSession)
    kind = bodies.schema[key].dataType.simpleString()
    return bodies.select(key, content).mapInArrow(_open(piece, step), f"`{key}` {kind}, piece int, body string".replace(f"`{key}`", "key"))


def read_bodies(spark: SparkSession, path: str | list[str], glob: str = "*", piece: int = PIECE) -> DataFrame:
    """``key`` (the file's path), ``piece, body`` of files of any name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return opened(files, "path", "content", piece)
