"""Captured responses as a data source of Spark: ``spark.read.format("captures")``.

A capture is a folder with a folder ``site=...`` for each site, which holds
JSON lines ``url, status, body`` as Spark's JSON writer leaves them. A file is
read in ranges of ``splitBytes``, a task each. Folders of other sites than the
option ``sites`` names (a JSON list) are neither listed nor read.

With the option ``pushdown`` conditions on ``site`` (equal, or one of some) do
the same. Spark keeps one such condition for a loaded frame, so a plan that
uses the frame twice must load it twice (``load`` makes a frame of its own).

Files are reached through ``pyarrow.fs``, on the driver for the listing and in
the tasks for the lines. A line that is no JSON object has a null ``url`` and
stays as ``body``. Empty files and folders have no rows; a folder that doesn't
exist is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from catloom.shipping import by_value, ship_package

SCHEMA = "site string, url string, status int, body string"
NO_SITE = "__HIVE_DEFAULT_PARTITION__"
SPLIT = 64 << 20
BLOCK = 1 << 20
#: Rows and characters of a batch.
ROWS, CHARS = 1024, 4 << 20


@dataclass
class Range(InputPartition):
    site: str | None
    file: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__(None)


def _fs(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/"))


def lines(source, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in a range of a file; the last one is read to its end."""
    at = start
    if start:
        # a line that begins just at the range is behind a line end just before it
        source.seek(start - 1)
        at -= 1
    held, first = b"", bool(start)
    while at < end or held:
        block = source.read(BLOCK)
        if not block:
            if held and not first and at < end:
                yield held
            return
        held += block
        *whole, held = held.split(b"\n")
        for line in whole:
            if first:
                first = False
            elif at < end:
                yield line
            else:
                return
            at += len(line) + 1
        if at >= end:
            return


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, split: int, sites: set[str] | None, pushdown: bool):
        self.path, self.split, self.sites, self.pushdown = path, split, sites, pushdown

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if self.pushdown and isinstance(f, EqualTo) and f.attribute == ("site",):
                wanted = {f.value}
            elif self.pushdown and isinstance(f, In) and f.attribute == ("site",):
                wanted = set(f.value)
            else:
                yield f
                continue
            self.sites = wanted if self.sites is None else self.sites & wanted

    def partitions(self) -> list[Range]:
        from pyarrow.fs import FileSelector, FileType

        fs, top = _fs(self.path)
        out = []
        for folder in sorted(fs.get_file_info(FileSelector(top)), key=lambda x: x.path):
            if folder.type != FileType.Directory or not folder.base_name.startswith("site="):
                continue
            name = folder.base_name.removeprefix("site=")
            site = None if name == NO_SITE else unquote(name)
            if self.sites is not None and site not in self.sites:
                continue
            for file in sorted(fs.get_file_info(FileSelector(folder.path, recursive=True)), key=lambda x: x.path):
                if file.type == FileType.File and file.size and not file.base_name.startswith(("_", ".")):
                    out += [Range(site, file.path, a, min(a + self.split, file.size)) for a in range(0, file.size, self.split)]
        return out or [Range(None, "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = _fs(self.path)
        urls, status, bodies, chars = [], [], [], 0
        with fs.open_input_file(partition.file) as source:
            for line in lines(source, partition.start, partition.end):
                if not line.strip():
                    continue
                try:
                    own = json.loads(line)
                    found = own.get("url"), own.get("status"), own.get("body")
                except (ValueError, AttributeError):
                    found = None, None, line.decode("utf-8", "replace")
                urls.append(found[0])
                status.append(found[1])
                bodies.append(found[2])
                chars += len(found[2] or "")
                if len(urls) >= ROWS or chars >= CHARS:
                    yield self._batch(partition.site, urls, status, bodies)
                    urls, status, bodies, chars = [], [], [], 0
        if urls:
            yield self._batch(partition.site, urls, status, bodies)

    @staticmethod
    def _batch(site: str | None, urls: list, status: list, bodies: list) -> pa.RecordBatch:
        columns = [pa.array([site] * len(urls), pa.string()), pa.array(urls, pa.string()), pa.array(status, pa.int32()), pa.array(bodies, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["site", "url", "status", "body"])


class Captures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        sites = self.options.get("sites")
        pushdown = self.options.get("pushdown", "false").lower() == "true"
        return CaptureReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)), None if sites is None else set(json.loads(sites)), pushdown)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship_package(spark)
    by_value(__name__)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Captures)


def load(spark: SparkSession, path: str, sites: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """The captured responses of some sites, or of all."""
    register(spark)
    named = {} if sites is None else {"sites": json.dumps(sites)}
    return spark.read.format("captures").options(splitBytes=split, **named).load(path)
