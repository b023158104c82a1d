"""Captured files through their source, output by epoch, dedupe across arrivals."""

import io
import json

import pytest
from pyspark.sql import functions as F

from catloom.operators import readers
from catloom.sources import captures
from catloom.streaming import arrivals, epochs


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_ranges_share_no_line(monkeypatch, block):
    monkeypatch.setattr(captures, "BLOCK", block)
    for data in (b"", b"\n", b"a", b"a\n", b"ab\n\ncde\nf", b"x" * 40 + b"\ny\n"):
        whole = data.split(b"\n")
        want = whole[:-1] if not whole[-1] else whole
        for split in range(1, len(data) + 2):
            got = [x for a in range(0, len(data), split) for x in captures.lines(io.BytesIO(data), a, min(a + split, len(data)))]
            assert got == want, (data, split)


@pytest.fixture
def capture(spark, tmp_path):
    for site in ("a", "b%2Fc", "__HIVE_DEFAULT_PARTITION__"):
        (tmp_path / f"site={site}").mkdir()
        for k in range(2):
            lines = [json.dumps({"url": f"{site}{k}{i}", "status": 200 + i, "body": "é" * i}) for i in range(50)]
            (tmp_path / f"site={site}" / f"part-{k}.json").write_text("\n".join(lines) + "\nbroken\n")
    (tmp_path / "site=a" / "_SUCCESS").write_text("")
    captures.register(spark)
    return str(tmp_path)


def test_captures_are_read_in_ranges(spark, capture):
    rows = spark.read.format("captures").option("splitBytes", 300).load(capture)
    assert rows.rdd.getNumPartitions() > 30
    got = rows.collect()
    assert len(got) == 6 * 51 and sum(r.url is None for r in got) == 6 and {r.site for r in got} == {"a", "b/c", None}
    assert {(r.url, r.status, r.body) for r in got if r.url and r.site == "a"} == {(f"a{k}{i}", 200 + i, "é" * i) for k in range(2) for i in range(50)}


def test_other_sites_are_not_read(spark, capture):
    assert captures.load(spark, capture, ["a"]).rdd.getNumPartitions() == 2 and captures.load(spark, capture, ["a", "b/c"]).rdd.getNumPartitions() == 4
    assert captures.load(spark, capture, []).count() == 0
    both = captures.load(spark, capture, ["a"]).where("site = 'a'").union(captures.load(spark, capture).where("site = 'b/c'"))
    assert both.groupBy("site").count().orderBy("site").collect() == [("a", 102), ("b/c", 102)]


def test_conditions_are_pushed_down(spark, capture):
    rows = spark.read.format("captures").option("pushdown", True).load(capture)
    for condition, files in ((F.col("site") == "a", 2), (F.col("site").isin("a", "b/c"), 4), ((F.col("site") == "a") & (F.col("status") < 210), 2), (F.col("site") == "none", 1)):
        assert rows.where(condition).rdd.getNumPartitions() == files
    assert rows.where("site = 'a' AND status < 210").count() == 20 and rows.where("site = 'none'").count() == 0
    assert rows.where("site IS NULL").count() == 102
    same = spark.read.format("captures").load(capture)
    assert same.where("site = 'a'").union(same.where("site = 'b/c'")).groupBy("site").count().orderBy("site").collect() == [("a", 102), ("b/c", 102)]


def test_sites_go_to_their_readers(spark):
    @readers.reader("mark")
    def mark(pages):
        return pages.select("site", F.lit("marked").alias("name"))

    pages = spark.createDataFrame([("x", "u"), ("y", "v"), (None, "w")], "site string, url string")
    got = {(r.site, r.name, r.url) for r in readers.read_sites(pages, {"x": "mark", "z": "mark"}).collect()}
    assert got == {("x", "marked", None), ("y", None, "v"), (None, None, "w")}


def stream_of(spark, path, rows=40):
    frame = spark.range(rows).select("id", (F.col("id") % 7).alias("k"))
    for part in range(4):
        frame.where(F.col("id") % 4 == part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("id long, k long").option("maxFilesPerTrigger", 1).parquet(path)


def test_epochs_survive_failures(spark, tmp_path):
    """Killed behind the second epoch and before its commit to the checkpoint, and with a half-written epoch left: no row lost or doubled."""
    stream, out, state = stream_of(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")
    calls = []

    def fail_once(number):
        calls.append(number)
        if calls.count(1) == 1 and number == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        epochs.write_epochs(stream, out, state, fail_once)
    spark.range(5).select("id", F.lit(0).cast("long").alias("k")).write.parquet(f"{out}/epoch=2")
    (tmp_path / "out" / "epoch=2" / "_SUCCESS").unlink()
    assert epochs.committed(spark, out) == [0, 1] and epochs.read_epochs(spark, out, "id long, k long").count() == 20
    epochs.write_epochs(stream, out, state, fail_once)
    assert calls == [0, 1, 1, 2, 3] and epochs.committed(spark, out) == [0, 1, 2, 3]
    rows = epochs.read_epochs(spark, out, "id long, k long").collect()
    assert sorted((r.id, r.k) for r in rows) == [(i, i % 7) for i in range(40)]
    assert epochs.read_epochs(spark, out, "id long, k long", after=2).count() == 10
    epochs.write_epochs(stream, out, state, fail_once)
    assert calls == [0, 1, 1, 2, 3]
    assert epochs.read_epochs(spark, str(tmp_path / "none"), "id long").count() == 0


def test_state_outlives_restarts(spark, tmp_path):
    """Keys seen before a restart stay seen; late windows count once."""
    src, state, out = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out")

    def put(rows):
        frame = spark.createDataFrame(rows, "user string, s long").select("user", F.timestamp_seconds("s").alias("ts"))
        frame.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(frame.schema).parquet(src)
        epochs.write_epochs(arrivals.first_in_window(stream, "user", "ts", 100), out, state)
        return sorted((r.user or "", r.window_s) for r in epochs.read_epochs(spark, out, "user string, window_s long").collect())

    assert put([("a", 5), ("a", 99), ("a", 100), ("b", 350), (None, 1), ("c", None)]) == [("", 0), ("a", 0), ("a", 100), ("b", 300)]
    assert put([("a", 7), ("b", 1), ("b", 399), (None, 2)]) == [("", 0), ("a", 0), ("a", 100), ("b", 0), ("b", 300)]


def test_arrivals_with_and_without_ttl(spark, tmp_path):
    """The same windows by Spark's state as by lists that are forgotten; without a time to live no row goes to Python."""
    src = str(tmp_path / "in")
    rows = [("a" if i % 3 else None, i * 37 % 5000) for i in range(400)]
    frame = spark.createDataFrame(rows, "user string, s long").select("user", F.timestamp_seconds("s").alias("ts"))
    frame.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(src)
    want = sorted({(u or "", s // 10 * 10) for u, s in rows})
    for ttl in (None, 3600):
        found = arrivals.first_in_window(stream, "user", "ts", 10, ttl)
        assert ("TransformWithState" in found._jdf.queryExecution().analyzed().toString()) == (ttl is not None)
        out = str(tmp_path / f"out{ttl}")
        # a state that can run out asks for batches without data for ever
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        try:
            epochs.write_epochs(found, out, str(tmp_path / f"state{ttl}"))
        finally:
            spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
        assert sorted((r.user or "", r.window_s) for r in epochs.read_epochs(spark, out, "user string, window_s long").collect()) == want
