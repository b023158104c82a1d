"""Captured files: sitemaps over many tasks, gzip in pieces."""

import gzip

import pytest
from pyspark.sql import functions as F

from catloom.sources import files


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    entries = [f"<url><loc>https://a.example/{i}?x=1&amp;y=é</loc><lastmod>2024</lastmod></url>" for i in range(60_000)]
    (tmp_path / "one.xml").write_text("<? xml version='1.0'?><urlset>" + "".join(entries) + "</urlset>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 19)
    try:
        got = files.read_locs(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 5
        assert sorted(r.loc for r in got.collect()) == sorted(f"https://a.example/{i}?x=1&y=é" for i in range(60_000))
        assert {r.kind for r in got.select("kind").distinct().collect()} == {"page"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_forms_of_entries(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<x:urlset xmlns:x='u'><x:url><x:loc>\n p1 \n</x:loc></x:url><x:url><x:loc>p2</x:loc></x:url></x:urlset>")
    (tmp_path / "b.xml").write_text("<sitemapindex><sitemap>\n<loc><![CDATA[ s1 ]]></loc></sitemap></sitemapindex>")
    (tmp_path / "c.xml").write_text("<urlset><url><loc></loc></url><url><loc>s2.xml.gz</loc></url><url><loc>p3</loc></url></urlset>")
    (tmp_path / "d.xml").write_text("")
    (tmp_path / "e.xml.gz").write_bytes(gzip.compress(b"<urlset><url><loc>p4</loc></url></urlset>"))
    got = {(r.file.rsplit("/", 1)[-1], r.kind, r.loc) for r in files.read_locs(spark, str(tmp_path)).collect()}
    assert got == {("a.xml", "page", "p1"), ("a.xml", "page", "p2"), ("b.xml", "sitemap", "s1"), ("c.xml", "sitemap", "s2.xml.gz"), ("c.xml", "page", "p3"), ("e.xml.gz", "page", "p4")}
    xml = {(r.loc, r.lastmod) for r in files.read_urls(spark, str(tmp_path / "[ce].xml*")).collect()}
    assert xml == {("s2.xml.gz", None), ("p3", None), ("p4", None)}
    assert [r.loc for r in files.read_urls(spark, str(tmp_path / "b.xml"), "sitemap").collect()] == ["s1"]


@pytest.mark.parametrize("piece,step", [(50, 7), (1 << 22, 1 << 16)])
def test_gzip_in_pieces(spark, piece, step):
    text = "".join(f"<loc>página {i}</loc>" for i in range(3000))
    whole = gzip.compress(text.encode())
    two = gzip.compress(text[:1000].encode()) + gzip.compress(text[1000:].encode()) + b"\0\0"
    odd = bytearray(whole)
    odd[len(odd) // 2] ^= 255
    rows = [(1, whole), (2, two), (3, whole[:-3]), (4, bytes(odd)), (5, text.encode()), (6, b""), (7, None), (8, whole + b"junk"), (9, b"\x1f\x8b"), (10, b"\xff<b>x</b>")]
    frame = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in rows], "k long, content binary")
    got = {}
    for r in files.opened(frame, "k", piece=piece, step=step).orderBy("key", "piece").collect():
        got.setdefault(r.key, []).append(r.body)
    assert {k: None if v == [None] else "".join(v) for k, v in got.items()} == {1: text, 2: text, 3: None, 4: None, 5: text, 6: "", 7: None, 8: None, 9: None, 10: "<b>x</b>"}
    if piece == 50:
        assert len(got[1]) > 100 and all(p.endswith("</loc>") for p in got[1])


def test_files_of_any_name(spark, tmp_path):
    (tmp_path / "body").write_bytes(gzip.compress(b"<loc>x</loc>"))
    (tmp_path / "plain.gz").write_bytes(b"<loc>y</loc>")
    assert {r.body for r in files.read_bodies(spark, str(tmp_path)).collect()} == {"<loc>x</loc>", "<loc>y</loc>"}
    assert files.read_bodies(spark, str(tmp_path), "*.gz").where(F.col("key").endswith("plain.gz")).count() == 1
