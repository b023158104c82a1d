"""Row-by-row folds, samples, streams and outputs against plain Python."""

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import Observation
from pyspark.sql import functions as F

from catloom.operators import patterns, requests
from catloom.sources import fixtures, sinks, sitemaps

SMALL = "/root/testdata/sf0.001"


def timed(spark):
    return fixtures.request_log(spark, SMALL).withColumn("at", F.col("event_id") * 0.3).select("user_id", "event_id", "at", "ok")


def by_user(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.event_id):
        out[r.user_id].append(r)
    return out


def test_leaky_bucket(spark):
    log = timed(spark).withColumn("hint", F.when(F.col("event_id") % 7 == 0, 4.5))
    got = {r.event_id: r.slot_s for r in requests.leaky_bucket(log, ["user_id"], ["event_id"], "at", 0.5, "hint").collect()}
    for rows in by_user(log.collect()).values():
        following = None
        for k, r in enumerate(rows):
            slot = r.at if following is None else max(r.at, following)
            assert got[r.event_id] == slot
            following = slot + (0.8 + 0.4 * (zlib.crc32(str(k).encode()) % 1000) / 1000) / 0.5
            if r.hint is not None:
                following = max(following, slot + r.hint)


def test_session_pool(spark):
    log = timed(spark)
    got = {r.event_id: r.session for r in requests.session_pool(log, ["user_id"], ["event_id"], "ok", size=3).collect()}
    for rows in by_user(log.collect()).values():
        errors, blocked, following = [0] * 3, [False] * 3, 0
        for r in rows:
            free = [(following + i) % 3 for i in range(3) if not blocked[(following + i) % 3]]
            if free:
                own = free[0]
                following = (own + 1) % 3
            else:
                own = errors.index(min(errors))
                blocked[own], errors[own] = False, 0
            assert got[r.event_id] == own
            errors[own] = max(0, errors[own] - 1) if r.ok else errors[own] + 1
            if not r.ok:
                blocked[own] = errors[own] > 3


def test_a_long_history_streams(spark):
    log = spark.range(200_000).select(F.lit(1).alias("k"), "id", (F.col("id") % 9 == 0).alias("error"), F.lit(False).alias("limited"))
    rows = requests.limiter_fold(log, ["k"], ["id"]).orderBy("block").collect()
    rpm = 60
    for r in rows:
        errors = sum(i % 9 == 0 for i in range(10 * r.block, 10 * r.block + 10))
        rpm = requests.adjusted(rpm, errors, 0, 10, "standard", 120)
        assert r.rpm == rpm
    assert len(rows) == 20_000


def test_odd_logs(spark):
    log = spark.createDataFrame([(None, 1, 0.0, True), (None, 2, 0.1, False), ("a", 1, 0.0, True)], "k string, i long, at double, ok boolean")
    assert sorted(r.wait_s for r in requests.token_bucket(log, ["k"], ["i"], "at", 1.0).collect()) == [0.0, 0.0, 0.9]
    assert requests.session_pool(log.limit(0), ["k"], ["i"], "ok").count() == 0


def test_hash_sample(spark):
    urls = [f"https://a.example.com/{i}" for i in range(1500)]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    want = sorted(urls, key=lambda u: (hashlib.md5(f"7:{u}".encode()).hexdigest(), u))
    assert {r.url for r in patterns.hash_sample(frame).collect()} == set(want[:10])
    assert {r.url for r in patterns.hash_sample(frame, extra=20).collect()} == set(want[:30])
    assert patterns.hash_sample(frame.limit(300)).count() == 5


def test_first_arrivals(spark, tmp_path):
    from catloom.streaming.requests import first_arrivals

    rows = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("c", 3), ("b", 4)], "url string, s int").select("url", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = first_arrivals(stream, ["url"]).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.url for r in spark.table("arrived").collect()) == ["a", "b", "c"]


def test_progress_is_observed(spark):
    seen = Observation("progress")
    log = timed(spark)
    assert sinks.observed(log, seen, "ok").count() == log.count()
    assert seen.get["rows"] == log.count() and seen.get["succeeded"] == log.where("ok").count()


def test_more_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "https://x.example.com/p?q=1", 1), ("b", "https://y.example.com", 2)], "platform string, url string, n int")
    sinks.write_lines(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    sinks.write_named(df, str(tmp_path / "named"))
    assert sorted(p.name for p in (tmp_path / "named").iterdir() if p.is_dir()) == ["file=x.example.com_p_q_1", "file=y.example.com"]


def test_gzip_is_known(spark):
    rows = spark.createDataFrame([("a.xml.gz", None, b""), ("a.xml", "GZIP", b""), ("a.xml", None, b"\x1f\x8b\x08"), ("a.xml", None, b"<u")], "p string, e string, b binary")
    got = rows.select(sitemaps.is_gzip(F.col("p"), F.col("e"), F.col("b")).alias("z")).collect()
    assert [r.z for r in got] == [True, True, True, False]


def test_entity_references(spark):
    from catloom.operators import structured

    cache = '{"Product:1":{"productName":"n","priceRange":{"id":"r"}},"r":{"sellingPrice":{"id":"gone","lowPrice":3.5},"listPrice":{"id":"l"}},"l":{"lowPrice":9},"Product:2":{"priceRange":{"id":"none"}},"Product:1.x":{},"$price":{"a":1}}'
    frame = spark.createDataFrame([(1, cache), (2, "{}"), (3, None)], "k long, body string").withColumn("v", F.try_parse_json("body"))
    got = {r.entity: (r.name, r.price and float(r.price), r.price_original and float(r.price_original)) for r in structured.cached_products(frame, "k", "v").collect()}
    assert got == {"Product:1": ("n", 3.5, 9.0), "Product:2": (None, None, None)}
    assert [r.entity for r in structured.priced_entities(frame, "k", "v").collect()] == ["$price"]


def test_price_pairs(spark):
    from catloom.functions import normalize

    texts = ["DE R$ 20,00\nPOR só R$ 10,00 R$ 5,00", "de R$ 1.020,00 ou R$ 10", "R$ 20,00 e R$ 10,00", "R$ 7,50", "nada", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k")
    want = {"near": [(20, 10), (1020, 10), (None, 20), (None, 7.5), (None, None), (None, None)], "any": [(20, 10), (1020, 10), (20, 10), (None, 7.5), (None, None), (None, None)]}
    for rule, pairs in want.items():
        got = [(r.p.original and float(r.p.original), r.p.price and float(r.p.price)) for r in frame.select(normalize.price_pair(F.col("t"), rule).alias("p")).collect()]
        assert got == pairs, rule


def test_trailing_count_of_one_key_over_many_tasks(spark):
    """The rows of one key in slices with halos, against plain counting; ties, gaps, no time, no key."""
    import bisect
    import random

    rng = random.Random(2)
    times = [rng.randrange(0, 3000) + rng.choice([0.0, 0.5]) for _ in range(800)] + [60.0] * 5 + [600.0, 1200.0, 599.999999, 540.0, -30.0, -700.0]
    rows = [(k, rng.choice(["a", "b", None]), t) for k, t in enumerate(times)] + [(9000 + k, "a", None) for k in range(3)]
    log = spark.createDataFrame(rows, "id long, user string, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    by = defaultdict(list)
    for _, u, t in rows:
        if t is not None:
            by[u].append(t)
    for v in by.values():
        v.sort()
    want = {i: 3 if t is None else bisect.bisect_right(by[u], t) - bisect.bisect_left(by[u], t - 60) for i, u, t in rows}
    for spans in (1, 10):
        for frame in (log, log.withColumn("ts", F.col("ts").cast("timestamp_ntz"))):
            got = requests.trailing_count(frame, ["user"], spans=spans)
            assert {r.id: r.in_window for r in got.collect()} == want and got.columns == [*frame.columns, "in_window"]


def test_heavy_values_are_exact(spark):
    """With few buckets that many values share, the result is the plain count's; a site of many paths shuffles few of them."""
    import random

    rng = random.Random(3)
    rows = [(site, rng.choice(["a", "b"]) if rng.random() < p else f"x{rng.randrange(3000)}") for site, p, n in (("s", 0.6, 4000), ("t", 0.1, 500), ("u", 1, 2), ("v", 1, 3)) for _ in range(n)]
    frame = spark.createDataFrame([(None, "a")] * 4 + rows, "site string, v string")
    totals = patterns.site_counts(frame, "site", "__total")
    counts, size = defaultdict(int), defaultdict(int)
    for site, v in rows:
        counts[site, v] += 1
        size[site] += 1
    want = {(s, v, n) for (s, v), n in counts.items() if n >= max(2, 0.2 * size[s]) and size[s] >= 3}
    for buckets in (1, 7, 1024):
        assert {tuple(r) for r in patterns.heavy(frame, totals, "v", 0.2, buckets=buckets).collect()} == want


def test_few_rows_are_broadcast_and_many_are_not(spark):
    from catloom.operators.ranks import join_few

    rows, few = spark.range(1000).select((F.col("id") % 10).alias("k")), spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    for most, name in ((10, "BroadcastHashJoin"), (9, "Join")):
        got = join_few(rows, few, ["k"], most=most)
        assert got.count() == 1000 and name in got._jdf.queryExecution().executedPlan().toString()
