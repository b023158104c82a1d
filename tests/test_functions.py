"""Edge cases of the column functions, sinks, readers and streams."""

import urllib.parse

import pytest
from pyspark.sql import functions as F

from catloom.functions import classify, html, normalize, urls
from catloom.operators import consolidate, crawl, readers, requests, structured
from catloom.sources import fixtures, links, sinks, sitemaps

SMALL = "/root/testdata/sf0.001"


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(col.alias("x")).first()["x"]


BASES = ["http://a.com/b/c/d?q=1#f", "https://a.com:8080/x/", "http://a.com"]
HREFS = ["g", "./g", "../g", "../../g", "../../../g", "/g", "//h.org/g", "?y=2", "#s", "", "g/./h/../i", "http://z.org/q", "mailto:a@b.c", "g/..", "a b"]


@pytest.mark.parametrize("base", BASES)
def test_resolve_like_the_standard(spark, base):
    rows = spark.createDataFrame([(h,) for h in HREFS], "h string")
    got = {r.h: r.x for r in rows.select("h", urls.resolve(F.lit(base), F.col("h")).alias("x")).collect()}
    for h in HREFS:
        want = urllib.parse.urljoin(base, h)
        assert got[h] == want, (base, h)


def test_title_case_like_python(spark):
    for t in ("kit 12v mop5010 40cm", "água d'oeste", "ABC-def_ghi", ""):
        assert one(spark, urls.title_case(F.col("t")), t=t) == t.title()


def test_bad_urls_are_null_and_never_raise(spark):
    rows = spark.createDataFrame([("not a url",), ("http://[::1",), (None,), ("",)], "u string")
    got = rows.select(urls.authority(F.col("u")).alias("a"), urls.depth(F.col("u")).alias("d"), urls.next_page(F.col("u")).alias("n")).collect()
    assert all(r.a is None and r.n is None for r in got)


def test_canonical_is_idempotent(spark):
    u = fixtures.url_samples(spark, SMALL)
    once = urls.canonical(F.col("url"))
    assert u.where(urls.canonical(once) != once).count() == 0


def test_prices(spark):
    for t, want in (("R$ 2.706,38", "2706.38"), ("2706.38", "2706.38"), ("12,5", "12.50"), ("1.234.567", None), ("", None), ("abc", None)):
        got = one(spark, normalize.clean_price(F.col("t")), t=t)
        assert (str(got) if got is not None else None) == want
    assert one(spark, normalize.clean_price(F.lit(None).cast("string"))) is None
    equal = one(spark, normalize.top_two(normalize.local_prices(F.col("t"))), t="R$ 20,00 R$ 20,00 R$ 5,00")
    assert equal["original"] is None and str(equal["price"]) == "20.00"


def test_zero_filter_keeps_round_prices(spark):
    assert one(spark, normalize.price_text(F.col("t")), t="R$ 0,00 e R$ 100,00") == "R$ 100,00"


def test_platform_quirk(spark):
    page = "<img src='image.png'>"
    assert one(spark, classify.platform(F.col("t")), t=page) is None
    assert one(spark, classify.platform(F.col("t"), "last"), t=page) == "MAGENTO"


def test_malformed_markup(spark):
    page = """<p><b>one<p>two<script>var t="</p><h1>no</h1>";</script><h1 class='x y'>A &amp; B<br>c</h1>
    <meta property=og:title content='q "z"'><table><tr><th>Cor</th><td>Azul</td></tr><tr><td>Cor</td><td>Verde</td></tr></table><li>Peso: 2 kg: bruto</li>"""
    tags = html.tag_lists(spark.createDataFrame([(1, page), (2, None), (3, "")], "k long, html string"), "k").orderBy("page")
    t = F.col("tags")
    row = tags.select(html.headings(t).alias("h"), html.meta_content(t, "og:title").alias("m"), html.specs(t).alias("s"), html.class_text(t, "x").alias("c")).collect()
    assert row[0].h == ["A & Bc"] and row[0].m == 'q "z"' and row[0].s == {"Cor": "Verde", "Peso": "2 kg: bruto"} and row[0].c == "A & Bc"
    assert row[1].h == [] and row[2].h == [] and row[1].s == {}
    second = html.tag_lists(spark.createDataFrame([(1, "<h1>a</h1><h1>b</h1>")], "k long, html string"), "k")
    assert second.select(html.heading(t, "second").alias("x")).first().x == "b"


def test_anchors_with_ancestors(spark):
    rows = html.tag_lists(spark.createDataFrame([(1, "<nav><a href='/a' class=K>x</a></nav><a>no</a><div><a href=/b id=i>y<b> z</b></a></div>")], "k long, html string"), "k")
    got = [(r.href, r.in_nav, r.class_id, r.text) for r in html.anchors(rows).orderBy("pos").collect()]
    assert got == [("/a", True, "k", "x"), ("/b", False, "i", "y z")]


def whole(node):
    """Tags of a page by plain recursion: (name, texts of it and all below, names above)."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.rows, self.open = [], []

        def handle_starttag(self, tag, attrs):
            self.rows.append((tag, [], [self.rows[i][0] for i in self.open]))
            if tag not in html.VOID:
                self.open.append(len(self.rows) - 1)

        def handle_endtag(self, tag):
            for k in reversed(range(len(self.open))):
                if self.rows[self.open[k]][0] == tag:
                    del self.open[k:]
                    return

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in html.VOID:
                self.open.pop()

        def handle_data(self, data):
            raw = self.open and self.rows[self.open[-1]][0] in ("script", "style")
            for i in self.open[-1:] if raw else self.open:
                self.rows[i][1].append(data)

    p = Plain()
    p.feed(node)
    p.close()
    return [(tag, " ".join("".join(parts).split()), above) for tag, parts, above in p.rows]


def test_intervals_are_the_tree(spark):
    """Texts and ancestors by intervals, on pages of random, often broken nesting."""
    import random

    rng = random.Random(4)
    bits = ["<div>", "</div>", "<p class=a>", "</p>", "<b>", "</b>", " x ", "\u00a0y\n", "<br>", "<i/>", "<script>a<b>c</script>", "&amp;", "</nav>", "<nav>", "<style>s</style>", "<img/>"]
    pages = [(k, "".join(rng.choices(bits, k=rng.randrange(1, 60)))) for k in range(150)]
    lists = html.tag_lists(spark.createDataFrame(pages, "k long, html string"), "k")
    t = F.col("tags")
    above = lambda e: F.transform(html.around(t, e), lambda c: c["tag"])
    rows = F.transform(F.filter(t, lambda e: e["tag"] != html.TEXT), lambda e: F.struct(e["tag"].alias("tag"), html.text_of(t, e).alias("text"), above(e).alias("above")))
    got = {r.page: [tuple(x) for x in r.rows] for r in lists.select("page", rows.alias("rows")).collect()}
    for k, page in pages:
        assert got[k] == whole(page), page


def test_large_and_deep_pages_take_seconds(spark):
    import time

    from catloom.functions import markup

    wide = "<body><div class=breadcrumb>" + "".join(f"<span><a href=/c{i}>n{i}</a> t</span>" for i in range(20_000)) + "</div><ul>" + "".join(f"<li>k{i}: v{i}</li>" for i in range(10_000)) + "</ul></body>"
    deep = "<body>" + "<div>x" * 5000 + "<h1>end</h1>" + "</div>" * 5000 + "</body>"
    lists = html.tag_lists(spark.createDataFrame([(1, wide), (2, deep)], "k long, html string"), "k").cache()
    lists.count()
    t, began = F.col("tags"), time.time()
    rows = lists.select("page", F.size(t).alias("n"), F.size(html.specs(t)).alias("s"), F.length(markup.category_path(t)).alias("c"), html.heading(t).alias("h"), F.length(markup.page_text(t)).alias("p")).orderBy("page").collect()
    assert rows[0].n > 50_000 and rows[0].s == 10_000 and rows[0].c > 100_000 and rows[1].h == "end" and rows[1].p > 5000
    assert time.time() - began < 60


def test_invalid_json_is_skipped(spark):
    page = """<script type="application/ld+json">{bad</script><script TYPE='application/ld+json'>[1, {"@type": ["Thing", "Product"], "name": "n", "offers": {"price": 0.1, "@type": "Offer"}}]</script>"""
    rows = structured.jsonld_products(spark.createDataFrame([(1, page)], "k long, html string"), "k").collect()
    assert len(rows) == 1 and rows[0]["name"] == "n" and str(rows[0].price) == "0.10" and rows[0].images == []


def test_homepage_products(spark):
    page = '<a href="/produto/furadeira-de-impacto?x=1">a</a><a href="/produto/furadeira-de-impacto/">b</a><a href="/produto/curto">c</a><a href="https://z.com/p/serra-circular-azul">d</a>'
    rows = spark.createDataFrame([(1, "https://a.com/", page)], "page_id long, url string, html string")
    got = [r.link for r in links.homepage_products(links.page_links(rows)).orderBy("position").collect()]
    assert got == ["https://a.com/produto/furadeira-de-impacto", "https://z.com/p/serra-circular-azul"]


def test_sitemap_readers_agree(spark):
    body = '<?xml version="1.0"?><urlset xmlns="http://x"><url><loc> http://a/1 </loc></url><url><loc>http://a/2</loc></url></urlset>'
    assert one(spark, sitemaps.locs(F.col("t")), t=body) == one(spark, sitemaps.locs_by_xml(F.col("t")), t=body) == ["http://a/1", "http://a/2"]
    assert one(spark, sitemaps.locs_by_pattern(F.col("t")), t=body) == [" http://a/1 ", "http://a/2"]


def test_recursive_sql_gives_the_tree(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    want = {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {(r.node, r.depth) for r in crawl.expand_sql(spark, seeds, edges, 4).collect()} == want
    assert {(r.node, r.depth) for r in crawl.reach(seeds, edges).collect()} == want


def test_readers_and_ragged_union(spark):
    @readers.reader("twice")
    def twice(pages):
        return pages.withColumn("n", F.lit(2))

    pages = spark.createDataFrame([(1, "twice"), (2, "unknown"), (3, None)], "k long, reader string")
    got = {r.k: r.n for r in readers.read_all(pages, "reader", ["twice"]).collect()}
    assert got == {1: 2, 2: None, 3: None}
    assert consolidate.ordered(spark.createDataFrame([(1, 2, 3)], "zeta int, name int, alpha int")).columns == ["name", "alpha", "zeta"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "n" * 50, ["x", "y"], None), ("b", "m", None, "2")], "platform string, name string, images array<string>, sku string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.write_csv(df, str(tmp_path / "by"), by_platform=True)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["platform", "name", "images", "sku"] and back.where("platform = 'a'").first().images == '["x","y"]'
    assert spark.read.option("header", True).csv(str(tmp_path / "by")).count() == 2
    assert sinks.preview(df, "platform").first().name == "n" * 40 + "..."
    assert [r.value for r in sinks.report_lines(df, ["platform", "sku"], "platform").collect()] == ["platform: a | sku: N/A", "platform: b | sku: 2"]
    sinks.write_envelope(df, df.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "env"))
    assert spark.read.json(str(tmp_path / "env/metadata")).first().n == 2


def test_session_pool_blocks_and_resets(spark):
    log = spark.createDataFrame([(1, i, False) for i in range(12)], "k long, i long, ok boolean")
    got = [r.session for r in requests.session_pool(log, ["k"], ["i"], "ok", size=2).orderBy("i").collect()]
    assert got == [0, 1, 0, 1, 0, 1, 0, 1, 0, 0, 0, 0]


def test_limiter_stream_equals_batch(spark, tmp_path):
    from catloom.streaming.requests import limiter

    log = fixtures.request_log(spark, SMALL)
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    q = limiter(stream, "user_id", "event_id").writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.user_id, r.block, r.rpm) for r in spark.table("limits").collect()}
    want = {(r.user_id, r.block, r.rpm) for r in requests.limiter_fold(log, ["user_id"], ["event_id"]).collect()}
    assert got == want and want


def test_reach_does_not_end_early(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(24)], "src long, dst long").cache()
    seeds = spark.createDataFrame([(0,)], "node long")
    assert {(r.node, r.depth) for r in crawl.reach(seeds, edges).collect()} == {(i, i) for i in range(25)}
    with pytest.raises(RuntimeError):
        crawl.reach(seeds, edges, most_rounds=3)
    assert crawl.reach(seeds, edges.where("src < 3"), most_rounds=3).count() == 4


def test_products_at_any_depth(spark):
    """Against plain recursion, with the level of each; one job, no shuffle."""
    import json

    deep = {"@type": "Product", "name": "deep"}
    for k in range(60):
        deep = {"x": deep} if k % 2 else [1, deep, "{["]
    values = [deep, {"@type": ["A", "Product"], "name": "a", "offers": [{"itemOffered": {"@type": "Product", "name": "b"}}, {"@type": "Product", "name": "c"}]}, [{"@type": "Product", "name": "d"}], 5, "text", {}, []]
    scripts = [json.dumps(v) for v in values] + ["{broken"]
    page = "".join(f'<script type="application/ld+json">{x}</script>' for x in scripts)

    def plain(v, level):
        own = v.get("@type") if isinstance(v, dict) else None
        if own == "Product" or (isinstance(own, list) and "Product" in own):
            yield v["name"], level
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            yield from plain(x, level + 1)

    want = sorted(x for v in values for top in (v if isinstance(v, list) else [v]) for x in plain(top, 0))
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "k long, html string")
    found = structured.nested_products(rows, "k")
    assert sorted((structured_name, level) for structured_name, level in found.select(structured.text_at(F.col("node"), "$.name"), "level").collect()) == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_payload_search_stops_at_its_level(spark):
    body = '{"name":"top","price":1,"a":{"b":{"c":{"title":"third","finalPrice":"3"},"d":{"e":{"name":"fourth","price":4}}}},"l":[{"productName":"two","sellingPrice":2.5},{"name":"no price"}]}'
    rows = spark.createDataFrame([(1, body), (2, "no json"), (3, None)], "k long, t string").select("k", F.try_parse_json("t").alias("v"))
    got = sorted(tuple(r) for r in structured.payload_products(rows, "k", "v").select("k", "level", "name", "price_raw").collect())
    assert got == [(1, 0, "top", "1"), (1, 2, "two", "2.5"), (1, 3, "third", "3")]


def test_a_sitemap_body_is_not_repeated_for_its_entries(spark):
    """Above the explode stands nothing that reads a body, so the work is linear in it."""
    rows = spark.createDataFrame([("i", "<sitemapindex><loc>s</loc></sitemapindex>"), ("s", "<urlset><loc>p</loc><loc>p</loc><loc>q.xml</loc></urlset>"), ("n", None)], "url string, body string")
    found = sitemaps.edges(rows)
    assert sorted(tuple(r) for r in found.collect()) == [("i", "s", "sitemap"), ("s", "p", "page"), ("s", "q.xml", "sitemap")]
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "sitemapindex" not in above and "body" not in above


def test_one_level_reads_a_body_once_for_each_use(spark):
    rows = spark.createDataFrame(
        [("i", "<sitemapindex><loc>products.xml</loc><loc>other.xml</loc></sitemapindex>"), ("products.xml", "<urlset><loc>a</loc><loc>a</loc></urlset>"), ("other.xml", "<urlset><loc>b</loc><loc>c/p</loc></urlset>"), ("lone", "<urlset><loc>d</loc></urlset>")],
        "url string, body string",
    )
    found = sitemaps.one_level(rows)
    assert sorted(tuple(r) for r in found.collect()) == [("i", "a"), ("i", "c/p"), ("lone", "d")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("sitemapindex" in branch.split("Generate")[0] for branch in plan.split("LogicalRDD"))


def test_one_level_reads_bodies_once_in_all(spark):
    """A child of two indexes goes to both, a sitemap that leads to itself is its own child, and a null URL is a root like others."""
    rows = spark.createDataFrame(
        [("i", "<sitemapindex><loc>x/PRODUCTS.xml</loc><loc>gone.xml</loc></sitemapindex>"), ("j", "<sitemapindex><loc>x/PRODUCTS.xml</loc></sitemapindex>"), (None, "<sitemapindex><loc>x/PRODUCTS.xml</loc></sitemapindex>"), ("x/PRODUCTS.xml", "<urlset><loc>a</loc><loc>a</loc></urlset>"), ("self.xml", "<urlset><loc>self.xml</loc><loc>b</loc><loc>c/p</loc></urlset>"), (None, "<urlset><loc>d</loc></urlset>"), ("n", None)],
        "url string, body string",
    )
    found = sitemaps.one_level(rows)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted([("i", "a"), ("j", "a"), (None, "a"), ("self.xml", "c/p"), (None, "d")], key=str)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1

def test_page_headings_like_its_sql(spark, tmp_path):
    """References stay as they stand but for two, also cut ones; pages without a heading give an empty one, null pages null."""
    import duckdb

    from catloom.plans import registry

    registry.load()
    pages = ["<h1>a &quot;b&amp;c&amp</h1><a href=x>", "<h1> &copy; &lt;b&gt;  x </h1><a x><a y>", "<H1>no</H1>", "<h1 class=x>no</h1>", "<h1>a\n<b>c</b></h1>", "", None]
    spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(db.execute(registry.ORACLE_SQL["page_headings"]).fetchall())
    assert sorted(tuple(r) for r in registry.QUERIES["page_headings"](spark, str(tmp_path)).collect()) == want


def test_a_small_frontier_does_not_shuffle_the_edges(spark, monkeypatch):
    plans, cut = [], crawl.cut
    monkeypatch.setattr(crawl, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    monkeypatch.setattr(crawl, "FEW", 3)
    edges = spark.createDataFrame([(0, i) for i in range(1, 6)] + [(i, 9) for i in range(1, 6)] + [(9, 0), (None, 1)], "src long, dst long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.node, r.depth) for r in crawl.reach(spark.createDataFrame([(0,)], "node long"), edges).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {(0, 0), (9, 2)} | {(i, 1) for i in range(1, 6)}
    joins = [(p.count("BroadcastHashJoin"), p.count("SortMergeJoin") + p.count("ShuffledHashJoin")) for p in plans if "Join" in p]
    # a frontier of one node and then of five; the visited set is too large from the second round on
    assert joins[:3] == [(2, 0), (0, 2), (1, 1)]


def test_first_product_reads_a_page_once(spark):
    """One parse, and only the fields that are asked for; what is no product is left out."""
    page = '<script type="application/ld+json">[{"@type":"Thing","name":"t"},{"@type":"Product","name":"a","sku":"1","offers":{"price":"5"}},{"@type":"Product","name":"b"}]</script>'
    rows = spark.createDataFrame([(1, page), (2, "<h1>x</h1>"), (3, None), (4, '<script type="application/ld+json">{</script>')], "k long, html string")
    found = structured.first_product(rows, "k").select("k", "name", "price")
    assert [(r.k, r.name, str(r.price)) for r in found.collect()] == [(1, "a", "5.00")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(html") == 1 and "gtin13" not in plan


def test_matched_product_reads_a_page_once(spark):
    def page(*own):
        return '<script type="application/ld+json">[' + ",".join(f'{{"@type":"Product",{x}}}' for x in own) + "]</script>"

    rows = spark.createDataFrame(
        [
            (1, "https://a.com/x-77", page('"name":"a"', '"name":"b","sku":"77"', '"name":"c","url":"https://A.com/x-77/"', '"name":"d","offers":{"url":"https://a.com/x-77"}')),
            (2, "https://a.com/x-77", page('"name":"a"', '"name":"b","sku":"77"', '"name":"c","sku":"77"')),
            (3, None, page('"name":"a"', '"name":"b"')),
            (4, "https://a.com/x-77", "<p>"),
        ],
        "k long, url string, html string",
    )
    found = structured.matched_product(rows, "k").select("k", "name", "match_rank")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "d", 1), (2, "b", 3), (3, "a", 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(html") == 1 and "gtin13" not in plan
