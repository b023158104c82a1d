"""Learning URL patterns: fixed pattern lists by match ratio, path templates by frequency, planning and validation.

Statistics are one-row or few-row aggregates that are broadcast back; the URL
lists themselves are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catloom.functions import urls
from catloom.operators.ranks import cut, global_positions, join_few

#: Pattern, least ratio; the first list goes by order, the second by the best ratio (fixed values).
FIRST_PATTERNS = ((r"/produtos?/[^/]+-\d+/?$", 0.25), (r"/p(roduto)?/[^/]+/\d+", 0.5), (r"^https?://[^/]+/[^/]+/[^/]+/[^/]+/?$", 0.15))
BEST_PATTERNS = (
    (r"/produtos?/[^/]+-\d+/?$", 0.25),
    (r"/p(roduto)?/[^/]+/\d+", 0.5),
    (r"/[^/]+-p-\d+", 0.5),
    (r"/produto/[^/]+\.html", 0.5),
    (r"/[^/]+/p/\d+", 0.5),
    (r"\.com\.br/[^/]+-\d+/", 0.5),
    (r"^https?://[^/]+/[^/]+/[^/]+/[^/]+/?$", 0.15),
    (r"^https?://[^/]+/[^/]+/[^/]+/[^/]+/[^/]+/?", 0.10),
)


def positions(links: DataFrame, order: list[str], by: list[str] | None = None, out: str = "position") -> DataFrame:
    """1-based positions in each site, or in all, which are numbered by ranges."""
    if not by:
        return global_positions(links, [F.col(c) for c in order], out)
    return links.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def site_counts(links: DataFrame, site: str, out: str = "__n") -> DataFrame:
    """A row for each site with the number of its links."""
    return links.groupBy(site).agg(F.count(F.lit(1)).alias(out))


def pattern_scores(links: DataFrame, patterns, site: str = "site", url: str = "url", skip: int = 20, take: int = 50, least: int = 70, lone: int = 50) -> DataFrame:
    """``site, ord, pattern, least_ratio, n, hits, ratio`` over a slice of each site's links by ``position``.

    A site of over ``least`` links gives the ``take`` after the first ``skip``; a smaller one its first ``lone``.
    """
    sized = join_few(links, site_counts(links, site), [site])
    big = F.col("__n") > least
    inside = F.when(big, (F.col("position") > skip) & (F.col("position") <= skip + take)).otherwise(F.col("position") <= lone)
    sample = sized.where(inside)
    hits = [F.sum(F.col(url).rlike(p).cast("int")).alias(f"h{k}") for k, (p, _) in enumerate(patterns)]
    counts = sample.groupBy(site).agg(F.first("__n").alias("total"), F.count(F.lit(1)).alias("n"), *hits)
    rows = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(p).alias("pattern"), F.lit(t).alias("least_ratio"), F.col(f"h{k}").alias("hits")) for k, (p, t) in enumerate(patterns)])
    return counts.select(site, "total", "n", F.inline(rows)).withColumn("ratio", F.col("hits") / F.col("n"))


def pick_first(links: DataFrame, site: str = "site", url: str = "url") -> DataFrame:
    """The first pattern that reaches its ratio; sites of fewer than 10 links have none."""
    scores = pattern_scores(links, FIRST_PATTERNS, site, url)
    return scores.where("total >= 10 AND ratio >= least_ratio").groupBy(site).agg(F.min_by("pattern", "ord").alias("pattern"), F.min("ord").alias("ord"))


def pick_best(links: DataFrame, site: str = "site", url: str = "url") -> DataFrame:
    """The pattern with the highest ratio among those that reach theirs; the earlier one on a tie."""
    scores = pattern_scores(links, BEST_PATTERNS, site, url, skip=20, take=100, least=20, lone=20)
    return scores.where("ratio >= least_ratio").groupBy(site).agg(F.max_by("pattern", F.struct("ratio", -F.col("ord"))).alias("pattern"), F.max("ratio").alias("ratio"))


def template(url: Column) -> Column:
    """Path with each segment that has a run of three digits as ``<NUM>``."""
    return F.array_join(F.transform(urls.segments(url), lambda s: F.when(s.rlike(r"\d{3,}"), F.lit("<NUM>")).otherwise(s)), "/")


#: Buckets of a site's sketch.
BUCKETS = 1024


def heavy(rows: DataFrame, totals: DataFrame, value: str, share: float, site: str = "site", buckets: int = BUCKETS) -> DataFrame:
    """``site, value, n``: the values that at least two of a site's rows have, and ``share`` of its ``__total``; sites below three have none.

    Two passes, neither of which shuffles what can't be kept. The first counts
    by a hash bucket of the value, at most ``buckets`` rows a site and task: a
    value is no more frequent than its bucket, so few buckets can hold one that
    is kept. The second counts the values of those buckets exactly.
    """
    enough = F.col("n") >= F.greatest(F.lit(2), F.col("__total") * share)
    dealt = rows.select(site, value).withColumn("__b", F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int"))
    known = totals.where("__total >= 3")
    sketch = dealt.groupBy(site, "__b").agg(F.count(F.lit(1)).alias("n")).join(known, site).where(enough).select(site, "__b", "__total")
    counts = join_few(dealt, sketch, [site, "__b"]).groupBy(site, value).agg(F.count(F.lit(1)).alias("n"), F.first("__total").alias("__total"))
    return counts.where(enough).select(site, value, "n")


def learn_templates(links: DataFrame, url: str = "url", share: float = 0.2, site: str = "site") -> DataFrame:
    """``site, template, n``: templates of at least two links and ``share`` of a site's; sites of fewer than three links have none."""
    rows = links.select(site, template(F.col(url)).alias("template"))
    return heavy(rows, site_counts(links, site, "__total"), "template", share, site)


def learn_segments(links: DataFrame, url: str = "url", share: float = 0.3, most: int = 5, site: str = "site") -> DataFrame:
    """``site, segment, n``: of a site's ``most`` most frequent segments that are no number, those of at least two links and ``share`` of all."""
    rows = links.select(site, F.explode(urls.segments(F.col(url))).alias("segment")).where(~F.col("segment").rlike(r"^\d+$"))
    # the ones with a share of all come before the others, so few are ranked
    kept = heavy(rows, site_counts(links, site, "__total"), "segment", share, site)
    rank = F.row_number().over(Window.partitionBy(site).orderBy(F.desc("n"), "segment"))
    return kept.withColumn("__r", rank).where(F.col("__r") <= most).select(site, "segment", "n")


def learn_prefixes(links: DataFrame, url: str = "url", share: float = 0.2, site: str = "site", most_levels: int | None = None) -> DataFrame:
    """``site, level, prefix, n``: the trie of a site's path templates down to the prefixes that ``share`` of its links have.

    Level by level: only links below a kept prefix are counted at the next
    level, so each shuffle is bounded by what is kept. Ends with the deepest
    kept prefix; ``most_levels`` ends it earlier.
    """
    totals = cut(site_counts(links, site, "__total"))
    parts = F.filter(F.split(template(F.col(url)), "/"), lambda s: s != "")
    rows = links.select(site, parts.alias("__parts"))
    found, level = None, 1
    while True:
        at = rows.where(F.size("__parts") >= level).select(site, "__parts", F.array_join(F.slice("__parts", 1, level), "/").alias("prefix"))
        kept = cut(heavy(at, totals, "prefix", share, site).select(site, F.lit(level).alias("level"), "prefix", "n"))
        found = kept if found is None else found.union(kept)
        if level == most_levels or not kept.head(1):
            return found
        rows = join_few(at, kept.select(site, "prefix"), [site, "prefix"], "left_semi").select(site, "__parts")
        level += 1


def apply_templates(links: DataFrame, templates: DataFrame, segments: DataFrame, url: str = "url", site: str = "site") -> DataFrame:
    """``links`` with ``matches``: a template learned for the site, or a path that contains one of its learned segments."""
    known = templates.groupBy(site).agg(F.collect_set("template").alias("__known"))
    learned = known.join(segments.groupBy(site).agg(F.collect_list("segment").alias("__kept")), site, "full_outer")
    # a site has at most a few templates and segments, each with a share of its links
    rows = join_few(links, learned, [site], "left")
    hit = F.coalesce(F.array_contains("__known", template(F.col(url))), F.lit(False)) | F.coalesce(F.exists("__kept", lambda s: urls.path(F.col(url)).contains(s)), F.lit(False))
    return rows.select(*links.columns, hit.alias("matches"))


def depth_bucket(url: Column) -> Column:
    """0 for two path segments, 1 for more, 2 for one, 3 for the rest; each URL is in one bucket."""
    n = urls.slash_count(url)
    return F.when(n == 4, 0).when(n >= 5, 1).when(n == 3, 2).otherwise(3)


def adaptive_validation(links: DataFrame, site: str = "site") -> DataFrame:
    """``links(site, position, valid, pattern_hit)`` with ``accepted``.

    Validate 20. With 10 valid and a pattern, apply the pattern to the rest.
    Else validate 30 more: from 80 % valid on accept the rest; from 50 % on
    validate 100 more and accept the rest from 70 % on; else validate to 500.
    """
    upto = lambda n: F.sum(F.when(F.col("position") <= n, F.col("valid").cast("int")).otherwise(0))
    seen = lambda n: F.least(F.count(F.lit(1)), F.lit(n))
    stats = links.groupBy(site).agg(
        upto(20).alias("__v20"), upto(50).alias("__v50"), upto(150).alias("__v150"), seen(50).alias("__n50"), seen(150).alias("__n150"), (F.count("pattern_hit") > 0).alias("__pattern")
    )
    s = join_few(links, stats, [site])
    by_pattern = (F.col("__v20") >= 10) & F.col("__pattern")
    rate50, rate150 = F.col("__v50") / F.col("__n50"), F.col("__v150") / F.col("__n150")
    mode = F.when(by_pattern, "pattern").when(rate50 >= 0.8, "accept_50").when((rate50 >= 0.5) & (rate150 >= 0.7), "accept_150").when(rate50 >= 0.5, "check_150").otherwise("check_500")
    s = s.withColumn("mode", mode)
    checked = F.when(F.col("mode") == "pattern", 20).when(F.col("mode") == "accept_50", 50).when(F.col("mode").isin("accept_150"), 150).otherwise(500)
    rest = F.when(F.col("mode") == "pattern", F.coalesce(F.col("pattern_hit"), F.lit(False))).when(F.col("mode").startswith("accept"), True).otherwise(False)
    return s.withColumn("accepted", F.when(F.col("position") <= checked, F.col("valid")).otherwise(rest)).drop("__v20", "__v50", "__v150", "__n50", "__n150", "__pattern")


def plan_discovery(links: DataFrame, categories: DataFrame, most: int = 500, site: str = "site", url: str = "url") -> DataFrame:
    """``links`` a plan keeps, with ``plan``: ``pattern``, ``deep``, ``all``, ``categories`` or ``fallback``.

    A sitemap of 1 to 4,999 links goes by its pattern, else by depth; a larger
    or missing one by categories (rows without links), else by depth up to ``most``.
    """
    picked = pick_first(links, site, url).select(site, F.col("ord").alias("__o"))
    has = categories.select(site).distinct().withColumn("__has", F.lit(True))
    deep = urls.slash_count(F.col(url)) >= 4
    stats = links.groupBy(site).agg(F.count(F.lit(1)).alias("__n"), F.max(deep).alias("__deep"))
    good = F.col("__n") < 5000
    plan = (
        F.when(good & F.col("__o").isNotNull(), "pattern").when(good & F.col("__deep"), "deep").when(good, "all").when(F.col("__has"), "categories").otherwise("fallback")
    )
    plans = stats.join(picked, site, "left").join(has, site, "left").select(site, "__o", plan.alias("plan"))
    hit = F.lit(False)
    for k, (p, _) in enumerate(FIRST_PATTERNS):
        hit = F.when(F.col("__o") == k, F.col(url).rlike(p)).otherwise(hit)
    rows = join_few(links, plans, [site])
    keep = F.when(F.col("plan") == "pattern", hit).when(F.col("plan") == "deep", deep).otherwise(F.col("plan") == "all")
    columns = [*links.columns, "plan"]
    # the rank is only worked out where it is asked for
    rank = F.row_number().over(Window.partitionBy(site).orderBy("position"))
    fallback = rows.where((F.col("plan") == "fallback") & deep).withColumn("__rank", rank).where(F.col("__rank") <= most)
    return rows.where(keep).select(*columns).union(fallback.select(*columns))


def hash_sample(links: DataFrame, url: str = "url", seed: int = 7, extra: int = 0) -> DataFrame:
    """A deterministic sample: 1 % of the links, 5 at least and 10 at most, by the MD5 of seed and URL; ``extra`` more where the first were too few.

    Null URLs come last; repeated rows count each.
    """
    total = links.agg(F.count(F.lit(1)).alias("__total"))
    by_hash = links.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(url)).cast("binary"))).orderBy(F.col("__h").asc_nulls_last(), url).limit(10 + extra)
    ranked = by_hash.withColumn("__r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("__h").asc_nulls_last(), url)))
    return ranked.join(F.broadcast(total)).where(f"__r <= least(10, greatest(5, cast(__total * 0.01 AS int))) + {int(extra)}").drop("__h", "__r", "__total")
