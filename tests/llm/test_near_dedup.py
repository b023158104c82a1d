"""Bottom-k near-dedup against all pairs of full sets."""

import random
import re
import string
from collections import defaultdict

from catloom.llm.bottomk import near_dedup, near_duplicates

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows):
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, t = sets[j]
            if s and t and a is not None and b is not None and 100 * len(s & t) >= 75 * len(s | t):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (a, _) in enumerate(sets):
        least[find(i)].append(a)
    out = []
    for i, (a, s) in enumerate(sets):
        c = a if a is None else min(least[find(i)])
        out.append((a, len(s), c, a == c))
    return sorted(out, key=str)


def check(frame):
    got = sorted((tuple(r) for r in near_duplicates(frame).collect()), key=str)
    assert got == brute(frame.select("doc_id", "text").collect())
    return got


def test_documents(docs):
    got = check(docs)
    assert any(not kept for *_, kept in got)


def test_chains_groups_and_common_passages(spark):
    draw = random.Random(3)

    def words(n):
        return ["".join(draw.choices("abcdefgh", k=5)) for _ in range(n)]

    rows, common = [], words(60)
    for _ in range(30):
        rows.append(common + words(40))
    seed = words(200)
    for _ in range(60):
        other = list(seed)
        other[draw.randrange(200)] = "changed"
        rows.append(other)
    link = words(133)
    rows += [link, link[:100], link[:76], link[:57], link[:43]]
    for n in range(1, 9):
        rows += [words(n), ["a"] * n, ["A"] * n]
    for _ in range(40):
        one = words(draw.randrange(20, 150))
        cut = draw.randrange(2, 12)
        rows += [one, one[cut:], one[: len(one) - cut] + words(cut)]
    order = list(range(len(rows)))
    draw.shuffle(order)
    frame = spark.createDataFrame([(i, "\t ".join(rows[k])) for i, k in enumerate(order)], "doc_id long, text string")
    check(frame)


def test_odd_rows(odd, none):
    check(odd.dropDuplicates(["doc_id", "text"]))
    assert near_duplicates(none).count() == 0
    kept = near_dedup(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 5, 6, 8, 9}


def test_a_common_passage_makes_no_candidates(spark):
    from pyspark.sql import functions as F

    from catloom.llm import bottomk

    # every document has the same 60 words and 40 of its own: no links, and no pairs to compare
    draw = random.Random(9)
    common = " ".join("".join(draw.choices("abcdefgh", k=6)) for _ in range(60))
    own = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("x"), k.cast("string"))), " ")
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(common + " "), own).alias("text"))
    rows = near_duplicates(frame).agg(F.count_if("kept").alias("kept"), F.min("n_shingles").alias("n")).first()
    assert rows.kept == 20_000 and rows.n == 96
    need = spark.range(1).select(bottomk.least_overlap(F.lit(96), 128, (75, 100)).alias("a"), bottomk.least_overlap(F.lit(5000), 128, (75, 100)).alias("b")).first()
    assert (need.a, need.b) == (72, 73)


def test_long_lists_are_joined_by_blocks(spark, monkeypatch):
    from catloom.llm import bottomk

    monkeypatch.setattr(bottomk, "LIST_BLOCK", 3)
    monkeypatch.setattr(bottomk, "FEW", 2)
    monkeypatch.setattr(bottomk, "STARS", 1)
    draw = random.Random(4)
    seed = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(120)]
    rows = []
    for k in range(40):
        other = list(seed)
        for _ in range(k % 4):
            other[draw.randrange(120)] = f"changed{k}"
        rows.append((k, " ".join(other[k % 7 :])))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_documents_that_share_most_without_linking(spark):
    """A passage of 70 % in every document: all meet in a few lists, few link, and the comparison is by blocks of matrices."""
    import time

    draw = random.Random(8)
    common = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(150)]
    rows = []
    for k in range(1500):
        own = [f"w{k if k % 50 else k + 1}x{j}" for j in range(60)]
        rows.append((k, " ".join(common + own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    got = {r.doc_id: r.component_id for r in near_duplicates(frame).collect()}
    assert got == {k: k - 1 if k % 50 == 1 else k for k, _ in rows}
    assert time.time() - began < 300


def test_matrices_count_common_values():
    import numpy as np

    from catloom.llm import bottomk

    rng = np.random.default_rng(3)
    lists = [np.unique(rng.integers(0, 4000, rng.integers(0, 900))) for _ in range(40)] + [np.zeros(0, dtype=np.int64)]
    got = bottomk._common(lists[:25], lists[20:])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in lists[20:]] for x in lists[:25]]


def test_components_with_hubs(spark):
    from catloom.llm.common import components

    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(7, 7), (None, 8)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(3000)) and all(got[5000 + i] == 5000 for i in range(41)) and len(got) == 3041
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_members_of_a_group_meet_few_leaders(spark):
    """A group that shares all its lists gives a member as many links as there are draws, whatever the number of lists."""
    from pyspark.sql import functions as F

    from catloom.llm import bottomk

    node = F.struct(F.col("id").alias("rep"), F.lit(0).cast("long").alias("k1"))
    rows = spark.range(400).select(node.alias("node"), F.lit(100).alias("n"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(120).cast("long"))).alias("v"))
    placed = bottomk._placed(rows, None)
    assert placed.count() == 400 * 120 and placed.agg(F.min("members")).first()[0] == 400
    assert 399 <= bottomk._stars(placed, 0, (75, 100)).count() <= 400 * bottomk.DRAWS
    # what is used several times over is read from files
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()


def test_components_write_a_file_for_each_core(spark):
    """Whatever the number of shuffle partitions: each file costs a process where Hadoop's native library is missing."""
    from catloom.llm.common import components

    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = components(spark.range(400).selectExpr("id AS u", "id - id % 4 AS v"))
        assert {(r["node"], r["component"]) for r in found.collect()} == {(i, i - i % 4) for i in range(400)}
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
