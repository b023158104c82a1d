"""Treap search against plain scoring of all documents."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from catloom.llm.treap_search import OP12_SQL, PATTERN, Search, search, treaps

SMALL = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(PATTERN, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    counted = [(r.doc_id, Counter(terms(r.text))) for r in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for r in items:
        own = set(terms(r.text)) & set(df)
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own}
        scored = []
        for i, c, n in counted:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        for rank, (s, known, i) in enumerate(sorted(scored)[:k], 1):
            out.append((r.item_id, rank, i if known else None, -s))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet").cache()


@pytest.mark.parametrize("size,block", [(8 << 20, 1000), (20_000, 7)])
def test_best_documents(docs, items, size, block):
    assert rows(search(docs, items, size=size, block=block)) == plain(docs.collect(), items.collect())


def test_defined_cases(spark, odd, none, items):
    ask = [(1, "one two THREE three"), (1, "one two THREE three"), (2, None), (3, ""), (4, "!!"), (5, "alpha end"), (None, "漢字 ümlaut ümlaut é"), (6, "no such words qqq")]
    asked = spark.createDataFrame(ask, "item_id long, text string")
    for size in (8 << 20, 1):
        assert rows(search(odd, asked, size=size)) == plain(odd.select("doc_id", "text").collect(), asked.collect())
    assert search(none, asked).count() == 0 and search(odd, asked.limit(0)).count() == 0


def test_ties_of_many_copies_go_by_id(spark):
    made = [(i * 7 % 500, "same words here" if i % 3 else f"same other {i}") for i in range(500)]
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "same words"), (2, "here other 9")], "item_id long, text string")
    for size in (8 << 20, 700):
        assert rows(search(frame, asked, size=size)) == plain(frame.collect(), asked.collect())


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 400, 0, 3, 1000, 2])
    docs = np.concatenate([np.sort(rng.choice(5000, n, replace=False)) for n in sizes])
    impacts = rng.integers(1, 12, len(docs)) * 1000
    left, right = treaps(sizes, docs, impacts)
    children = [*left[left >= 0], *right[right >= 0]]
    assert len(set(children)) == len(children) == sizes.sum() - np.count_nonzero(sizes)
    depth = 0
    for root in set(range(len(docs))) - set(children):
        seen, stack = [], [(root, 1)]
        while stack:
            at, d = stack.pop()
            seen.append(at)
            depth = max(depth, d)
            for c, sign in ((left[at], -1), (right[at], 1)):
                if c >= 0:
                    assert impacts[c] <= impacts[at] and (docs[c] - docs[at]) * sign > 0
                    stack.append((c, d + 1))
        assert sorted(seen) == list(range(min(seen), max(seen) + 1))
    assert depth < 40  # equal impacts don't make a list


def test_search_prunes():
    """The rare heavy term's documents are found without scoring most of the common one's."""
    n = 4000
    docs = np.concatenate([np.arange(n), [17, 900, 3000]])
    impacts = np.concatenate([np.full(n, 10), [900, 900, 900]])
    sizes = np.array([n, 3])
    left, right = treaps(sizes, docs, impacts)
    found = Search(["common", "rare"], [[(0, 1), (1, 100)]], 3)
    scored = []
    real = found.enter
    found.enter = lambda q, score, ids: scored.extend(ids) or real(q, score, ids)
    found.segment(np.arange(n), ["common", "rare"], sizes, *(x.astype(np.int32) for x in (docs, impacts, left, right)))
    assert found.ids[0].tolist() == [17, 900, 3000] and found.scores[0].tolist() == [90010] * 3
    assert len(scored) < n / 10


def test_sql_says_the_same(docs, items):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({OP12_SQL})").fetchall()
    assert sorted(map(tuple, got), key=str) == plain(docs.collect(), items.collect())


def test_row_groups_end_by_size_whatever_the_number_of_rows(spark):
    """A task's segments are not one row group: it would be held, and read back, whole."""
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from catloom.llm.common import stash

    rows = spark.range(40).coalesce(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda x: F.xxhash64(x, "id")).alias("v"))
    kept = stash(rows, "groups", "zstd", {"parquet.block.size": str(2 << 20)})
    assert kept.agg(F.count("v"), F.sum(F.size("v"))).first() == (40, 2_000_000)
    (file,) = glob.glob(kept._catloom_path.removeprefix("file://") + "/*.parquet")
    found = pq.ParquetFile(file).metadata
    groups = [found.row_group(i) for i in range(found.num_row_groups)]
    assert len(groups) > 3 and all(g.total_byte_size < 8 << 20 for g in groups)


def test_terms_are_counted_by_bytes_in_arrow(spark, odd):
    """The count of terms in advance: half the query's time went to a pattern that walked each text by characters."""
    from pyspark.sql import functions as F

    from catloom.llm.treap_search import corpus_size

    made = [None, "", " ", "a", "b", "a b", " c", "d ", "-", "é", "é-漢字 \U0001f600", "A1_b2", "\x7f\x80", "x" * 70_000 + " y", "~z"] * 90
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string").coalesce(1)
    for docs in (frame, frame.limit(0), frame.where("text IS NULL"), odd.select("doc_id", "text")):
        counts = [len(terms(r.text)) for r in docs.collect()]
        assert corpus_size(docs) == (sum(n > 0 for n in counts), sum(counts))
    plans = []
    real = type(frame).first
    try:
        type(frame).first = lambda self: plans.append(self._jdf.queryExecution().toString()) or real(self)
        corpus_size(frame.select(F.col("text"), F.lit(1).alias("more")))
    finally:
        type(frame).first = real
    assert "MapInArrow" in plans[0] and "regexp" not in plans[0].lower()
