"""Embedding near-dedup against all cosines."""

import numpy as np

from catloom.llm.embed_graph import near_vectors, robust_graph, range_search, padded


def brute(ids, x, least=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return {i: (int(n), int(c), i == c) for i, n, c in zip(ids, near.sum(axis=1), label, strict=True)}


def made(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 32))
    for k in range(0, n // 3, 5):
        x[k + 1 : k + 4] = x[k] + 0.1 * rng.normal(size=(3, 32))
    x[n // 2 : n // 2 + n // 5] = x[n // 2] + 0.05 * rng.normal(size=(n // 5, 32))
    x[-20:] = x[-21]
    return x


def test_matches_brute_force(spark):
    x = made(1500, 1)
    ids = list(range(1, 3000, 2))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(frame).collect()}
    want = brute(ids, x)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert sum(got[i][1] == want[i][1] for i in ids) >= 0.99 * len(ids)


def test_blocks_and_overlap_count_each_link_once(spark, monkeypatch):
    from catloom.llm import embed_graph

    for name, value in (("SHARD_ROWS", 64), ("BLOCK_ROWS", 100), ("CELLS_PER_REGION", 2)):
        monkeypatch.setattr(embed_graph, name, value)
    x = made(900, 2)
    ids = list(range(900))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(frame).collect()}
    want = brute(ids, x.astype(np.float32).astype(np.float64))
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (10, [2.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (11, [1e200, 1e-200])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n_links string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in near_vectors(frame).collect())
    assert got == [(0, 0, None), (1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 1, 9), (10, 1, 9), (11, 3, 1)]
    assert near_vectors(frame.limit(0)).count() == 0


def test_graph_search_reaches_far_groups():
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.03 * rng.normal(size=(30, 24)) for c in rng.normal(size=(20, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = range_search(x, padded(robust_graph(x)), np.array([0]), np.arange(len(x)), 0.9, 16)
    assert hit.sum() >= 0.99 * (x @ x.T >= 0.9).sum()


def test_many_blocks_lose_no_links(spark, monkeypatch):
    from catloom.llm import embed_graph

    monkeypatch.setattr(embed_graph, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(3)
    # distinct near copies along a ring: each links with some neighbours only, so few edges survive a block pair
    angle = np.linspace(0, 2 * np.pi, 600, endpoint=False)
    x = np.concatenate([np.stack([np.cos(angle), np.sin(angle)], axis=1), 0.01 * rng.normal(size=(600, 14))], axis=1)
    x = np.concatenate([x, rng.normal(size=(200, 16))])
    # no id is divisible by 100, so no audit widens the search
    ids = [100 * k + 1 for k in range(len(x))]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(frame, least=0.995).collect()}
    want = brute(ids, x, 0.995)
    assert sum(got[i][0] for i in ids) >= 0.99 * sum(w[0] for w in want.values())
    assert sum(got[i][1] == want[i][1] for i in ids) >= 0.99 * len(ids)


def test_failed_retries_end_exactly(spark, monkeypatch):
    from catloom.llm import embed_graph

    for name, value in (("SHARD_ROWS", 8), ("CELLS_PER_REGION", 1)):
        monkeypatch.setattr(embed_graph, name, value)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(800, 16))
    x[:400] = x[0] + 0.02 * rng.normal(size=(400, 16))
    x[401:800:2] = x[400:800:2] + 0.42 * rng.normal(size=(200, 16))
    ids = [100 * k for k in range(len(x))]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    rows = near_vectors(frame, overlap=1, beam=1).collect()
    got, want = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}, brute(ids, x)
    small = [i for i in ids[400:] if want[i][0]]
    assert len(small) > 100
    assert np.mean([got[i][0] / want[i][0] for i in small]) >= 0.99
    assert rows[0].audit_recall >= 0.99


def test_exact_search_finds_every_link(spark, monkeypatch):
    from pyspark.sql import functions as F

    from catloom.llm import embed_graph

    for name, value in (("SHARD_ROWS", 32), ("BLOCK_ROWS", 50), ("CELLS_PER_REGION", 2)):
        monkeypatch.setattr(embed_graph, name, value)
    x = made(700, 4)[:-20]
    frame = spark.createDataFrame([(i, i * 7, 1, v.tolist()) for i, v in enumerate(x)], "rep long, h long, m long, v array<double>")
    found = embed_graph._exact(frame, len(x), embed_graph.unit_rows(frame.toArrow().column("v")), 0.9)
    got = {r.rep: r.n for r in found.groupBy("rep").agg(F.sum("links").alias("n")).collect()}
    assert got == {i: w[0] for i, w in brute(list(range(len(x))), x).items()}


def test_a_hot_group_does_not_hide_small_ones(spark):
    from catloom.llm.embed_graph import recalls_of

    kind = "links long, t long, near long, tn long"
    # 99 queries of a hot group with all links, one query with neither of its two
    mean, n, worst = recalls_of(spark.createDataFrame([(1000, 1000, 1000, 1000)] * 99 + [(0, 2, 0, 2)] + [(0, 0, 0, 0)] * 5, kind))
    assert worst == 0 and mean == 0.99 and n == 100
    # a million found copies do not hide nine missed vectors
    assert recalls_of(spark.createDataFrame([(1_000_000, 1_000_009, 1, 10)], kind))[2] == 0.1


def test_recall_is_null_where_nothing_was_asked(spark):
    frame = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1, 9)], "vec_id long, embedding array<double>")
    assert {r.audit_recall for r in near_vectors(frame).collect()} == {None}


def test_copies_are_asked(spark):
    from catloom.llm import embed_graph

    # 100 is a copy of 7, the representative of its class
    nodes = [(7, 1, 2, [1.0, 0.0], True), (8, 2, 1, [1.0, 0.1], False)]
    truth = embed_graph._truth(spark.createDataFrame(nodes, "rep long, h long, m long, v array<double>, asked boolean"), 0.9)
    assert [tuple(r) for r in truth.collect()] == [(7, 1, 1, 1)]
