"""A frontier over several runs against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from catloom.operators import frontier


def plain(edges, seeds):
    seen, todo = set(seeds), list(seeds)
    while todo:
        at = todo.pop()
        for s, d in edges:
            if s == at and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


def test_runs_go_on_where_the_last_ended(spark, tmp_path):
    rng = random.Random(5)
    state = frontier.Frontier(spark, f"file://{tmp_path}/state", bits=1 << 16)
    edges, seeds, before = [], set(), set()
    for run in range(3):
        new = [(rng.randrange(120), rng.randrange(120)) for _ in range(60)]
        more = {rng.randrange(120)} if run != 1 else set()
        edges, seeds = edges + new, seeds | more
        got = state.advance(spark.createDataFrame(new * 2 + [(None, 1), (1, None)], "src long, dst long"), spark.createDataFrame([(n,) for n in more], "node long"))
        want = plain(edges, seeds)
        rows = state.visited().collect()
        assert len(rows) == len(want) and {r.node for r in rows} == want and got == len(want - before)
        assert {r.node for r in rows if r.run == run} == want - before
        before = want
        assert {(r.src, r.dst) for r in state.waiting().collect()} == {(s, d) for s, d in edges if s not in want}
    assert state.advance(spark.createDataFrame([], "src long, dst long")) == 0 and state.runs() == 4


def test_a_run_that_died_is_begun_anew(spark, tmp_path, monkeypatch):
    state = frontier.Frontier(spark, f"file://{tmp_path}/state", bits=1 << 16)
    edges = spark.createDataFrame([(k, k + 1) for k in range(5)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    real, calls = state._stash, []

    def dying(df, path):
        calls.append(path)
        if path.endswith("round=3"):
            raise RuntimeError("killed")
        return real(df, path)

    monkeypatch.setattr(state, "_stash", dying)
    with pytest.raises(RuntimeError):
        state.advance(edges, seeds)
    assert state.runs() == 0 and state.visited().count() == 0
    monkeypatch.setattr(state, "_stash", real)
    assert state.advance(edges, seeds) == 6 and sorted(r.node for r in state.visited().collect()) == list(range(6))


def test_a_filter_leaves_out_no_member(spark):
    rows = spark.range(20_000).withColumn("t", F.concat(F.lit("https://a.example/"), F.col("id").cast("string")))
    sieve = frontier.bloom(rows.where("id % 10 = 0"), "t", 1 << 18)
    assert sieve.count() <= (1 << 18) // frontier.ROW
    passed = {r.id for r in frontier.maybe_in(rows, "t", sieve, 1 << 18).collect()}
    assert passed >= set(range(0, 20_000, 10)) and len(passed) < 2500
