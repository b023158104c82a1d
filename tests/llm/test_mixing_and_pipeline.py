"""Pfair mixing against the slot-by-slot rule; the pipeline against its parts."""

from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from catloom.llm import langid
from catloom.llm.byte_bpe import read_ranks
from catloom.llm.mixing import mix_rows, mixed, quanta, schedule


def test_less_than_one_block_off():
    for weights in ({"a": 1.0, "b": 2.0, "c": 7.5}, {f"s{i}": 1.0 / (i + 1) for i in range(40)}, {None: 1.0, "x": 1.0}, {"only": 3.0}):
        shares = quanta(weights, 512)
        assert sum(shares.values()) == 512 and min(shares.values()) >= 1
        got = Counter()
        for slot, (s, k, at, release, due, q) in enumerate(schedule(shares)):
            got[s] += 1
            assert at == slot and k == got[s] and release <= slot < due and q == shares[s]
            assert all(abs(got[x] - shares[x] * (slot + 1) / 512) < 1 for x in shares)


def brute(counts, weights, block, period):
    """Positions of each source's ranks by going through the slots."""
    shares = quanta(weights, period)
    done, order = Counter(), []
    one = [s for s, *_ in schedule(shares)]
    while any(done[s] < n for s, n in counts.items()):
        for s in one:
            take = min(block, max(0, counts[s] - done[s]))
            order += [(s, done[s] + i) for i in range(take)]
            done[s] += take
    return order


def test_positions(docs, odd, none):
    for frame in (docs, odd, none):
        weights = {"src0": 5.0, "a": 2.0, None: 1.0}
        rows = mixed(frame, weights=weights, block=3, period=64).collect()
        assert sorted(r["__position"] for r in rows) == list(range(frame.count()))
        if not rows:
            continue
        counts = Counter(r["__source"] for r in rows)
        want = brute(counts, {s: weights.get(s, 0.0) for s in counts}, 3, 64)
        rows.sort(key=lambda r: r["__position"])
        assert [r["__source"] for r in rows] == [s for s, _ in want]
        blocks = defaultdict(set)
        for r in rows:
            blocks[r["__source"]].add(r["__block"])
            assert r["__release"] <= r["__slot"] < r["__deadline"]
        assert all(b == set(range(len(b))) for b in blocks.values())


def test_rows_are_whole_and_in_order(spark, odd, tmp_path):
    out = str(tmp_path / "mixed")
    mix_rows(odd, partitions=3).write.parquet(out)
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, odd.collect()))


def test_pipeline(spark, docs, tmp_path):
    from tests.llm.test_near_dedup import brute as near
    from tests.llm.test_tokens import Tokenizer  # noqa: F401

    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    first = corpus_pipeline.identify_language(spark, docs, sf).collect()
    seen, exact = set(), []
    for r in sorted(first, key=lambda r: r.doc_id):
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
        if key not in seen:
            seen.add(key)
            exact.append(r)
    assert got == {i for i, _, _, kept in near(exact) if kept}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["langid", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]


def test_pipeline_stages_keep_the_columns(spark, odd):
    frame = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "")
        assert frame.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, frame, "").count() == frame.count()


def test_shares_are_the_target_weights(spark):
    rest = 512
    rows = [(i, "big" if i < 500 else f"s{i % (rest - 1)}" if i < 1500 else "none") for i in range(1510)]
    frame = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"big": 0.5, **{f"s{k}": 0.5 / (rest - 1) for k in range(rest - 1)}}
    found = sorted(mixed(frame, weights=weights, block=1).collect(), key=lambda r: r["__position"])
    assert [r["__position"] for r in found] == list(range(1510))
    assert {r["__source"] for r in found[1500:]} == {"none"}
    seen, slots = Counter(), [r["__slot"] for r in found]
    assert slots == sorted(set(slots))
    for r in found[:900]:
        seen[r["__source"]] += 1
        assert r["__release"] <= r["__slot"] < r["__deadline"]
        assert abs(seen["big"] - 0.5 * (r["__slot"] + 1)) < 1
        assert abs(seen[r["__source"]] - weights[r["__source"]] * (r["__slot"] + 1)) < 1


def test_schedule_passes_over_empty_slots():
    """Against a look at every slot; tiny weights beside a source that has run out take no time."""
    import random
    import time

    from catloom.llm.mixing import WHOLE, exact_schedule, fixed

    def slot_by_slot(shares, blocks):
        whole, out, slot = sum(shares.values()), [], 0
        following = {s: 1 for s in shares}
        while sum(following[s] <= blocks[s] for s in shares) > 1:
            free = [(-(-k * whole // shares[s]), s, k) for s, k in following.items() if k <= blocks[s] and (k - 1) * whole // shares[s] <= slot]
            if free:
                due, s, k = min(free)
                out.append((s, k, slot))
                following[s] += 1
            slot += 1
        return out

    rng = random.Random(1)
    for _ in range(40):
        shares = {s: rng.choice([1, 3, 17, 400]) for s in "abcd"[: rng.randint(2, 4)]}
        blocks = {s: rng.randint(0, 12) for s in shares}
        got = exact_schedule(shares, blocks)
        want = slot_by_slot(shares, blocks)
        assert [x[:3] for x in got[: len(want)]] == want and len(got) == sum(blocks.values())
        assert all(release <= slot < due for _, _, slot, release, due in got)
    began = time.time()
    plan = exact_schedule(fixed({"big": 1.0, "x": 1e-9, "y": 1e-9}), {"big": 500, "x": 50, "y": 51})
    assert len(plan) == 601 and plan[-1][2] > WHOLE / 100 and time.time() - began < 1


def test_pipeline_result_has_the_mixed_order(spark, docs, tmp_path):
    import hashlib

    from catloom.llm.mixing import exact_plan

    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    rows = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(rows))) and len(rows) > 64
    known = {r.doc_id: r for r in docs.collect()}
    counts = Counter(known[r.doc_id].source for r in rows)
    plan = exact_plan({s: n**0.7 for s, n in counts.items()}, counts, 64)
    want = [s for s, k, *_ in plan for _ in range(min(64, counts[s] - (k - 1) * 64))]
    assert [known[r.doc_id].source for r in rows] == want
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in rows:
        ids = library.encode_ordinary(known[r.doc_id].text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(known[r.doc_id].text.encode()).hexdigest()


def test_first_stage_keeps_what_the_model_knows(docs):
    model = langid.fit(docs)
    want = set()
    for r in docs.collect():
        lang, score = model.scored([r.text])
        if r.text and any(c.isalpha() for c in r.text) and lang != ["und"] and score[0] >= 0.5:
            want.add(r.doc_id)
    assert {r.doc_id for r in corpus_pipeline.identify_language(docs.sparkSession, docs, "").collect()} == want


def test_many_sources(spark):
    rows = [(i, f"s{i % 3000}") for i in range(9000)]
    found = mixed(spark.createDataFrame(rows, "doc_id long, source string"), block=1).collect()
    assert sorted(r["__position"] for r in found) == list(range(9000)) and len({r["__source"] for r in found}) == 3000


def test_blocks_grow_so_that_the_plan_stays_bounded(spark, monkeypatch):
    from catloom.llm import mixing

    monkeypatch.setattr(mixing, "PLAN_BLOCKS", 10)
    frame = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(1000)], "doc_id long, source string")
    found = mixed(frame, block=1).collect()
    assert sorted(r["__position"] for r in found) == list(range(1000)) and max(r["__block"] for r in found) < 10
    with pytest.raises(ValueError):
        mixed(spark.createDataFrame([(i, str(i)) for i in range(11)], "doc_id long, source string"))


def test_idle_workers_give_memory_back(spark):
    """What a stage's Python workers had is not held through the next stages, which run none."""
    import re
    from pathlib import Path

    import numpy as np

    from catloom.llm import bottomk, byte_bpe, langid
    from catloom.llm.common import give_back, giving_back

    def held():
        return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    def run(batches):
        for batch in batches:
            # freed but for the last piece, which keeps the C library from giving back what lies below it
            pieces = [bytes(60_000) for _ in range(3000)]
            kept.append(pieces[-1])
            del pieces
            before.append(held())
            yield batch

    kept, before = [], []
    give_back()
    least = held()
    assert list(giving_back(run)(iter([1, 2]))) == [1, 2]
    assert before[-1] - least > 100 and held() - least < 50
    # each text is scored by itself, so the length of a slice doesn't matter
    rng = np.random.default_rng(4)
    model = langid.Model(["a", "b"], np.zeros(2), rng.random((2, langid.BUCKETS)).astype(np.float32))
    texts = ["some words here", None, "", "x" * 5000, "ümlaut 漢字"] * 30
    whole, was = model.scored(texts), langid.CHARS
    try:
        langid.CHARS = 50
        short = model.scored(texts)
    finally:
        langid.CHARS = was
    assert was <= 1 << 18 and whole[0] == short[0] and whole[1].tolist() == short[1].tolist()
    # the stages' functions are wrapped where they are handed to Spark
    found = []
    frame = spark.createDataFrame([(i, f"some text number {i} of a few words") for i in range(5)], "doc_id long, text string")
    real = type(frame).mapInArrow
    try:
        type(frame).mapInArrow = lambda self, f, *a, **b: found.append(hasattr(f, "__wrapped__")) or real(self, f, *a, **b)
        byte_bpe.encode(frame).count(), bottomk.near_duplicates(frame).count()
    finally:
        type(frame).mapInArrow = real
    assert len(found) == 5 and all(found)
