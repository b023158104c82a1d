"""Exact dedup and hash-tree sharding against plain Python."""

import hashlib
import string
import zlib
from collections import defaultdict

import math
import xxhash

from catloom.llm.exact_dedup import exact_dedup, exact_groups
from catloom.llm.hash_tree import Tree, assign_shards, place

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def norm(t):
    return (t or "").translate(LOWER)


def brute_groups(rows, pick):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    out = []
    for r in rows:
        own = groups[norm(r.text)]
        known = [i for i in own if i is not None]
        keep = (pick(known) if known else None) if len(own) > 1 else r.doc_id
        out.append((r.doc_id, keep, len(own), keep == r.doc_id, hashlib.sha256(norm(r.text).encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups(docs, odd, none):
    for frame in (docs, odd, none):
        rows = frame.select("doc_id", "text").collect()
        for keep, pick in (("min", min), ("max", max)):
            got = [tuple(r) for r in exact_groups(frame, keep=keep).collect()]
            assert sorted(got, key=str) == brute_groups(rows, pick)


def test_rows_that_stay_keep_their_columns(odd, docs):
    kept = exact_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 5, 6, 7, 8, 9]
    texts = [norm(r.text) for r in exact_dedup(docs).collect()]
    assert len(texts) == len(set(texts)) == len({norm(r.text) for r in docs.collect()})


def draw(key, level, number, weight):
    h = 42
    for raw in ([key.to_bytes(8, "little", signed=True)] if key is not None else []) + [x.to_bytes(4, "little") for x in (level, number)]:
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return -math.log(((h >> 12) + 0.5) / (1 << 52)) / weight


def descend(key, regions):
    """Region, rack and shard of a key in a tree of nested weights."""
    racks, shards, path = {}, {}, {}
    for r, own in enumerate(regions):
        for rack in own:
            k = len(path)
            path[k] = r
            racks.setdefault(r, {})[k] = sum(rack)
            at = sum(map(len, shards.values()))
            shards[k] = {at + i: w for i, w in enumerate(rack)}

    def least(level, children):
        return min(children, key=lambda n: (draw(key, level, n, children[n]), n))

    region = least(1, {r: sum(own.values()) for r, own in racks.items()})
    rack = least(2, racks[region])
    return region, rack, least(3, shards[rack])


EQUAL = (((1.0,) * 4,) * 3,) * 2


def test_shards_follow_the_tree(docs, odd, none):
    for frame in (docs, odd, none):
        rows = assign_shards(frame).collect()
        assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == sorted(
            (r.doc_id or -1, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in frame.select("doc_id", "text").collect()
        )
        slots = defaultdict(list)
        for r in rows:
            assert r.law == "key" and r.shard == descend(r.doc_id, EQUAL)[2] and r.grown_shard == descend(r.doc_id, (*EQUAL, ((1.0,),)))[2]
            assert r.grown_shard in (r.shard, 24)
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


KEYS = 20000


def placed(spark, tree):
    keys = spark.range(KEYS).withColumnRenamed("id", "k")
    return {r.k: r.s for r in place(keys, "k", tree, "s", ["k"]).collect()}


def test_weights_move_rows_only_where_they_change(spark):
    before, heavier = Tree.of((1.0,) * 24), Tree.of((*[1.0] * 5, 3.0, *[1.0] * 18))
    old, new = placed(spark, before), placed(spark, heavier)
    assert all(new[k] == descend(k, heavier.regions)[2] for k in range(0, KEYS, 97))
    moved = {k for k in old if old[k] != new[k]}
    # shard 5 is in rack 1 of region 0: keys that were there already go to its rack or to the shard itself
    assert moved and all(new[k] < 12 for k in moved)
    assert all(4 <= new[k] < 8 for k in moved if old[k] < 12) and all(new[k] == 5 for k in moved if 4 <= old[k] < 8)
    shares = [sum(s == n for s in new.values()) / KEYS for n in range(24)]
    assert all(abs(share - w / 26) < 0.01 for share, w in zip(shares, (*[1.0] * 5, 3.0, *[1.0] * 18), strict=True))
    lighter = placed(spark, Tree.of((*[1.0] * 5, 0.25, *[1.0] * 18)))
    assert all(old[k] == lighter[k] for k in old if old[k] >= 12) and any(lighter[k] >= 12 for k in old if old[k] < 12)


def test_growth_takes_rows_only_into_the_new_shard(spark):
    tree = Tree.of([1.0, 2.0, 0.5, 4.0, 1.5, 1.0, 3.0], shards_per_rack=2, racks_per_region=2)
    old, new = placed(spark, tree), placed(spark, tree.grown(2.0))
    assert all(new[k] in (old[k], 7) for k in old)
    assert abs(sum(s == 7 for s in new.values()) / KEYS - 2 / 15) < 0.01


def test_the_descent_is_not_one_draw_of_all_shards(spark):
    flat = {k: min(range(24), key=lambda s: draw(k, 3, s, 1.0)) for k in range(2000)}
    got = placed(spark, Tree.of((1.0,) * 24))
    assert sum(got[k] != flat[k] for k in flat) > 1500


def test_a_third_of_all_rows_in_one_group(spark):
    """The hot group's rows stay where they are or are dealt evenly, with adaptive skew splitting off."""
    rows = [(i, "Hot text") for i in range(3000)] + [(3000 + i, f"text {i // 2}") for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = exact_groups(frame, keep="max")
        parts = [n for n in found.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {i: (2999, 3000, i == 2999) if i < 3000 else (3001 + (i - 3000) // 2 * 2, 2, i % 2 == 1) for i, _ in rows}
    assert max(parts) < 2 * sorted(parts)[len(parts) // 2]
