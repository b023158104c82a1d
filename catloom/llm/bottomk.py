"""MinHash near-dedup: bottom-k sketches from one hash function.

1. Each document's set of shingle hashes is worked out from its whole text; the
   sketch is the ``k`` smallest hashes (all of a small set). Documents of equal
   sets become one class with the smallest id as representative, so exact
   copies, however many, are one vertex.
2. Inverted lists of retained values: two sets of similarity 0.75 share three
   quarters of the larger set, and of its sketch three quarters less what
   chance takes, ``least_overlap`` (for k = 128 a pair at the very threshold
   falls short of it with a chance of 3e-6; sets that can only link with sets
   within k need no allowance and lose nothing). So of each sketch only the
   ``size - least_overlap + 1`` rarest values need a list (the prefix rule,
   rarest first by the number of sketches that retain a value). Values of
   passages that many documents share are the least rare and drop out.
3. Each list is a star at first: a leader against the others. Leaders are drawn
   by a hash of the member and of one of ``DRAWS`` numbers that the list has, so
   lists with the same members mostly share one: a document of a large group of
   near copies meets about ``DRAWS`` leaders, whatever the number of its lists,
   and the group is joined in a round or two. After ``STARS`` rounds,
   each followed by labels of the least node within three hops, the lists that
   still hold several labels give the pairs of different labels; the join
   itself asks for alike sketches and for the pair's first common list, so it
   makes a row for each candidate and no more. No link is lost: pairs left out
   have one label, and so one component, already.
4. Candidates pass a size filter and the union-sketch estimate (the ``WIDE``
   smallest of both, the share in both, at ``SLACK`` below the threshold or
   more, which a pair at the threshold misses with a chance of 2e-6), and are
   then verified by exact Jaccard on the full sets.

Sets are held as 64-bit hashes; two different shingles of one pair of documents
share a hash with a chance of about 1e-11 even at 20,000 words each.

Defined cases: a null or empty text has an empty set, which links with nothing;
a row without id links with nothing and has a null component; rows that repeat
an id are judged each by its own text; texts of any length count whole; lists
and leaders that tie go by hash and change no component; an empty table gives
an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import components, discard, giving_back, join_by_key, stash
from catloom.llm.shingles import set_keys, shingle_sets
from catloom.shipping import ship_package

K = 128
#: Standard deviations that chance may take from the overlap of two sketches.
DEVIATIONS = 4.6
#: Length of the sketches that the estimate compares, and its slack: 4.8 standard deviations at the threshold.
WIDE = 256
SLACK = 0.13
#: Rounds of stars before the pairs across components, and the different draws of leaders in a round.
STARS = 2
DRAWS = 8
#: Members of a longer list that one task compares with as many others.
LIST_BLOCK = 2048
#: Members of a list that is joined with itself as it is.
FEW = 48
MAX_BATCH_IDS = 1 << 18


def _emit(words: int, k: int, full: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow batches of ``doc_id, t`` to ``doc_id, n, k1, k2, hashes``: the sketch, or the full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = 0, [], 0

            def out(rows, at):
                sizes, keys1, keys2, values = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(rows)),
                        pa.array(sizes, pa.int32()),
                        pa.array(keys1, pa.int64()),
                        pa.array(keys2, pa.int64()),
                        pa.array(values, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "k1", "k2", "hashes"],
                )

            for own in shingle_sets(batch.column(1), words):
                # a copy: a view would keep the whole set
                values = own if full else own[:k].copy()
                rows.append((len(own), *set_keys(own), values))
                held += len(values)
                if held >= MAX_BATCH_IDS:
                    yield out(rows, at)
                    at, rows, held = at + len(rows), [], 0
            if rows:
                yield out(rows, at)

    return run


SCHEMA = "doc_id long, n int, k1 long, k2 long, hashes array<long>"


def least_overlap(n: Column, k: int, share: tuple[int, int]) -> Column:
    """Retained values that a set of ``n`` has in common with every set it links with."""
    s = share[0] / share[1]
    allowed = max(1, math.floor(k * s - DEVIATIONS * math.sqrt(k * s * (1 - s))))
    # sets up to k * share link only with sets that are retained whole
    return F.when(n * share[1] <= k * share[0], F.ceil(n * share[0] / share[1])).otherwise(F.lit(allowed))


def _close(a: str, b: str, share: tuple[int, int]) -> str:
    """Sizes that can reach the threshold."""
    return f"{share[1]} * least({a}, {b}) >= {share[0]} * greatest({a}, {b})"


def _alike(a: str, b: str, share: tuple[int, int]) -> Column:
    """Union-sketch estimate: of the ``WIDE`` smallest of both, enough are in both; exact for unions within ``WIDE``, but for
    one value, as two of a sketch may fall together."""
    union, least = F.array_sort(F.array_union(a, b)), share[0] / share[1]
    inner = F.array_intersect(a, b)
    exact = lambda u: (F.size(inner) + 1) * share[1] >= F.size(u) * share[0]
    cut = lambda u: F.slice(u, 1, WIDE)
    return F.exists(F.array(union), lambda u: F.when(F.size(u) <= WIDE, exact(u)).otherwise(F.size(F.array_intersect(cut(u), inner)) >= (least - SLACK) * WIDE))


def _sketches(sets: DataFrame) -> DataFrame:
    """``node, sketch``: the upper halves of the ``WIDE`` smallest hashes, in the same order and at half the bytes."""
    upper = F.transform(F.slice("hashes", 1, WIDE), lambda x: F.shiftright(x, 32).cast("int"))
    return sets.select("node", upper.alias("sketch"))


def _placed(lists: DataFrame, joined: DataFrame | None) -> DataFrame:
    """List rows ``node, n, v`` with ``c``, the component so far, and ``members``, the length of the list; only lists with several components.

    Stashed, as the plans on top use them several times over.
    """
    rows = lists.withColumn("c", F.col("node")) if joined is None else lists.join(joined, "node", "left").select("node", "n", "v", F.coalesce("component", "node").alias("c"))
    open_ = rows.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi").select("v", "members")
    return stash(rows.join(open_, "v"), "lists", narrow=True)


def _stars(rows: DataFrame, turn: int, share: tuple[int, int]) -> DataFrame:
    """``a, b``: each list's leader with its members of other components.

    Leaders are drawn by a hash of node and one of ``DRAWS`` numbers, not by
    list: a group that shares dozens of lists would give dozens of links a member.
    """
    draw = F.xxhash64(F.pmod("v", F.lit(DRAWS)), "node", F.lit(turn))
    lead = rows.groupBy("v").agg(F.min_by(F.struct("node", "n", "c"), draw).alias("lead"))
    pairs = rows.join(lead, "v").where("c <> lead.c").where(_close("n", "lead.n", share))
    return pairs.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()


def _estimated(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The ``pairs(a, b)`` whose sketches are alike."""
    sketch = _sketches(sets)
    both = pairs.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    return both.where(_alike("sa", "sb", share)).select("a", "b")


def _across(rows: DataFrame, suspects: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``a, b``: pairs of one list with different labels and alike sketches, each from their first common list.

    Lists within ``FEW`` members are joined with themselves. A longer list is
    dealt into blocks of ``LIST_BLOCK`` members, and each pair of blocks is one
    group of bounded size that compares its members as two matrices.
    """
    sketch = _sketches(sets)
    wide = rows.join(suspects.select("node", "prefix"), "node").join(sketch, "node")
    few = wide.where(F.col("members") <= FEW).select("v", "node", "n", "c", "prefix", "sketch")
    a, b = few.alias("a"), few.alias("b")
    first = F.array_min(F.array_intersect("a.prefix", "b.prefix")) == F.col("a.v")
    near = F.when(F.expr(_close("a.n", "b.n", share)) & first, _alike("a.sketch", "b.sketch", share)).otherwise(False)
    short = a.join(b, (F.col("a.v") == F.col("b.v")) & (F.col("a.c") < F.col("b.c")) & near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))

    blocks = F.ceil(F.col("members") / LIST_BLOCK).cast("int")
    dealt = wide.where(F.col("members") > FEW).withColumn("block", F.pmod(F.xxhash64("node", "v"), blocks).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "v", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "n", "prefix", "sketch",
        F.col("node.rep").alias("rep"), F.col("node.k1").alias("k1"), F.col("c.rep").alias("crep"), F.col("c.k1").alias("ck1"),
    )
    found = paired.groupBy("v", "lo", "hi").applyInArrow(_compared(share), "arep long, ak1 long, brep long, bk1 long")
    struct = lambda x: F.struct(F.col(f"{x}rep").alias("rep"), F.col(f"{x}k1").alias("k1"))
    return short.union(found.select(struct("a").alias("a"), struct("b").alias("b")))


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each list on the left has in common with each on the right; lists have no value twice."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for own in (left, right):
        sizes = [len(x) for x in own]
        sides.append((np.concatenate(own) if own else np.zeros(0, dtype=np.int64), np.repeat(np.arange(len(own)), sizes)))
    both = np.intersect1d(sides[0][0], sides[1][0])
    for lo in range(0, len(both), 1024):
        part = both[lo : lo + 1024]
        ones = []
        for (values, owner), own in zip(sides, (left, right), strict=True):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            matrix = np.zeros((len(own), len(part)), dtype=np.float32)
            matrix[owner[hit], at[hit]] = 1
            ones.append(matrix)
        out += ones[0] @ ones[1].T
    return out


def _similar(x: np.ndarray, y: np.ndarray, share: tuple[int, int]) -> bool:
    """``_alike`` for two sketches."""
    union, inner = np.union1d(x, y), np.intersect1d(x, y)
    if len(union) <= WIDE:
        return (len(inner) + 1) * share[1] >= len(union) * share[0]
    return np.count_nonzero(inner <= union[WIDE - 1]) >= (share[0] / share[1] - SLACK) * WIDE


def _compared(share: tuple[int, int]) -> Callable[[pa.Table], pa.Table]:
    """The alike pairs between two blocks of a list, or inside one, by matrices of common values."""

    def run(table: pa.Table) -> pa.Table:
        v, lo, hi = (table[c][0].as_py() for c in ("v", "lo", "hi"))
        block, n, label, label2, rep, k1 = (table[c].to_numpy() for c in ("block", "n", "crep", "ck1", "rep", "k1"))

        def lists(column: str, rows: np.ndarray, below: int | None = None) -> list[np.ndarray]:
            own = table[column].combine_chunks()
            offsets, values = own.offsets.to_numpy(), own.values.to_numpy()
            found = [np.unique(values[offsets[r] : offsets[r + 1]]) for r in rows]
            return found if below is None else [x[x < below] for x in found]

        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        a, b = n[left][:, None].astype(np.int64), n[right][None, :].astype(np.int64)
        open_ = share[1] * np.minimum(a, b) >= share[0] * np.maximum(a, b)
        open_ &= (label[left][:, None] != label[right][None, :]) | (label2[left][:, None] != label2[right][None, :])
        if lo == hi:
            open_ = np.triu(open_, 1)
        if open_.any():
            # pairs with a smaller common value in their prefixes are compared in its list
            open_ &= _common(lists("prefix", left, v), lists("prefix", right, v)) == 0
        i = j = np.zeros(0, dtype=np.int64)
        if open_.any():
            x, y = lists("sketch", left), lists("sketch", right)
            inner = _common(x, y)
            union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - inner
            # what is in both of the whole sketches is no less than what is in both of the smallest
            enough = np.where(union <= WIDE, (inner + 1) * share[1] >= union * share[0], inner >= (share[0] / share[1] - SLACK) * WIDE)
            i, j = np.nonzero(open_ & enough)
            kept = np.array([_similar(x[p], y[q], share) for p, q in zip(i, j, strict=True)], dtype=bool)
            i, j = i[kept], j[kept]
        i, j = left[i], right[j]
        return pa.table({"arep": rep[i], "ak1": k1[i], "brep": rep[j], "bk1": k1[j]})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The links among ``pairs(a, b)`` by the full sets."""
    return (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
        .withColumn("both", F.size(F.array_intersect("ha", "hb")))
        .where(F.col("both") * share[1] >= (F.size("ha") + F.size("hb") - F.col("both")) * share[0])
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
        .distinct()
    )


def _labels(links: DataFrame, hops: int = 3) -> DataFrame:
    """``node, component``: the least node within some hops; equal labels are one component, different ones may be."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("component"))
    for _ in range(hops - 1):
        near = both.join(out, both.v == out.node).groupBy("u").agg(F.min("component").alias("c"))
        out = near.select(F.col("u").alias("node"), F.least("c", "u").alias("component"))
    return stash(out, "labels", narrow=True)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] = (75, 100), k: int = K
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    ``share``: numerator and denominator of the least Jaccard similarity of a link.
    """
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    sketched = stash(slim.mapInArrow(giving_back(_emit(words, k, False)), SCHEMA), "sketches")
    classes = (
        sketched.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("n", "k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.min_by("hashes", "doc_id").alias("sketch"), F.count(F.lit(1)).alias("copies"))
        .select(F.struct("rep", "k1").alias("node"), "n", "k1", "k2", "copies", "sketch")
    )
    classes = stash(classes, "classes")
    # from here on the sketches of copies are not needed, and further down no sketch is
    slim_rows = stash(sketched.select("doc_id", "n", "k1", "k2"), "sizes", narrow=True)
    discard(sketched)

    values = classes.select("node", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    listed = values.join(shared, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("hits"))
    hits = F.size("hits")
    room = hits - least_overlap(F.col("n"), k, share) + 1
    suspects = stash(
        classes.join(listed, "node").where(room > 0).select("node", "n", F.transform(F.slice("hits", 1, room.cast("int")), lambda h: h["v"]).alias("prefix")),
        "suspects",
    )
    vertices = stash(classes.drop("sketch"), "vertices", narrow=True)
    discard(classes)
    lists = suspects.select("node", "n", F.explode("prefix").alias("v"))
    wanted = suspects.select(F.col("node.rep").alias("doc_id")).distinct()
    full = slim.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "t"]).mapInArrow(giving_back(_emit(words, k, True)), SCHEMA)
    sets = stash(full.select(F.struct(F.col("doc_id").alias("rep"), "k1").alias("node"), "hashes"), "sets")

    links, labels = [], None
    for turn in range(STARS):
        placed = _placed(lists, labels)
        new = stash(_verified(_estimated(_stars(placed, turn, share), sets, share), sets, share), "links", narrow=True)
        discard(placed)
        links.append(new)
        if new.isEmpty():
            break
        if labels is not None:
            discard(labels)
        labels = _labels(reduce(DataFrame.union, links))
    placed = _placed(lists, labels)
    across = stash(_across(placed, suspects, sets, share), "across", narrow=True)
    discard(placed)
    links.append(stash(_verified(across, sets, share), "links", narrow=True))
    joined = stash(components(reduce(DataFrame.union, links)), "joined", narrow=True)
    discard(suspects, sets, across, *links, *([] if labels is None else [labels]))

    placed = stash(vertices.join(joined, "node", "left").select("n", "k1", "k2", "copies", F.coalesce("component.rep", "node.rep").alias("c")), "placed", narrow=True)
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    grouped = join_by_key(slim_rows.where(linked), placed, ["n", "k1", "k2"], "copies", slim_rows.count())
    rows = grouped.select("doc_id", "n", F.col("c").alias("component_id")).union(slim_rows.where(~linked).select("doc_id", "n", "doc_id"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, and all without a link."""
    found = near_duplicates(docs, id_col, text_col, **options)
    dropped = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("k")).where("NOT k").select(F.col("doc_id").alias("__gone"))
    return docs.join(dropped, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")


def op3_bottomk_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
