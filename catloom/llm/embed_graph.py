"""Embedding near-dedup by a robust-pruned flat graph.

1. Equal vectors become one class by a 128-bit key, so copies, however many, are one node.
2. Centroids are fitted on a bounded sample (``FIT_ROWS`` vectors, at most
   ``MAX_CELLS`` centroids). A node belongs to the cells of its ``overlap``
   nearest centroids: overlapping cluster shards. Cells above ``SHARD_ROWS``
   are split by a hash, each node into two parts.
3. Each shard builds a graph: nearest neighbours and a few far ones, pruned by
   the robust rule (a candidate is dropped if a kept neighbour is nearer to it
   by the factor ``ALPHA``). The adjacency lists of a node are united over its
   shards.
4. Cells are gathered into regions. A node is a member of the regions of all its
   cells and is searched for in that of its nearest one: a greedy beam search
   from the cells' medoids over the united lists, which then expands through
   everything within the range plus a margin. In a region above ``BLOCK_ROWS``
   members, nodes are compared exactly with blocks of members, so no task holds
   a hot region. Links are verified in double precision. A task gives its nodes'
   link counts and a spanning forest, never all pairs.
5. Audit: all nodes that hold an id divisible by 100 are compared with all nodes
   by brute force, block by block. If the mean recall of the nodes of a size
   class (links by powers of two) is below ``least_recall``, the search is
   repeated with more overlap and a wider beam, twice at most, and then done
   exactly: every node is compared with all blocks of the regions that can hold
   a vector within the range. The mean recall by node is returned, null where no
   id is divisible by 100 and so nothing was asked.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; so do rows without an id; vectors of different
lengths never link; rows that repeat an id are nodes of their own if their
vectors differ and copies otherwise; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import components, discard, join_by_key, stash
from catloom.shipping import ship_package

FIT_ROWS = 20_000
MAX_CELLS = 4_096
SHARD_ROWS = 1_024
CELLS_PER_REGION = 4
BLOCK_ROWS = 4_096
#: Audited nodes that are asked in one pass over all nodes.
AUDIT_BLOCK = 16_384
ALPHA = 1.2
NEAR, FAR, CANDIDATES = 20, 6, 48
BEAM = 16
MARGIN = 0.05
QUERIES = 256


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an array column of equal lengths, scaled to length 1 in double precision."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(col.flatten(), dtype=np.float64)
    x = flat.reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from spread-out rows of ``x``; deterministic."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def robust_graph(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists of a shard: pruned near neighbours, far links, and the reverse of both."""
    n = len(x)
    sim = x @ x.T
    np.fill_diagonal(sim, -2.0)
    dist = np.sqrt(np.maximum(0.0, 2 - 2 * sim))
    take = min(CANDIDATES, n - 1)
    kept = np.full((n, NEAR), -1)
    count = np.zeros(n, dtype=int)
    if take > 0:
        near = np.argpartition(-sim, take - 1, axis=1)[:, :take]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, axis=1), axis=1, kind="stable"), axis=1)
        rows = np.arange(n)
        for j in range(take):
            c = near[:, j]
            to_kept = np.where(kept >= 0, dist[kept, c[:, None]], np.inf)
            good = ((ALPHA * to_kept > dist[rows, c][:, None]).all(axis=1)) & (count < NEAR)
            kept[rows[good], count[good]] = c[good]
            count += good
    draw = np.random.default_rng(n)
    far = draw.integers(0, n, size=(n, FAR))
    out: list[set[int]] = [set(a[a >= 0].tolist()) | set(b.tolist()) for a, b in zip(kept, far, strict=True)]
    for i, own in enumerate([set(o) for o in out]):
        for j in own:
            out[j].add(i)
    return [np.array(sorted(o - {i}), dtype=np.int64) for i, o in enumerate(out)]


def padded(lists: list[np.ndarray]) -> np.ndarray:
    wide = max([1, *map(len, lists)])
    out = np.full((len(lists), wide), -1, dtype=np.int64)
    for i, own in enumerate(lists):
        out[i, : len(own)] = own
    return out


def range_search(x: np.ndarray, graph: np.ndarray, medoids: np.ndarray, queries: np.ndarray, least: float, beam: int) -> np.ndarray:
    """For each query row of ``x``, the rows found with a cosine of ``least`` or more (boolean matrix)."""
    q, n = len(queries), len(x)
    mine = x[queries]
    rows = np.arange(q)
    seen = np.zeros((q, n), dtype=bool)
    hit = np.zeros((q, n), dtype=bool)
    reach = np.zeros((q, n), dtype=bool)

    def judge(r: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        seen[r, c] = True
        hit[r[s >= least], c[s >= least]] = True
        reach[r[s >= least - MARGIN], c[s >= least - MARGIN]] = True

    sims = mine @ x[medoids].T
    r, c = np.repeat(rows, len(medoids)), np.tile(medoids, q)
    judge(r, c, sims.ravel())
    width = max(beam, 1)
    ids = np.full((q, width), -1)
    best = np.full((q, width), -3.0)
    done = np.ones((q, width), dtype=bool)
    top = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    ids[:, : top.shape[1]] = medoids[top]
    best[:, : top.shape[1]] = np.take_along_axis(sims, top, axis=1)
    done[:, : top.shape[1]] = False
    while True:
        open_ = np.where(done, -4.0, best)
        pick = open_.argmax(axis=1)
        live = np.flatnonzero(open_[rows, pick] > -4.0)
        if not len(live):
            break
        done[live, pick[live]] = True
        near = graph[ids[live, pick[live]]]
        fresh = near >= 0
        fresh[fresh] = ~seen[np.repeat(live, fresh.sum(axis=1)), near[fresh]]
        s = np.full(near.shape, -3.0)
        at, col = np.nonzero(fresh)
        if len(at):
            s[at, col] = np.einsum("ij,ij->i", mine[live[at]], x[near[at, col]])
            judge(live[at], near[at, col], s[at, col])
        all_s = np.concatenate([best[live], s], axis=1)
        all_i = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        all_d = np.concatenate([done[live], ~fresh], axis=1)
        order = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
        best[live], ids[live], done[live] = (np.take_along_axis(v, order, axis=1) for v in (all_s, all_i, all_d))
    expanded = np.zeros((q, n), dtype=bool)
    while True:
        r, c = np.nonzero(reach & ~expanded)
        if not len(r):
            break
        expanded[r, c] = True
        for lo in range(0, len(r), 1 << 15):
            near = graph[c[lo : lo + (1 << 15)]]
            at, col = np.nonzero(near >= 0)
            key = np.unique(r[lo : lo + (1 << 15)][at] * n + near[at, col])
            rr, cc = key // n, key % n
            new = ~seen[rr, cc]
            rr, cc = rr[new], cc[new]
            if len(rr):
                judge(rr, cc, np.einsum("ij,ij->i", mine[rr], x[cc]))
    return hit


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes over the pairs."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new[root] == root).all():
            break
        root = new[root]
    return root


def _route(cells: np.ndarray, region_of: np.ndarray, overlap: int):
    """Adds the cells of each node, nearest first, their regions, and the cosine with the nearest centroid."""

    def run(batches):
        for batch in batches:
            x = unit_rows(batch.column("v"))
            sims = x @ cells.T
            top = np.argsort(-sims, axis=1, kind="stable")[:, : min(overlap, len(cells))]
            regions = [list(dict.fromkeys(region_of[t].tolist())) for t in top]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("rep", "h", "m", "v")),
                    pa.array(list(top.astype(np.int32)), pa.list_(pa.int32())), pa.array(regions, pa.list_(pa.int32())),
                    pa.array(sims[np.arange(len(x)), top[:, 0]], pa.float64()),
                ],
                names=["rep", "h", "m", "v", "cells", "regions", "fit"],
            )

    return run


def _build(table: pa.Table) -> pa.Table:
    """One shard: ``rep, h`` and the neighbours as struct list."""
    x = unit_rows(table.column("v"))
    rep, h = table.column("rep").to_numpy(), table.column("h").to_numpy()
    lists = robust_graph(x)
    near = [[{"rep": int(rep[j]), "h": int(h[j])} for j in own] for own in lists]
    return pa.table({"rep": rep, "h": h, "near": pa.array(near, pa.list_(pa.struct([("rep", pa.int64()), ("h", pa.int64())])))})


class Tally:
    """Links and a spanning forest of one task's nodes, gathered from blocks of pairs."""

    def __init__(self, mult: np.ndarray) -> None:
        n = len(mult)
        self.mult = mult.astype(np.float64)
        self.links, self.near, self.root = np.zeros(n), np.zeros(n), np.arange(n)

    def add(self, rows: np.ndarray, cols: np.ndarray, hit: np.ndarray) -> None:
        """The links of ``rows`` with ``cols``."""
        self.links[rows] += hit @ self.mult[cols]
        self.near[rows] += hit.sum(axis=1)
        r, c = np.nonzero(hit & (self.root[rows][:, None] != self.root[cols][None, :]))
        if len(r):
            self.root = forest(self.root[rows[r]], self.root[cols[c]], len(self.root))[self.root]

    def table(self, rep: np.ndarray, h: np.ndarray) -> pa.Table:
        links, near = self.links.astype(np.int64), self.near.astype(np.int64)
        return pa.table({"rep": rep, "h": h, "links": links, "near": near, "root_rep": rep[self.root], "root_h": h[self.root]})


FOUND = "rep long, h long, links long, near long, root_rep long, root_h long"


def _search(least: float, beam: int):
    """One region by its graph: ``rep, h, links, near, root_rep, root_h``; the nodes at home in it are searched for."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending"), ("h", "ascending")])
        x = unit_rows(table.column("v"))
        n = len(x)
        rep, h, mult = (table.column(c).to_numpy() for c in ("rep", "h", "m"))
        tally, home = Tally(mult), np.flatnonzero(table.column("home").to_numpy(zero_copy_only=False))
        cell, fit = table.column("cell").to_numpy(), table.column("fit").to_numpy()
        at = {key: i for i, key in enumerate(zip(rep.tolist(), h.tolist(), strict=True))}
        lists = [np.array([at[k] for k in ((e["rep"], e["h"]) for e in own or []) if k in at], dtype=np.int64) for own in table.column("near").to_pylist()]
        graph = padded(lists)
        order = np.lexsort((np.arange(n), -fit, cell))
        medoids = order[np.concatenate([[True], cell[order][1:] != cell[order][:-1]])]
        for a in range(0, len(home), QUERIES):
            rows = home[a : a + QUERIES]
            hit = range_search(x, graph, medoids, rows, least, beam)
            hit[np.arange(len(rows)), rows] = False
            tally.add(rows, np.arange(n), hit)
        return tally.table(rep, h)

    return run


def _audit(queries: np.ndarray, keys: list[tuple[int, int]], least: float):
    """Links of each query, and the distinct vectors of them, by brute force over this task's nodes; the query itself among them."""

    def run(batches):
        links, near = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for batch in batches:
            x, m = unit_rows(batch.column("v")), batch.column("m").to_numpy()
            for a in range(0, len(keys), QUERIES):
                hit = queries[a : a + QUERIES] @ x.T >= least
                links[a : a + QUERIES] += hit @ m
                near[a : a + QUERIES] += hit.sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(links), pa.array(near)],
            names=["rep", "h", "true_links", "true_near"],
        )

    return run


def _truth(nodes: DataFrame, least: float) -> DataFrame | None:
    """``rep, h, t, tn``: links and distinct linked vectors of every node with an id divisible by 100; None without any."""
    asked = nodes.where("asked")
    blocks = -(-asked.count() // AUDIT_BLOCK)
    found = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b).select("rep", "h", "v").toArrow()
        keys = list(zip(own.column("rep").to_pylist(), own.column("h").to_pylist(), strict=True))
        if not keys:
            continue
        audit = _audit(unit_rows(own.column("v")), keys, least)
        rows = nodes.select("rep", "h", "m", "v").mapInArrow(audit, "rep long, h long, true_links long, true_near long").groupBy("rep", "h")
        part = stash(rows.agg(F.sum("true_links").alias("t"), F.sum("true_near").alias("tn")), "truth")
        found = part if found is None else found.union(part)
    return None if found is None else found.join(nodes.select("rep", "h", "m"), ["rep", "h"]).select("rep", "h", (F.col("t") - F.col("m")).alias("t"), (F.col("tn") - 1).alias("tn"))


def recalls_of(checked: DataFrame) -> tuple[float | None, int, float]:
    """Mean recall of the audited nodes that link, their number, and the least mean of a size class, of ``links, t, near, tn``.

    A node's recall is the smaller of that of its links and that of the distinct
    vectors it links with, a size class is a power of two of those, so neither
    many copies nor a large group hides others.
    """
    recall = F.least(F.col("links") / F.col("t"), F.col("near") / F.col("tn"))
    classes = checked.where("tn > 0").groupBy(F.floor(F.log2("tn")).alias("size")).agg(F.sum(recall).alias("sum"), F.count(F.lit(1)).alias("n")).collect()
    n = sum(r["n"] for r in classes)
    return (sum(r["sum"] for r in classes) / n if n else None), n, min((r["sum"] / r["n"] for r in classes), default=1.0)


def _visits(cells: np.ndarray, region_of: np.ndarray, least: float):
    """Adds each node's home region and all regions that can hold a vector linked with it.

    A linked vector is within the chord ``t``. If its nearest centroid is ``c``,
    then for the node's own nearest ``d`` holds ``x.d - x.c <= t |d - c|``.
    """
    t = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-7

    def run(batches):
        for batch in batches:
            x = unit_rows(batch.column("v"))
            home, visits = np.zeros(len(x), dtype=np.int32), []
            for a in range(0, len(x), QUERIES):
                sims = x[a : a + QUERIES] @ cells.T
                own = sims.argmax(axis=1)
                apart = np.sqrt(np.maximum(0.0, ((cells**2).sum(axis=1)[own][:, None] + (cells**2).sum(axis=1) - 2 * cells[own] @ cells.T)))
                can = sims.max(axis=1)[:, None] - sims <= t * apart + 1e-7
                home[a : a + len(own)] = region_of[own]
                visits += [np.unique(region_of[c]).astype(np.int32) for c in can]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("rep", "h", "m", "v")), pa.array(home), pa.array(visits, pa.list_(pa.int32()))],
                names=["rep", "h", "m", "v", "home", "visits"],
            )

    return run


def _compare(least: float):
    """One block of a region's members against one block of the nodes that ask it, exactly; links go to those that ask."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending"), ("h", "ascending")])
        x = unit_rows(table.column("v"))
        rep, h, mult = (table.column(c).to_numpy() for c in ("rep", "h", "m"))
        member = table.column("member").to_numpy(zero_copy_only=False)
        guests, own = np.flatnonzero(~member), np.flatnonzero(member)
        tally = Tally(mult)
        for a in range(0, len(guests), QUERIES):
            rows = guests[a : a + QUERIES]
            hit = x[rows] @ x[own].T >= least
            tally.add(rows, own, hit & ~((rep[rows][:, None] == rep[own]) & (h[rows][:, None] == h[own])))
        return tally.table(rep, h)

    return run


def _blockwise(asking: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """Every row of ``asking`` against every row of ``members`` (``rep, h, m, v, region``) of its region, by pairs of blocks."""
    columns = ["rep", "h", "m", "v", "region"]

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.col("region").alias(f"r_{name}")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))

    sizes = blocks(members, "members").join(blocks(asking, "askers"), F.col("r_members") == F.col("r_askers"))
    placed = asking.select(*columns, F.lit(False).alias("member")).union(members.select(*columns, F.lit(True)))
    placed = placed.join(F.broadcast(sizes), F.col("region") == F.col("r_members"))

    def block(count: str) -> Column:
        return F.pmod(F.xxhash64("rep", "h", F.lit("block")), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    slim = [*columns, "member"]
    pairs = placed.where("member").select(*slim, block("members").alias("lo"), every("askers").alias("hi")).union(
        placed.where("NOT member").select(*slim, every("members").alias("lo"), block("askers").alias("hi"))
    )
    return pairs.groupBy("region", "lo", "hi").applyInArrow(_compare(least), FOUND)


def _cells(sample: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids, and the region of each."""
    cells = kmeans(sample, int(min(MAX_CELLS, max(1, -(-total // (SHARD_ROWS // 2))))))
    groups = kmeans(cells, max(1, -(-len(cells) // CELLS_PER_REGION)))
    return cells, (cells @ groups.T).argmax(axis=1)


def _exact(nodes: DataFrame, total: int, sample: np.ndarray, least: float) -> DataFrame:
    """As ``_pass``, but with every link: each node is compared with all blocks of the regions that can hold one."""
    cells, region_of = _cells(sample, total)
    routed = stash(nodes.mapInArrow(_visits(cells, region_of, least), "rep long, h long, m long, v array<double>, home int, visits array<int>"), "visits")
    asking = routed.select("rep", "h", "m", "v", F.explode("visits").alias("region"))
    out = stash(_blockwise(asking, routed.withColumnRenamed("home", "region"), least), "found")
    discard(routed)
    return out


def _pass(nodes: DataFrame, total: int, sample: np.ndarray, least: float, overlap: int, beam: int) -> DataFrame:
    """Nodes of one length: ``rep, h, links, near, root_rep, root_h``, one row or more for each node."""
    cells, region_of = _cells(sample, total)
    routed = stash(nodes.mapInArrow(_route(cells, region_of, overlap), "rep long, h long, m long, v array<double>, cells array<int>, regions array<int>, fit double"), "routed")
    rows = routed.select("rep", "h", "v", F.explode("cells").alias("cell"))
    parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("parts")).withColumnRenamed("cell", "c")
    own = F.pmod(F.xxhash64("rep", "h"), F.col("parts")).cast("int")
    also = F.pmod(F.xxhash64("h", "rep"), F.col("parts")).cast("int")
    regions = routed.select(F.explode("regions").alias("region")).groupBy("region").agg((F.count(F.lit(1)) > BLOCK_ROWS).alias("big"))
    members = routed.select(*[c for c in routed.columns if c != "regions"], F.explode("regions").alias("region"), F.col("regions")[0].alias("at_home"))
    members = members.join(F.broadcast(regions), "region").withColumn("home", F.col("region") == F.col("at_home"))
    # no graph is built for nodes of large regions alone
    small = members.where("NOT big").select("rep", "h").distinct()
    shards = rows.join(small, ["rep", "h"], "left_semi").join(F.broadcast(parts), F.col("cell") == F.col("c")).withColumn("part", F.explode(F.array_distinct(F.array(own, also))))
    lists = shards.groupBy("cell", "part").applyInArrow(_build, "rep long, h long, near array<struct<rep:long,h:long>>")
    united = lists.groupBy("rep", "h").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    graph = members.where("NOT big").select("rep", "h", "m", "v", "region", "home", "fit", F.col("cells")[0].alias("cell")).join(united, ["rep", "h"], "left")
    found = graph.groupBy("region").applyInArrow(_search(least, beam), FOUND)
    big = members.where("big")
    out = stash(found.union(_blockwise(big.where("home"), big, least)), "found")
    discard(routed)
    return out


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, least_recall: float = 0.98, overlap: int = 2, beam: int = BEAM) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept, audit_recall``."""
    spark = vectors.sparkSession
    ship_package(spark)
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    keyed = slim.select("vec_id", "v", F.when(usable, F.xxhash64("v")).alias("h"), F.when(usable, F.xxhash64(F.lit(1), "v")).alias("h2"))
    grouped = keyed.where("h IS NOT NULL").groupBy("h", "h2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"), F.max(F.pmod("vec_id", F.lit(100)) == 0).alias("asked")
    )
    nodes = stash(grouped.select("rep", "h", "h2", "m", "v", F.size("v").alias("d"), "asked"), "nodes")
    found, audited, linked = None, 0.0, 0
    for dim, total in [tuple(r) for r in nodes.groupBy("d").count().orderBy("d").collect()]:
        of_dim = nodes.where(F.col("d") == dim)
        plain = of_dim.select("rep", "h", "m", "v")
        draw = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = unit_rows(of_dim.where(draw < FIT_ROWS / total).orderBy("rep", "h").select("v").toArrow().column("v")) if total > 1 else np.ones((0, dim))
        sample = sample if len(sample) else np.ones((1, dim))
        truth = _truth(of_dim, least)
        width, reach = overlap, beam
        for attempt in range(4):
            own = _pass(plain, total, sample, least, width, reach) if attempt < 3 else _exact(plain, total, sample, least)
            if truth is None:
                break
            sums = own.groupBy("rep", "h").agg(F.sum("links").alias("links"), F.sum("near").alias("near"))
            mean, n, worst = recalls_of(truth.join(sums, ["rep", "h"]))
            if worst >= least_recall or attempt == 3:
                audited, linked = audited + (mean or 0.0) * n, linked + n
                break
            discard(own)
            width, reach = width + 2, reach * 2
        found = own if found is None else found.union(own)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    edges = found.select(F.struct("rep", "h").alias("u"), F.struct(F.col("root_rep").alias("rep"), F.col("root_h").alias("h")).alias("v"))
    joined = stash(components(edges), "joined")
    counts = found.groupBy("rep", "h").agg(F.sum("links").alias("links"))
    merged = stash(
        nodes.select("h", "h2", "rep", "m", F.struct("rep", "h").alias("node"))
        .join(counts, ["rep", "h"], "left")
        .join(joined, "node", "left")
        .select("h", "h2", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component.rep", "rep").alias("c")),
        "merged",
    )
    ids = stash(keyed.select("vec_id", "h", "h2"), "ids")
    rows = join_by_key(ids.where("h IS NOT NULL"), merged, ["h", "h2"], "m", ids.count())
    linked_rows = rows.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("c").alias("component_id"))
    alone = ids.where("h IS NULL").select("vec_id", F.lit(0).cast("long"), "vec_id")
    recall = F.lit(audited / linked if linked else (1.0 if truth_asked(nodes) else None)).cast("double")
    return linked_rows.union(alone).select("vec_id", "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("vec_id")).alias("kept"), recall.alias("audit_recall"))


def truth_asked(nodes: DataFrame) -> bool:
    """Whether any node was audited; if none of them links, none of their links was missed."""
    return not nodes.where("asked").isEmpty()


def op2_pruned_graph_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
