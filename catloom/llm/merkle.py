"""Merkle manifest of a dataset: a tree for each group, one over the groups' roots, proofs for every row.

A digest is lowercase hex SHA-256; a node is the digest of its children's
digests, and an odd last node is the digest of its one child.

The leaves, 32 bytes each, are written once and range-sorted by group and id.
The rows of a group in one sorted partition are a run of its leaves; the counts
by group and partition, a row for each partition and one more for each group,
give every run its offset and every group its number and size. Where they are
more than ``OFFSETS`` they are joined by a shuffle, else they are broadcast.

1. Each task folds its runs into complete aligned subtrees of at most ``2^STEP``
   leaves and passes on only their tops (``_tops``).
2. Tops below that height lie at the ragged ends of runs. They alone are
   shuffled, by the coordinate of the block they belong to, and finish it.
3. The upper levels fold the block roots in the same way, ``STEP`` levels a
   round, by coordinate; each round keeps the siblings that its nodes met.
4. The groups' roots are the leaves of one more tree.
5. For the proofs the leaves go by block to the siblings above their block.

No task holds more than ``2^STEP`` nodes of a level, whatever the size of a
group. Groups may be many, but their numbers are dealt in one window over the
counts, so they should be far fewer than the rows.

Defined cases: a null is the leaf's ``-``; a null id stands before the ids and
is never tampered with; rows that repeat an id are leaves of their own in the
order of their digests; a null group is a group and the first; one leaf alone
is its group's root, one group's root alone is the root, and the proof without
siblings is empty; long texts are hashed whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catloom.llm.common import stash
from catloom.shipping import ship_package

#: Levels that one task folds; a block has ``2 ** STEP`` nodes at most.
STEP = 12
#: Runs whose offsets are broadcast (some 40 bytes each).
OFFSETS = 1 << 20
NODE = "gid int, level int, idx long, digest binary"
PATH = "gid int, idx long, siblings array<binary>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's values, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    gid, level, idx, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(gid, pa.int32()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(digest, pa.binary())], names=["gid", "level", "idx", "digest"]
    )


def _tops(step: int):
    """The largest complete aligned subtrees, of ``step`` levels at most, of each run of consecutive leaves ``gid, idx, digest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, stack, out, group, due = hashlib.sha256, [], [], None, None
        for batch in batches:
            for g, i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if g != group or i != due:
                    out += [(group, *node) for node in stack]
                    stack, group = [], g
                due, level, at = i + 1, 0, i
                while level < step and at & 1 and stack and stack[-1][0] == level:
                    d = sha((stack.pop()[2].hex() + d.hex()).encode()).digest()
                    level, at = level + 1, at >> 1
                if level == step:
                    out.append((g, level, at, d))
                else:
                    stack.append((level, at, d))
            if len(out) > 1 << 13:
                yield _emit(out)
                out = []
        out += [(group, *node) for node in stack]
        if out:
            yield _emit(out)

    return run


def levels_of(nodes: dict[int, dict[int, bytes]], base: int, top: int, last: int) -> list[dict[int, bytes]]:
    """All levels ``base..top`` of a block: what is given, and the parents of what is known. ``last``: the number of the last node at ``base``."""
    known = dict(nodes.get(base, {}))
    out = [known]
    for level in range(base, top):
        above, end = dict(nodes.get(level + 1, {})), last >> (level - base)
        for i in known:
            p = i >> 1
            if p not in above:
                pair = [known[2 * p]] if 2 * p == end else [known[2 * p], known[2 * p + 1]]
                above[p] = parent(pair)
        known = above
        out.append(known)
    return out


def _blocks(base: int, step: int, paths: bool):
    """Fold the nodes of one block, of levels ``base`` on, ``step`` levels up or to the group's root.

    Gives the top node, or with ``paths`` for each node of level ``base`` its
    siblings on the way (null where a node has none), and the top with it.
    """

    def run(table: pa.Table) -> pa.Table:
        nodes: dict[int, dict[int, bytes]] = {}
        for level, i, d in zip(table["level"].to_pylist(), table["idx"].to_pylist(), table["digest"].to_pylist(), strict=True):
            nodes.setdefault(level, {})[i] = d
        gid, depth, last = table["gid"][0].as_py(), table["depth"][0].as_py(), (table["n"][0].as_py() - 1) >> base
        top = max(base, min(base + step, depth))
        levels = levels_of(nodes, base, top, last)
        (at, root), *more = levels[-1].items()
        if more:
            raise ValueError("a block has one top")
        if not paths:
            return pa.table({"gid": pa.array([gid], pa.int32()), "level": pa.array([top], pa.int32()), "idx": pa.array([at], pa.int64()), "digest": pa.array([root], pa.binary())})
        own = sorted(levels[0])
        siblings = [[levels[k].get((i >> k) ^ 1) for k in range(top - base)] for i in own]
        return pa.table(
            {
                "gid": pa.array([gid] * len(own), pa.int32()),
                "idx": pa.array(own, pa.int64()),
                "siblings": pa.array(siblings, pa.list_(pa.binary())),
                "top_idx": pa.array([at] * len(own), pa.int64()),
                "top": pa.array([root] * len(own), pa.binary()),
            }
        )

    return run


def above(roots: DataFrame, sizes: DataFrame, base: int, deepest: int, step: int) -> DataFrame:
    """``gid, idx, siblings, root`` for the nodes of level ``base`` (or the root of a lower tree): the siblings up to the group's root.

    A round for each ``step`` levels; its rows are a ``2 ** step``-th of the round's before.
    """
    rounds = []
    nodes = roots
    while True:
        within = F.shiftright("idx", step)
        folded = nodes.join(sizes, "gid").withColumn("block", within).groupBy("gid", "block").applyInArrow(_blocks(base, step, True), f"{PATH}, top_idx long, top binary")
        rounds.append(stash(folded, "paths"))
        base += step
        if base >= deepest:
            break
        nodes = rounds[-1].select("gid", F.lit(base).alias("level"), F.col("top_idx").alias("idx"), F.col("top").alias("digest")).distinct()
    out = rounds[-1].select("gid", "idx", "siblings", F.col("top").alias("root"))
    for lower in reversed(rounds[:-1]):
        up = out.select("gid", F.col("idx").alias("top_idx"), F.col("siblings").alias("more"), "root")
        out = stash(lower.join(up, ["gid", "top_idx"]).select("gid", "idx", F.concat("siblings", "more").alias("siblings"), "root"), "paths")
    return out


_HEX = np.array([f"{b:02x}".encode() for b in range(256)], dtype="S2").view(np.uint8).reshape(256, 2)


def _proofs(step: int, kept: list[str]):
    """Each leaf of a block with its proof: the siblings in the block and those above it."""

    def run(leaves: pa.Table, path: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("idx")
        first, rows = leaves["idx"][0].as_py(), leaves.num_rows
        n, depth = leaves["n"][0].as_py(), leaves["depth"][0].as_py()
        digests = leaves["digest"].to_pylist()
        levels = levels_of({0: dict(enumerate(digests, first))}, 0, min(step, depth), n - 1)
        higher = path["siblings"][0].as_py()
        place, held, none = np.arange(rows), [], []
        for k, level in enumerate(levels[:-1]):
            start = first >> k
            block = np.frombuffer(b"".join(level[i] for i in range(start, start + len(level))), dtype=np.uint8).reshape(-1, 32)
            beside = ((place + first) >> k) ^ 1
            inside = beside - start < len(block)
            held.append(block[np.where(inside, beside - start, 0)])
            none.append(~inside)
        for d in higher:
            held.append(np.broadcast_to(np.frombuffer(d or bytes(32), dtype=np.uint8), (rows, 32)))
            none.append(np.full(rows, d is None))
        depth_all = len(held)
        flat = np.stack(held, axis=1).reshape(-1, 32) if held else np.zeros((0, 32), dtype=np.uint8)
        text = _HEX[flat].reshape(-1)
        offsets = np.arange(len(flat) + 1, dtype=np.int32) * 64
        mask = np.packbits(~np.stack(none, axis=1).reshape(-1), bitorder="little") if none else np.zeros(0, dtype=np.uint8)
        strings = pa.StringArray.from_buffers(len(flat), pa.py_buffer(offsets), pa.py_buffer(text), pa.py_buffer(mask))
        proof = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * depth_all), strings)
        root = path["root"][0].as_py()
        return pa.Table.from_arrays(
            [*[leaves[c].combine_chunks() for c in kept], pa.array([root.hex()] * rows, pa.string()), proof], names=[*kept, "subroot", "proof"]
        )

    return run


def depth_of(n: Column) -> Column:
    """Levels above ``n`` leaves."""
    return F.length(F.regexp_replace(F.bin(n - 1), "^0+", "")).cast("int")


def forest(leaves: DataFrame, group: str, order: list[str], step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """A tree for each group of ``leaves``, which hold ``group``, the ``order`` columns and ``digest``.

    The leaves with ``gid, idx, n, depth``, and ``gid, idx, siblings, root`` for
    each block of ``2 ** step`` leaves (``idx`` numbers the blocks).
    """
    spark = leaves.sparkSession
    keys = [group, *order, "digest", "__row"]
    # equal leaves are told apart by a row number, so that no key is too large for a partition
    dealt = stash(leaves.withColumn("__row", F.monotonically_increasing_id()), "leaves")
    sorted_rows = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    placed = stash(sorted_rows.withColumn("__part", F.shiftright("__at", 33).cast("int")), "sorted")
    runs = placed.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("c"), F.min("__at").alias("first"))
    runs = stash(runs, "runs")
    earlier = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runs.groupBy("__g").agg(F.sum("c").alias("n"))
    sizes = sizes.select("*", (F.row_number().over(Window.orderBy(F.col("__g").asc_nulls_first())) - 1).cast("int").alias("gid"), depth_of(F.col("n")).alias("depth"))
    sizes = stash(sizes, "sizes")
    offsets = runs.select("__g", "__p", (F.coalesce(F.sum("c").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    s = sizes.withColumnRenamed("__g", "__sg")
    offsets = stash(offsets.join(s, F.col("__g").eqNullSafe(F.col("__sg"))).select("__g", "__p", "shift", "gid", "n", "depth"), "offsets")
    small = offsets.count() <= OFFSETS
    same = (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g"))
    numbered = placed.join(F.broadcast(offsets) if small else offsets, same).withColumn("idx", F.col("__at") + F.col("shift"))
    runs_in_order = numbered if small else numbered.sortWithinPartitions("__at")
    tops = stash(runs_in_order.select("gid", "idx", "digest").mapInArrow(_tops(step), NODE), "tops")
    sizes = sizes.select("gid", "n", "depth")
    # a block that a run covered is done; the tops at ragged ends are shuffled to theirs
    ragged = tops.where(F.col("level") < step).join(sizes, "gid")
    ragged = ragged.withColumn("block", F.expr(f"shiftright(idx, {step} - level)"))
    finished = ragged.groupBy("gid", "block").applyInArrow(_blocks(0, step, False), NODE)
    roots = finished.union(tops.where(F.col("level") == step))
    deepest = sizes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    paths = above(roots.select("gid", F.lit(step).alias("level"), "idx", "digest"), sizes, step, deepest, step)
    rows = numbered.select("gid", "idx", "n", "depth", *[c for c in leaves.columns])
    return rows, paths


def manifest(
    docs: DataFrame, digest: Column, id_col: str = "doc_id", group_col: str = "lang", carried: dict[str, Column] | None = None, step: int = STEP
) -> DataFrame:
    """``id, leaf, idx, subroot, gid, root, proof`` for each row, and the ``carried`` columns.

    ``proof`` lists the sibling at each level, null where a node had none, from
    the leaf to the root; ``idx`` and ``gid``, the numbers of the leaf in its
    group and of the group, say which ones stand to the left, and ``depth`` how
    many belong to the group's tree.
    """
    spark = docs.sparkSession
    ship_package(spark)
    extra = carried or {}
    slim = docs.select(F.col(id_col).alias("__id"), F.col(group_col).alias("__group"), digest.alias("digest"), *[c.alias(n) for n, c in extra.items()])
    rows, paths = forest(slim, "__group", ["__id"], step)
    kept = ["gid", "idx", "depth", "__id", "digest", *extra]
    types = dict(slim.dtypes) | {"gid": "int", "idx": "bigint", "depth": "int"}
    ddl = ", ".join([f"`{c}` {types[c]}" for c in kept] + ["subroot string", "proof array<string>"])
    by_block = rows.withColumn("block", F.shiftright("idx", step)).groupBy("gid", "block")
    proved = by_block.cogroup(paths.withColumn("block", F.col("idx")).groupBy("gid", "block")).applyInArrow(_proofs(step, kept), ddl)
    # the groups' roots are few, and their tree is the same as any other
    roots = paths.select("gid", F.col("root").alias("digest")).distinct().select(F.lit(0).alias("one"), F.col("gid").alias("group_no"), "digest")
    top_rows, top_paths = forest(roots, "one", ["group_no"], step)
    top_ddl = "idx long, depth int, group_no int, subroot string, proof array<string>"
    top_kept = ["idx", "depth", "group_no"]
    tops = (
        top_rows.withColumn("block", F.shiftright("idx", step))
        .groupBy("gid", "block")
        .cogroup(top_paths.withColumn("block", F.col("idx")).groupBy("gid", "block"))
        .applyInArrow(_proofs(step, top_kept), top_ddl)
    )
    tops = stash(tops.select("group_no", F.col("subroot").alias("root"), F.col("proof").alias("higher")), "roots")
    return proved.join(tops, F.col("gid") == F.col("group_no")).select(
        F.col("__id").alias("id"), F.lower(F.hex("digest")).alias("leaf"), "gid", "idx", "depth", "subroot", "root", F.concat("proof", "higher").alias("proof"), *extra
    )


def folded(digest: Column, proof: Column, idx: Column, depth: Column, gid: Column) -> Column:
    """The root that a leaf's hex digest and its proof lead to."""

    def step(state: Column, sibling: Column) -> Column:
        # the number of the node at this level, in the group's tree and then in the groups'
        k, at = state["k"], F.when(state["k"] == depth, gid).otherwise(state["at"])
        own = state["d"]
        pair = F.when(sibling.isNull(), own).when(at % 2 == 1, F.concat(sibling, own)).otherwise(F.concat(own, sibling))
        return F.struct((k + 1).alias("k"), F.shiftright(at, 1).alias("at"), F.sha2(pair, 256).alias("d"))

    start = F.struct(F.lit(0).alias("k"), idx.cast("long").alias("at"), digest.alias("d"))
    return F.aggregate(proof, start, step, lambda s: s["d"])


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(proof, ""), 256)


def tamper_checked(docs: DataFrame, step: int = STEP) -> DataFrame:
    """The manifest of ``documents``, its proofs' digests, and what each row leads to after tampering with ``n_chars`` of some."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = [f if i != 3 else f + 1 for i, f in enumerate(fields)]
    tampered = F.when(hit & F.col("n_chars").isNotNull(), leaf(*changed))
    found = manifest(docs, leaf(*fields), carried={"tampered": tampered}, step=step)
    now = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    out = found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("proof")).alias("proof_sha256"),
        folded(now, F.col("proof"), F.col("idx"), F.col("depth"), F.col("gid").cast("long")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 18, upper: int = 5) -> str:
    """The same in SQL, with a common table for each level; ``2 ** levels`` leaves a group and ``2 ** upper`` groups at most."""
    leaf_sql = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "{n}", "text"))
    crc = (
        "xor(4294967295::UBIGINT, list_reduce([4294967295]::UBIGINT[] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT), "
        "lambda s, b: list_reduce([xor(s, b)]::UBIGINT[] || [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[], lambda r, k: xor(r >> 1, 3988292384::UBIGINT * (r & 1)))))"
    )
    parts = [
        f"""d AS MATERIALIZED (
    SELECT doc_id, lang, sha256({leaf_sql.format(n="n_chars")}) AS leaf, sha256({leaf_sql.format(n="(n_chars + 1)")}) AS changed,
           coalesce({crc} % 7 = 0, false) AND n_chars IS NOT NULL AS hit
    FROM documents
)""",
        "l0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "n0 AS MATERIALIZED (SELECT lang AS g, i, leaf AS h FROM l0)",
    ]

    def climb(prefix: str, count: int) -> None:
        for k in range(count):
            parts.append(
                f"{prefix}{k + 1} AS MATERIALIZED (SELECT g, j AS i, CASE WHEN max(c) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h "
                f"FROM (SELECT g, i, i // 2 AS j, h, count(*) OVER (PARTITION BY g) AS c FROM {prefix}{k}) GROUP BY g, j)"
            )

    climb("n", levels)
    parts.append(f"m0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, g AS lang FROM n{levels})")
    climb("m", upper)
    parts.append(
        f"r0 AS MATERIALIZED (SELECT l.doc_id, l.leaf, l.i AS at, CASE WHEN l.hit THEN l.changed ELSE l.leaf END AS f, '' AS p, l.lang, m0.h AS subroot, m0.i AS no, m{upper}.h AS root "
        f"FROM l0 l JOIN m0 ON l.lang IS NOT DISTINCT FROM m0.lang CROSS JOIN m{upper})"
    )

    def prove(source: str, count: int, group: str, start: str, base: int) -> None:
        for k in range(count):
            have = f"(SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {source}{k})"
            parts.append(
                f"r{base + k + 1} AS MATERIALIZED (SELECT r.doc_id, r.leaf, r.at // 2 AS at, CASE WHEN o.c = 1 THEN f WHEN s.h IS NULL THEN sha256(f) "
                f"WHEN r.at % 2 = 1 THEN sha256(s.h || f) ELSE sha256(f || s.h) END AS f, p || coalesce(s.h, '') AS p, r.lang, r.subroot, r.no, r.root "
                f"FROM {start if k == 0 else f'r{base + k}'} r JOIN {have} o ON o.g IS NOT DISTINCT FROM {group} AND o.i = r.at "
                f"LEFT JOIN {source}{k} s ON s.g IS NOT DISTINCT FROM {group} AND s.i = xor(r.at, 1))"
            )

    prove("n", levels, "r.lang", "r0", 0)
    parts.append(f"up AS MATERIALIZED (SELECT doc_id, leaf, no AS at, f, p, lang, subroot, no, root FROM r{levels})")
    prove("m", upper, "0", "up", levels)
    sql = ",\n".join(parts)
    return f"""WITH {sql}
SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM r{levels + upper}"""


OP13_SQL = _oracle()


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_checked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
