"""Sitemap trees and link graphs as fixpoints over edge tables.

Each round joins the frontier with the edges and drops what was visited, so
cycles end. The visited set is written to the shared folder every few rounds
to cut the lineage; nothing is collected but the number of new rows. Up to
``ranks.FEW`` rows the frontier and the visited set are broadcast, so the edges
stay where they are; beyond that they are shuffled for the round.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.operators.ranks import FEW, cut


def reach(seeds: DataFrame, edges: DataFrame, most_rounds: int | None = None, most_nodes: int | None = None) -> DataFrame:
    """``node, depth``: what is reachable from ``seeds(node)`` over ``edges(src, dst)``, at its least depth.

    Runs until the frontier is empty; with ``most_rounds``, deeper nodes are an error and never left out in silence.
    With ``most_nodes`` no new round starts once so many nodes were visited.
    """
    frontier = seeds.select("node").distinct()
    visited = cut(frontier.withColumn("depth", F.lit(0)))
    frontier, found = visited.select("node"), visited.count()
    total = found

    def few(rows: DataFrame, n: int) -> DataFrame:
        return F.broadcast(rows) if n <= FEW else rows

    for depth in count(1):
        new = edges.join(few(frontier, found), edges.src == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
        new = cut(new.join(few(visited.select("node"), total), "node", "left_anti").withColumn("depth", F.lit(depth)))
        found = new.count()
        total += found
        if not found:
            break
        if most_rounds is not None and depth > most_rounds:
            raise RuntimeError(f"nodes are left after {most_rounds} rounds")
        visited = visited.union(new)
        if depth % 4 == 0:
            visited = cut(visited)
        if most_nodes is not None and total >= most_nodes:
            break
        frontier = new.select("node")
    return visited


def expand_sql(spark, seeds: DataFrame, edges: DataFrame, levels: int) -> DataFrame:
    """The same by a recursive query with a depth cap, for trees: paths may meet, so nodes are reduced at the end."""
    return spark.sql(
        f"""WITH RECURSIVE t(node, depth) AS (
            SELECT node, 0 FROM {{seeds}}
            UNION ALL
            SELECT e.dst, t.depth + 1 FROM t JOIN {{edges}} e ON e.src = t.node WHERE t.depth < {int(levels)})
        SELECT node, min(depth) AS depth FROM t GROUP BY node""",
        seeds=seeds,
        edges=edges,
    )
