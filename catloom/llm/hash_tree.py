"""Sharding by a hierarchical weighted hash tree. Native: hashes and comparisons only.

The tree has regions of racks of shards; a rack weighs what its shards weigh
together and a region what its racks do. A key descends: at each node every
child draws ``-ln(u) / weight``, an exponential variable of its weight, with
``u`` a hash of the key and the child's own number, and the least draw is taken.
A child's draw depends on nothing but the key, its number and its weight, so a
changed weight moves keys only into or out of the nodes that weigh more or less
than before: other regions exchange nothing, nor do other racks of the region
among those keys that stay in it.

Growth hangs one more shard into the tree as a region of its own. All other
weights stay as they were, so the new shard takes keys only into itself.

Defined cases: a null text has 8 bytes and the checksum of the empty text; all
null keys draw alike and share a shard; equal keys share a shard; slots order
the rows of a shard by a hash bucket of id, size and checksum and then by
these; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import rank_within

#: What a node's number is hashed with, so that a rack never draws as the region or shard of its number.
REGION, RACK, SHARD = 1, 2, 3


@dataclass(frozen=True)
class Tree:
    """``regions[r][k]``: the weights of the shards of rack ``k`` of region ``r``; numbers run through the tree in order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    def __post_init__(self):
        weights = [w for racks in self.regions for rack in racks for w in rack]
        if not weights or min(weights) <= 0 or not all(racks and all(racks) for racks in self.regions):
            raise ValueError("every node needs a child and every shard a weight above 0")

    @classmethod
    def of(cls, weights, shards_per_rack: int = 4, racks_per_region: int = 3) -> Tree:
        """The shards dealt in order to racks and the racks to regions."""
        weights = tuple(map(float, weights))
        racks = tuple(weights[i : i + shards_per_rack] for i in range(0, len(weights), shards_per_rack))
        return cls(tuple(racks[i : i + racks_per_region] for i in range(0, len(racks), racks_per_region)))

    def grown(self, weight: float) -> Tree:
        """With one more shard, in a rack and region of its own."""
        return Tree((*self.regions, ((float(weight),),)))

    def levels(self) -> tuple[list, list, list]:
        """``(number, weight)`` of the children of the root, of each region and of each rack."""
        racks = [rack for own in self.regions for rack in own]
        top = [[(r, float(sum(map(sum, own)))) for r, own in enumerate(self.regions)]]
        return top, _numbered([[float(sum(rack)) for rack in own] for own in self.regions]), _numbered(racks)


def _numbered(weights: list) -> list[list[tuple[int, float]]]:
    out, at = [], 0
    for own in weights:
        out.append([(at + i, float(w)) for i, w in enumerate(own)])
        at += len(own)
    return out


def draw(key: Column, level: int, number: Column, weight: Column) -> Column:
    """An exponential variable of rate ``weight`` from 52 bits of a hash of key and node."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), number), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(unit) / weight


def chosen(key: Column, level: int, children: list[tuple[int, float]]) -> Column:
    """The child of the least draw, of the least number on a tie."""
    drawn = [F.struct(draw(key, level, F.lit(n), F.lit(w)).alias("draw"), F.lit(n).alias("number")) for n, w in children]
    return (F.least(*drawn) if len(drawn) > 1 else drawn[0])["number"]


def _below(key: Column, level: int, parent: Column, children: list[list[tuple[int, float]]]) -> Column:
    """``chosen`` among the children of the node ``parent``; the draws of other nodes' children are not made."""
    out = F.lit(None).cast("int")
    for k, own in reversed(list(enumerate(children))):
        out = F.when(parent == k, chosen(key, level, own)).otherwise(out)
    return out


def place(df: DataFrame, key: str, tree: Tree, out: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``out``, the shard of each row."""
    top, racks, shards = tree.levels()
    at = df.select(*keep, F.col(key).alias("__key"), chosen(F.col(key), REGION, top[0]).alias("__region"))
    at = at.select(*keep, "__key", _below(F.col("__key"), RACK, F.col("__region"), racks).alias("__rack"))
    return at.select(*keep, _below(F.col("__key"), SHARD, F.col("__rack"), shards).cast("int").alias(out))


def assign_shards(docs: DataFrame, shards: int = 24, weights: tuple[float, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``size, text_crc32, law, shard, slot, grown_shard`` for each row; equal weights unless given."""
    tree = Tree.of(weights or (1.0,) * shards)
    grown = tree.grown(tree.regions[-1][-1][-1])
    binary = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(binary) + 8).cast("long").alias("size"), F.crc32(binary).cast("long").alias("text_crc32")
    )
    own = ["doc_id", "size", "text_crc32"]
    placed = place(slim, "doc_id", tree, "shard", own)
    placed = place(placed, "doc_id", grown, "grown_shard", [*own, "shard"])
    ranked = rank_within(placed, ["shard"], own, "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_hash_tree_shards(spark, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
