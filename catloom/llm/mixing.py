"""Mixing sources to target weights by Pfair scheduling.

A source is cut into blocks of ``block`` documents. With target weight ``w``,
its k-th block is released at slot ``floor((k - 1) / w)`` and due at slot
``ceil(k / w)``; each slot goes to the released block with the earliest
deadline. In every prefix of the slots a source then has less than one block
more or less than its weight's share. Weights are whole numbers over the
denominator ``WHOLE``, so releases and deadlines are exact. The slots of all blocks are
worked out on the driver and broadcast, ``PLAN_BLOCKS`` and one more a source at
most (some 80 MB): where blocks of ``block`` documents would be more, they are
made as long as that needs. More sources than ``PLAN_BLOCKS`` are refused.
With a ``period`` given, weights are whole quanta of that many slots instead
(one at least), the schedule repeats, and the driver works out one period; the
shares are then only as near to the weights as the quanta.

A source that has run out leaves its slots empty and positions close up, so the
others go on in the proportions of their weights. No row is dropped or
repeated. Ranks inside a source come from ``rank_within``, so a hot source is
dealt over many tasks; the order inside a source is by a hash of the id.

Defined cases: a null source is a source of its own; sources of weight 0 or
without a given weight follow all others, evenly mixed (with a ``period``, they
get one quantum); repeated ids are ranked as rows of their
own; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from catloom.llm.common import rank_within

BLOCK = 64
PLAN_BLOCKS = 1 << 20
#: Denominator of the weights.
WHOLE = 1 << 40
#: Target weight of a source: its number of rows to this power.
POWER = 0.7


def quanta(weights: dict, period: int) -> dict:
    """Whole quanta of each source: one at least, ``period`` together, by largest remainders."""
    total = sum(weights.values())
    spare = period - len(weights)
    if spare < 0 or total <= 0 or min(weights.values()) < 0:
        raise ValueError("the period needs a slot for each source, and weights must not be below 0")
    ideal = {s: spare * w / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in ideal.items()}
    by_rest = sorted(weights, key=lambda s: (int(ideal[s]) - ideal[s], s is not None, str(s)))
    for s in by_rest[: period - sum(out.values())]:
        out[s] += 1
    return out


def schedule(shares: dict) -> list[tuple]:
    """One period: ``(source, k, slot, release, deadline, quanta)``, earliest deadline first."""
    period = sum(shares.values())
    order = sorted(shares, key=lambda s: (s is not None, str(s)))
    later = [(0, i, 1) for i in range(len(order))]
    heapq.heapify(later)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(period):
        while later and later[0][0] <= slot:
            release, i, k = heapq.heappop(later)
            heapq.heappush(ready, (-(-k * period // shares[order[i]]), i, k, release))
        due, i, k, release = heapq.heappop(ready)
        out.append((order[i], k, slot, release, due, shares[order[i]]))
        if k < shares[order[i]]:
            heapq.heappush(later, (k * period // shares[order[i]], i, k + 1))
    return out


def fixed(weights: dict) -> dict:
    """Weights as whole numbers that are ``WHOLE`` together, by largest remainders; one at least for a weight above 0."""
    total = sum(Fraction(w) for w in weights.values())
    ideal = {s: Fraction(w) * WHOLE / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in ideal.items()}
    by_rest = sorted(weights, key=lambda s: (int(ideal[s]) - ideal[s], s is not None, str(s)))
    for s in by_rest[: max(0, WHOLE - sum(out.values()))]:
        out[s] += 1
    out[max(out, key=lambda s: (out[s], s is None, str(s)))] -= max(0, sum(out.values()) - WHOLE)
    return out


def exact_schedule(shares: dict, blocks: dict, first: int = 0) -> list[tuple]:
    """``(source, k, slot, release, deadline)`` of all blocks, earliest deadline first, from slot ``first`` on.

    A source that has run out asks for no more slots, and slots for which no
    block is released yet stay empty and take no time. Once a single source is
    left, each of its blocks takes the last slot before its deadline.
    """
    whole = sum(shares.values())
    order = sorted(shares, key=lambda s: (s is not None, str(s)))
    later = [(0, i, 1) for i, s in enumerate(order) if blocks[s] > 0]
    ready: list[tuple[int, int, int, int]] = []
    done, left, out, slot = {s: 0 for s in order}, len(later), [], 0
    while left > 1:
        if not ready and later:
            slot = max(slot, later[0][0])
        while later and later[0][0] <= slot:
            release, i, k = heapq.heappop(later)
            heapq.heappush(ready, (-(-k * whole // shares[order[i]]), i, k, release))
        due, i, k, release = heapq.heappop(ready)
        s = order[i]
        out.append((s, k, first + slot, first + release, first + due))
        done[s] = k
        if k == blocks[s]:
            left -= 1
        else:
            heapq.heappush(later, (k * whole // shares[s], i, k + 1))
        slot += 1
    for s in order:
        for k in range(done[s] + 1, blocks[s] + 1):
            due = -(-k * whole // shares[s])
            out.append((s, k, first + due - 1, first + (k - 1) * whole // shares[s], first + due))
    return out


def exact_plan(weights: dict, rows: dict, block: int) -> list[tuple]:
    """``exact_schedule`` for the rows of each source, with the position where each block starts; weights of 0 come last."""
    blocks = {s: -(-n // block) for s, n in rows.items()}
    plan: list[tuple] = []
    for own in ({s: w for s, w in weights.items() if w > 0}, {s: 1 for s, w in weights.items() if w == 0}):
        if own:
            plan += exact_schedule(fixed(own), blocks, plan[-1][2] + 1 if plan else 0)
    start, out = 0, []
    for s, k, slot, release, due in plan:
        out.append((s, k, slot, release, due, start))
        start += min(block, rows[s] - (k - 1) * block)
    return out


def source_rows(docs: DataFrame, source_col: str) -> dict:
    """Rows of each source; one row a source comes to the driver, ``PLAN_BLOCKS`` at most."""
    rows = docs.groupBy(source_col).count().limit(PLAN_BLOCKS + 1).collect()
    if len(rows) > PLAN_BLOCKS:
        raise ValueError(f"the driver can't plan for more than {PLAN_BLOCKS} sources; give a coarser source column")
    return {r[0]: r[1] for r in rows}


def mixed(
    docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, period: int | None = None, power: float = POWER
) -> DataFrame:
    """``__row`` (all columns) with ``__source, __block, __release, __deadline, __slot, __position``."""
    spark = docs.sparkSession
    counts = source_rows(docs, source_col)
    own = {s: float(n) ** power for s, n in counts.items()}
    wanted = own if weights is None else {s: float(weights.get(s, 0.0)) for s in own}
    if wanted and not sum(wanted.values()):
        raise ValueError("no source of the table has a weight")
    if wanted and min(wanted.values()) < 0:
        raise ValueError("weights must not be below 0")
    block = max(block, -(-sum(counts.values()) // PLAN_BLOCKS))
    rows = docs.select(F.struct("*").alias("__row"), F.col(source_col).alias("__source"), F.col(id_col).alias("__id"))
    ranked = rank_within(rows, ["__source"], ["__id"], "__rank").select(
        "__row", "__source", F.floor(F.col("__rank") / block).cast("long").alias("__block"), F.pmod("__rank", F.lit(block)).alias("__in")
    )
    kind = docs.schema[source_col].dataType
    if period is None:
        plan = exact_plan(wanted, counts, block)
        names = ("s", "k", "__slot", "__release", "__deadline", "start")
        columns = list(zip(*plan, strict=True)) or [()] * len(names)
        table = pa.table({n: pa.array(c, to_arrow_type(kind) if n == "s" else pa.int64()) for n, c in zip(names, columns, strict=True)})
        placed = F.broadcast(spark.createDataFrame(table))
        return ranked.join(placed, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__block") + 1 == F.col("k"))).select(
            "__row", "__source", "__block", "__release", "__deadline", "__slot", (F.col("start") + F.col("__in")).cast("long").alias("__position")
        )
    while period < 2 * len(wanted):
        period *= 2
    plan = spark.createDataFrame(
        schedule(quanta(wanted, period)) if wanted else [], f"s {kind.simpleString()}, k long, at long, release long, deadline long, quanta long"
    )
    shares = plan.groupBy("s").agg(F.first("quanta").alias("q"))
    a = ranked.join(F.broadcast(shares), F.col("__source").eqNullSafe(F.col("s"))).select("__row", "__source", "__block", "__in", F.col("q").alias("__q"))
    a = a.withColumn("__turn", F.floor(F.col("__block") / F.col("__q")).cast("long")).withColumn("__k", F.pmod("__block", "__q") + 1)
    slotted = a.join(F.broadcast(plan), F.col("__source").eqNullSafe(F.col("s")) & (F.col("__k") == F.col("k"))).select(
        "__row",
        "__source",
        "__block",
        "__in",
        "__turn",
        *[(F.col("__turn") * period + F.col(c)).alias(n) for c, n in (("at", "__slot"), ("release", "__release"), ("deadline", "__deadline"))],
    )
    sizes = slotted.groupBy("__turn", "__slot").agg(F.count(F.lit(1)).alias("n"))
    in_turn = Window.partitionBy("__turn").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each period of the schedule: the corpus divided by block * period
    turns = sizes.groupBy("__turn").agg(F.sum("n").alias("n"))
    before = turns.select(F.col("__turn").alias("u"), F.coalesce(F.sum("n").over(Window.orderBy("__turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("head"))
    starts = (
        sizes.select("__turn", F.col("__slot").alias("v"), F.coalesce(F.sum("n").over(in_turn), F.lit(0)).alias("inner"))
        .join(before, F.col("__turn") == F.col("u"))
        .select("v", (F.col("head") + F.col("inner")).alias("start"))
    )
    return slotted.join(starts, F.col("__slot") == F.col("v")).select(
        "__row", "__source", "__block", "__release", "__deadline", "__slot", (F.col("start") + F.col("__in")).cast("long").alias("__position")
    )


def mix_rows(docs: DataFrame, partitions: int | None = None, place_col: str | None = None, **options) -> DataFrame:
    """The rows of ``docs`` in mixed order: partitions, and so written files, follow each other in it.

    Files may be read again in another order; ``place_col`` adds the position as a column.
    """
    found = mixed(docs, **options).select("__row", "__position")
    dealt = found.repartitionByRange(partitions, "__position") if partitions else found.repartitionByRange("__position")
    return dealt.sortWithinPartitions("__position").select("__row.*", *([F.col("__position").alias(place_col)] if place_col else []))


def op9_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    found = mixed(docs)
    return found.select(
        "__row.doc_id", F.col("__source").alias("source"), *[F.col(f"__{c}").alias(c) for c in ("block", "release", "deadline", "slot", "position")]
    )
