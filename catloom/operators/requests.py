"""Ordered request logs: windows, queues, retries, limiters, session pools, watchdogs.

Counts over time are windows. What depends on every earlier outcome is a fold
over sorted rows that stream by; where a rule goes by blocks of requests, the
blocks are reduced first and the fold has a row for each block and key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from catloom.operators.ranks import global_positions

#: Limiter rules: (least 429s, factor, floor), (least error rate, factor, floor), (rate below, factor); fixed values.
ADAPTIVE = {
    "standard": {"many": (2, 0.5, 20), "errors": (0.2, 0.7, 30), "calm": (0.05, 1.1)},
    "careful": {"many": (2, 0.3, 15), "errors": (0.2, 0.6, 20), "calm": (0.05, 1.05)},
}


def micros(log: DataFrame, ts: str) -> Column:
    """A time column in microseconds; without a zone it counts as it stands."""
    if log.schema[ts].dataType.simpleString() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(F.col(ts))


def trailing_count(log: DataFrame, key: list[str], ts: str = "ts", seconds: int = 60, out: str = "in_window", spans: int = 10) -> DataFrame:
    """Requests of a key in the trailing window, the row included.

    Time is cut into slices of ``spans`` windows, and a key's slices are
    windowed apart, so that one key is spread over many tasks. Each slice also
    gets the rows of the last window of the slice before it, which only count:
    one row in ``spans`` is sent twice. Rows without time count each other.
    """
    step = int(seconds) * 1_000_000
    at, width = micros(log, ts), step * int(spans)
    own = F.floor(at / width).cast("long")
    place = lambda n, counts: F.struct(n.alias("__slice"), F.lit(counts).alias("__own"))
    halo = F.when(at >= (own + 1) * width - step, F.array(place(own, True), place(own + 1, False))).otherwise(F.array(place(own, True)))
    rows = log.select("*", F.inline(halo))
    by = ", ".join(f"`{k}`" for k in [*key, "__slice"])
    window = f"PARTITION BY {by} ORDER BY `{ts}` RANGE BETWEEN INTERVAL {int(seconds)} SECONDS PRECEDING AND CURRENT ROW"
    counted = log.sparkSession.sql(f"SELECT *, count(*) OVER ({window}) AS `{out}` FROM {{rows}}", rows=rows)
    return counted.where("__own").drop("__slice", "__own")


def blocks(log: DataFrame, key: list[str], order: list[str], size: int = 10) -> DataFrame:
    """Whole non-overlapping blocks of ``size`` requests of a key: ``block, requests, errors, limited``.

    ``log`` has ``error`` (any failure but a 429) and ``limited`` (a 429) as booleans. The last, short block is left out.
    """
    at = Window.partitionBy(*key).orderBy(*order)
    rows = log.withColumn("block", F.floor((F.row_number().over(at) - 1) / size).cast("int"))
    out = rows.groupBy(*key, "block").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.col("error").cast("int")).alias("errors"), F.sum(F.col("limited").cast("int")).alias("limited")
    )
    return out.where(F.col("requests") == size)


def adjusted(rpm: int, errors: int, limited: int, requests: int, rule: str, most: int) -> int:
    """Requests a minute after a block, by its outcome."""
    many, bad, calm = (ADAPTIVE[rule][k] for k in ("many", "errors", "calm"))
    rate = (errors + limited) / requests
    if limited > many[0]:
        return max(many[2], int(rpm * many[1]))
    if rate > bad[0]:
        return max(bad[2], int(rpm * bad[1]))
    if rate < calm[0] and limited == 0:
        return min(most, int(rpm * calm[1]))
    return rpm


def paced(pps: float, errors: int, limited: int, requests: int) -> float:
    """Requests a second after a block."""
    good = (requests - errors - limited) / requests
    if limited / requests > 0.2:
        pps *= 0.5
    elif good < 0.85:
        pps *= 0.8
    elif good >= 0.95 and limited == 0:
        pps *= 1.1
    return min(max(pps, 0.3), 1.2)


def fold_rows(rows: DataFrame, key: list[str], order: list[str], out: str, inputs: list[str], begin: Callable[[], object], step: Callable) -> DataFrame:
    """``rows`` with the column ``out`` (name and type), row-by-row state of each key in order.

    ``step(state, *inputs)`` gives the next state and the row's value;
    ``begin()`` is a key's first state. Rows are dealt by key and sorted, and
    stream through Arrow batches, so a task holds one state and one batch
    however long a key's history is.
    """
    from catloom.shipping import ship_package

    ship_package(rows.sparkSession)
    name, kind = out.split(" ", 1)
    arrow, spark_type = {"int": (pa.int32(), IntegerType()), "double": (pa.float64(), DoubleType())}[kind]
    dealt = rows.repartition(*key).sortWithinPartitions(*key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            keys = zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in key], strict=True)
            values = zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs], strict=True)
            made = []
            for k, v in zip(keys, values, strict=True):
                if k != now:
                    now, state = k, begin()
                state, value = step(state, *v)
                made.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], names=[*batch.schema.names, name])

    return dealt.mapInArrow(run, StructType([*dealt.schema.fields]).add(name, spark_type))


def limiter_fold(log: DataFrame, key: list[str], order: list[str], start: int = 60, most: int = 120, rule: str = "standard", size: int = 10) -> DataFrame:
    """``key, block, rpm``: the rate after each whole block; a last, short block changes nothing."""

    def step(rpm, errors, limited, requests):
        rpm = adjusted(rpm, errors, limited, requests, rule, most)
        return rpm, rpm

    return fold_rows(blocks(log, key, order, size), key, ["block"], "rpm int", ["errors", "limited", "requests"], lambda: start, step).select(*key, "block", "rpm")


def pace_fold(log: DataFrame, key: list[str], order: list[str], start: float = 1.0, size: int = 10) -> DataFrame:
    """Requests a second by whole block: halved over 20 % limited, 0.8 under 85 % success, 1.1 from 95 % without a limit; 0.3 to 1.2."""

    def step(pps, errors, limited, requests):
        pps = paced(pps, errors, limited, requests)
        return pps, pps

    return fold_rows(blocks(log, key, order, size), key, ["block"], "pps double", ["errors", "limited", "requests"], lambda: start, step).select(*key, "block", "pps")


def token_bucket(log: DataFrame, key: list[str], order: list[str], at: str, rate: float) -> DataFrame:
    """``log`` with ``wait_s``: capacity is the rate, refill by elapsed seconds (column ``at``), an empty bucket waits."""

    def step(state, now):
        tokens, last = state
        tokens = min(rate, tokens + (now - last) * rate) if last is not None else rate
        wait = (1 - tokens) / rate if tokens < 1 else 0.0
        return (max(tokens - 1, 0.0), now + wait), wait

    return fold_rows(log, key, order, "wait_s double", [at], lambda: (rate, None), step)


def leaky_bucket(log: DataFrame, key: list[str], order: list[str], at: str, rate: float, retry_after: str | None = None) -> DataFrame:
    """``log`` with ``slot_s``: evenly spaced slots with a seeded spread of 20 %; a retry hint pushes the next slot."""
    import zlib

    def step(state, now, hint=None):
        k, following = state
        slot = now if following is None else max(now, following)
        spread = 0.8 + 0.4 * (zlib.crc32(str(k).encode()) % 1000) / 1000
        following = slot + spread / rate
        if hint is not None and hint == hint:
            following = max(following, slot + hint)
        return (k + 1, following), slot

    return fold_rows(log, key, order, "slot_s double", [at, *([retry_after] if retry_after else [])], lambda: (0, None), step)


def session_pool(log: DataFrame, key: list[str], order: list[str], ok: str, size: int = 5) -> DataFrame:
    """``log`` with ``session``: turns among unblocked sessions; a failure adds an error, a success takes one; over 3 block."""

    def step(state, good):
        errors, blocked, turn = state
        for ahead in range(size):
            own = (turn + ahead) % size
            if not blocked[own]:
                turn = (own + 1) % size
                break
        else:
            own = errors.index(min(errors))
            blocked[own], errors[own] = False, 0
        if good:
            errors[own] = max(0, errors[own] - 1)
        else:
            errors[own] += 1
            blocked[own] = errors[own] > 3
        return (errors, blocked, turn), own

    return fold_rows(log, key, order, "session int", [ok], lambda: ([0] * size, [False] * size, 0), step)


def queue_order(requests: DataFrame, key: str, priority: str, seq: str) -> DataFrame:
    """Each key once (its first request), with ``turn``: high priority first, then first in."""
    first = requests.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(seq))).where("__r = 1").drop("__r")
    return global_positions(first, [F.desc(priority), F.col(seq)], "turn")


def retried_queue(requests: DataFrame, outcomes: DataFrame, key: str, priority: str, seq: str, most: int = 3) -> DataFrame:
    """``key, attempt, ok, last, turn``: a queue that puts failed requests back at the end of their priority, ``most`` times at most.

    ``outcomes`` has ``key, attempt, ok`` (attempts from 0). All of one priority
    are tried before any is tried again, and higher priorities always go first,
    so turns are the order by priority, attempt and arrival.
    """
    first = requests.groupBy(key).agg(F.min_by(F.struct(F.col(priority).alias("p"), F.col(seq).alias("s")), seq).alias("r"))
    done = outcomes.where("ok").groupBy(key).agg(F.min("attempt").alias("__done"))
    tried = outcomes.join(first, key).join(done, key, "left").where(F.col("attempt") <= F.least(F.coalesce("__done", F.lit(most)), F.lit(most)))
    last = F.col("ok") | (F.col("attempt") == most)
    rows = tried.select(key, "attempt", "ok", last.alias("last"), F.col("r.p").alias("__priority"), F.col("r.s").alias("__seq"))
    return global_positions(rows, [F.desc("__priority"), F.col("attempt"), F.col("__seq")], "turn").drop("__priority", "__seq")


def queue_counters(turns: DataFrame) -> DataFrame:
    """One row ``completed, failed, retried`` of a ``retried_queue``."""
    return turns.agg(F.count_if("ok").alias("completed"), F.count_if(~F.col("ok") & F.col("last")).alias("failed"), F.count_if(~F.col("ok") & ~F.col("last")).alias("retried"))


def batch_summaries(log: DataFrame, key: list[str], order: list[str], size_col: str, batch: int = 10) -> DataFrame:
    """``key, batch, requests, succeeded, bytes, total_bytes``: sums by batch of a key, and bytes so far."""
    at = Window.partitionBy(*key).orderBy(*order)
    rows = log.withColumn("batch", F.floor((F.row_number().over(at) - 1) / batch).cast("int"))
    sums = rows.groupBy(*key, "batch").agg(F.count(F.lit(1)).alias("requests"), F.count_if("ok").alias("succeeded"), F.sum(size_col).alias("bytes"))
    return sums.withColumn("total_bytes", F.sum("bytes").over(Window.partitionBy(*key).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)))


def retry_outcome(attempts: DataFrame, key: list[str], order: list[str], ok: str, most: int = 3) -> DataFrame:
    """``key, attempts, succeeded, waited_s``: up to ``most`` tries, ending at the first success; waits are 2, 4, 8, ..."""
    at = Window.partitionBy(*key).orderBy(*order)
    rows = attempts.withColumn("__a", F.row_number().over(at)).withColumn("__good", F.sum(F.col(ok).cast("int")).over(at.rowsBetween(Window.unboundedPreceding, -1)))
    used = rows.where((F.col("__a") <= most) & (F.coalesce("__good", F.lit(0)) == 0))
    return used.groupBy(*key).agg(F.count(F.lit(1)).alias("attempts"), F.max_by(F.col(ok), "__a").alias("succeeded")).withColumn(
        "waited_s", F.pow(F.lit(2), F.col("attempts")).cast("long") - 2
    )


def backoff(attempt: Column, kind: str = "double", draw: Column | None = None) -> Column:
    """Seconds before the next try: ``double`` 2^n, ``gentle`` min(8, 1.6^n + 0.6 u), ``capped`` min(60, 2^n (1 + 2 u)), ``flat`` 0.5."""
    u = draw if draw is not None else F.lit(0.0)
    return {
        "double": F.pow(F.lit(2.0), attempt),
        "gentle": F.least(F.lit(8.0), F.pow(F.lit(1.6), attempt) + 0.6 * u),
        "capped": F.least(F.lit(60.0), F.pow(F.lit(2.0), attempt) * (1 + 2 * u)),
        "flat": F.lit(0.5) + attempt * 0,
    }[kind]


def retry_after(header: Column, observed: Column) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date against the time it was seen."""
    date = F.try_to_timestamp(F.substring(header, 6, 100), F.lit("dd MMM yyyy HH:mm:ss z"))
    ahead = (F.unix_seconds(date) - F.unix_seconds(observed)).cast("double")
    return F.coalesce(header.try_cast("double"), F.when(ahead > 0, ahead).when(ahead <= 0, 0.0))


def watchdog(log: DataFrame, key: list[str], order: list[str], seconds: str, limit: float, every: int = 10, least: int = 10) -> DataFrame:
    """The first check of a key whose running mean is over the limit: ``key, at_request, mean_s``."""
    at = Window.partitionBy(*key).orderBy(*order)
    rows = log.withColumn("n", F.row_number().over(at)).withColumn("mean_s", F.avg(seconds).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    bad = rows.where((F.col("n") >= least) & (F.col("n") % every == 0) & (F.col("mean_s") > limit))
    return bad.groupBy(*key).agg(F.min("n").alias("at_request"), F.min_by("mean_s", "n").alias("mean_s"))
