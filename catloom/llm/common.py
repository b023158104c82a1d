"""What the corpus operators share: the shared folder, ranks without one big task, components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: list[str] = []
#: A key with more than this share of the rows is joined by broadcast; so at most as many keys are broadcast as its inverse.
HOT = 1 / 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the warehouse; a session of one machine may use its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="catloom-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/catloom/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stash(df: DataFrame, name: str = "stash", compression: str | None = None, options: dict[str, str] | None = None, narrow: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and keeps the
    compressed columnar form, so that it is smaller than a checkpointed RDD.
    Row groups end by their size from the first row on: by default the writer
    looks after a hundred rows, and rows of some MB would all be held, and read
    back, as one group.

    ``narrow``: rows of a few numbers go to a file for each core, and not for
    each shuffle partition. Where Hadoop's native library is missing, its local
    file system starts a chmod process for each file and folder that it makes,
    which for a moment counts as a second executor of the same memory.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if narrow:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    df.write.options(**{"parquet.page.size.row.check.min": "1", **(options or {})}).parquet(path, compression=compression)
    again = spark.read.schema(df.schema).parquet(path)
    again._catloom_path = path
    return again


def discard(*frames: DataFrame) -> None:
    """Delete stashed frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_catloom_path", None)
        if path:
            spark = df.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def give_back() -> None:
    """Return freed memory of this Python process to the system.

    Spark keeps Python workers for later tasks. What Arrow's pool and the C
    library hold in reserve for them counts for the executor meanwhile, through
    all stages that run no Python.
    """
    pa.default_memory_pool().release_unused()
    # only glibc has it
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """``run``, a function from batches to batches, that gives memory back at a task's end."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def rank_within(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int = 256) -> DataFrame:
    """Add ``out``: a gapless rank from 0 within ``group``, without a task per group.

    The order is by a hash bucket of the ``order`` columns and then by those
    columns, so each group is dealt over ``buckets`` windows. Offsets come from
    the counts by group and bucket, which are ``buckets`` rows a group.
    Rows equal in all ``order`` columns are interchangeable; null groups are
    groups, null order values come first; an empty frame gives an empty result.
    """
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy(*order)))
    a, b = ranked.alias("a"), offsets.alias("b")
    same = F.col("a.__bucket") == F.col("b.__bucket")
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return a.join(b, same).select(*[F.col(f"a.{c}") for c in df.columns], (F.col("b.__before") + F.col("a.__rank") - 1).cast("long").alias(out))


def join_by_key(rows: DataFrame, found: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``found``, which has one row for each key and the number of its ``rows`` in ``count``.

    The rows of a key with more than ``HOT`` of all stay where they are: the at
    most ``1 / HOT`` rows of ``found`` for such keys are broadcast. Keys are not null.
    """
    least = total * HOT
    hot = F.broadcast(found.where(F.col(count) > least))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(found.where(F.col(count) <= least), keys)
    return rows.join(hot, keys).unionByName(cold)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)``: ``(node, component)``, the smallest node reached.

    Alternates large and small stars; each round is stashed in the shared
    folder. No adjacency list is ever collected: stars are joins against the
    smallest neighbour of each node, and hubs are joined by broadcast. An empty
    frame gives an empty result; nodes without an edge are not in the result;
    null nodes have no edges, repeated edges count once.
    """
    stars = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", narrow=True)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())

    seen = state(stars)
    for _ in range(rounds):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        near = join_by_key(both, least, ["u"], "n", 2 * seen[0])
        large = stash(near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large", narrow=True)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_by_key(large, least, ["u"], "n", seen[0])
        small = joined.select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = stash(small.where("u <> v").distinct(), "small", narrow=True)
        discard(stars, large)
        now, stars = state(after), after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
