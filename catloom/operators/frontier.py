"""A crawl frontier that goes on from where the last run ended.

The state is a folder in shared storage that has for each run the nodes that it
reached, round by round, and the edges whose source nobody has reached yet. A run reads the new edges and those that wait, never the ones that earlier
runs have followed. It counts once its marker is written; a run that died is
begun anew over its leavings.

What earlier runs visited is cut down once for each run to what the run's edges
can touch: a Bloom filter over their ends, of at most ``BITS`` bits, is
broadcast to the visited nodes. It only spares work: what passes is joined
exactly.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter; two are set for each value, so 16 million values fill a fifth of it. Broadcast as up to 4,096 rows of 4 KB.
BITS = 1 << 27
#: Bits of one row of a filter, as Spark's bitmap functions have it.
ROW = 1 << 15


def _places(value: Column, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(value, F.lit(k)), F.lit(bits)) + 1 for k in range(2)])


def bloom(values: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """``__row, __bitmap``: a Bloom filter over a column in rows of 4 KB, at most ``bits / 32768`` of them."""
    at = values.select(F.explode(_places(F.col(column), bits)).alias("p"))
    return at.groupBy(F.bitmap_bucket_number("p").alias("__row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bitmap"))


def maybe_in(frame: DataFrame, column: str, filter_rows: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows whose value may be in the filter; never leaves out one that is. Nulls are left out."""
    places = _places(F.col(column), bits)
    out = frame.where(F.col(column).isNotNull())
    for k in range(2):
        byte = F.conv(F.hex(F.expr("substring(__bitmap, cast(__bit div 8 AS int) + 1, 1)")), 16, 10).cast("int")
        held = out.withColumn("__bit", F.bitmap_bit_position(places[k])).join(F.broadcast(filter_rows), F.bitmap_bucket_number(places[k]) == F.col("__row"))
        out = held.withColumn("__byte", byte).where("getbit(__byte, cast(__bit % 8 AS int)) = 1").select(*frame.columns)
    return out


class Frontier:
    """The runs below ``path``, over nodes of one type."""

    def __init__(self, spark: SparkSession, path: str, node_type: str = "long", bits: int = BITS):
        self.spark, self.path, self.type, self.bits = spark, path.rstrip("/"), node_type, bits

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def runs(self) -> int:
        """How many runs are done."""
        return next(n for n in count() if not self._exists(f"{self.path}/done/run={n}"))

    def visited(self) -> DataFrame:
        """``node, run, round`` of all that was reached, each node once."""
        schema = f"node {self.type}, run int, round int"
        paths = [f"{self.path}/visited/run={n}" for n in range(self.runs())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/visited").parquet(*paths)

    def waiting(self) -> DataFrame:
        """``src, dst``: edges whose source is not reached."""
        n, schema = self.runs(), f"src {self.type}, dst {self.type}"
        return self.spark.read.schema(schema).parquet(f"{self.path}/waiting/run={n - 1}") if n else self.spark.createDataFrame([], schema)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _stash(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def advance(self, edges: DataFrame, seeds: DataFrame | None = None) -> int:
        """Follow new ``edges(src, dst)`` from all that is reached and from new ``seeds(node)``; the number of nodes that are new.

        Null ends lead nowhere; repeated edges and cycles end; an empty frame
        of edges or seeds adds nothing.
        """
        run = self.runs()
        work, reached, waiting = (f"{self.path}/{part}/run={run}" for part in ("work", "visited", "waiting"))
        self._delete(reached)
        typed = edges.select(F.col("src").cast(self.type).alias("src"), F.col("dst").cast(self.type).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
        mine = self._stash(typed.union(self.waiting()).distinct(), f"{work}/edges")
        starts = seeds.select(F.col("node").cast(self.type).alias("node")).where("node IS NOT NULL") if seeds is not None else self.spark.createDataFrame([], f"node {self.type}")
        ends = mine.select(F.col("src").alias("node")).union(mine.select("dst")).union(starts)
        sieve = self._stash(bloom(ends, "node", self.bits), f"{work}/sieve")
        old = self._stash(maybe_in(self.visited().select("node"), "node", sieve, self.bits), f"{work}/touched")
        known = old
        found = mine.join(old, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).union(starts)
        total = 0
        for k in count():
            new = self._stash(found.distinct().join(known, "node", "left_anti"), f"{reached}/round={k}")
            n = new.count()
            total += n
            if not n:
                break
            known = known.union(new)
            found = mine.join(new, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node"))
        mine.join(known, F.col("src") == F.col("node"), "left_anti").write.mode("overwrite").parquet(waiting)
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done/run={run}")
        done.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(done, True).close()
        self._delete(work)
        return total
