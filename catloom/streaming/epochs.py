"""Periodic durable output: a stream that commits its rows by epoch.

Each micro-batch is a folder ``epoch=N`` and counts once its ``_SUCCESS`` marker
is there, which Spark's committer writes last. A batch that is run again after
a failure, from the stream's own checkpoint, overwrites its folder. So readers
see each row once: not rows of a half-written epoch, and not a batch twice.

The size of an epoch is the source's: ``maxFilesPerTrigger`` and the like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from catloom.shared import new_path


def epoch_writer(stream: DataFrame, path: str, checkpoint: str, done: Callable[[int], None] | None = None) -> DataStreamWriter:
    """A writer of epochs below ``path``; ``done`` is called with the number of each after it is committed."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={number}")
        if done is not None:
            done(number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def write_epochs(stream: DataFrame, path: str, checkpoint: str, done: Callable[[int], None] | None = None) -> StreamingQuery:
    """Write all that is there as epochs, then end."""
    query = epoch_writer(stream, path, checkpoint, done).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the epochs that are whole."""
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*/_SUCCESS")
    fs = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getParent().getName().removeprefix("epoch=")) for s in fs.globStatus(found) or [])


def read_epochs(spark: SparkSession, path: str, schema: str, after: int = -1) -> DataFrame:
    """The rows of the whole epochs numbered above ``after``, with their ``epoch``."""
    paths = [f"{path}/epoch={n}" for n in committed(spark, path) if n > after]
    typed = f"{schema}, epoch int"
    if not paths:
        return spark.createDataFrame([], typed)
    return spark.read.schema(typed).option("basePath", path).parquet(*paths)


def epochs_of(stream: DataFrame, name: str = "epochs") -> DataFrame:
    """All rows of a stream over what is there now, through epochs in the shared folder."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    write_epochs(stream, f"{path}/rows", f"{path}/state")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return read_epochs(spark, f"{path}/rows", fields)
