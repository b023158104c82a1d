"""Dedupe across arrivals with keyed state that outlives a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from catloom.shipping import by_value, ship_package

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Windows of a key that share a list of state: a list is read and extended once a batch, and stays this short.
SPAN = 256


class FirstInWindow(StatefulProcessor):
    """Which windows of a key and span were seen; each is forgotten ``ttl_ms`` after it was."""

    def __init__(self, key: str, ttl_ms: int):
        self.key, self.ttl_ms = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "w long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # each call of the state is a round trip to the JVM: two for a key and span, however many windows it has
        asked = dict.fromkeys(int(w) for frame in rows for w in frame.iloc[:, -1].unique())
        known = {w for (w,) in self.seen.get()}
        out = [w for w in asked if w not in known]
        if out:
            self.seen.appendList([(w,) for w in out])
            yield pd.DataFrame({self.key: [key[0]] * len(out), "window_s": out})

    def close(self) -> None:
        pass


def first_in_window(stream: DataFrame, key: str, ts: str = "ts", seconds: int = 3600, ttl_seconds: int | None = None) -> DataFrame:
    """``key, window_s``: each key once for each window of event time (its start in seconds), in whatever order and however late its rows arrive.

    No watermark drops a row. State is kept for ``ttl_seconds`` of processing
    time after a window was first seen, for ever without; a window that is seen
    again after that counts anew. Needs RocksDB as the session's state store.
    Rows without time are left out; a null key is a key.
    """
    spark = stream.sparkSession
    ship_package(spark)
    by_value(__name__)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kind = stream.schema[key].dataType.simpleString()
    width = int(seconds)
    # a time without zone counts as it stands, whatever the session's zone
    zoneless = stream.schema[ts].dataType.simpleString() == "timestamp_ntz"
    at = F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts}`)") if zoneless else F.unix_seconds(F.col(ts))
    window = (F.floor(at / width) * width).cast("long")
    span = F.floor(window / (width * SPAN)).alias("__span")
    rows = stream.where(F.col(ts).isNotNull()).select(F.col(key), span, window.alias("__w"))
    if ttl_seconds is None:
        # nothing is forgotten: Spark's own state by key and window, without a round trip to Python
        return rows.select(F.col(key), F.col("__w").alias("window_s")).dropDuplicates([key, "window_s"])
    processor = FirstInWindow(key, ttl_seconds * 1000)
    return rows.groupBy(key, "__span").transformWithStateInPandas(processor, f"`{key}` {kind}, window_s long", "Append", "ProcessingTime")
