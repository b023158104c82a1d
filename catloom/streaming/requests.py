"""Request logs as streams (extension): dedupe across arrivals, and adaptive limits as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from catloom.operators.requests import adjusted
from catloom.shipping import ship_package


def first_arrivals(stream: DataFrame, key: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key once; state is kept for the watermark's span only."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def limiter(stream: DataFrame, key: str, order: str, start: int = 60, most: int = 120, rule: str = "standard", size: int = 10) -> DataFrame:
    """``key, block, rpm`` after each whole block; state is six numbers a key."""
    ship_package(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rpm, block, n, errors, limited = state.get if state.exists else (start, 0, 0, 0, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        for e, lim in zip(rows["error"], rows["limited"], strict=True):
            n, errors, limited = n + 1, errors + int(e), limited + int(lim)
            if n == size:
                rpm = adjusted(rpm, errors, limited, n, rule, most)
                out.append((k[0], block, rpm))
                block, n, errors, limited = block + 1, 0, 0, 0
        state.update((rpm, block, n, errors, limited))
        yield pd.DataFrame(out, columns=[key, "block", "rpm"])

    return stream.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, block int, rpm int", "rpm int, block int, n int, errors int, limited int", "append", GroupStateTimeout.NoTimeout
    )
