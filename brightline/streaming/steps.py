"""Stateful steps on streams: duplicates, tumbling and session windows, and chains of revisions. All state is bounded by the watermark or by the keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def without_repeats(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key; keys are forgotten when the watermark is `late` past them."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(stream: DataFrame, keys: list[str], time: str, width: str, late: str) -> DataFrame:
    """Rows of each window and key; rows that come later than `late` are left out."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.unix_seconds("w.start").alias("start_s"), "n")


def session_counts(stream: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """Rows of each session of a key that ends with a gap."""
    w = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.unix_seconds("w.start").alias("start_s"), "n")


def numbered(stream: DataFrame, key: str, time: str, row: str, late: str) -> DataFrame:
    """Each row with its number in its key's chain, in order of time, ties by row: columns key, row, version. Rows may come in any order of files.

    A row waits in its key's state until the watermark, `late` behind the latest time seen, has passed it; then all that could come before it is
    there. Rows that come later than that are left out. The state of a key is the last number, and the times and numbers of the rows that wait (row is a
    whole number), no more than `late` holds.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = (state.get[0], np.frombuffer(state.get[1], np.int64).reshape(-1, 2)) if state.exists else (0, np.zeros((0, 2), np.int64))
        new = [np.column_stack((b[time].to_numpy("datetime64[us]").astype(np.int64), b[row].to_numpy(np.int64))) for b in batches if len(b)]
        waiting = np.concatenate([waiting, *new])
        waiting = waiting[np.lexsort((waiting[:, 1], waiting[:, 0]))]
        ready = int(np.searchsorted(waiting[:, 0], state.getCurrentWatermarkMs() * 1000, "right"))
        state.update((last + ready, waiting[ready:].tobytes()))
        if ready < len(waiting):
            state.setTimeoutTimestamp(int(waiting[ready, 0] // 1000) + 1)
        yield pd.DataFrame({key: k[0], row: waiting[:ready, 1], "version": np.arange(last + 1, last + ready + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = f"{key} {kinds[key]}, {row} {kinds[row]}, version long"
    rows = stream.select(key, time, row).withWatermark(time, late).where(F.col(row).isNotNull() | F.col(key).isNull())
    rows = rows.withColumn(row, F.coalesce(row, F.lit(0)))
    return rows.groupBy(key).applyInPandasWithState(run, out, "last long, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
