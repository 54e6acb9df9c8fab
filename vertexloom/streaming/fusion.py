"""Occupancy with decay over a stream: state by voxel, late rows dropped by the watermark, voxels forgotten when stale."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "x long, y long, z long, l double, last double, n long"
STATE = "l double, last double, n long"


def _fold(rate: float, low: float, high: float, max_age: float | None):
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        l, last, n = state.get if state.exists else (0.0, None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        for t, occupied, p in zip(rows["ts"].astype("int64") / 10 ** (9 if rows["ts"].dtype.str.endswith("[ns]") else 6), rows["occupied"], rows["confidence"], strict=True):
            d = math.log(p / (1 - p)) * (1 if occupied else -1)
            l = max(low, min(high, l * (math.exp(-rate * (t - last)) if last is not None else 1.0) + d))
            last, n = t, n + 1
        state.update((l, last, n))
        if max_age is not None:
            state.setTimeoutTimestamp(max(int(last * 1000 + max_age * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"x": [key[0]], "y": [key[1]], "z": [key[2]], "l": [l], "last": [last], "n": [n]})

    return step


def temporal_stream(rows: DataFrame, rate: float, late: str = "1 hour", max_age: float | None = None, low: float = -3.466, high: float = 3.466) -> DataFrame:
    """Streaming observations (x, y, z, ts, seq, occupied, confidence) to the state of each voxel that changed."""
    timeout = GroupStateTimeout.NoTimeout if max_age is None else GroupStateTimeout.EventTimeTimeout
    return rows.withWatermark("ts", late).groupBy("x", "y", "z").applyInPandasWithState(_fold(rate, low, high, max_age), OUT, STATE, "update", timeout)


def density_stream(rows: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by voxel and window of event time; late rows beyond the watermark are dropped."""
    from pyspark.sql import functions as F

    return rows.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "x", "y", "z").agg(F.count("*").alias("n"))
