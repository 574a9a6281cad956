"""A streaming gap filler: keeps each animal's last fix and fills the gap when the next one comes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "animal_id string, time timestamp, x double, y double, filled boolean"
STATE = "t double, x double, y double"


def fill(fixes: DataFrame, fine_min: float, forget: str = "7 days") -> DataFrame:
    """Fixes (animal_id, time, x, y) and linear points between them at fine_min minutes.

    Fixes later than the watermark are dropped, as are those not after the last one
    kept; an animal without a fix for `forget` of event time starts anew.
    """
    keep_ms = pd.Timedelta(forget).value // 1_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("time")
        last = state.get if state.exists else None
        out = []
        for time, x, y in zip(rows["time"], rows["x"], rows["y"], strict=True):
            t = time.timestamp()
            if last and t <= last[0]:
                continue
            if last:
                n = max(1, round((t - last[0]) / (60 * fine_min)))
                out += [(key[0], pd.Timestamp(last[0] + (t - last[0]) * k / n, unit="s"), last[1] + (x - last[1]) * k / n, last[2] + (y - last[2]) * k / n, True) for k in range(1, n)]
            out.append((key[0], time, x, y, False))
            last = (t, float(x), float(y))
        if last:
            state.update(last)
            state.setTimeoutTimestamp(max(int(last[0] * 1000), state.getCurrentWatermarkMs()) + keep_ms)
        if out:
            yield pd.DataFrame(out, columns=["animal_id", "time", "x", "y", "filled"])

    marked = fixes.withWatermark("time", forget)
    return marked.groupBy("animal_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
