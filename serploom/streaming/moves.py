"""An extension: rank moves from a stream of result captures, with the last rank per keyword and domain as state."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from serploom.shipping import ship

OUT = "keyword string, domain string, ts timestamp, before_rank int, after_rank int, status string"


def unique_captures(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per (keyword, domain, ts) within the watermark; later repeats go."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["keyword", "domain", "ts"])


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, keep_ms: int = 0) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # a domain that hasn't been captured for so long is entered anew when it comes back
        state.remove()
        return
    last, seen = state.get if state.exists else (None, None)
    out = []
    for r in pd.concat(list(batches)).sort_values("ts").itertuples():
        if seen is not None and r.ts.value <= seen:
            continue  # late: a newer capture has been told already
        now = int(r.rank)
        status = "entered" if last is None else "up" if now < last else "down" if now > last else "same"
        out.append((key[0], key[1], r.ts, last, now, status))
        last, seen = now, r.ts.value
    state.update((last, seen))
    state.setTimeoutTimestamp(max(seen // 1_000_000, state.getCurrentWatermarkMs()) + keep_ms)
    frame = pd.DataFrame(out, columns=["keyword", "domain", "ts", "before_rank", "after_rank", "status"])
    frame["before_rank"] = frame["before_rank"].astype("Int32")
    frame["after_rank"] = frame["after_rank"].astype("Int32")
    yield frame


def move_stream(stream: DataFrame, delay: str = "1 day", keep_days: int = 400) -> DataFrame:
    """stream: keyword, domain, ts, rank. One row for each capture of a domain, against its last rank, which is kept for ``keep_days`` behind the watermark."""
    ship(stream.sparkSession)
    grouped = stream.select("keyword", "domain", "ts", "rank").withWatermark("ts", delay).groupBy("keyword", "domain")
    step = partial(_step, keep_ms=keep_days * 86_400_000)
    return grouped.applyInPandasWithState(step, OUT, "last int, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def activity(stream: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Windowed counts of captures per keyword, closed by the watermark."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "keyword").agg(F.count("*").alias("captures"), F.approx_count_distinct("domain").alias("domains"))
