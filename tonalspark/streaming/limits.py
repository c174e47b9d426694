"""Sliding-log rate limits over a stream of requests, and windows of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "client string, path string, ts timestamp, allowed boolean, retry_after double"


def decide(stamps: list[float], now: float, limit: int, window: float) -> tuple[list[float], bool, float | None]:
    """Drops stamps that have left the window; allows and notes a request if fewer than ``limit`` are left, else says how
    many seconds until the oldest leaves. A denied request isn't noted."""
    stamps = [t for t in stamps if t > now - window]
    if len(stamps) < limit:
        return [*stamps, now], True, None
    return stamps, False, stamps[0] + window - now


def rate_limited(requests: DataFrame, limit: int = 30, window: float = 60.0) -> DataFrame:
    """Decisions for a batch of requests (client, path, ts), each key's in order of time; a key's requests come sorted
    from the shuffle and stream through, and what is held is at most ``limit`` stamps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, stamps = None, []
        for rows in batches:
            allowed, after = [], []
            for client, path, ts in zip(rows["client"], rows["path"], rows["ts"]):
                if (client, path) != key:
                    key, stamps = (client, path), []
                stamps, ok, wait = decide(stamps, ts.timestamp(), limit, window)
                allowed.append(ok)
                after.append(wait)
            yield rows.assign(allowed=allowed, retry_after=pd.Series(after, dtype="float64", index=rows.index))

    dealt = requests.select("client", "path", "ts").repartition("client", "path").sortWithinPartitions("client", "path", "ts")
    return dealt.mapInPandas(run, OUT)


def rate_limited_stream(requests: DataFrame, limit: int = 30, window: float = 60.0) -> DataFrame:
    """The same for a streaming DataFrame with a watermark on ts: the state of a key is its stamps within the window, and
    goes when no request came for a window."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stamps = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts", ignore_index=True)
        allowed, after = [], []
        for ts in rows["ts"]:
            stamps, ok, wait = decide(stamps, ts.timestamp(), limit, window)
            allowed.append(ok)
            after.append(wait)
        state.update((stamps,))
        state.setTimeoutTimestamp(int((max(t.timestamp() for t in rows["ts"]) + window) * 1000) + 1)
        yield pd.DataFrame({"client": key[0], "path": key[1], "ts": rows["ts"], "allowed": allowed, "retry_after": pd.Series(after, dtype="float64", index=rows.index)})

    return requests.groupBy("client", "path").applyInPandasWithState(run, OUT, "stamps array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed(events: DataFrame, time: str, width: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """(start, keys, n, total) by tumbling windows; with ``late`` as a stream that waits so long for late rows."""
    source = events.withWatermark(time, late) if late else events
    return source.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """(key, start, end, n) of runs of events no further apart than ``gap``."""
    return events.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
