"""Endless play queues and a cache with a time to live, as state of a stream and as a batch over the same rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Songs that a queue gets at once, how near its end that happens, and how many of its last songs are left out when more are asked for.
MORE, AHEAD, RECENT = 14, 3, 120
#: Candidates of a seed that can ever be asked for.
POOL = MORE + RECENT

PLAYED = "session long, event_id long, ts timestamp, song_idx long, added int, exhausted boolean"
CACHED = "key string, event_id long, ts timestamp, hit boolean, made_at timestamp"


class Queue:
    """A session's queue: the songs, the place of the one that plays, and whether the seed has no more."""

    def __init__(self, songs: list[int], at: int = 0, exhausted: bool = False):
        self.songs, self.at, self.exhausted = songs, at, exhausted

    def topped_up(self, pool: list[int]) -> int:
        """Near the end: the first MORE of the seed's songs that aren't among the RECENT last ones, if new to the queue. Without
        any the seed is exhausted, and the queue will begin again."""
        if self.exhausted or self.at < len(self.songs) - AHEAD:
            return 0
        recent = set(self.songs[-RECENT:])
        fresh = [s for s in pool if s not in recent][:MORE]
        new = [s for s in fresh if s not in set(self.songs)]
        self.songs += new
        self.exhausted = not new
        return len(new)

    def advance(self) -> None:
        self.at = (self.at + 1) % len(self.songs)


def _played(queue: Queue | None, pool: list[int], rows: pd.DataFrame) -> tuple[Queue, list[int], pd.DataFrame]:
    """What each event of a session plays; its first event, or one with a pool of its own, starts a queue with the seed."""
    song, added, exhausted = [], [], []
    for seed, own in zip(rows["seed"], rows["pool"]):
        if queue is None or own is not None and len(own):
            queue, pool = Queue([int(seed)]), [int(x) for x in own] if own is not None else []
        else:
            queue.advance()
        added.append(queue.topped_up(pool))
        song.append(queue.songs[queue.at])
        exhausted.append(queue.exhausted)
    out = rows[["session", "event_id", "ts"]].assign(song_idx=song, added=added, exhausted=exhausted)
    return queue, pool, out


def played(events: DataFrame) -> DataFrame:
    """(session, event_id, ts, song_idx, added, exhausted) of events (session, event_id, ts, seed, pool), each a song that begins:
    a session's first event, or any with a pool (ranked candidates, POOL of them at most), starts its queue with the seed.

    Sessions come sorted from the shuffle and stream through; what is held is one queue, whose length RECENT and MORE bound.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, queue, pool = None, None, []
        for rows in batches:
            for key, part in rows.groupby("session", sort=False):
                if key != session:
                    session, queue, pool = key, None, []
                queue, pool, out = _played(queue, pool, part)
                yield out

    dealt = events.select("session", "event_id", "ts", "seed", "pool").repartition("session").sortWithinPartitions("session", "ts", "event_id")
    return dealt.mapInPandas(run, PLAYED)


class _Radio(StatefulProcessor):
    """List state for the queue and the pool, value state for the place, and a timer that forgets a session that is idle."""

    def __init__(self, idle: float):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.songs, self.pool = handle.getListState("songs", "song long"), handle.getListState("pool", "song long")
        self.place = handle.getValueState("place", "at int, exhausted boolean")
        self.ends = handle.getValueState("ends", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["ts", "event_id"], ignore_index=True)
        queue, pool = None, []
        if self.place.exists():
            at, exhausted = self.place.get()
            queue, pool = Queue([x[0] for x in self.songs.get()], at, exhausted), [x[0] for x in self.pool.get()]
        before = len(pool)
        queue, pool, out = _played(queue, pool, rows)
        self.songs.put([(s,) for s in queue.songs])
        if pool and (before != len(pool) or any(p is not None and len(p) for p in rows["pool"])):
            self.pool.put([(s,) for s in pool])
        self.place.update((queue.at, queue.exhausted))
        if self.ends.exists():
            self.handle.deleteTimer(self.ends.get()[0])
        ms = int(rows["ts"].max().timestamp() * 1000 + self.idle * 1000)
        self.handle.registerTimer(ms)
        self.ends.update((ms,))
        yield out

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        for state in (self.songs, self.pool, self.place, self.ends):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def played_stream(events: DataFrame, idle: float = 86_400.0) -> DataFrame:
    """The same for a streaming DataFrame with a watermark on ts: a queue lives in the state store, survives restarts from the
    checkpoint, and goes when a session has been idle for so many seconds. Within a micro-batch events count in order of time."""
    dealt = events.select("session", "event_id", "ts", "seed", "pool").groupBy("session")
    return dealt.transformWithStateInPandas(statefulProcessor=_Radio(idle), outputStructType=PLAYED, outputMode="Append", timeMode="EventTime")


def _cached(made: float | None, rows: pd.DataFrame) -> tuple[float, float, pd.DataFrame]:
    """Which requests of a key find a value that hasn't expired; others make it anew, with the time to live that they ask for."""
    hits, stamps, until = [], [], None
    for ts, ttl in zip(rows["ts"], rows["ttl_s"]):
        now = ts.timestamp()
        hit = made is not None and now < made + ttl
        made = made if hit else now
        until = made + ttl
        hits.append(hit)
        stamps.append(pd.Timestamp(made, unit="s"))
    return made, until, rows[["key", "event_id", "ts"]].assign(hit=hits, made_at=pd.Series(stamps, dtype="datetime64[ns]", index=rows.index).dt.round("us"))


def cached(requests: DataFrame) -> DataFrame:
    """(key, event_id, ts, hit, made_at) of requests (key, event_id, ts, ttl_s): a request finds what an earlier one has made less
    than ``ttl_s`` seconds before; else it makes it. A key's requests stream through in order of time; one stamp is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, made = None, None
        for rows in batches:
            for k, part in rows.groupby("key", sort=False):
                if k != key:
                    key, made = k, None
                made, _, out = _cached(made, part)
                yield out

    dealt = requests.select("key", "event_id", "ts", "ttl_s").where("key IS NOT NULL").repartition("key").sortWithinPartitions("key", "ts", "event_id")
    return dealt.mapInPandas(run, CACHED)


class _Cache(StatefulProcessor):
    """A value's time in state; a timer removes it when it has expired, so the store holds live keys alone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made, self.ends = handle.getValueState("made", "at double"), handle.getValueState("ends", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["ts", "event_id"], ignore_index=True)
        made, until, out = _cached(self.made.get()[0] if self.made.exists() else None, rows)
        self.made.update((made,))
        if self.ends.exists():
            self.handle.deleteTimer(self.ends.get()[0])
        ms = int(until * 1000) + 1
        self.handle.registerTimer(ms)
        self.ends.update((ms,))
        yield out

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.made.clear()
        self.ends.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached_stream(requests: DataFrame) -> DataFrame:
    """The same for a streaming DataFrame with a watermark on ts."""
    dealt = requests.select("key", "event_id", "ts", "ttl_s").groupBy("key")
    return dealt.transformWithStateInPandas(statefulProcessor=_Cache(), outputStructType=CACHED, outputMode="Append", timeMode="EventTime")


def state_store(conf: Callable[[str, str], object]) -> None:
    """Sets the state store that these streams need: ``state_store(spark.conf.set)``."""
    conf("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
