"""Queues and caches over streams: restarts, and the batch over the same events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tonalspark.streaming import radio

EPOCH = datetime(2024, 1, 1)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    radio.state_store(spark.conf.set)
    yield spark
    spark.conf.unset(key)


def plain_queue(seed, pool, events):
    """Played songs by the rules, with lists alone."""
    queue, at, done, out = [seed], 0, False, []
    for i in range(events):
        if i:
            at = (at + 1) % len(queue)
        if not done and at >= len(queue) - 3:
            fresh = [s for s in pool if s not in queue[-120:]][:14]
            new = [s for s in fresh if s not in queue]
            queue += new
            done = not new
        out.append((queue[at], done))
    return out


def streamed(spark, make, schema, parts, folder):
    """The stream's rows when files come one after another and the query is stopped and begun again between them."""
    out = []
    (folder / "in").mkdir()
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(folder / f"made{i}"))
        for f in (folder / f"made{i}").glob("*.parquet"):
            f.rename(folder / "in" / f"{i}-{f.name}")
        source = spark.readStream.schema(schema).parquet(str(folder / "in")).withWatermark("ts", "1 hour")
        query = make(source).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
    return spark.read.parquet(str(folder / "out"))


def test_endless_queue(rocks, tmp_path):
    spark, rng = rocks, random.Random(3)
    schema = "session long, event_id long, ts timestamp, seed long, pool array<long>"
    rows, want = [], {}
    for session, (events, size) in enumerate([(200, 134), (30, 134), (40, 20), (5, 0), (160, 40)]):
        pool = rng.sample(range(1000, 2000), size)
        for i, x in enumerate(plain_queue(session, pool, events)):
            want[session, i] = x
            rows.append((session, i, EPOCH + timedelta(minutes=i), session, pool if i == 0 else None))
    got = {(r.session, r.event_id): (r.song_idx, r.exhausted) for r in radio.played(spark.createDataFrame(rows, schema).repartition(4)).collect()}
    assert got == want
    cuts = [spark.createDataFrame([r for r in rows if a <= r[1] < b], schema) for a, b in ((0, 7), (7, 90), (90, 500))]
    done = streamed(spark, radio.played_stream, schema, cuts, tmp_path).collect()
    assert len(done) == len(rows) and {(r.session, r.event_id): (r.song_idx, r.exhausted) for r in done} == want


def test_cache_with_a_time_to_live(rocks, tmp_path):
    spark, rng = rocks, random.Random(5)
    schema = "key string, event_id long, ts timestamp, ttl_s long"
    rows = sorted((EPOCH + timedelta(seconds=rng.randrange(20_000)), rng.choice("abc"), i) for i in range(300))
    rows = [(k, i, ts, {"a": 180, "b": 600, "c": 3600}[k]) for ts, k, i in rows]
    want, made = {}, {}
    for k, i, ts, ttl in rows:
        hit = k in made and (ts - made[k]).total_seconds() < ttl
        if not hit:
            made[k] = ts
        want[i] = (hit, made[k])
    got = {r.event_id: (r.hit, r.made_at) for r in radio.cached(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    assert got == want and 0 < sum(h for h, _ in want.values()) < len(rows)
    cuts = [spark.createDataFrame(rows[a:b], schema) for a, b in ((0, 120), (120, 130), (130, 300))]
    done = streamed(spark, radio.cached_stream, schema, cuts, tmp_path).collect()
    assert len(done) == len(rows) and {r.event_id: (r.hit, r.made_at) for r in done} == want
    assert radio.cached(spark.createDataFrame([], schema)).count() == 0 and radio.played(spark.createDataFrame([], "session long, event_id long, ts timestamp, seed long, pool array<long>")).agg(F.count("*")).first()[0] == 0
