"""Versioned tables under racing writers, and work that is taken up again."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tonalspark.sources.versions import Conflict, VersionedTable, WorkLog, claimed

SCHEMA = "id long, name string, n int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_one_of_racing_claims_wins(spark, tmp_path):
    (tmp_path / "log").mkdir()
    won, path = [], f"file://{tmp_path}/log/v1"
    racers = [threading.Thread(target=lambda i=i: claimed(spark, path, f"text {i}") and won.append(i)) for i in range(8)]
    for r in racers:
        r.start()
    for r in racers:
        r.join()
    assert len(won) == 1 and (tmp_path / "log/v1").read_text() == f"text {won[0]}"
    assert [x.name for x in (tmp_path / "log").iterdir() if not x.name.endswith(".crc")] == ["v1"]


def test_upserts_against_a_dictionary(spark, tmp_path):
    rng, want = random.Random(2), {}
    table = VersionedTable(spark, f"file://{tmp_path}/t", ["id"], buckets=5)
    for step in range(6):
        new = [(rng.randrange(40) if rng.random() < 0.95 else None, rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for _ in range(12)]
        df = spark.createDataFrame(new, SCHEMA)
        last = {}
        for r in sorted((r for r in new if r[0] is not None), key=lambda r: [(x is not None, x) for x in r]):
            last[r[0]] = r
        if step % 3 == 2:
            table.insert_new(df)
            want |= {k: r for k, r in last.items() if k not in want}
        else:
            table.upsert(df, keep=step % 2 == 0)
            for k, r in last.items():
                old = want.get(k, (k, None, None))
                want[k] = tuple(x if x is not None or step % 2 else y for x, y in zip(r, old))
        assert rows_of(table.read()) == sorted(want.values(), key=repr)
    assert table.version() == 6
    part = spark.createDataFrame([(1, 99), (77, 5)], "id long, n int")  # a column less: its values stay
    before = {r[0]: r for r in rows_of(table.read())}
    table.upsert(part)
    after = {r[0]: r for r in rows_of(table.read())}
    assert after[1] == (1, before.get(1, (1, None))[1], 99) and after[77] == (77, before.get(77, (77, None))[1], 5)
    assert table.insert_new(spark.createDataFrame([(1, "z", 0)], SCHEMA)) == 7 == table.version()  # nothing new, no version


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", ["id"], buckets=8)
    table.upsert(spark.createDataFrame([(i, "x", i) for i in range(100)], SCHEMA))
    first = table.manifest()["folders"]
    held = table.read()
    table.upsert(spark.createDataFrame([(3, "y", 0)], SCHEMA))
    second = table.manifest()["folders"]
    assert sum(first[b] != second[b] for b in first) == 1
    assert held.where("id = 3").first()["name"] == "x" and table.read().where("id = 3").first()["name"] == "y"  # readers keep what they opened
    table.replace(table.read().where("id < 10"))
    table.vacuum(keep=1)
    assert table.read().count() == 10 and len(list((tmp_path / "t/versions").glob("v*"))) == 1
    assert table.read(table.version()).count() == 10


def test_racing_upserts_lose_nothing(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", ["id", "name"], buckets=3)
    table.upsert(spark.createDataFrame([(0, "seed", 0)], SCHEMA))
    failed = []

    def write(w):
        try:
            for i in range(3):
                table.upsert(spark.createDataFrame([(w, f"{i}", 1), (50, f"shared{i}", w)], SCHEMA), tries=30)
        except Conflict as e:
            failed.append(e)

    writers = [threading.Thread(target=write, args=(w,)) for w in range(1, 5)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    got = rows_of(table.read())
    assert not failed and table.version() == 13
    assert {r[:2] for r in got} == {(0, "seed")} | {(w, f"{i}") for w in range(1, 5) for i in range(3)} | {(50, f"shared{i}") for i in range(3)} and len(got) == 16


def test_work_goes_on_after_a_failure(spark, tmp_path):
    items = spark.createDataFrame([(i, i * 10) for i in range(50)] + [(None, 1), (7, 70)], "id long, x long")
    log, calls = WorkLog(spark, f"file://{tmp_path}/w", "id"), []

    def work(df):
        calls.append({r.id for r in df.collect()})
        if len(calls) == 3:
            raise RuntimeError("killed")
        return df.where("id != 13").select("id", (F.col("x") + 1).alias("y"))

    with pytest.raises(RuntimeError, match="killed"):
        log.run(items, work, every=10)
    done = {r.id for r in log.results().collect()}
    assert done == calls[0] | calls[1] - {13} and len(log.entries()) == 2
    (spark.createDataFrame([(49, 0)], "id long, y long")).write.parquet(f"file://{tmp_path}/w/results/whole-but-not-entered")
    said = log.run(items, work, every=10)
    assert said["pending"] == 50 - len(done - {13}) and said["failed"] == 1 and said["done"] == said["pending"] - 1
    assert not done & set().union(*calls[3:])  # nothing is done twice
    got = log.results().collect()
    assert sorted(r.id for r in got) == sorted(set(range(50)) - {13}) and all(r.y == r.id * 10 + 1 for r in got)
    assert log.run(items.where("id != 13"), work, every=10) == {"pending": 0, "done": 0, "failed": 0}
    assert {r.id for r in log.pending(items.dropna()).collect()} == {13}


def test_micro_batches_are_committed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log = WorkLog(spark, f"file://{tmp_path}/w", "id")
    state = {"fail": True}

    def work(df):
        if state["fail"] and df.where("id = 15").count():
            raise RuntimeError("killed")
        return df.select("id", (F.col("id") * 2).alias("y"))

    def run():
        source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = log.stream(source, work, str(tmp_path / "checkpoint"))
        query.awaitTermination(120)

    for i, ids in enumerate(([0, 1, 2], [10, 15, 1], [20])):
        spark.createDataFrame([(x,) for x in ids], "id long").coalesce(1).write.parquet(str(tmp_path / f"m{i}"))
        for f in (tmp_path / f"m{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}.parquet")
    with pytest.raises(Exception, match="killed"):
        run()
    assert {r.id for r in log.results().collect()} == {0, 1, 2}
    state["fail"] = False
    run()
    run()
    assert rows_of(log.results()) == [(x, 2 * x) for x in (0, 1, 10, 15, 2, 20)] or sorted(rows_of(log.results())) == [(x, 2 * x) for x in (0, 1, 2, 10, 15, 20)]
    assert not log.commit("micro-batch-0", spark.createDataFrame([(99, 0)], "id long, y long")) and len(log.entries()) == 3
