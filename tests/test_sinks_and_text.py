"""Writers that fail half-way, fuzzy text, cleaning rules and statistics on hand-made rows."""

import os
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonalspark.functions import cleaning, fuzzy, shaping, text
from tonalspark.operators import enrichment, filters, metrics, probes, ranks
from tonalspark.sources import sinks


def rows_of(spark, path):
    return sorted(r[0] for r in spark.read.parquet(path).collect())


@pytest.mark.parametrize("fails", [1, 2])
def test_a_failed_rename_keeps_the_old_table(spark, tmp_path, monkeypatch, fails):
    path = f"file://{tmp_path}/t"
    sinks.replace(spark.range(3), path)
    real, calls = sinks._moved, []

    def moved(spark, a, b):
        calls.append((a, b))
        return False if len(calls) == fails else real(spark, a, b)

    monkeypatch.setattr(sinks, "_moved", moved)
    with pytest.raises(RuntimeError):
        sinks.replace(spark.range(9), path)
    assert rows_of(spark, path) == [0, 1, 2] and os.listdir(tmp_path) == ["t"]
    sinks.replace(spark.read.parquet(path).unionByName(spark.range(1)), path)  # a table from itself
    assert rows_of(spark, path) == [0, 0, 1, 2] and os.listdir(tmp_path) == ["t"]


def test_two_failed_renames_say_where_the_table_is(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    sinks.replace(spark.range(3), path)
    real, calls = sinks._moved, []

    def moved(spark, a, b):
        calls.append((a, b))
        return real(spark, a, b) if len(calls) == 1 else False

    monkeypatch.setattr(sinks, "_moved", moved)
    with pytest.raises(RuntimeError, match="which is at"):
        sinks.replace(spark.range(9), path)
    assert rows_of(spark, calls[0][1]) == [0, 1, 2]


def test_a_refused_release_publishes_nothing(spark, tmp_path):
    songs, path = spark.range(4), f"file://{tmp_path}/r"
    first = sinks.release({"a": songs, "b": songs.withColumn("x", F.lit(1))}, songs, "id", path)
    assert sorted(r["part"] for r in first.collect()) == ["a", "b"]
    for bad in (songs.limit(3), songs.unionByName(songs.limit(1)), songs.select((F.col("id") + 1).alias("id"))):
        with pytest.raises(ValueError):
            sinks.release({"a": songs.withColumn("new", F.lit(2)), "b": bad}, songs, "id", path)
        assert spark.read.parquet(f"{path}/a").columns == ["id"] and os.listdir(tmp_path) == ["r"]


def test_reports(spark, tmp_path):
    counts = spark.createDataFrame([("duration", 3), ("kept", 7)], "reason string, rows long")
    sinks.filtered(spark.range(2).withColumn("t", F.lit('a "b", c')), counts, f"file://{tmp_path}/f")
    assert [r.t for r in spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/f/rows").collect()] == ['a "b", c'] * 2
    assert "| duration | 3 |" in [r[0] for r in spark.read.text(f"file://{tmp_path}/f/report").collect()]
    sinks.vectors(spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>"), "id", "v", f"file://{tmp_path}/v")
    assert spark.read.json(f"file://{tmp_path}/v/metadata").first().asDict() == {"least_width": 2, "rows": 1, "width": 2}


def test_matched_share_is_the_sequence_ratio(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choice("abc ") for _ in range(rng.randrange(30))), "".join(rng.choice("abc ") for _ in range(rng.randrange(30)))) for _ in range(200)] + [(None, "a"), (None, None), ("same", "same")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.sequence_ratio(F.col("a"), F.col("b")).alias("r"), fuzzy.sequence_ratio(F.col("a"), F.col("b"), 0.6).alias("s")).collect()
    for r in got:
        want = SequenceMatcher(None, r.a or "", r.b or "", autojunk=False).ratio()
        assert abs(r.r - want) < 1e-12 and (r.s >= 0.6) == (want >= 0.6)


def test_marks_are_stripped_however_they_are_written(spark):
    words = ["Đêm Mưa", "Ångström", "été", "Ştefan ŁÓDŹ", "ệ", None]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.no_marks(F.col("w"))).collect()]
    assert got == ["dem mua", "angstrom", "ete", "stefan łodz", "e", None]


def test_views_popularity_and_length(spark):
    rows = [(25_000, None, None, 2025), (500_000, None, None, 2025), (60_000, None, None, 2025), (20_000, None, None, 2025), (60_000, None, None, 2018), (1, 30, None, 2018), (1, None, "chart", 2018), (None, 5, None, None), (200_000, 5, None, None)]
    got = spark.createDataFrame(rows, "v long, p int, h string, y int").select(cleaning.low_views(F.col("v"), F.col("p"), F.col("h"), F.col("y")).alias("views"), cleaning.low_popularity(F.col("p"), F.col("v"), F.col("h")).alias("popularity")).collect()
    assert [r.views for r in got] == [True, False, False, True, True, False, False, False, False]
    assert [r.popularity for r in got] == [False] * 7 + [True, False]
    short = spark.createDataFrame([("1", "x", 100_000), ("2", "Kept One", 100_000), ("3", "x", None), ("4", "x", 400_000), ("2", "Kept One", 400_000)], "i string, t string, d long")
    fits = cleaning.duration_fits(F.col("d"), cleaning.allowed_short(F.col("i"), F.col("t"), ["9"], ["kept one"]))
    assert [r[0] for r in short.select(fits).collect()] == [False, True, True, False, False]


def test_channels_on_the_primary_artist_only(spark):
    names = spark.createDataFrame([("Some Channel", "channel"), ("TV Star", "current"), ("Known TV", "known")], "name string, kind string")
    rows = spark.createDataFrame([(1, "Singer, Some Channel"), (2, "some-channel"), (3, "SOME CHANNEL, Singer"), (4, "TV Star"), (5, "known-tv"), (6, "Other TV"), (7, None)], "id int, artists string")
    met = filters.with_kinds(rows, "id", F.coalesce(text.artists(F.col("artists")), F.array().cast("array<string>")), names)
    got = {r.id: r.c for r in met.select("id", filters.non_artist_channel(F.get(text.artists(F.col("artists")), F.lit(0)), F.col("primary_kinds"), r"(?i)\btv\b").alias("c")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False}


def test_variants_at_collection_by_plain_loops(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["song", "song remix", "song live", "Song  ", "other", "other remix"]), rng.choice("ab")) for i in range(80)]
    df = spark.createDataFrame(rows, "ord int, title string, artist string").repartition(3)
    base = F.regexp_replace("title", " (remix|live)$", "")
    got = sorted(r.ord for r in filters.collected(df, F.col("title"), base, F.col("artist"), "ord").collect())
    seen, counts, want = set(), {}, []
    for i, title, artist in rows:
        t = title.strip().lower()
        b = t.removesuffix(" remix").removesuffix(" live")
        if (t, artist) in seen or b != t and counts.get((b, artist), 0) >= 3:
            continue
        seen.add((t, artist))
        counts[b, artist] = counts.get((b, artist), 0) + 1
        want.append(i)
    assert got == want


def test_statistics_against_numpy(spark):
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=400), 1), rng.normal(size=400)
    df = spark.createDataFrame([(i, float(a), float(b), f"g{i % 2}", i % 20) for i, (a, b) in enumerate(zip(x, y))], "i int, x double, y double, g string, c int").repartition(5)
    row = ranks.percentiles(df, "x", {"a": 0.05, "b": 0.5, "c": 0.99, "d": 1.0}).first()
    assert np.allclose([*row], np.percentile(x, [5, 50, 99, 100]))
    least = {r.i: r.m for r in ranks.suffix_min(df, "x", "y", "m").collect()}
    assert all(least[i] == min(y[x >= x[i]]) for i in range(400))
    assert abs(metrics.wasserstein(df, "x", "y").first()[0] - np.abs(np.sort(x) - np.sort(y)).mean()) < 1e-9
    tiles = {r.i: r.t for r in ranks.tiles(df.withColumn("at", F.struct("x", "i")), "at", 7, "t").collect()}
    order = sorted(range(400), key=lambda i: (x[i], i))
    assert [tiles[i] for i in order] == [k + 1 for k, part in enumerate(np.array_split(np.arange(400), 7)) for _ in part]
    found = {r.g: r for r in metrics.bootstrap(df, "g", "i", "y", draws=4000).collect()}
    for g in (0, 1):
        mine = y[g::2]
        drawn = np.sort(mine[np.random.default_rng(1).integers(0, 200, (4000, 200))].mean(1))
        assert abs(found[f"g{g}"].mean - mine.mean()) < 1e-9 and abs(found[f"g{g}"].low - drawn[100]) < 0.03 and abs(found[f"g{g}"].high - drawn[3900]) < 0.03
    same = {r.g: r for r in metrics.bootstrap(df.repartition(2), "g", "i", "y", draws=4000).collect()}
    assert all(abs(same[g].low - found[g].low) < 1e-9 for g in found)
    wide = metrics.bootstrap(df.withColumn("g", F.lit("c")), "g", "c", "y", draws=2000).first()
    assert wide["low"] < y.mean() < wide["high"]


def test_probes(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([(i, [float(a) for a in r], float(b)) for i, (r, b) in enumerate(zip(x, y))], "i int, v array<double>, y double").repartition(4)
    got = {r.alpha: r.r2 for r in probes.ridge_by_folds(df, "v", "y", F.col("i") % 3, [0.1, 100.0]).collect()}
    for alpha, r2 in got.items():
        error = total = 0.0
        for k in range(3):
            test = np.arange(300) % 3 == k
            a = np.column_stack([x[~test], np.ones((~test).sum())])
            w = np.linalg.solve(a.T @ a + alpha * np.diag([1, 1, 1, 1, 0]), a.T @ y[~test])
            error += ((y[test] - np.column_stack([x[test], np.ones(test.sum())]) @ w) ** 2).sum()
            total += ((y[test] - y[test].mean()) ** 2).sum()
        assert abs(r2 - (1 - error / total)) < 1e-5
    blend = spark.createDataFrame([(float(a), float(b), float(0.7 * a + 0.3 * b)) for a, b in rng.random((200, 2))], "a double, b double, t double")
    w = {r.signal: r.weight for r in probes.blend_weights(blend, ["a", "b"], "t", {}).collect()}
    assert abs(w["a"] - 0.7) < 1e-6 and abs(w["b"] - 0.3) < 1e-6
    floored = {r.signal: r.weight for r in probes.blend_weights(blend.withColumn("t", F.col("a")), ["a", "b"], "t", {"b": 0.15}).collect()}
    assert floored["b"] > 0.1


def test_shaping(spark):
    df = spark.createDataFrame([(1, float("nan"), [1.0, float("inf"), None]), (2, 1.5, None)], "id int, x double, v array<double>")
    assert [tuple(r) for r in shaping.sanitised(df).orderBy("id").collect()] == [(1, None, [1.0, None, None]), (2, 1.5, None)]
    assert shaping.allow_listed(df, ["v", "nothing", "id"]).columns == ["v", "id"] and shaping.first_present(df.columns, ["y", "x"]) == "x"
    beats = spark.createDataFrame([("[1, 2.5, null, 3]",), ("oops",), (None,)], "t string").select(shaping.beats_of(F.col("t"))).collect()
    assert [r[0] for r in beats] == [[1.0, 2.5, 3.0], [], []]
    ends = spark.createDataFrame([(0.1, 0.1), (0.9, 0.9), (0.5, 0.5)], "v double, a double").select(shaping.nearest_end(F.col("v"), F.col("a"), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    assert [r[0] for r in ends.collect()] == [0, 1, 0]
    known = enrichment.media_flags(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",)], "k string"), spark.createDataFrame([("x/a.mp3",)], "path string"), "k")
    assert {r.k: r.has_media for r in known.collect()} == {"a": False, "b": True}


def test_the_catalogue_follows_its_tables(spark, tmp_path):
    from tonalspark.sources import catalogue

    source = "/root/testdata/sf0.001"
    for n in (20, 30):
        for t in ("embeddings", "part"):
            spark.read.parquet(f"{source}/{t}.parquet").limit(1000).where(f"{'vec_id' if t == 'embeddings' else 'p_partkey'} BETWEEN 1 AND {n}").write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        assert catalogue.songs(spark, str(tmp_path)).count() == n
        assert catalogue.songs(spark, str(tmp_path)).inputFiles() == catalogue.songs(spark, str(tmp_path)).inputFiles()


def test_nested_tracks_in_each_form(spark, tmp_path):
    from tonalspark.sources import catalogue

    a = '{"videoId":"a","title":"T","artists":[{"name":"X","id":"1"},{"name":"Y","id":"2"}],"duration":"1:05","year":"2019"}'
    b = '{"videoId":"b","title":"U","artists":[],"album":{"name":"Z"},"duration_seconds":7,"thumbnails":[{"url":"s"},{"url":"l"}]}'
    for name, text in (("object", f'{{"tracks":[{a},{b}]}}'), ("list", f"[{a},{b}]"), ("lines", f"{a}\n\n{b}\n"), ("none", '{"tracks":[]}')):
        (tmp_path / f"{name}.json").write_text(text)
        got = {r.track_id: r for r in catalogue.nested_tracks(spark, str(tmp_path / f"{name}.json")).collect()}
        assert set(got) == (set() if name == "none" else {"a", "b"})
        if got:
            assert (got["a"].artists, got["a"].artist_ids, got["a"].track_duration_ms, got["a"].year) == ("X, Y", "1, 2", 65_000, 2019)
            assert (got["b"].primary_artist, got["b"].album_name, got["b"].track_duration_ms, got["b"].art_url) == (None, "Z", 7_000, "l")


def test_profiles_fall_back(spark, tmp_path):
    from tonalspark.sources import catalogue

    (tmp_path / "a.csv").write_text("﻿artist_id,name,thumbnail_url\n 1 ,A,http://t\n2,B,\n,C,http://u\n", encoding="utf-8")
    for text, want in (('{"A":{"image_url":"http://i","genres":["x"],"followers":3}}', {"A": "http://i"}), ("{}", {"1": "http://t"}), (None, {"1": "http://t"})):
        path = tmp_path / "p.json"
        path.unlink(missing_ok=True)
        if text is not None:
            path.write_text(text)
        assert {r.key: r.image_url for r in catalogue.artist_profiles(spark, str(path), str(tmp_path / "a.csv")).collect()} == want
    assert catalogue.artist_profiles(spark, str(tmp_path / "no"), str(tmp_path / "none")).count() == 0


def test_sources_are_asked_in_order(spark):
    from tonalspark.sources import catalogue

    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    one, two = spark.createDataFrame([("a", " "), ("b", "x"), ("b", "w")], "k string, v string"), spark.createDataFrame([("a", "y"), ("b", "z"), (None, "q")], "k string, v string")
    got = {r.k: (r.v, r.found_in) for r in catalogue.sought(df, [("one", one), ("two", two)], "k", "v").collect()}
    assert got == {"a": ("y", "two"), "b": ("w", "one"), "c": (None, "not found"), None: (None, "not found")}
