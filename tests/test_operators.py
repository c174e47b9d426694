"""Operators on hand-made rows."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tonalspark.functions import color, emotion, text
from tonalspark.operators import catalogue, entities, metrics, ranks, rerank, search, sequences
from tonalspark.sources import sinks
from tonalspark.streaming import limits

EPOCH = datetime(2020, 1, 1)

#: Valence, arousal and quadrant of the twelve colours.
GOLDEN = {
    "red": (0.3747, 0.7229, "Q2"), "orange": (0.5969, 0.7288, "Q1"), "yellow": (0.7668, 0.6961, "Q1"), "pink": (0.6755, 0.8579, "Q1"), "green": (0.6197, 0.3419, "Q4"), "turquoise": (0.6675, 0.2062, "Q4"),
    "blue": (0.5647, 0.3579, "Q4"), "purple": (0.4623, 0.4341, "Q3"), "brown": (0.3869, 0.5691, "Q2"), "white": (0.5907, 0.3744, "Q4"), "grey": (0.4106, 0.2286, "Q3"), "black": (0.2547, 0.1226, "Q3"),
}


def test_colors(spark):
    rows = spark.createDataFrame([*color.COLORS.items(), ("none", "#12")], "name string, hex string").withColumn("m", color.valence_arousal(F.col("hex")))
    got = {r["name"]: r for r in rows.select("name", "m.*", color.quadrant(F.col("m.valence"), F.col("m.arousal")).alias("q")).collect()}
    for name, (v, a, q) in GOLDEN.items():
        assert abs(got[name]["valence"] - v) < 1e-4 and abs(got[name]["arousal"] - a) < 1e-4 and got[name]["q"] == q
    assert got["none"]["valence"] is None


def test_ciede2000_of_published_pairs(spark):
    pairs = [((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492), ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082)]
    rows = spark.createDataFrame([([*p], [*q], d) for p, q, d in pairs], "p array<double>, q array<double>, d double")
    for r in rows.select(color.ciede2000(F.col("p"), F.col("q")).alias("x"), "d").collect():
        assert abs(r["x"] - r["d"]) < 1e-4


def test_average_ranks(spark):
    x = [3.0, 1.0, 2.0, 2.0, None, 9.0, 2.0]
    got = {r["i"]: r["r"] for r in ranks.with_rank(spark.createDataFrame([*enumerate(x)], "i int, x double"), "x", "r", scaled=False).collect()}
    want = pd.Series(x).rank()
    assert all(got[i] == w or got[i] is None and np.isnan(w) for i, w in enumerate(want))


def test_titles(spark):
    rows = spark.createDataFrame([("Lá Xanh (feat. Bình)", "02. Sông [live]", "3:05", "Jan 2019"), (None, None, "x", "99")], "a string, b string, c string, d string")
    r = rows.select(text.canonical_title(F.col("a")), text.base_title(F.col("b")), text.seconds(F.col("c")), text.year(F.col("d"))).collect()
    assert tuple(r[0]) == ("la xanh", "song", 185, 2019)
    assert r[1][2] is None and r[1][3] is None


def test_lexicon(spark):
    lex = emotion.Lexicon({"happy": ("joy",), "sad": ("grief",), "nostalgia": ("past",)}, ("very",), ("not",), ("but",), frozenset({"happy"}), frozenset({"sad"}))
    texts = ["joy", "not joy", "not grief", "not past", "not him, joy and grief", "very joy, grief", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(emotion.lexicon_scores(F.col("t"), lex)).collect()]
    assert got[:5] == [{"happy": 1.0}, {"sad": 1.0}, {"happy": 1.0}, {}, {"happy": 0.5, "sad": 0.5}]
    assert abs(got[5]["happy"] - 0.6) < 1e-12 and got[6:] == [{}, {}]


def test_lexicon_against_a_pattern_for_each_word(spark):
    import random
    import re

    rng = random.Random(4)
    words = {"happy": ("sun", "sunny day", "joy"), "sad": ("rain", "day", "sun"), "hope": ("été", "a")}
    lexicon = emotion.Lexicon(words, ("very",), ("not",), ("but",), frozenset({"happy"}), frozenset({"sad"}))
    pieces = ["sun", "sunny", "day", "joy", "rain", "été", "a", "very", "not", "but", "sunday", "_sun", ",", ".", "x"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "", " "]) for _ in range(rng.randrange(0, 25))) for _ in range(300)] + [None, "", "SUNNY DAY"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(emotion.lexicon_scores(F.col("t"), lexicon)).collect()]
    for text, found in zip(texts, got):
        low, sums = (text or "").lower(), {}
        for feeling, terms in words.items():
            for w in terms:
                for m in re.finditer(rf"(?<!\w){re.escape(w)}(?!\w)", low):
                    near = re.split(r"[,.;:!?\n]", low[max(0, m.start() - 24) : m.start()])[-1]
                    weight = (1.5 if "very" in near else 1.0) * (1.4 if "but" in low[max(0, m.start() - 40) : m.start()] else 1.0)
                    if "not" not in near:
                        sums[feeling] = sums.get(feeling, 0) + weight
                    elif feeling in ("happy", "sad"):
                        other = {"happy": "sad", "sad": "happy"}[feeling]
                        sums[other] = sums.get(other, 0) + 0.7 * weight
        total = sum(sums.values())
        assert set(found) == set(sums) and all(abs(found[k] - v / total) < 1e-9 for k, v in sums.items())


def test_grounded_valence(spark):
    rows = spark.createDataFrame([("sun and rain",), ("not sun rain",), ("old rain sun",), ("sun",), (None,)], "t string")
    got = [r[0] for r in rows.select(emotion.grounded_valence(F.col("t"), {"sun": 0.9, "rain": 0.3, "old rain": 0.5}, ("not",))).collect()]
    assert [None if x is None else round(x, 9) for x in got] == [0.6, 0.4, 0.7, None, None]


def test_rerankers_agree_with_plain_loops():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(12, 6))
    g = pd.DataFrame({"query_id": 0, "song_idx": range(12), "score": sorted(rng.random(12))[::-1], "lyrics_vec": list(v)})
    u, rel = v / np.linalg.norm(v, axis=1, keepdims=True), g["score"].to_numpy()
    picks: list[int] = []
    while len(picks) < 5:
        value = [(-np.inf if i in picks else rel[i] if not picks else 0.7 * rel[i] - 0.3 * max(u[i] @ u[j] for j in picks)) for i in range(12)]
        picks.append(int(np.argmax(value)))
    assert [i for i, _ in rerank.mmr(5)(g)] == picks
    kernel = np.sqrt(np.outer(rel, rel)) * (u @ u.T)
    chosen: list[int] = []
    while len(chosen) < 5:
        chosen.append(max((i for i in range(12) if i not in chosen), key=lambda i: np.linalg.det(kernel[np.ix_([*chosen, i], [*chosen, i])])))
    assert [i for i, _ in rerank.dpp(5)(g)] == chosen


def test_other_rerankers_agree_with_plain_loops():
    rng = np.random.default_rng(2)
    n = 14
    v = rng.normal(size=(n, 5))
    g = pd.DataFrame({"query_id": 0, "song_idx": range(n), "score": sorted(rng.random(n))[::-1], "audio_vec": list(v), "valence": rng.random(n), "arousal": rng.random(n), "artist": [f"a{i % 4}" for i in range(n)], "mood": [f"m{i % 3}" for i in range(n)]})
    u, rel, at = v / np.linalg.norm(v, axis=1, keepdims=True), g["score"].to_numpy(), g[["valence", "arousal"]].to_numpy()
    picks: list[int] = []
    while len(picks) < 6:
        value = [-np.inf if i in picks else rel[i] if not picks else 0.5 * rel[i] + 0.5 * min(np.linalg.norm(at[i] - at[j]) for j in picks) for i in range(n)]
        picks.append(int(np.argmax(value)))
    assert [i for i, _ in rerank.va_mmr(6)(g)] == picks
    scaled, close = (rel - rel.min()) / (rel.max() - rel.min() + 1e-9), []
    while len(close) < 6:
        best = None
        for i in range(n):
            if i in close:
                continue
            x = scaled[i]
            if close:
                centre = np.mean([u[j] for j in close], axis=0)
                x = 0.55 * x + 0.45 * float(u[i] @ (centre / (np.linalg.norm(centre) + 1e-9)))
            x = round(x * max(0.0, 1 - 0.15 * min(sum(g["artist"][j] == g["artist"][i] for j in close), 3)) * 1e6)
            if best is None or x > best[0]:
                best = (x, i)
        close.append(best[1])
    assert [i for i, _ in rerank.coherent(6)(g)] == close
    out, artists, moods = [], {}, set()
    for i in range(n):
        score, a, m = rel[i], g["artist"][i], g["mood"][i]
        if a in artists:
            score *= (1 - 0.15) ** artists[a]
            if score < 0.3:
                continue
        if m not in moods:
            score *= 1.03
        moods.add(m)
        artists[a] = artists.get(a, 0) + 1
        out.append((i, score))
    got = rerank.artist_penalty(8)(g)
    assert [i for i, _ in got] == [i for i, _ in out[:8]] and np.allclose([s for _, s in got], [s for _, s in out[:8]])


def test_metrics_by_hand(spark):
    recs = spark.createDataFrame([(1, r, s) for r, s in ((1, 10), (2, 11), (3, 12))], "query_id long, rank int, song_idx long")
    truth = spark.createDataFrame([(1, 12), (2, 5)], "query_id long, song_idx long")
    got = {r["query_id"]: r for r in metrics.accuracy(recs, truth, 10).collect()}
    assert abs(got[1]["ndcg"] - 0.5) < 1e-12 and abs(got[1]["rr"] - 1 / 3) < 1e-12 and got[1]["hit"] == 1.0
    assert all(got[2][k] == 0 for k in ("ndcg", "precision", "recall", "ap", "rr", "hit"))


def test_wilcoxon_and_bootstrap(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.random(40) + 0.2, rng.random(40))], "a double, b double")
    assert metrics.wilcoxon(rows, "a", "b").first()["p"] < 0.05
    ci = metrics.bootstrap(rows.select(F.lit("s").alias("g"), "a"), "g", "a", "a", draws=2000).first()
    assert ci["low"] < ci["mean"] < ci["high"]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (12, 11)], "a long, b long")
    assert {(r[0], r[1]) for r in entities.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (11, 10), (12, 10)}


def test_variants_and_empty_columns(spark):
    rows = spark.createDataFrame([(i, "a", i > 1, 0, None) for i in range(7)], "i int, k string, v boolean, z int, n string")
    assert [r["i"] for r in catalogue.limit_variants(rows, F.col("k"), F.col("v"), [F.col("i").asc()]).orderBy("i").collect()] == [0, 1, 2, 3, 4]
    assert catalogue.without_empty_columns(rows).columns == ["i", "k", "v"]


def test_bpm_and_snap(spark):
    rows = spark.createDataFrame([([0.0, 2.0, 4.0, 6.0], 3.2), ([], 1.0)], "b array<double>, t double")
    r = rows.select(sequences.bpm_of(F.col("b")), sequences.snap(F.col("t"), F.col("b")), sequences.snap(F.col("t"), F.col("b"), "before"), sequences.snap(F.col("t"), F.col("b"), "after")).collect()
    assert tuple(r[0]) == (120.0, 4.0, 2.0, 4.0) and r[1][0] is None and r[1][1] == 1.0


def test_sliding_log(spark):
    stamps = [0, 10, 20, 30, 61, 62]
    rows = spark.createDataFrame([("c", "/a", EPOCH + timedelta(seconds=s)) for s in stamps], "client string, path string, ts timestamp")
    got = limits.rate_limited(rows, limit=3, window=60.0).orderBy("ts").collect()
    assert [r["allowed"] for r in got] == [True, True, True, False, True, False]
    assert got[3]["retry_after"] == 30.0 and got[5]["retry_after"] == 8.0


def test_stream_of_requests(spark, tmp_path):
    rows = spark.createDataFrame([("c", "/a", EPOCH + timedelta(seconds=s)) for s in (0, 1, 2)], "client string, path string, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    q = limits.rate_limited_stream(stream, limit=2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("limited").orderBy("ts").collect()
    assert [r["allowed"] for r in got] == [True, True, False], got


def test_fuzzy(spark):
    items = spark.createDataFrame([(1, "Blue Moon", 1.0), (2, "Red Sun", 2.0), (3, None, 3.0)], "item long, title string, popularity double")
    assert [r["item"] for r in search.typo_matches(items, "blue mon").collect()] == [1]


def test_release_contract(spark, tmp_path):
    songs = spark.createDataFrame([(1,), (2,)], "id long")
    got = sinks.release({"a": songs.withColumn("x", F.lit(1))}, songs, "id", str(tmp_path / "r")).collect()
    assert got[0]["rows"] == 2
    try:
        sinks.release({"b": songs.limit(1)}, songs, "id", str(tmp_path / "r"))
        raise AssertionError("a part that lacks keys must not pass")
    except ValueError:
        pass
