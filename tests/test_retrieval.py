"""Retrieval held against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonalspark.operators import entities, inverted_file, retrieval, vector_join

WEIGHTS = (0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.3)


@pytest.fixture(scope="module")
def songs(spark):
    rng = np.random.default_rng(4)

    def unit(n):
        v = rng.normal(size=n)
        return [float(x) for x in v / np.linalg.norm(v)]

    rows = [(i, unit(8), unit(4), unit(3), [float(rng.random()), float(rng.random())], unit(3), unit(2), float(rng.random()), float(rng.random()), "abc"[i % 3] if i % 7 else None, f"artist{i % 5}", float(rng.integers(60, 180)) if i % 11 else None) for i in range(120)]
    return spark.createDataFrame(rows, "song_idx long, audio_vec array<double>, lyrics_vec array<double>, timbre array<double>, rhythm array<double>, tonality array<double>, instruments array<double>, valence double, arousal double, mood string, artist string, bpm double").repartition(4)


def cos(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def plain_score(s, q):
    parts = [
        cos(s.timbre, q.timbre), 1 - np.mean(np.abs(np.subtract(s.rhythm, q.rhythm))), cos(s.tonality, q.tonality), (cos(s.lyrics_vec, q.lyrics_vec) + 1) / 2,
        np.exp(-0.5 * (((s.valence - q.valence) / 0.22) ** 2 + ((s.arousal - q.arousal) / 0.14) ** 2)), (cos(s.instruments, q.instruments) + 1) / 2, float(bool(s.mood) and s.mood == q.mood), (np.dot(s.audio_vec, q.audio_vec) + 1) / 2,
    ]
    return float(np.dot(WEIGHTS, parts))


def top(scores, k):
    return sorted(scores, key=lambda x: (-round(x[1] * 1e6), x[0]))[:k]


def test_similar_songs_in_blocks_and_as_pairs(spark, songs, monkeypatch):
    rows = songs.collect()
    seeds = songs.where("song_idx % 10 = 0")
    gone = spark.createDataFrame([(0, i) for i in range(40)], "query_id long, song_idx long")
    want = {}
    for q in rows:
        if q.song_idx % 10 == 0:
            scores = [(s.song_idx, plain_score(s, q)) for s in rows if s.song_idx != q.song_idx and s.song_idx % 9 != 1 and not (q.song_idx == 0 and s.song_idx < 40)]
            want[q.song_idx] = [i for i, x in top([x for x in scores if x[1] >= 0.3], 6)]
    for sizes in ((16_384, 512), (7, 3)):
        monkeypatch.setattr(retrieval, "ROWS", sizes[0])
        monkeypatch.setattr(retrieval, "QUERIES", sizes[1])
        got = retrieval.similar_songs(songs, seeds, 6, WEIGHTS, excluded=gone, played=songs.where("song_idx % 9 = 1")).orderBy("query_id", "rank").collect()
        assert {q: [r.song_idx for r in got if r.query_id == q] for q in want} == want
    allowed = spark.createDataFrame([(q, i) for q in want for i in range(q % 7, 120, 7)], "query_id long, song_idx long")
    got = retrieval.similar_songs(songs, seeds, 4, WEIGHTS, candidates=allowed).collect()
    by = {r.song_idx: r for r in rows}
    for q in want:
        scores = [(i, plain_score(by[i], by[q])) for i in range(q % 7, 120, 7) if i != q]
        assert [r.song_idx for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [i for i, _ in top([x for x in scores if x[1] >= 0.3], 4)]
    assert retrieval.similar_songs(songs, seeds.where("false"), 4, WEIGHTS).count() == 0


def test_journeys_score_all_songs(spark, songs):
    rows = sorted(songs.collect(), key=lambda r: r.song_idx)
    ends = spark.createDataFrame([(1, 0.1, 0.2, 0.9, 0.8), (2, 0.5, 0.5, 0.5, 0.5)], "query_id long, from_v double, from_a double, to_v double, to_a double")
    got = retrieval.journeys(songs, ends, k=6, played=songs.where("song_idx = 3")).orderBy("query_id", "place").collect()
    ease = 1 / (1 + np.exp(-np.linspace(-3, 3, 6)))
    ease = (ease - ease[0]) / (ease[-1] - ease[0])
    for e in ends.collect():
        used, last, path = [], None, []
        for t in ease:
            best = None
            for s in rows:
                if s.song_idx == 3 or s.song_idx in used:
                    continue
                x = np.exp(-0.5 * (((s.valence - e.from_v - t * (e.to_v - e.from_v)) / 0.20) ** 2 + ((s.arousal - e.from_a - t * (e.to_a - e.from_a)) / 0.14) ** 2))
                x *= max(0.0, 1 - 0.15 * min(sum(p.artist == s.artist for p in path), 3))
                if last is not None and x > 0:
                    x += 0.30 * (0.5 * np.clip(cos(s.audio_vec, last.audio_vec), -1, 1) + (0.5 * np.exp(-abs(s.bpm - last.bpm) / 20.0) if s.bpm is not None and last.bpm is not None else 0.0))
                x = round(x * 1e6)
                if x > 0 and (best is None or x > best[0]):
                    best = (x, s)
            used.append(best[1].song_idx)
            last = best[1]
            path.append(last)
        assert [r.song_idx for r in got if r.query_id == e.query_id] == used


def pairs_over(v, least):
    c = np.rint(v @ v.T * 1e6) / 1e6
    return {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if c[i, j] > least}


def test_near_pairs_are_all_found_and_few_are_met(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(24, 32))
    v = np.concatenate([c + 0.12 * rng.normal(size=(25, 32)) for c in centres])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(9000, None), (9001, [0.0] * 32)], "song_idx long, audio_vec array<double>").repartition(5)
    for block in (4096, 10):
        monkeypatch.setattr(vector_join, "BLOCK", block)
        for least in (0.97, 0.99):
            got = [(r.a, r.b) for r in vector_join.near_pairs(rows, least).collect()]
            assert len(got) == len(set(got)) and set(got) == pairs_over(v, least) and got
    done = vector_join.met(rows, 0.99).agg(F.sum("scored"), F.sum("visited")).first()
    assert done[0] < 0.1 * len(v) ** 2 / 2 and done[1] < 0.25 * len(v) ** 2 / 2
    assert vector_join.near_pairs(rows.where("false"), 0.9).count() == 0
    assert vector_join.near_pairs(rows.where("song_idx < 1"), 0.9).count() == 0


def test_prefixes_spare_vectors_without_groups(spark):
    """On the given vectors, which have hardly any structure, few pairs are multiplied to the end."""
    d = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id")
    v = np.array([r.embedding for r in e.collect()], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    done = vector_join.met(e, 0.85, "vec_id", "embedding")
    got, n = {(r.a, r.b) for r in done.where("a IS NOT NULL").collect()}, len(v) * (len(v) - 1) // 2
    assert got == pairs_over(v, 0.85)
    assert done.agg(F.sum("scored")).first()[0] < 0.05 * n


# one recording or not: (durations, lyrics, audio, artists) of two rows, and whether they are merged
TEXT, OTHER = "the same words again and again " * 5, "quite another song with other words " * 5
CASES = [
    ("swapped artists", ("Song", "Song (feat. B)"), (277, 277), (TEXT, TEXT), None, (("A, B", "A"), ("B, A", "B")), True),
    ("another uploader", ("Song", "Song"), (268, 269), (TEXT, TEXT), 0.999, (("A", "A"), ("U", "U")), True),
    ("same lyrics, other audio", ("Song", "Song"), (219, 228), (TEXT, TEXT), 0.0, (("A", "A"), ("U", "U")), False),
    ("a cover", ("Song", "Song"), (311, 342), (TEXT, TEXT), None, (("A", "A"), ("U", "U")), False),
    ("same title, other content", ("Song", "Song"), (200, 240), (TEXT, OTHER), None, (("A", "A"), ("A", "A")), False),
    ("nearly the same lyrics", ("Song", "01. Song [x]"), (200, 290), (TEXT, TEXT + "oh"), None, (("A", "A"), ("A", "A")), True),
    ("audio and length", ("Song", "Song"), (200, 203), ("", ""), 0.99, (("A", "A"), ("A", "A")), True),
    ("audio, other length", ("Song", "Song"), (200, 206), ("", ""), 0.99, (("A", "A"), ("A", "A")), False),
    ("strangers alike", ("Song", "Song"), (200, 206), ("", ""), 0.996, (("A", "A"), ("U", "U")), True),
    ("an alias", ("Song", "Quite another name"), (200, 203), (TEXT, TEXT), 0.996, (("A", "A"), ("A", "A")), True),
    ("an alias of strangers", ("Song", "Quite another name"), (200, 203), (TEXT, TEXT), 0.996, (("A", "A"), ("U", "U")), False),
    ("no title", ("", ""), (200, 200), ("", ""), 0.99, (("A", "A"), ("U", "U")), False),
]


def test_duplicate_decision(spark):
    rows, pairs = [], []
    for i, (_, titles, lengths, lyrics, audio, artists, _) in enumerate(CASES):
        for j in range(2):
            rows.append((2 * i + j, titles[j], artists[j][0], None, artists[j][1], None, lengths[j] * 1000, lyrics[j], None, "nan"))
        pairs.append((2 * i, 2 * i + 1, audio))
    schema = "id long, track_name string, artists string, artist_ids string, primary_artist string, primary_artist_id string, track_duration_ms long, plain_lyrics string, synced_lyrics string, lyrics_id string"
    ready = entities.prepared(spark.createDataFrame(rows, schema))
    got = {r.a // 2: r.same for r in entities.same_recording(entities.paired(spark.createDataFrame(pairs, "a long, b long, audio double"), ready)).collect()}
    assert {CASES[i][0]: got[i] for i in got} == {c[0]: c[-1] for c in CASES}
    # the pairs that are met without audio are those that titles, credits and lyrics suggest
    alone = [(i, f"{title} {chr(97 + i // 2) * 5}", *rest) for i, title, *rest in rows if CASES[i // 2][4] is None]  # titles of their own
    kept = {(r.a, r.b) for r in entities.duplicate_pairs(spark.createDataFrame(alone, schema)).collect()}
    assert kept == {(2 * i, 2 * i + 1) for i, c in enumerate(CASES) if c[4] is None and c[-1]}


def test_inverted_file(spark, monkeypatch):
    """Exact without a bound of probes; with a few probes nearly all neighbours of vectors that form groups, many fewer rows read."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 24))
    v = np.concatenate([centres[rng.integers(40, size=1500)] + 0.4 * rng.normal(size=(1500, 24)), np.zeros((1, 24))])
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(5000, None)], "song_idx long, audio_vec array<double>").repartition(6)
    u = v[:1500] / np.linalg.norm(v[:1500], axis=1, keepdims=True)
    c = np.rint(u @ u.T * 1e6) / 1e6
    asked = rows.where("song_idx % 50 = 0").withColumnRenamed("song_idx", "query_id")
    want = {q: sorted((i for i in range(1500) if i != q), key=lambda i: (-c[q, i], i))[:10] for q in range(0, 1500, 50)}
    monkeypatch.setattr(inverted_file, "SHARD", 40)
    built = inverted_file.build(rows, lists=40)
    index = inverted_file.opened(spark, built.path)
    assert built.shards.max() > 1 and (index.centres == built.centres).all()
    for probes, least in ((None, 1.0), (40, 1.0), (6, 0.95)):
        got = {}
        for r in inverted_file.search(index, asked, 10, probes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.song_idx)
        if least == 1.0:
            assert got == want
        assert np.mean([len(set(got[q]) & set(w)) / 10 for q, w in want.items()]) >= least
    few = inverted_file._visits(index, asked.select("query_id", F.col("audio_vec").alias("v"), F.lit(-2.0).alias("least")), lambda cos, least: (np.repeat(np.arange(len(cos)), 6), np.argsort(-cos, axis=1)[:, :6].ravel()))
    assert few.count() < 0.5 * 30 * built.shards.sum()
    none = inverted_file.build(rows.where("false"))
    assert inverted_file.search(none, asked, 10).count() == 0 and inverted_file.search(index, asked.where("false"), 10).count() == 0
