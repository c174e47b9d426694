"""Indexes, searches for weights, nested folds and sequence ratios held against plain loops."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tonalspark.functions import fuzzy
from tonalspark.functions import text as T
from tonalspark.operators import inverted_file, probes, search, trigram_index, weights

NAMES = ["", "a", "of", "Đêm mưa", "dem mua", "Small Ring 12", "small ring", "smalll rnig", "ring small 12", "the ringing", "Österreich", "12 12 12", "x-y", "brand", "Brand#12", "Brand 12 (live)", "ring", "éclair ring"]


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(NAMES) + rng.choice(["", " two", " ring"]), rng.choice(NAMES), rng.choice([None, 1.0, 2.0])) for i in range(600)]
    return spark.createDataFrame([*rows, (900, None, None, 1.0)], "item long, title string, artist string, popularity double")


def test_trigram_index_finds_what_a_scan_finds(spark, items):
    index = trigram_index.build(items.repartition(4))
    for query in ("brand 12", "small ring", "ri", "12", "é", "dem mua", "nothing like it", "small rong 13", "a ring"):
        for least in (0.3, 0.7):
            got = [tuple(r) for r in trigram_index.search(index, query, 1000, least).collect()]
            assert got == [tuple(r) for r in search.by_trigrams(items, query, 1000, least).collect()], query
    assert trigram_index.search(trigram_index.build(items.where("false")), "ring", 5).count() == 0


def test_trigram_index_reads_matching_postings_alone(spark, items):
    index = trigram_index.build(items)
    few = trigram_index.candidates(index, "brand 12", 0.5)
    plan = few._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan and "/items" not in plan
    assert few.count() < 0.5 * items.count()


def test_sequence_ratios_against_plain_recursion(spark):
    rng = random.Random(1)
    pairs = [("", ""), ("a", ""), ("abc", "abc"), ("é🎉x", "x🎉é"), ("ab" * 40, "ba" * 40)]
    for _ in range(400):
        a = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60)))
        b = list(a) if rng.random() < 0.5 else [rng.choice("abcd ") for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(4)):
            if b:
                b[rng.randrange(len(b))] = rng.choice("abcxyz")
        pairs.append((a, "".join(b)))
    want = [SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]
    assert np.allclose(fuzzy.matched_shares(pairs), want, atol=1e-12)
    some = fuzzy.matched_shares(pairs, 0.8)
    assert all(abs(g - w) < 1e-12 if w >= 0.8 else g in (0.0, pytest.approx(w)) for g, w in zip(some, want))
    df = spark.createDataFrame([*pairs, (None, "a"), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(fuzzy.sequence_ratio(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got, [*want, 0.0, 1.0], atol=1e-12)


def test_probed_neighbours(spark):
    d = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = np.array([r.embedding for r in e.orderBy("vec_id").collect()], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = inverted_file.build(e, "vec_id", "embedding", lists=32)
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in inverted_file.search(index, asked, 10, probes=24, vector="embedding").collect():
        got.setdefault(r.query_id, set()).add(r.song_idx)
    want = {q: set(np.lexsort((np.arange(len(v)), -np.where(np.arange(len(v)) == q, -2, v @ v[q])))[:10].tolist()) for q in range(0, len(v), 20)}
    assert np.mean([len(got[q] & w) / 10 for q, w in want.items()]) >= 0.95


def test_simplex():
    for n, steps, most in ((3, 4, 1.0), (4, 6, 0.5)):
        got = weights.simplex(n, steps, most)
        assert len(got) == len(set(got)) and all(abs(sum(w) - 1) < 1e-9 and max(w) <= most + 1e-9 for w in got)
        plain = [c for c in np.ndindex(*[steps + 1] * n) if sum(c) == steps and max(c) <= most * steps]
        assert len(got) == len(plain)


def test_weight_search_against_plain_loops(spark):
    rng = np.random.default_rng(8)
    n, k = 80, 5
    kinds = rng.integers(0, 6, n)
    vec = {c: rng.normal(size=(n, 6)) + w * np.eye(6)[kinds] * 4 for c, w in (("x", 0.2), ("y", 1.0), ("lyrics_vec", 0.0))}
    songs = spark.createDataFrame([(i, *[vec[c][i].tolist() for c in vec]) for i in range(n)], "song_idx long, x array<double>, y array<double>, lyrics_vec array<double>").repartition(3)
    seeds = songs.where("song_idx % 4 = 0").withColumnRenamed("song_idx", "query_id")
    lists = spark.createDataFrame([(int(10 * kinds[i] + i % 3), i) for i in range(n)], "list_id long, song_idx long")
    split = weights.split_lists(lists)
    held = {r.list_id: r.held_out for r in split.collect()}
    assert sum(not h for h in held.values()) == round(0.8 * len(held))
    truth = weights.relevant(split, seeds)
    good = {(r.query_id, r.song_idx, r.held_out) for r in truth.collect()}
    assert good == {(q, s, held[l]) for l in held for q, s in ((a, b) for a in range(0, n, 4) for b in range(n) if a != b and 10 * kinds[a] + a % 3 == l == 10 * kinds[b] + b % 3)}

    def unit(m):
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def signals(rows, asked):
        return [unit(rows[c]) @ unit(asked[c]).T for c in ("x", "y", "lyrics_vec")]

    parts = [unit(vec[c]) @ unit(vec[c]).T for c in ("x", "y", "lyrics_vec")]

    def plain(w):
        out, ilds = {False: [], True: []}, []
        for q in range(0, n, 4):
            score = np.rint(sum(a * m[:, q] for a, m in zip(w, parts)) * 1e9)
            top = sorted((i for i in range(n) if i != q), key=lambda i: (-score[i], i))[:k]
            for h in out:
                rel = {s for a, s, x in good if a == q and x == h}
                if rel:
                    out[h].append(sum(1 / np.log2(r + 2) for r, s in enumerate(top) if s in rel) / sum(1 / np.log2(r + 2) for r in range(min(len(rel), k))))
            if any(a == q and not x for a, _, x in good):
                ilds.append(np.mean([1 - parts[2][a, b] for a, b in combinations(top, 2)]))
        return np.mean(out[False]), np.mean(out[True]), np.mean(ilds)

    some = [(0.5, 0.5, 0.0), (0.2, 0.3, 0.5), (0.0, 0.5, 0.5)]
    for r in weights.evaluated(songs, seeds, truth, signals, some, k, "lyrics_vec").collect():
        assert np.allclose((r.ndcg, r.held_out_ndcg, r.ild), plain(some[r.candidate]), atol=1e-9)
    base = (0.4, 0.2, 0.4)
    found = weights.search(songs, seeds, truth, signals, [base], k=k, step=0.2, least=0.04)
    floor = 0.95 * plain(base)[2]
    best = max(x[0] for x in map(plain, weights.simplex(3, 10, 0.5)) if x[2] >= floor)
    assert np.allclose((found.ndcg, found.held_out_ndcg, found.ild), plain(found.weights), atol=1e-9)
    assert found.ild >= floor - 1e-9 and found.ndcg >= best - 1e-9 and max(found.weights) <= 0.5 + 1e-9 and abs(sum(found.weights) - 1) < 1e-9
    frozen = weights.search(songs, seeds, truth, signals, [base], k=k, step=0.2, least=0.1, frozen=(2,))
    assert frozen.weights == (0.5, 0.5, 0.0)


def test_nested_folds_and_transfer(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    y = x @ rng.normal(size=8) + 2 + rng.normal(size=300) * 2
    fold, inner = rng.integers(0, 5, 300), rng.integers(0, 3, 300)
    rows = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), int(fold[i]), int(inner[i])) for i in range(300)] + [(900, None, 1.0, 0, 0), (901, [0.0] * 8, None, 0, 0)], "i long, v array<double>, y double, f int, g int").repartition(4)
    strengths = [0.1, 10.0, 100.0, 1000.0]

    def fit(a, b, alpha):
        m, c = a.mean(0), b.mean()
        w = np.linalg.solve((a - m).T @ (a - m) + alpha * np.eye(8), (a - m).T @ (b - c))
        return lambda z: (z - m) @ w + c

    r2 = lambda p, t: 1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum()
    got = {r.fold: r for r in probes.nested_ridge(rows, "v", "y", F.col("f"), F.col("g"), strengths).collect()}
    assert set(got) == set(range(5))
    for o, r in got.items():
        train = fold != o
        scores = [np.mean([r2(fit(x[train & (inner != g)], y[train & (inner != g)], a)(x[train & (inner == g)]), y[train & (inner == g)]) for g in range(3)]) for a in strengths]
        alpha = strengths[int(np.argmax(scores))]
        assert r.alpha == alpha and abs(r.r2 - r2(fit(x[train], y[train], alpha)(x[~train]), y[~train])) < 1e-9 and r.rows == (~train).sum()
    told, score = probes.transferred(rows.where("f < 3"), rows.where("f >= 3"), "v", "y", 10.0)
    model, test = fit(x[fold < 3], y[fold < 3], 10.0), fold >= 3
    assert abs(score - r2(model(x[test]), y[test])) < 1e-9
    assert all(abs(r.predicted - model(x[[r.i]])[0]) < 1e-9 for r in told.collect())
    assert probes.nested_ridge(rows.where("false"), "v", "y", F.col("f"), F.col("g"), strengths).count() == 0
