"""Operators 11 to 13 held against brute force."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tonalspark.llm import importance, neighbours, queries, vector_codes

from .conftest import prose

DIR = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def collected(df):
    return [r.asDict() for r in df.collect()]


def vectors_of(spark, rows, label=True):
    """Rows (vec_id, embedding, label) with columns whose names clash with those that the operators add."""
    return spark.createDataFrame([(*r, 1, 2.0, "c", b"x", 0) for r in rows], "vec_id long, embedding array<float>, label int, cell int, score double, code string, parts binary, rank int")


@pytest.fixture(scope="module")
def embeddings():
    t = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{DIR}/embeddings.parquet' ORDER BY vec_id").fetchall()
    return [(i, list(e), n) for i, e, n in t]


# 11


def plain_neighbours(rows, every, k):
    ok = sorted({(i, tuple(e)) for i, e, *_ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)})
    out, asked = {}, set()
    for q, v in ok:
        if q % every == 0 and q not in asked:
            asked.add(q)
            scores = []
            for i, w in ok:
                if i != q:
                    s = 0.0
                    for a, b in zip(v, w):
                        s += float(np.float32(a)) * float(np.float32(b))
                    scores.append((-s, i))
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / max(sum(map(len, want.values())), 1)


def found(df):
    out = {}
    for r in sorted(collected(df), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_chi_square_quantiles():
    for share, degrees, want in ((0.95, 1, 3.841459), (0.95, 12, 21.026070), (0.5, 2, 2 * math.log(2)), (0.99, 30, 50.892181)):
        assert neighbours.chi_square_quantile(share, degrees) == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("shard", [neighbours.SHARD, 32])
def test_recall_and_scores(spark, embeddings, shard):
    want = plain_neighbours(embeddings, 20, 20)
    rows = collected(neighbours.neighbours(vectors_of(spark, embeddings), shard=shard))
    got = found(neighbours.neighbours(vectors_of(spark, embeddings), shard=shard))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values()) and len(rows) == 20 * len(got)
    assert recall(got, want) >= 0.95
    exact = {(q, i): s for q, w in plain_neighbours(embeddings, 20, len(embeddings)).items() for i, s in w}
    for q, near in got.items():
        assert [(-s, i) for i, s in near] == sorted((-s, i) for i, s in near)
        assert all(exact[q, i] == s for i, s in near)  # to the last bit


def test_groups_of_vectors_are_searched_in_part(spark, monkeypatch):
    """Where vectors form groups the test stops the search early, and small lengths are no harm."""
    rng = np.random.default_rng(2)
    middles = rng.standard_normal((30, 16))
    rows = [(i, ((middles[i % 30] + 0.05 * rng.standard_normal(16)) * (1 + (i % 7) / 20)).tolist(), None) for i in range(3000)]
    monkeypatch.setattr(neighbours, "LEAF", 32)
    df = vectors_of(spark, rows)
    index = neighbours.build(df, 10, shard=256)
    asked = df.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "CAST(embedding AS array<double>) AS embedding")
    got = neighbours.search(index, asked, 10)
    assert recall(found(got), plain_neighbours(rows, 50, 10)) >= 0.9
    tried = {r["query_id"]: r["verified"] for r in collected(got)}
    assert len(index.shards) > 4 and np.mean(list(tried.values())) < 0.5 * len(rows)


def test_copies_and_ties(spark):
    """Copies fill ranks by their ids; more copies than ranks, in many shards, lose none of them."""
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    rows = [(i, base[0] if i % 3 == 0 else base[i % 60], 1) for i in range(900)]
    got, want = found(neighbours.neighbours(vectors_of(spark, rows), every=30, k=20, shard=16)), plain_neighbours(rows, 30, 20)
    assert set(got) == set(want) and recall(got, want) >= 0.95
    assert got[0] == want[0]


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [2.0, 0.0], None), (2, None, 1), (3, [None, 1.0], 1), (4, [NAN, 1.0], 1), (5, [INF, 1.0], 1), (6, [0.0, -0.0], 1), (7, [], 1), (None, [1.0, 1.0], 1),
        (8, [0.5], 1), (20, [0.0, 1.0, 3.0], 1), (20, [0.0, 1.0, 3.0], 1), (40, [-1.0, 0.0], 1), (40, [-1.0, 5.0], 2), (60, [3e38, 3e38], 1), (-20, [1.0, 0.0], 1),
    ]
    got = found(neighbours.neighbours(vectors_of(spark, rows)))
    assert got == plain_neighbours(rows, 20, 20) and set(got) == {0, 20, 40, 60, -20}
    assert neighbours.neighbours(vectors_of(spark, rows).where("false")).count() == 0
    assert neighbours.neighbours(vectors_of(spark, rows[:1])).count() == 0


# 12


def plain_importance(docs, target, most, buckets, least, percent, seed):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    made, aims = [(i, *grams(t)) for i, t in docs], [grams(t)[1] for t in target]
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, _, g in made:
        np.add.at(s, g, 1)
    for g in aims:
        np.add.at(t, g, 1)
    gain = [math.floor(1000 * math.log((float(a) + 1) * (float(s.sum()) + buckets) / ((float(b) + 1) * (float(t.sum()) + buckets)))) for a, b in zip(t.tolist(), s.tolist())]
    rows = []
    for i, n, g in made:
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = fit[: percent * len(fit) // 100]
    out = [(*r, k) for k, r in enumerate(drawn, 1)]
    rest = list(rows)
    for r in drawn:
        rest.remove(r)
    return sorted(map(repr, out + [(*r, None) for r in rest]))


def test_crcs_are_combined():
    rng = random.Random(1)
    words = [bytes(rng.randrange(97, 123) for _ in range(rng.choice((1, 2, 7, 300, 70_000)))) for _ in range(40)]
    crcs, lengths = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words])
    for n, got in enumerate(importance.ngram_crcs(crcs, lengths, 4), 1):
        assert got.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_importance_against_plain_loops(spark, odd, none, monkeypatch, most):
    monkeypatch.setattr(importance, "PIECE", 50)
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randrange(1, 80))) for i in range(300)] + [(i, "Ünïcode WORDS 中文 mixed-up 7 " * (i % 9)) for i in range(300, 340)] + [(5, "same words " * 40)] * 30 + [(None, "x y " * 15)] * 9
    target = [prose(rng, 50) for _ in range(5)] + [None, ""]
    tdf = spark.createDataFrame([(t, "z") for t in target], "text string, doc_id string")
    odd_rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for df, rows in ((spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank int, weight int"), docs), (odd, odd_rows), (none, [])):
        for percent in (10, 100, 0):
            got = importance.importance(df, tdf, most=most, buckets=97, percent=percent, seed=7)
            assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
            assert sorted(repr(tuple(r)) for r in got.collect()) == plain_importance(rows, target, most, 97, 20, percent, 7)


def test_resampled_rows(spark, odd):
    drawn = {r["doc_id"] for r in importance.importance(odd, odd, percent=50).where("rank IS NOT NULL").collect()}
    got = importance.resample(odd, odd, percent=50)
    assert got.columns == odd.columns and {r["doc_id"] for r in got.collect()} == drawn - {None}
    assert all(r["text"] in {o["text"] for o in odd.collect()} for r in got.collect())


def test_importance_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()
    target = [t for (t,) in duckdb.sql(f"SELECT text FROM '{DIR}/benchmark.parquet'").fetchall()]
    got = sorted(repr((r["doc_id"], r["n_features"], r["n_features"], r["weight"], r["score"], r["rank"])) for r in queries.op12_importance(spark, DIR).collect())
    assert got == plain_importance(docs, target, 1, 10_000, 20, 10, 2024)


# 13


def plain_codes(rows, parts=4, entries=256, rounds=4, unit=1024):
    kept = [(i, [math.floor(unit * float(np.float32(x))) for x in e], n) for i, e, n in rows if e and all(x is not None and math.isfinite(x) and abs(x) <= vector_codes.LARGEST / unit for x in e)]
    if not kept:
        return []
    width = -(-max(len(e) for _, e, _ in kept) // parts)
    kept = [(i, e + [0] * (parts * width - len(e)), n) for i, e, n in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], np.int32).tobytes()))[:entries]
    cut = lambda e, p: e[p * width : (p + 1) * width]
    books = [[cut(e, p) for _, e, _ in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, e, _ in kept:
                of.setdefault(nearest(cut(e, p), books[p])[1], []).append(cut(e, p))
            books[p] = [[sum(c) // len(c) for c in zip(*of[j])] if j in of else c for j, c in enumerate(books[p])]
    out = []
    for i, e, n in kept:
        near = [nearest(cut(e, p), books[p]) for p in range(parts)]
        out.append((i, n, bytes(j for _, j in near).hex(), sum(d for d, _ in near)))
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(repr((i, c, e, sum(r[3] for r in out if r[1] == n), sha)) for i, n, c, e in out)


def digest(df):
    return sorted(repr(tuple(r)) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_codes_against_plain_loops(spark):
    rng = np.random.default_rng(1)
    middles = rng.standard_normal((12, 10))
    rows = [(int(i), (middles[i % 12] + 0.2 * rng.standard_normal(10)).round(2).tolist(), None if i % 5 == 0 else int(i % 3)) for i in range(400)]
    rows += [(7, rows[7][1], 2)] * 40 + [(None, rows[8][1], 1)] * 3  # ten components for four parts, copies, few values: many ties
    rows += [(500, None, 1), (501, [], 1), (502, [NAN] * 10, 1), (503, [INF] * 10, 1), (504, [None] * 10, 1), (505, [1e30] * 10, 1), (506, [0.0] * 10, 1), (507, [-3.0, 2.5], 9), (508, [1e4] * 10, 9)]
    for parts, entries in ((4, 16), (2, 256), (1, 7)):
        got = vector_codes.survey(vectors_of(spark, rows).repartition(5), parts=parts, entries=entries)
        assert digest(got) == plain_codes(rows, parts, entries)
    assert digest(vector_codes.survey(vectors_of(spark, rows).where("false"))) == []
    assert digest(vector_codes.survey(vectors_of(spark, rows[:1]))) == plain_codes(rows[:1])


def test_large_components_are_measured_exactly(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-130_000, 130_000) for _ in range(4)], 1) for i in range(60)]
    assert digest(vector_codes.survey(vectors_of(spark, rows), parts=2, entries=5)) == plain_codes(rows, 2, 5)


def test_bounds_spare_distances(spark, embeddings):
    made = vector_codes.compress(vectors_of(spark, embeddings), entries=64)
    n = len(embeddings) * 4 * 64
    assert made.tried[0] == n and len(made.tried) == 5 and made.tried[4] < made.tried[3] < 0.5 * n


def test_codes_query(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    want = con.sql("SELECT vec_id, code, error, label_error, codebooks_sha256 FROM (" + queries.oracle_sql()["op13_vector_codes"] + ")").fetchall()
    assert digest(queries.op13_vector_codes(spark, DIR)) == sorted(map(repr, want))
