"""What a reviewer found: work that grew faster than its tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonalspark.functions import cleaning, emotion, fuzzy
from tonalspark.llm import jaccard_join
from tonalspark.operators import chain as chains
from tonalspark.operators import catalogue, entities, metrics, retrieval, search, weights
from tonalspark.plans import chain, measures, quality, shaping  # noqa: F401  (they register their queries)
from tonalspark.plans.registry import QUERIES
from tonalspark.sources import catalogue as sources
from tonalspark.sources import versions


def _texts(n, seed, words=300):
    r = random.Random(seed)
    known = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)]
    out = []
    while len(out) < n:
        text = [r.choice(known) for _ in range(words)]
        out.append(" ".join(text))
        for share in (0.004, 0.02, 0.04, 0.08):
            out.append(" ".join(r.choice(known) if r.random() < share else w for w in text))
            out.append("".join(c for c in out[-1] if r.random() > share / 2))
    return out[:n]


def test_texts_that_may_match_are_never_left_out():
    texts = [*_texts(18, 1, 80), *_texts(9, 2, 20), "a" * 130, "a" * 126, "ab" * 65, ""]
    may = fuzzy.may_match(texts, texts, 0.96)
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if i < j]
    shares = fuzzy.matched_shares([(texts[i], texts[j]) for i, j in pairs])
    like = np.array([may[p] for p in pairs])
    assert (shares >= 0.96).sum() > 5 and like[shares >= 0.96].all()
    assert like[shares < 0.6].mean() < 0.05


def test_only_texts_that_may_be_alike_become_candidates(spark, monkeypatch):
    """Unlike lyrics of one title, artist and length were all compared with each other: in full, and in one task."""
    monkeypatch.setattr(entities, "CELL", 4)
    texts = [*dict.fromkeys(_texts(24, 3, 80))]
    rows = spark.createDataFrame([(i, "a song", "a song", ["n:x", "i:1"], t) for i, t in enumerate(texts)], "id long, title string, base string, who array<string>, lyrics string").withColumns({"seconds": F.lit(100.0), "text_id": F.lit(None).cast("string")})
    found = {(r.a, r.b) for r in entities.candidate_pairs(rows).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    shares = fuzzy.matched_shares([(texts[i], texts[j]) for i, j in pairs])
    true = {p for p, s in zip(pairs, shares) if s >= 0.96}
    unlike = {p for p, s in zip(pairs, shares) if s < 0.6}
    assert true and true <= found and len(found & unlike) < len(unlike) / 10
    same = entities.same_recording(entities.paired(entities.candidate_pairs(rows), rows)).where("same")
    assert {(r.a, r.b) for r in same.collect()} == true


def test_best_token_match_of_rows_with_common_words(spark):
    """Rows that have a word in common with most others met all of them; now only those that have no better match look there."""
    r = random.Random(4)
    title = lambda i: " ".join([r.choice(["large", "small"]), *([str(i // 3)] if i % 4 else []), *(["old", "new"] if i % 5 == 0 else [])])
    rows = [(i, f"a{i % 3}", title(i)) for i in range(240)]
    left = [(1000 + i, f"a{i % 2}", title(i)) for i in range(0, 240, 7)]
    df = lambda x: spark.createDataFrame(x, "id long, artist string, title string")
    want = {}
    for i, a, t in left:
        x = set(t.split())
        scores = [(-round(0.7 * len(x & set(u.split())) / len(x | set(u.split())) + 0.3 * (a == b), 9), j) for j, b, u in rows if x & set(u.split())]
        if scores and min(scores)[0] <= -0.5:
            want[i] = min(scores)
    got = {q.left_id: (-q.score, q.right_id) for q in search.best_token_match(df(left), df(rows)).collect()}
    assert got == want and len({s for s, _ in want.values()}) > 2


def test_ideals_come_from_sizes_of_groups(spark):
    """Each seed met every song that shares a mood or artist with it; now grades are made of the songs in the lists alone."""
    r = random.Random(5)
    songs = [(i, r.choice([0, 1, 2, None]), r.choice("mno"), r.choice(["x", "y", None])) for i in range(90)]
    df = spark.createDataFrame(songs, "song_idx long, label int, mood string, artist string")
    recs = [(q, n + 1, s) for q in range(0, 90, 10) for n, s in enumerate(r.sample([i for i in range(90) if i != q], 6))]
    rec = spark.createDataFrame(recs, "query_id long, rank int, song_idx long")
    grade = lambda a, b: sum(x is not None and x == y for x, y in zip(songs[a][1:], songs[b][1:]))
    for k in (3, 10, 60):
        grades, best = metrics.shared_grades(df, df.where("song_idx % 10 = 0"), rec, ("label", "mood", "artist"), k)
        assert grades.count() <= len(recs)
        got = {x.query_id: x.ndcg for x in metrics.graded_ndcg(rec, grades, k, best).collect()}
        for q in range(0, 90, 10):
            gains = sorted((2 ** grade(q, i) - 1 for i in range(90) if i != q), reverse=True)[:k]
            ideal = sum(g / np.log2(n + 2) for n, g in enumerate(gains))
            dcg = sum((2 ** grade(q, s) - 1) / np.log2(n + 1) for p, n, s in recs if p == q and n <= k)
            assert abs(got[q] - dcg / ideal) < 1e-9


@pytest.mark.parametrize("name", ["signal_features", "color_bridges", "beat_features"])
def test_much_work_on_few_bytes_is_dealt_to_all_tasks(spark, name):
    """All rows of a small file were worked through in one task."""
    rows = QUERIES[name](spark, "/root/testdata/sf0.001")
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 8


def test_a_batch_of_work_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "ROWS", 25)
    widest = []
    log = versions.WorkLog(spark, str(tmp_path), "id")
    log.run(spark.range(200), lambda df: (widest.append(max(x["count"] for x in df.groupBy(F.input_file_name()).count().collect())), df)[1], every=200)
    assert log.results().count() == 200 and max(widest) < 100


def test_the_catalogue_sends_neither_of_its_tables_whole(spark):
    plan = sources.catalogue(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    near = [line for line in plan.splitlines() if "p_partkey" in line and "vec_id" in line and "Join" in line]
    assert near and not any("Broadcast" in line for line in near)


def test_rounds_of_components_send_no_side_whole(spark, monkeypatch):
    plans, stored = [], entities.stored
    monkeypatch.setattr(entities, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df, name))[1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r.label for r in entities.components(edges).collect()} == {0}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_rules_by_row_are_run_once(spark, monkeypatch):
    """Both the rows that they drop and the rules by artists ran them again."""
    written, stored = [], quality.stored
    monkeypatch.setattr(quality, "stored", lambda df, name: (written.append(df.rdd.getNumPartitions()), stored(df, name))[1])
    out = quality.filter_chain(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(written) == 1 and plan.count("nursery") < 2


def test_a_search_for_weights_meets_all_songs_once(spark, monkeypatch):
    """Every job of the search held all songs against all seeds anew; now the songs that can be best under any weights are kept."""
    monkeypatch.setattr(weights, "ROWS", 16)
    monkeypatch.setattr(weights, "SEEDS", 8)
    passes, written = [], weights.written
    monkeypatch.setattr(weights, "written", lambda df, name: (passes.append(name), written(df, name))[1])
    rng, n, k = np.random.default_rng(6), 150, 4
    x, y, label = rng.normal(size=(n, 5)), rng.normal(size=(n, 5)), rng.integers(0, 4, n).astype(float)
    for i in range(60, 130):  # copies, whose scores are equal
        x[i], y[i], label[i] = x[i % 7], y[i % 7], label[i % 7]
    songs = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist(), x[i].tolist(), float(label[i])) for i in range(n)], "song_idx long, x array<double>, y array<double>, lyrics_vec array<double>, label double").repartition(2)
    seeds = songs.where("song_idx % 6 = 0").withColumnRenamed("song_idx", "query_id")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    signals = lambda a, b: [*(unit(a[c]) @ unit(b[c]).T for c in ("x", "y")), (a["label"][:, None] == b["label"]).astype(float)]
    parts = signals({"x": x, "y": y, "label": label}, {"x": x, "y": y, "label": label})
    for most in (0.5, 1.0):
        some = weights.simplex(3, 6, most)
        got = {}
        for r in weights.ranked(songs, seeds, signals, some, k).orderBy("rank").collect():
            got.setdefault((r.candidate, r.query_id), []).append(r.song_idx)
        for c, w in enumerate(some):
            score = np.rint(sum(a * m for a, m in zip(w, parts)) * 1e9)
            for q in range(0, n, 6):
                assert got[c, q] == sorted((i for i in range(n) if i != q), key=lambda i: (-score[i, q], i))[:k]
    pool = weights.pools(songs, seeds, signals, weights.corners([(0.4, 0.2, 0.4)], 0.5), k)
    assert pool.count() < seeds.count() * n / 2
    passes.clear()
    truth = spark.createDataFrame([(q, (q + d) % n, d > 20) for q in range(0, n, 6) for d in range(1, 40)], "query_id long, song_idx long, held_out boolean")
    found = weights.search(songs, seeds, truth, signals, [(0.4, 0.2, 0.4)], k=k, least=0.09)
    assert len(found.steps) > 1 and passes.count("seeds") == 1


def test_accuracy_by_labels_comes_from_their_sizes(spark):
    """Each seed met every song of its label, which was shuffled to be made distinct."""
    r = random.Random(9)
    songs = [(i, r.choice([0, 1, 2, 3, None]) if i else 7) for i in range(80)]
    df = spark.createDataFrame(songs, "song_idx long, label int")
    recs = spark.createDataFrame([(q, n + 1, s) for q in range(0, 70, 10) for n, s in enumerate(r.sample([i for i in range(80) if i != q], 6))], "query_id long, rank int, song_idx long")
    seeds = df.where("song_idx % 10 = 0")
    truth = df.join(seeds.select(F.col("song_idx").alias("query_id"), "label"), "label").where("song_idx != query_id").select("query_id", "song_idx")
    for k in (3, 10):
        got = metrics.labelled_accuracy(recs, df, seeds, "label", k)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, metrics.accuracy(recs, truth, k).collect()))
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_block_of_scores_is_small():
    """Blocks of songs and queries made ten matrices of 67 MB each in every task, as soon as tables were large enough to fill them."""
    assert retrieval.ROWS * retrieval.QUERIES * 8 <= 2**23


def test_words_that_no_term_begins_with_are_passed_over(spark):
    """Each word of a text was looked up with its neighbours."""
    value, not_, r = {"sun": 0.9, "old rain": 0.5, "rain": 0.3, "rain sun": 0.1}, ("not", "no"), random.Random(2)
    texts = [" ".join(r.choice(["sun", "old", "rain", "not", "no", "Other", "words", "x"]) for _ in range(r.randint(0, 25))) for _ in range(300)]

    def plain(text):
        w, got, i = text.lower().split(), [], 0
        while i < len(w):
            two = value.get(" ".join(w[i : i + 2])) if i + 1 < len(w) else None
            v = value.get(w[i]) if two is None else two
            if v is not None:
                got.append(1 - v if set(w[max(i - 3, 0) : i]) & set(not_) else v)
            i += 1 if two is None else 2
        return sum(got) / len(got) if len(got) >= 2 else None

    out = spark.createDataFrame([(t,) for t in texts], "t string").select(emotion.grounded_valence(F.col("t"), value, not_).alias("v"))
    assert [r.v if r.v is None else round(r.v, 12) for r in out.collect()] == [x if x is None else round(x, 12) for x in map(plain, texts)]
    assert "filter(transform" in out._jdf.queryExecution().optimizedPlan().toString()


def test_lyrics_are_met_once_by_the_cleaning_chain(spark, monkeypatch):
    """Every kind of copy joined the lyrics anew, and every stage shuffled and wrote them, also of rows that were dropped."""
    written, stored = [], chains.stored
    monkeypatch.setattr(chains, "stored", lambda df, name: (written.append(df), stored(df, name))[1])
    chain.cleaned_raw(spark, "/root/testdata/sf0.001")
    assert not any({"plain_lyrics", "synced_lyrics"} & set(df.columns) for df in written)
    read = [line for df in written for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project [doc_id#" in line and " text#" in line]
    assert len(read) == 1


def test_lyrics_are_read_only_where_a_rule_is_up_to_them(spark):
    """Lyrics of all songs were normalised and searched for seasonal words before titles and albums were looked at."""
    unread = F.when(F.col("id") >= 0, F.raise_error(F.lit("read")).cast("string"))
    rows = spark.createDataFrame([(1, "christmas song", None), (2, "arena springtime winter", None), (3, "other", "some album"), (4, "springtime", "promo")], "id int, title string, album string")
    got = rows.withColumn("is", cleaning.seasonal_release(F.col("title"), F.col("album"), unread, **quality.SEASON)).collect()
    assert [r["is"] for r in sorted(got)] == [True, False, False, True]


def test_lyrics_are_normalised_once_by_the_cleaning_chain(spark):
    """Their digest normalised them anew wherever it named them, and rules searched them again for each of their bounds."""
    rows = chain.raw_tracks(spark, "/root/testdata/sf0.001")
    plan = chain.with_details(rows, spark, "/root/testdata/sf0.001", F.col("track_duration_ms") > 0).select("sung")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(lower(") == plan.count(" AS _words#") == 1


def test_no_link_of_compatible_titles_or_like_lyrics_is_left_out(spark):
    """Other titles than a row's own met only by equal bases, one row stood for all of a base and a text, and bases had to be there."""
    r = random.Random(8)
    titles = ["old plate", "cold plate", "cold plates", "01. old plate [x]", "old plate (abc)", "(old plate)", "one two three four five six", "one two three four five", "abc", "abc (live)", "cold gear", "gear cold", ""]
    base = _texts(5, 4, 30)
    texts = [*base, _texts(5, 6, 30)[0], "", "too short"]
    rows = []
    for i in range(110):
        a = ", ".join(r.sample(["A", "B", "C", "D"], r.choice([1, 1, 2])))
        rows.append((i, r.choice(titles), a, r.choice([None, None, "7", "8"]), a.split(", ")[0], None, 1000 * r.randint(100, 130), r.choice(texts), None, r.choice(["nan", "nan", "nan", "1", "2", "3"])))
    schema = "id long, track_name string, artists string, artist_ids string, primary_artist string, primary_artist_id string, track_duration_ms long, plain_lyrics string, synced_lyrics string, lyrics_id string"
    df = spark.createDataFrame(rows, schema)
    ready = entities.prepared(df).cache()
    near = spark.createDataFrame([(a, b, r.choice([0.985, 0.99, 0.996])) for a in range(0, 110, 3) for b in range(a + 1, 110, 7)], "a long, b long, cosine double")

    def groups(pairs):
        of = list(range(110))
        for a, b in pairs:
            x, y = sorted((of[a], of[b]))
            of = [x if k == y else k for k in of]
        return of

    for heard in (None, near):
        every = spark.range(110).selectExpr("id AS a").join(spark.range(110).selectExpr("id AS b")).where("a < b")
        every = every.withColumn("audio", F.lit(None).cast("double")) if heard is None else every.join(heard.withColumnRenamed("cosine", "audio"), ["a", "b"], "left")
        want = {(x.a, x.b) for x in entities.same_recording(entities.paired(every, ready)).where("same").collect()}
        got = [(x.a, x.b) for x in entities.duplicate_pairs(df, heard).collect()]
        assert len(got) == len(set(got)) and set(got) <= want and groups(got) == groups(want)
        assert 5 < len(set(groups(want))) < 110


def test_texts_that_may_share_are_never_left_out():
    texts = [*_texts(18, 1, 80), *_texts(9, 2, 20), "a" * 130, "a" * 126, "ab" * 65, "", "ab"]
    every = np.arange(len(texts))
    may = fuzzy.may_share(texts, every, every, 0.96, np.ones((len(texts), len(texts)), bool))
    shares = fuzzy.matched_shares([(a, b) for a in texts for b in texts]).reshape(len(texts), -1)
    assert may[shares >= 0.96].all() and may[shares < 0.6].mean() < 0.05


def test_lyrics_are_compared_only_where_they_decide(spark):
    """Unlike lyrics of one lyrics id, of strangers or of other titles were compared in full."""
    rows = [(1, 2, "one", "one", ["n:x"], ["n:x"], 1.0, 1.0, "7", "7", None), (3, 4, "one", "one", ["n:x"], ["n:y"], 1.0, 1.0, None, None, 0.99), (5, 6, "one", "other title", ["n:x"], ["n:x"], 1.0, 1.0, None, None, 0.99), (7, 8, "one", "one", ["n:x"], ["n:x"], 1.0, 2.0, None, None, 0.99)]
    pairs = spark.createDataFrame(rows, "a long, b long, a_title string, b_title string, a_who array<string>, b_who array<string>, a_seconds double, b_seconds double, a_text_id string, b_text_id string, audio double")
    pairs = pairs.withColumns({"a_base": F.col("a_title"), "b_base": F.col("b_title"), "a_lyrics": F.lit("x" * 120), "b_lyrics": F.lit("y" * 120)})
    with pytest.MonkeyPatch.context() as m:
        ratio, read = entities.sequence_ratio, F.raise_error(F.lit("compared")).cast("double")
        m.setattr(entities, "sequence_ratio", lambda a, b, least=0.0: F.when(a.isNotNull(), read).otherwise(1.0) if least else ratio(a, b))
        same = entities.same_recording(pairs)
    assert {x.a: x.same for x in same.collect()} == {1: True, 3: False, 5: False, 7: True}


def test_sketches_never_leave_out_a_link():
    """Rows that met by a common block alone brought their texts to cells, more and more of them in larger tables."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 300, 3000):
        for change in (0, 0.02, 0.09, 0.1, 0.11, 0.12, 0.5, 1):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate((a[int(change * len(a)) :], rng.integers(0, 1 << 63, int(rng.uniform(0.8, 1.2) * change * n), dtype=np.uint64))))
            x, y = (np.frombuffer(jaccard_join.sketch(s), np.uint8) for s in (a, b))
            bins, common = min(len(x), len(y)), len(np.intersect1d(a, b))
            near = jaccard_join._near(jaccard_join.folded(x, bins), jaccard_join.folded(y, bins)[None], 80)[0]
            assert near or 100 * common < 80 * (len(a) + len(b) - common)
            assert not near or change < 0.5 or n < 40


def test_only_rows_that_may_be_linked_bring_their_texts(spark, monkeypatch):
    r = random.Random(4)
    known = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        text = [r.choice(known) for _ in range(120)]
        texts += [text, [r.choice(known) if r.random() < 0.012 else w for w in text], [r.choice(known) if r.random() < 0.03 else w for w in text]]
    common = "some words that all of these texts begin with and so they meet".split()
    docs = spark.createDataFrame([(i, " ".join(common + t)) for i, t in enumerate(texts)], "doc_id long, text string")
    asked, overlaps = [], jaccard_join.overlaps
    monkeypatch.setattr(jaccard_join, "overlaps", lambda pairs, *rest: (asked.append(pairs.count()), overlaps(pairs, *rest))[1])
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(docs, 5, 80).collect()}
    grams = [{tuple((common + t)[i : i + 5]) for i in range(len(common) + len(t) - 4)} for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j]):
                x, y = sorted((want[i], want[j]))
                want = [x if c == y else c for c in want]
    assert got == dict(enumerate(want)) and len(set(want)) < len(texts) and asked[0] <= len(texts)


def test_a_report_of_covers_finds_pairs_once_and_broadcasts_none(spark, monkeypatch):
    """Pairs by sound were found twice, and they and the songs' keys were sent to the driver and to all executors."""
    written, stored = [], catalogue.stored
    monkeypatch.setattr(catalogue, "stored", lambda df, name: (written.append(name), stored(df, name))[1])
    songs = spark.range(60).select(F.col("id").alias("song_idx"), F.concat(F.lit("title "), F.col("id") % 7).alias("title"), F.concat(F.lit("artist "), F.col("id") % 2).alias("artist"))
    pairs = spark.range(59).select(F.col("id").alias("a"), (F.col("id") + F.when(F.col("id") < 40, 14).otherwise(1)).alias("b")).where("b < 60")
    out = catalogue.cover_report(songs, pairs, F.col("title"), F.col("artist"))
    near = {(i, i + (14 if i < 40 else 1)) for i in range(59)}
    named = {(i, j) for j in range(60) for i in range(j) if (i - j) % 14 == 0}
    assert dict(map(tuple, out.collect())) == {"songs": 60, "by_sound": len(near), "more_by_title": len(named - near), "covered": len({i for p in near | named for i in p})}
    assert written == ["pairs"] and "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
