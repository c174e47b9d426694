"""Systems held against each other: baselines, ablations, sweeps, audits, and the statistics of their reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.emotion import LABEL_PLACES, nearest_label
from ..operators import metrics as M
from ..operators import probes, ranks, retrieval, weights
from ..sources import sinks
from ..sources.shared import stored
from .evaluation import _TOP, _accuracy, _recs
from .registry import query, songs, table
from .similarity import _FUSED, _TARGETS, _targets, seeds_of

_JACCARD = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))::DOUBLE"


def _listed(recs: DataFrame, out: str = "list") -> DataFrame:
    return recs.groupBy("query_id").agg(F.collect_set("song_idx").alias(out))


def _jaccard(a: str, b: str):
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _sure(seeds: str) -> str:
    return f"""SELECT q.song_idx AS query_id, s.song_idx, round_even((0.08 * (list_cosine_similarity(s.lyrics_vec, q.lyrics_vec) + 1) / 2 + 0.16 * exp(-0.5 * (power((s.valence - q.valence) / 0.22, 2) + power((s.arousal - q.arousal) / 0.14, 2))) + 0.76 * (list_dot_product(s.audio_vec, q.audio_vec) + 1) / 2) * 1e6, 0) / 1e6 AS score
  FROM songs s, {seeds} q WHERE s.song_idx <> q.song_idx"""


@query(
    "symmetry",
    f"""WITH {_TOP}, b AS (SELECT query_id, min_by(song_idx, (song_idx * 7919 % 1009) * 1000000 + song_idx) AS other, list(song_idx) AS l FROM recs GROUP BY query_id), o AS (SELECT DISTINCT s.* FROM songs s JOIN b ON s.song_idx = other),
    r AS (SELECT query_id, list(song_idx) AS m FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_idx) AS n FROM ({_sure('o')}) WHERE score >= 0.3) WHERE n <= 10 GROUP BY query_id)
    SELECT b.query_id, other, round({_JACCARD.format('l', 'm')}, 6) AS overlap FROM b JOIN r ON r.query_id = other""",
)
def symmetry(spark: SparkSession, d: str) -> DataFrame:
    """How much the list of a seed has in common with that of one of its songs, chosen by a hash."""
    s, recs = _recs(spark, d)
    place = (F.col("song_idx") * 7919 % 1009) * 1_000_000 + F.col("song_idx")
    chosen = recs.groupBy("query_id").agg(F.min_by("song_idx", place).alias("other"), F.collect_set("song_idx").alias("l"))
    others = s.join(chosen.select(F.col("other").alias("song_idx")).distinct(), "song_idx", "left_semi")
    theirs = _listed(retrieval.similar_songs(s, others, 10), "m").withColumnRenamed("query_id", "other")
    return chosen.join(theirs, "other").select("query_id", "other", F.round(_jaccard("l", "m"), 6).alias("overlap"))


@query("serendipity", f"WITH {_TOP} SELECT query_id, round(avg(1 - least(greatest(list_cosine_similarity(s.lyrics_vec, q.lyrics_vec), -1), 1)), 6) AS serendipity, round(avg(CASE WHEN s.artist = q.artist THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS same_artist FROM recs JOIN songs s USING (song_idx) JOIN songs q ON q.song_idx = query_id GROUP BY query_id")
def serendipity(spark: SparkSession, d: str) -> DataFrame:
    """How far the songs of a list are from their seed in words, and how many are of its artist."""
    s, recs = _recs(spark, d)
    q = s.select(F.col("song_idx").alias("query_id"), F.col("lyrics_vec").alias("q"), F.col("artist").alias("q_artist"))
    far = 1 - F.least(F.greatest(V.cosine(F.col("lyrics_vec"), F.col("q")), F.lit(-1.0)), F.lit(1.0))
    return recs.join(s.select("song_idx", "lyrics_vec", "artist"), "song_idx").join(q, "query_id").groupBy("query_id").agg(F.round(F.avg(far), 6).alias("serendipity"), F.round(F.avg((F.col("artist") == F.col("q_artist")).cast("double")), 6).alias("same_artist"))


_BASE = """lists AS (
  SELECT 'audio' AS system, q.song_idx AS query_id, s.song_idx, round_even(list_cosine_similarity(s.audio_vec, q.audio_vec) * 1e6, 0) / 1e6 AS score FROM songs s, seeds q WHERE s.song_idx <> q.song_idx
  UNION ALL SELECT 'lyrics', q.song_idx, s.song_idx, round_even(list_cosine_similarity(s.lyrics_vec, q.lyrics_vec) * 1e6, 0) / 1e6 FROM songs s, seeds q WHERE s.song_idx <> q.song_idx
  UNION ALL SELECT 'mood', q.song_idx, s.song_idx, round_even(exp(-0.5 * (power((s.valence - q.valence) / 0.20, 2) + power((s.arousal - q.arousal) / 0.14, 2))) * 1e6, 0) / 1e6 FROM songs s, seeds q WHERE s.song_idx <> q.song_idx
  UNION ALL SELECT 'popularity', q.song_idx, s.song_idx, s.popularity FROM (SELECT * FROM songs ORDER BY popularity DESC, song_idx LIMIT 11) s, seeds q WHERE s.song_idx <> q.song_idx
), simple AS (SELECT system, query_id, song_idx, row_number() OVER (PARTITION BY system, query_id ORDER BY score DESC, song_idx) AS rank FROM lists QUALIFY rank <= 10)"""


def baselines(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """(system, query_id, rank, song_idx) of simple systems: nearest by audio, lyrics or mood alone, and the most popular songs."""
    s = songs(spark, d)
    q = seeds_of(s)
    targets = q.select(F.col("song_idx").alias("query_id"), F.col("valence").alias("t_valence"), F.col("arousal").alias("t_arousal"))
    mood = retrieval.by_targets(s, targets, k + 1).where("song_idx != query_id")
    top = s.orderBy(F.col("popularity").desc(), "song_idx").limit(k + 1).select("song_idx", F.col("popularity").alias("score"))
    popular = q.select(F.col("song_idx").alias("query_id")).crossJoin(F.broadcast(top)).where("song_idx != query_id")  # k + 1 rows for each seed
    lists = {"audio": retrieval.nearest(s, q, k), "lyrics": retrieval.nearest(s, q, k, "lyrics_vec"), "mood": ranks.top_per_query(mood.drop("rank"), F.col("score"), k), "popularity": ranks.top_per_query(popular, F.col("score"), k)}
    return reduce(DataFrame.unionByName, [x.select(F.lit(n).alias("system"), "query_id", "rank", "song_idx") for n, x in lists.items()])


@query("baseline_lists", f"WITH {{songs}}, {_FUSED.split(', scored AS')[0]}, {_BASE} SELECT system, query_id, CAST(rank AS INTEGER) AS rank, song_idx FROM simple")
def baseline_lists(spark: SparkSession, d: str) -> DataFrame:
    return baselines(spark, d)


@query("random_baseline", "WITH {songs} SELECT song_idx FROM songs ORDER BY md5('7/' || song_idx), song_idx LIMIT 10")
def random_baseline(spark: SparkSession, d: str) -> DataFrame:
    """A uniform sample, by a hash of the song's number."""
    return songs(spark, d).orderBy(F.md5(F.concat(F.lit("7/"), F.col("song_idx").cast("string"))), "song_idx").limit(10).select("song_idx")


_NDCG = "sum(CASE WHEN s.label = q.label THEN 1 / log2(rank + 1) ELSE 0 END) / 4.543559338088346"


@query("editorial_ndcg", f"WITH {_TOP}, {_BASE}, all_ AS (SELECT system, query_id, rank, song_idx FROM simple UNION ALL SELECT 'fused', query_id, rank, song_idx FROM recs) SELECT system, round(avg(n), 6) AS ndcg, count(*) AS queries FROM (SELECT system, query_id, {_NDCG} AS n FROM all_ JOIN songs s USING (song_idx) JOIN songs q ON q.song_idx = query_id GROUP BY system, query_id) GROUP BY system")
def editorial_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """The mean gain of the fused system and of the simple ones, where songs of the seed's label are right."""
    s, recs = _recs(spark, d)
    lists = baselines(spark, d).unionByName(recs.select(F.lit("fused").alias("system"), "query_id", "rank", "song_idx"))
    label = s.select("song_idx", "label")
    met = lists.join(label, "song_idx").join(label.select(F.col("song_idx").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    gain = met.groupBy("system", "query_id").agg((F.sum(F.when(F.col("label") == F.col("q_label"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)) / 4.543559338088346).alias("n"))
    return gain.groupBy("system").agg(F.round(F.avg("n"), 6).alias("ndcg"), F.count(F.lit(1)).alias("queries"))


_ARMS = {"none": (0.08, 0.16, 0.76), "lyrics": (0.0, 0.16, 0.76), "mood": (0.08, 0.0, 0.76), "audio": (0.08, 0.16, 0.0)}


def _arm(w: tuple[float, float, float]) -> tuple[float, float, float]:
    return tuple(x / sum(w) for x in w)


def _arm_sql(name: str, w: tuple[float, float, float]) -> str:
    a, b, c = (f"{x!r}::DOUBLE" for x in _arm(w))
    return f"""SELECT '{name}' AS dropped, q.song_idx AS query_id, s.song_idx, round_even(({a} * (list_cosine_similarity(s.lyrics_vec, q.lyrics_vec) + 1) / 2 + {b} * exp(-0.5 * (power((s.valence - q.valence) / 0.22, 2) + power((s.arousal - q.arousal) / 0.14, 2))) + {c} * (list_dot_product(s.audio_vec, q.audio_vec) + 1) / 2) * 1e6, 0) / 1e6 AS score FROM songs s, seeds q WHERE s.song_idx <> q.song_idx"""


@query("ablation", f"WITH {{songs}}, seeds AS (SELECT * FROM songs WHERE song_idx % 100 = 0), l AS ({' UNION ALL '.join(_arm_sql(n, w) for n, w in _ARMS.items())}), t AS (SELECT *, row_number() OVER (PARTITION BY dropped, query_id ORDER BY score DESC, song_idx) AS rank FROM l WHERE score >= 0 QUALIFY rank <= 10), g AS (SELECT dropped, query_id, {_NDCG} AS n FROM t JOIN songs s USING (song_idx) JOIN songs q ON q.song_idx = query_id GROUP BY dropped, query_id), m AS (SELECT dropped, avg(n) AS m FROM g GROUP BY dropped) SELECT dropped, round(m, 6) AS ndcg, round(m - (SELECT m FROM m WHERE dropped = 'none'), 6) AS change FROM m")
def ablation(spark: SparkSession, d: str) -> DataFrame:
    """What is lost without each part of the score, the other weights scaled to one."""
    s = songs(spark, d)
    label = s.select("song_idx", "label")
    arms = []
    for name, w in _ARMS.items():
        a, b, c = _arm(w)
        recs = retrieval.similar_songs(s, seeds_of(s), 10, weights=(0, 0, 0, a, b, 0, 0, c), floor=0.0)
        arms.append(recs.withColumn("dropped", F.lit(name)))
    met = reduce(DataFrame.unionByName, arms).join(label, "song_idx").join(label.select(F.col("song_idx").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    gain = met.groupBy("dropped", "query_id").agg((F.sum(F.when(F.col("label") == F.col("q_label"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)) / 4.543559338088346).alias("n"))
    means = gain.groupBy("dropped").agg(F.avg("n").alias("m"))
    whole = means.where("dropped = 'none'").select(F.col("m").alias("whole"))
    return means.join(F.broadcast(whole)).select("dropped", F.round("m", 6).alias("ndcg"), F.round(F.col("m") - F.col("whole"), 6).alias("change"))


@query("weight_grid", f"WITH {_TOP}, p AS (SELECT query_id, r.song_idx, (list_cosine_similarity(s.lyrics_vec, q.lyrics_vec) + 1) / 2 AS l, (list_dot_product(s.audio_vec, q.audio_vec) + 1) / 2 AS a, CASE WHEN s.label = q.label THEN 1 ELSE 0 END AS good FROM recs r JOIN songs s USING (song_idx) JOIN songs q ON q.song_idx = query_id), g AS (SELECT i / 10.0::DOUBLE AS w FROM range(0, 11) t(i)), r AS (SELECT w, query_id, good, row_number() OVER (PARTITION BY w, query_id ORDER BY round_even((w * a + (1 - w) * l) * 1e9, 0) DESC, song_idx) AS rank FROM p, g), n AS (SELECT w, query_id, sum(good / log2(rank + 1)) AS n FROM r GROUP BY w, query_id) SELECT w, round(avg(n), 6) AS ndcg FROM n GROUP BY w")
def weight_grid(spark: SparkSession, d: str) -> DataFrame:
    """How the order of each list would do under other weights of audio against lyrics: a grid of weights as rows."""
    s, recs = _recs(spark, d)
    q = s.select(F.col("song_idx").alias("query_id"), F.col("lyrics_vec").alias("ql"), F.col("audio_vec").alias("qa"), F.col("label").alias("q_label"))
    parts = recs.select("query_id", "song_idx").join(s, "song_idx").join(q, "query_id").select("query_id", "song_idx", V.half_up(V.cosine(F.col("lyrics_vec"), F.col("ql"))).alias("l"), V.half_up(V.dot(F.col("audio_vec"), F.col("qa"))).alias("a"), (F.col("label") == F.col("q_label")).cast("int").alias("good"))
    return M.weight_grid(parts, ["a", "l"], steps=10).select("w", F.round("ndcg", 6).alias("ndcg"))


@query("sigma_sweep", f"WITH {{songs}}, {_TARGETS}, g(f) AS (VALUES (0.5::DOUBLE), (1.0), (2.0)), s AS (SELECT f, query_id, song_idx, valence, arousal, t_valence, t_arousal, round_even(exp(-0.5 * (power((valence - t_valence) / (0.20 * f), 2) + power((arousal - t_arousal) / 0.14, 2))) * 1e6, 0) / 1e6 AS score FROM songs, targets, g), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY f, query_id ORDER BY score DESC, song_idx) <= 10) SELECT f, round(avg(sqrt(power(valence - t_valence, 2) + power(arousal - t_arousal, 2))), 6) AS error FROM r GROUP BY f")
def sigma_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How far from their colours the songs are under kernels of other widths: widths as rows of the query set."""
    s, t = songs(spark, d), _targets(spark, d)
    widths = spark.createDataFrame([(0.5,), (1.0,), (2.0,)], "f double")
    asked = t.crossJoin(F.broadcast(widths)).withColumn("query_id", F.col("query_id") * 10 + (F.col("f") * 2).cast("long"))
    recs = retrieval.best_matches(s.select("song_idx", "valence", "arousal"), asked, retrieval.scaled_mood_scores, 10, -1.0)
    top = ranks.top_per_query(recs, F.col("score"), 10).join(asked, "query_id").join(s.select("song_idx", "valence", "arousal"), "song_idx")
    return top.groupBy("f").agg(F.round(F.avg(F.sqrt(F.pow(F.col("valence") - F.col("t_valence"), F.lit(2)) + F.pow(F.col("arousal") - F.col("t_arousal"), F.lit(2)))), 6).alias("error"))


@query(
    "self_consistency",
    f"""WITH {_TOP}, a AS (SELECT query_id, list(song_idx) AS l FROM recs GROUP BY query_id), o AS (SELECT * REPLACE (list_concat([audio_vec[1] + 0.2], audio_vec[2:]) AS audio_vec) FROM seeds),
    r AS (SELECT query_id, list(song_idx) AS m FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_idx) AS n FROM ({_sure('o')}) WHERE score >= 0.3) WHERE n <= 10 GROUP BY query_id) SELECT query_id, round({_JACCARD.format('l', 'm')}, 6) AS overlap FROM a JOIN r USING (query_id)""",
)
def self_consistency(spark: SparkSession, d: str) -> DataFrame:
    """How much of a list stays when its seed's audio is moved a little."""
    s, recs = _recs(spark, d)
    moved = seeds_of(s).withColumn("audio_vec", F.concat(F.array(F.get("audio_vec", F.lit(0)) + 0.2), F.slice("audio_vec", 2, 63)))
    return _listed(recs, "l").join(_listed(retrieval.similar_songs(s, moved, 10), "m"), "query_id").select("query_id", F.round(_jaccard("l", "m"), 6).alias("overlap"))


_COLOR_TOP = f"{{songs}}, {_TARGETS}, sure AS (SELECT query_id, song_idx, round_even(exp(-0.5 * (power((valence - t_valence) / 0.20, 2) + power((arousal - t_arousal) / 0.14, 2))) * 1e6, 0) / 1e6 AS score FROM songs, targets), top AS (SELECT CAST(query_id AS BIGINT) AS query_id, song_idx, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_idx) AS rank FROM sure QUALIFY rank <= 10)"


@query(
    "color_recall",
    f"""WITH {_COLOR_TOP}, truth AS (SELECT CAST(query_id AS BIGINT) AS query_id, song_idx FROM songs, targets WHERE sqrt(power(valence - t_valence, 2) + power(arousal - t_arousal, 2)) <= 0.10), n AS (SELECT query_id, count(*) AS relevant FROM truth GROUP BY query_id),
    h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM top JOIN truth USING (query_id, song_idx)), a AS (SELECT query_id, count(*) AS found, sum(hits / rank::DOUBLE) AS running FROM h GROUP BY query_id)
    SELECT query_id, round(coalesce(found / relevant::DOUBLE, 0), 6) AS recall, round(coalesce(running / least(relevant, 10), 0), 6) AS ap FROM n LEFT JOIN a USING (query_id)""",
)
def color_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the songs near each colour, how many its list has, by their numbers in the catalogue."""
    s, t = songs(spark, d), _targets(spark, d)
    truth = retrieval.within_radius(s, t, 0.10).select("query_id", "song_idx")
    return M.accuracy(retrieval.by_targets(s, t), truth, 10).select("query_id", F.round("recall", 6).alias("recall"), F.round("ap", 6).alias("ap"))


@query(
    "color_audit",
    f"""WITH {_COLOR_TOP}, r AS (SELECT query_id, rank, s.* FROM top JOIN songs s USING (song_idx)), p AS (SELECT a.query_id, avg(list_cosine_similarity(a.audio_vec, b.audio_vec)) AS inside FROM r a JOIN r b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY a.query_id),
    m AS (SELECT query_id, mood, count(*) AS n FROM r GROUP BY query_id, mood), d AS (SELECT query_id, mood AS dominant, n / 10.0::DOUBLE AS share FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, mood) = 1),
    c AS (SELECT query_id, avg(valence) AS v, avg(arousal) AS a FROM r GROUP BY query_id), e AS (SELECT x.query_id, min(sqrt(power(x.v - y.v, 2) + power(x.a - y.a, 2))) AS separation FROM c x JOIN c y ON x.query_id <> y.query_id GROUP BY x.query_id)
    SELECT query_id, round(inside, 6) AS inside, dominant, round(share, 6) AS share, round(separation, 6) AS separation FROM p JOIN d USING (query_id) JOIN e USING (query_id)""",
)
def color_audit(spark: SparkSession, d: str) -> DataFrame:
    """Of each colour's list: how alike the songs sound, which mood leads, and how far the nearest other colour's list is."""
    s = songs(spark, d)
    rows = retrieval.by_targets(s, _targets(spark, d)).join(s, "song_idx")
    apart = M.spread(rows.select("query_id", "rank", "song_idx"), s).select("query_id", F.round(1 - F.col("ild_audio"), 6).alias("inside"))
    lead = M.most_frequent_share(rows, "query_id", "mood").select("query_id", F.col("mood").alias("dominant"), F.round("share", 6).alias("share"))
    centre = rows.groupBy("query_id").agg(F.avg("valence").alias("v"), F.avg("arousal").alias("a"))
    other = centre.select(F.col("query_id").alias("o"), F.col("v").alias("ov"), F.col("a").alias("oa"))
    far = F.sqrt(F.pow(F.col("v") - F.col("ov"), F.lit(2)) + F.pow(F.col("a") - F.col("oa"), F.lit(2)))
    gap = centre.join(F.broadcast(other), F.col("query_id") != F.col("o")).groupBy("query_id").agg(F.round(F.min(far), 6).alias("separation"))  # twelve rows
    return apart.join(lead, "query_id").join(gap, "query_id")


@query("rater_agreement", "WITH v AS (SELECT p_size / 50.0::DOUBLE AS x, (p_retailprice - 900) / 1000 AS y FROM part), s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c, (avg(x) + avg(y)) / 2 AS g FROM v), q AS (SELECT 2 * sum(power((x + y) / 2 - g, 2)) / (max(n) - 1) AS r, sum(power(x - (x + y) / 2 - mx + g, 2) + power(y - (x + y) / 2 - my + g, 2)) / (max(n) - 1) AS e FROM v, s) SELECT round((r - e) / (r + (n * (power(mx - g, 2) + power(my - g, 2))) / n + e + 1e-12), 6) AS icc, round(2 * c / (vx + vy + power(mx - my, 2) + 1e-9), 6) AS ccc, n FROM s, q")
def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "part").select((F.col("p_size") / 50).alias("x"), ((F.col("p_retailprice") - 900) / 1000).alias("y"))
    return M.agreement(v, "x", "y").select(F.round("icc", 6).alias("icc"), F.round("ccc", 6).alias("ccc"), "n")


@query("distribution_distance", "WITH a AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM (SELECT p_size / 50.0::DOUBLE AS x FROM part)), b AS (SELECT y, row_number() OVER (ORDER BY y) AS i FROM (SELECT (p_retailprice - 900) / 1000 AS y FROM part)) SELECT round(avg(abs(x - y)), 6) AS distance FROM a JOIN b USING (i)")
def distribution_distance(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "part").select((F.col("p_size") / 50).alias("x"), ((F.col("p_retailprice") - 900) / 1000).alias("y"))
    return M.wasserstein(v, "x", "y").select(F.round("distance", 6).alias("distance"))


@query("tag_discrimination", "WITH c AS (SELECT p_type AS t, count(*) AS n FROM part GROUP BY p_type), s AS (SELECT sum(n) AS a, count(*) AS k, max(n) AS f FROM c) SELECT k AS tags, round(f / a::DOUBLE, 6) AS top1, round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC LIMIT 2)) / a::DOUBLE, 6) AS top2, round((SELECT -sum(n / a::DOUBLE * log2(n / a::DOUBLE)) FROM c), 6) AS entropy, f / a::DOUBLE <= 0.8 AND (SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC LIMIT 2)) / a::DOUBLE <= 0.8 AND k >= 5 AS accepted FROM s")
def tag_discrimination(spark: SparkSession, d: str) -> DataFrame:
    return M.discriminative(table(spark, d, "part"), "p_type").select("tags", *[F.round(c, 6).alias(c) for c in ("top1", "top2", "entropy")], "accepted")


@query(
    "survey_norms",
    """WITH r AS (SELECT c_nationkey AS color, c_mktsegment AS emotion, avg(c_acctbal + 2000) AS m FROM customer GROUP BY 1, 2), a AS (SELECT emotion, avg(m) AS o FROM r GROUP BY emotion), n AS (SELECT color, emotion, m / o AS v FROM r JOIN a USING (emotion)), p AS (SELECT color, emotion, v / sum(v) OVER (PARTITION BY color) AS p FROM n)
    SELECT color, max_by(emotion, p) AS top, round(max(p), 6) AS share, round(sum(p * length(emotion)), 6) AS centre FROM p GROUP BY color""",
)
def survey_norms(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of colours on emotions, each over its mean of all colours, as shares; the highest and the weighted centre."""
    r = table(spark, d, "customer").select(F.col("c_nationkey").alias("color"), F.col("c_mktsegment").alias("emotion"), (F.col("c_acctbal") + 2000).alias("rating"))
    norms = M.norms(r, "color", "emotion", "rating")
    return norms.groupBy("color").agg(F.max_by("emotion", "share").alias("top"), F.round(F.max("share"), 6).alias("share"), F.round(F.sum(F.col("share") * F.length("emotion")), 6).alias("centre"))


@query("opposite_moods", "WITH {songs}, l(k, v, a) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE, {a}::DOUBLE)" for k, (v, a) in LABEL_PLACES.items()) + "), o AS (SELECT x.k, y.k AS other, round(sqrt(power(x.v - y.v, 2) + power(x.a - y.a, 2)), 6) AS distance FROM l x JOIN l y ON (x.v - 0.5) * (y.v - 0.5) < 0 AND (x.a - 0.5) * (y.a - 0.5) < 0), s AS (SELECT song_idx, k FROM songs, l QUALIFY row_number() OVER (PARTITION BY song_idx ORDER BY power(valence - v, 2) + power(arousal - a, 2), k) = 1) SELECT song_idx, k AS mood, CAST(row_number() OVER (PARTITION BY song_idx ORDER BY distance DESC, other) AS INTEGER) AS place, other, distance FROM s JOIN o USING (k)")
def opposite_moods(spark: SparkSession, d: str) -> DataFrame:
    """For each song's label those in the opposite quadrant, the farthest first."""
    l = spark.createDataFrame([(k, v, a) for k, (v, a) in LABEL_PLACES.items()], "mood string, v double, a double")
    r = l.select(F.col("mood").alias("other"), F.col("v").alias("w"), F.col("a").alias("c"))
    met = l.join(F.broadcast(r), (F.col("v") - 0.5) * (F.col("w") - 0.5) < 0).where("(a - 0.5) * (c - 0.5) < 0")  # of eight rows
    far = F.round(F.sqrt(F.pow(F.col("v") - F.col("w"), F.lit(2)) + F.pow(F.col("a") - F.col("c"), F.lit(2))), 6)
    lists = met.groupBy("mood").agg(F.array_sort(F.collect_list(F.struct((-far).alias("far"), "other"))).alias("found"))
    s = songs(spark, d).select("song_idx", nearest_label(F.col("valence"), F.col("arousal")).alias("mood"))
    flat = s.join(F.broadcast(lists), "mood").select("song_idx", "mood", F.posexplode("found").alias("at", "x"))
    return flat.select("song_idx", "mood", (F.col("at") + 1).alias("place"), F.col("x.other").alias("other"), (-F.col("x.far")).alias("distance"))


@query("report_changes", f"WITH {_TOP}, {_BASE}, one AS (SELECT system, avg(rank) AS mean_rank, count(*)::DOUBLE AS n FROM simple GROUP BY system), a AS (SELECT system, 'mean_rank' AS metric, mean_rank AS before FROM one UNION ALL SELECT system, 'n', n FROM one WHERE system <> 'mood'), b AS (SELECT system, 'n' AS metric, n * 2 AS after FROM one WHERE system <> 'audio' UNION ALL SELECT system, 'extra', 1.0 FROM one WHERE system <> 'audio') SELECT system, metric, before, after, after - before AS change FROM (SELECT coalesce(a.system, b.system) AS system, coalesce(a.metric, b.metric) AS metric, before, after FROM a FULL JOIN b ON a.system = b.system AND a.metric = b.metric) WHERE system <> 'audio'")
def report_changes(spark: SparkSession, d: str) -> DataFrame:
    """Two reports side by side: systems that both have, metrics that either has."""
    one = baselines(spark, d).groupBy("system").agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).cast("double").alias("n"))
    a = one.unpivot("system", ["mean_rank", "n"], "metric", "value").where("metric != 'n' OR system != 'mood'")
    b = one.where("system != 'audio'").select("system", (F.col("n") * 2).alias("n"), F.lit(1.0).alias("extra")).unpivot("system", ["n", "extra"], "metric", "value")
    return M.compared(a, b)


@query("paired_gates")
def paired_gates(spark: SparkSession, d: str) -> DataFrame:
    """The fused system against the audio one, query by query, with intervals of the difference, single and by label, and a gate."""
    s, recs = _recs(spark, d)
    audio = _accuracy(retrieval.nearest(s, seeds_of(s), 10), s).select("query_id", F.col("ndcg").alias("b"))
    both = _accuracy(recs, s).select("query_id", F.col("ndcg").alias("a")).join(audio, "query_id").join(s.select(F.col("song_idx").alias("query_id"), "label"), "query_id").withColumn("d", F.col("a") - F.col("b"))
    both = stored(both, "paired")
    paired = M.bootstrap(both.withColumn("g", F.lit("paired")), "g", "query_id", "d")
    clustered = M.bootstrap(both.withColumn("g", F.lit("clustered")), "g", "label", "d")
    return paired.unionByName(clustered).select(F.col("g").alias("kind"), *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], (F.col("low") > 0).alias("passes"))


@query("tercile_sample", "WITH t AS (SELECT p_partkey, ntile(3) OVER (ORDER BY p_retailprice, p_partkey) AS third FROM part), s AS (SELECT *, row_number() OVER (PARTITION BY third ORDER BY md5('3/' || p_partkey)) AS n FROM t) SELECT p_partkey, CAST(third AS INTEGER) AS third, md5('9/' || p_partkey) < '33333333333333333333333333333333' AS held_out FROM s WHERE n <= 30")
def tercile_sample(spark: SparkSession, d: str) -> DataFrame:
    """Thirty of each third by price, chosen by a hash, and a hash split of 80 to 20."""
    p = table(spark, d, "part").select("p_partkey", F.struct("p_retailprice", "p_partkey").alias("at"))
    thirds = ranks.tiles(p, "at", 3, "third")
    digest = lambda s: F.md5(F.concat(F.lit(s), F.col("p_partkey").cast("string")))
    pick = F.row_number().over(Window.partitionBy("third").orderBy(digest("3/")))
    return thirds.withColumn("n", pick).where("n <= 30").select("p_partkey", "third", (digest("9/") < "3" * 32).alias("held_out"))


@query("quadrant_breakdown", "WITH {songs} SELECT CASE WHEN valence >= 0.5 AND arousal >= 0.5 THEN 'Q1' WHEN arousal >= 0.5 THEN 'Q2' WHEN valence < 0.5 THEN 'Q3' ELSE 'Q4' END AS quadrant, count(*) AS songs, round(avg(bpm), 6) AS bpm, round(count(*) / (SELECT max(c) FROM (SELECT count(*) AS c FROM songs GROUP BY artist))::DOUBLE, 6) AS per_top_artist FROM songs GROUP BY 1")
def quadrant_breakdown(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.color import quadrant

    s = songs(spark, d)
    most = s.groupBy("artist").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("most"))
    rows = s.groupBy(quadrant(F.col("valence"), F.col("arousal")).alias("quadrant")).agg(F.count(F.lit(1)).alias("songs"), F.round(F.avg("bpm"), 6).alias("bpm"))
    return rows.join(F.broadcast(most)).select("quadrant", "songs", "bpm", F.round(F.col("songs") / F.col("most"), 6).alias("per_top_artist"))


@query("latency_percentiles", "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return ranks.percentiles(table(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).select(*[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query("artist_songs", "WITH {songs}, e AS (SELECT * FROM songs WHERE lower(artist) = 'brand#1'), c AS (SELECT * FROM songs WHERE contains(lower(artist), 'brand#1')) SELECT song_idx, title FROM e UNION ALL SELECT song_idx, title FROM c WHERE (SELECT count(*) FROM e) = 0")
def artist_songs(spark: SparkSession, d: str) -> DataFrame:
    """An artist's songs: of that name in whatever case, or, if there are none, of names that contain it."""
    from ..operators import search

    return search.of_artist(songs(spark, d), "Brand#1").select("song_idx", "title")


@query("name_lookup", "WITH {songs} SELECT song_idx, title FROM songs WHERE regexp_matches(title, '(?i)blue.*g') ORDER BY song_idx LIMIT 1")
def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    return songs(spark, d).where(F.col("title").rlike("(?i)blue.*g")).orderBy("song_idx").limit(1).select("song_idx", "title")


@query("fresh_results", "SELECT event_type AS key, max_by(value, ts) AS value FROM events WHERE epoch(TIMESTAMP '2099-01-01') - epoch(ts) < 1e12 GROUP BY event_type")
def fresh_results(spark: SparkSession, d: str) -> DataFrame:
    """Cached results that haven't expired."""
    cache = table(spark, d, "events").select(F.col("event_type").alias("key"), "value", F.col("ts").alias("made_at"), F.lit(1e12).alias("ttl_s"))
    return sinks.fresh(cache, cache.select("key"), F.to_timestamp(F.lit("2099-01-01 00:00:00")))


@query("chunk_means", "WITH c AS (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 400)) AS pos, text FROM documents) SELECT doc_id, count(*) AS chunks, round(avg(length(regexp_replace(substr(text, CAST(pos + 1 AS INTEGER), 400), '[^aeiou]', '', 'g')) / 400.0::DOUBLE), 6) AS mean FROM c GROUP BY doc_id")
def chunk_means(spark: SparkSession, d: str) -> DataFrame:
    """Long texts in chunks, a prediction (here the share of vowels) for each, the mean for the text."""
    vowels = lambda c: F.length(F.regexp_replace(c, "[^aeiou]", "")) / 400
    return probes.by_chunks(table(spark, d, "documents"), "doc_id", "text", 400, vowels).select("doc_id", "chunks", F.round("mean", 6).alias("mean"))


_OUTER, _INNER = 4, 3


@query("nested_ridge")
def nested_ridge(spark: SparkSession, d: str) -> DataFrame:
    """How well vectors predict valence by nested folds: the strength is chosen within the rows that a fold leaves."""
    h = F.xxhash64(F.lit(1), "song_idx")
    return probes.nested_ridge(songs(spark, d), "audio_vec", "valence", F.pmod(h, F.lit(_OUTER)), F.pmod(F.shiftright(h, 8), F.lit(_INNER)), [0.1, 1.0, 10.0, 100.0])


@query("transferred_ridge")
def transferred_ridge(spark: SparkSession, d: str) -> DataFrame:
    """A model fitted to the songs of even labels predicts those of odd ones, as if these were another corpus."""
    s = songs(spark, d)
    rows, r2 = probes.transferred(s.where("label % 2 = 0"), s.where("label % 2 = 1"), "audio_vec", "arousal", alpha=10.0)
    return rows.select("song_idx", F.round("predicted", 6).alias("predicted"), F.lit(round(r2, 6)).alias("r2"))


_GRID = weights.simplex(3, 8, 0.5)
_SIGNALS = """a AS (SELECT q.song_idx AS query_id, s.song_idx, (list_cosine_similarity(q.audio_vec, s.audio_vec) + 1) / 2 AS s1, (list_cosine_similarity(q.lyrics_vec, s.lyrics_vec) + 1) / 2 AS s2, CASE WHEN q.label = s.label THEN 1.0::DOUBLE ELSE 0 END AS s3
  FROM songs q JOIN songs s ON q.song_idx % 25 = 0 AND q.song_idx <> s.song_idx)"""


def fused_signals(rows: dict, seeds: dict) -> list:
    """Halved-up cosines of audio and lyrics, and whether the labels are the same."""
    return [(retrieval._cosines(rows[c], seeds[c]) + 1) / 2 for c in ("audio_vec", "lyrics_vec")] + [(rows["label"][:, None] == seeds["label"]).astype(float)]


def _orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Songs, every twenty-fifth of them as seeds, and orders as lists of songs, of which each fifth is held out."""
    s = songs(spark, d).select("song_idx", "audio_vec", "lyrics_vec", "label")
    lists = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_partkey").alias("song_idx")).join(s.select("song_idx"), "song_idx", "left_semi").distinct()
    seeds = s.where("song_idx % 25 = 0").withColumnRenamed("song_idx", "query_id")
    return s, seeds, weights.relevant(lists.withColumn("held_out", F.col("list_id") % 5 == 0), seeds)


@query(
    "weight_search_grid",
    f"""WITH {{songs}}, {_SIGNALS}, g(candidate, w1, w2, w3) AS (VALUES {", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(_GRID))}),
    r AS (SELECT candidate, query_id, song_idx, row_number() OVER (PARTITION BY candidate, query_id ORDER BY round_even((w1 * s1 + w2 * s2 + w3 * s3) * 1e9, 0) DESC, song_idx) AS rank FROM a, g QUALIFY rank <= 10),
    l AS (SELECT DISTINCT l_orderkey AS list_id, l_partkey AS song_idx FROM lineitem JOIN songs ON l_partkey = song_idx),
    t AS (SELECT DISTINCT x.song_idx AS query_id, y.song_idx, x.list_id % 5 = 0 AS held FROM l x JOIN l y USING (list_id) WHERE x.song_idx % 25 = 0 AND x.song_idx <> y.song_idx),
    z AS (SELECT query_id, held, sum(1 / log2(i + 1)) AS ideal FROM (SELECT query_id, held, row_number() OVER (PARTITION BY query_id, held) AS i FROM t) WHERE i <= 10 GROUP BY query_id, held),
    n AS (SELECT c.candidate, z.query_id, z.held, coalesce(sum(1 / log2(r.rank + 1)) FILTER (t.song_idx IS NOT NULL), 0) / any_value(ideal) AS ndcg FROM (SELECT candidate FROM g) c CROSS JOIN z LEFT JOIN r ON r.candidate = c.candidate AND r.query_id = z.query_id LEFT JOIN t ON t.query_id = z.query_id AND t.held = z.held AND t.song_idx = r.song_idx GROUP BY c.candidate, z.query_id, z.held),
    i AS (SELECT x.candidate, x.query_id, avg(1 - list_cosine_similarity(p.lyrics_vec, q.lyrics_vec)) AS ild FROM r x JOIN r y ON x.candidate = y.candidate AND x.query_id = y.query_id AND x.rank < y.rank JOIN songs p ON p.song_idx = x.song_idx JOIN songs q ON q.song_idx = y.song_idx WHERE x.query_id IN (SELECT query_id FROM t WHERE NOT held) GROUP BY x.candidate, x.query_id),
    e AS (SELECT candidate, avg(ndcg) FILTER (NOT held) AS ndcg, avg(ndcg) FILTER (held) AS held_out_ndcg, any_value(ild) AS ild FROM n JOIN (SELECT candidate, avg(ild) AS ild FROM i GROUP BY candidate) USING (candidate) GROUP BY candidate),
    f AS (SELECT *, ild >= 0.95 * (SELECT ild FROM e WHERE candidate = 0) AS feasible FROM e)
    SELECT candidate, round(ndcg, 6) AS ndcg, round(held_out_ndcg, 6) AS held_out_ndcg, round(ild, 6) AS ild, feasible, candidate = (SELECT candidate FROM f WHERE feasible ORDER BY round(ndcg, 9) DESC, round(ild, 9) DESC, candidate LIMIT 1) AS chosen FROM f""",
)
def weight_search_grid(spark: SparkSession, d: str) -> DataFrame:
    """All weights of three signals in eighths, none over a half: gains on lists to learn from and on those held out, diversity, and the
    winner among those that keep 95 % of the first one's diversity."""
    s, seeds, truth = _orders(spark, d)
    found = weights.evaluated(s, seeds, truth, fused_signals, _GRID, 10, "lyrics_vec")
    return weights.chosen(found, F.col("candidate") == 0).select("candidate", *[F.round(c, 6).alias(c) for c in ("ndcg", "held_out_ndcg", "ild")], "feasible", "chosen")


@query("weight_search")
def weight_search(spark: SparkSession, d: str) -> DataFrame:
    """The winner of the pattern search over the same, from two starts; the base's figures beside it."""
    w = weights.search(*_orders(spark, d), fused_signals, [(0.4, 0.2, 0.4), (0.2, 0.5, 0.3)])
    return spark.createDataFrame([(list(w.weights), w.ndcg, w.held_out_ndcg, w.ild, w.base["ndcg"], w.base["ild"])], "weights array<double>, ndcg double, held_out_ndcg double, ild double, base_ndcg double, base_ild double")


@query("ridge_probe")
def ridge_probe(spark: SparkSession, d: str) -> DataFrame:
    """How well vectors predict valence, by ridge regressions of several strengths, each fold held out once."""
    s = songs(spark, d)
    return probes.ridge_by_folds(s, "audio_vec", "valence", F.pmod(F.xxhash64("song_idx"), F.lit(4)).cast("int"), [0.1, 1.0, 10.0])


@query("tempo_weight_sweep", "WITH p AS (SELECT p_size / 50.0::DOUBLE AS a, CASE WHEN p_partkey % 3 > 0 THEN (p_retailprice - 900) / 200 END AS t, ((p_partkey * 7) % 100) / 100.0::DOUBLE AS y FROM part), g AS (SELECT i / 10.0::DOUBLE AS w FROM range(0, 6) t(i)) SELECT w, round(corr(((1 - w) * a + coalesce(w * t, 0)) / ((1 - w) + CASE WHEN t IS NOT NULL THEN w ELSE 0 END), y), 6) AS agreement FROM p, g GROUP BY w")
def tempo_weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A blend of two signals under several weights of the second, which not all rows have."""
    p = table(spark, d, "part").select((F.col("p_size") / 50).alias("a"), F.when(F.col("p_partkey") % 3 > 0, (F.col("p_retailprice") - 900) / 200).alias("t"), (F.col("p_partkey") * 7 % 100 / 100).alias("y"))
    return probes.weight_sweep(p, "a", "t", "y", [i / 10 for i in range(6)]).select("w", F.round("agreement", 6).alias("agreement"))


@query("calibrated_arousal", "WITH s AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s FROM part) SELECT p_partkey, round(least(greatest(0.45::DOUBLE + (p_size - m) * 0.15::DOUBLE / s, 0), 1), 6) AS arousal FROM part, s")
def calibrated_arousal(spark: SparkSession, d: str) -> DataFrame:
    return probes.calibrated(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x")), "x", 0.45, 0.15, "arousal").select("p_partkey", F.round("arousal", 6).alias("arousal"))


@query("collection_dashboard", "WITH {tracks}, r AS (SELECT count(*)::DOUBLE AS rows, count(DISTINCT primary_artist)::DOUBLE AS artists, avg(tempo) AS mean_tempo, avg(view_count) AS mean_view_count, avg(CASE WHEN trim(coalesce(plain_lyrics, '')) <> '' THEN 1.0 ELSE 0.0 END)::DOUBLE AS with_plain_lyrics, avg(CASE WHEN trim(coalesce(album_name, '')) <> '' THEN 1.0 ELSE 0.0 END)::DOUBLE AS with_album_name FROM tracks) SELECT name, round(value, 6) AS value FROM (UNPIVOT r ON rows, artists, mean_tempo, mean_view_count, with_plain_lyrics, with_album_name INTO NAME name VALUE value)")
def collection_dashboard(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.tracks import tracks

    return M.dashboard(tracks(spark, d), "primary_artist", ["tempo", "view_count"], ["plain_lyrics", "album_name"]).select("name", F.round("value", 6).alias("value"))


@query("metric_bundle", f"WITH {_TOP}, g AS (SELECT query_id, count(*) FILTER (s.label = q.label) / 10.0::DOUBLE AS precision, greatest(0, 1 - stddev_pop(s.bpm) / avg(s.bpm)) AS tempo FROM recs JOIN songs s USING (song_idx) JOIN songs q ON q.song_idx = query_id GROUP BY query_id) SELECT query_id, round(precision, 6) AS precision, round(tempo, 6) AS tempo_coherence FROM g")
def metric_bundle(spark: SparkSession, d: str) -> DataFrame:
    s, recs = _recs(spark, d)
    return M.bundle(_accuracy(recs, s), recs, s).select("query_id", F.round("precision", 6).alias("precision"), F.round("tempo_coherence", 6).alias("tempo_coherence"))


@query("blend_weights")
def blend_weights(spark: SparkSession, d: str) -> DataFrame:
    """The non-negative blend of three signals nearest to a target, the tempo's weight at least .15 before scaling."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select((F.col("p_size") / 50).alias("audio"), (k * 7 % 100 / 100).alias("lyrics"), (k * 13 % 100 / 100).alias("tempo"), (0.6 * F.col("p_size") / 50 + 0.4 * (k * 7 % 100) / 100).alias("wanted"))
    out = probes.blend_weights(p, ["audio", "lyrics", "tempo"], "wanted", {"tempo": 0.15})
    return out.select("signal", F.round("weight", 6).alias("weight"))
