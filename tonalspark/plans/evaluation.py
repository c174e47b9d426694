"""Metrics over batches of queries, statistics, windows over events, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import retrieval, sequences
from ..streaming import limits
from .registry import query, songs, table
from .similarity import _FUSED, seeds_of

_TOP = f"{{songs}}, {_FUSED}, recs AS (SELECT query_id, song_idx, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_idx) AS rank FROM sure QUALIFY rank <= 10)"


def _recs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = songs(spark, d)
    return s, retrieval.similar_songs(s, seeds_of(s), 10)


def _accuracy(recs: DataFrame, s: DataFrame) -> DataFrame:
    """Songs of the seed's label are relevant."""
    return M.labelled_accuracy(recs, s, seeds_of(s), "label", 10)


@query(
    "ndcg_map_mrr",
    f"""WITH {_TOP}, truth AS (SELECT q.song_idx AS query_id, s.song_idx FROM songs s JOIN seeds q ON s.label = q.label AND s.song_idx <> q.song_idx),
    n AS (SELECT query_id, count(*) AS relevant FROM truth GROUP BY query_id), h AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM recs r JOIN truth USING (query_id, song_idx)),
    a AS (SELECT query_id, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg, sum(hits / rank::DOUBLE) AS running, min(rank) AS first FROM h GROUP BY query_id)
    SELECT query_id, round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(relevant, 10) + 1) t(i)), 0), 6) AS ndcg, round(coalesce(found / 10.0, 0), 6)::DOUBLE AS precision, round(coalesce(found / relevant::DOUBLE, 0), 6) AS recall,
      round(coalesce(running / least(relevant, 10), 0), 6) AS ap, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr, CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM n LEFT JOIN a USING (query_id)""",
)
def ndcg_map_mrr(spark: SparkSession, d: str) -> DataFrame:
    s, recs = _recs(spark, d)
    out = _accuracy(recs, s)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "query_id"])


@query(
    "graded_ndcg",
    f"""WITH {_TOP}, g AS (SELECT q.song_idx AS query_id, s.song_idx, CAST(s.label = q.label AS INTEGER) + CAST(s.mood = q.mood AS INTEGER) + CAST(s.artist = q.artist AS INTEGER) AS grade FROM songs s, seeds q WHERE s.song_idx <> q.song_idx AND (s.label = q.label OR s.mood = q.mood OR s.artist = q.artist)),
    i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(place + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM g) WHERE place <= 10 GROUP BY query_id),
    t AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM recs JOIN g USING (query_id, song_idx) GROUP BY query_id)
    SELECT query_id, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM i LEFT JOIN t USING (query_id)""",
)
def graded_ndcg(spark: SparkSession, d: str) -> DataFrame:
    s, recs = _recs(spark, d)
    grades, best = M.shared_grades(s, seeds_of(s), recs, ("label", "mood", "artist"), 10)
    return M.graded_ndcg(recs, grades, 10, best).withColumn("ndcg", F.round("ndcg", 6))


@query(
    "ild_metrics",
    f"""WITH {_TOP}, r AS (SELECT query_id, rank, s.* FROM recs JOIN songs s USING (song_idx)),
    p AS (SELECT a.query_id, avg(1 - list_cosine_similarity(a.audio_vec, b.audio_vec)) AS x, avg(sqrt(power(a.valence - b.valence, 2) + power(a.arousal - b.arousal, 2))) AS y FROM r a JOIN r b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY a.query_id),
    m AS (SELECT query_id, max(n) / sum(n)::DOUBLE AS mood FROM (SELECT query_id, mood, count(*) AS n FROM r GROUP BY query_id, mood) GROUP BY query_id), t AS (SELECT query_id, greatest(0, 1 - stddev_pop(bpm) / avg(bpm)) AS tempo FROM r GROUP BY query_id)
    SELECT query_id, round(x, 6) AS ild_audio, round(y, 6) AS ild_va, round(tempo, 6) AS tempo_coherence, round(mood, 6) AS mood_coherence FROM t JOIN p USING (query_id) JOIN m USING (query_id)""",
)
def ild_metrics(spark: SparkSession, d: str) -> DataFrame:
    s, recs = _recs(spark, d)
    out = M.spread(recs, s)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "query_id"])


@query(
    "coverage_gini_entropy",
    f"""WITH {_TOP}, r AS (SELECT s.* FROM recs JOIN songs s USING (song_idx)), c AS (SELECT floor(least(valence * 10, 9)) AS v, floor(least(arousal * 10, 9)) AS a, count(*) AS n FROM r GROUP BY 1, 2),
    e AS (SELECT artist, count(*) AS n FROM r GROUP BY artist), o AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS m, sum(n) OVER () AS s FROM e)
    SELECT round((SELECT count(DISTINCT song_idx) FROM r) / (SELECT count(*) FROM songs)::DOUBLE, 6) AS catalogue, round((SELECT count(*) FROM c) / 100.0::DOUBLE, 6) AS coverage,
      round((SELECT -sum(n / t::DOUBLE * log2(n / t::DOUBLE)) / log2(100) FROM (SELECT n, sum(n) OVER () AS t FROM c)), 6) AS entropy, round((SELECT 2 * sum(i * n) / (max(m) * max(s))::DOUBLE - (max(m) + 1) / max(m)::DOUBLE FROM o), 6) AS gini""",
)
def coverage_gini_entropy(spark: SparkSession, d: str) -> DataFrame:
    s, recs = _recs(spark, d)
    rows = recs.select("song_idx").join(s, "song_idx").select("song_idx", "artist", "valence", "arousal").persist()
    share = rows.agg(F.count_distinct("song_idx").alias("r")).join(s.agg(F.count(F.lit(1)).alias("n"))).select((F.col("r") / F.col("n")).alias("catalogue"))
    exposure = M.gini(rows.groupBy("artist").agg(F.count(F.lit(1)).alias("n")), "n")
    return share.join(M.grid(rows)).join(exposure).select(*[F.round(c, 6).alias(c) for c in ("catalogue", "coverage", "entropy", "gini")])


@query("calibration_kl", f"WITH {_TOP}, p AS (SELECT mood, count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM songs GROUP BY mood), q AS (SELECT mood, count(*) / sum(count(*)) OVER ()::DOUBLE AS q FROM recs JOIN songs USING (song_idx) GROUP BY mood) SELECT round(sum(p * ln(p / (0.99::DOUBLE * coalesce(q, 0) + 0.01::DOUBLE * p))), 6) AS kl FROM p LEFT JOIN q USING (mood)")
def calibration_kl(spark: SparkSession, d: str) -> DataFrame:
    s, recs = _recs(spark, d)
    return M.calibration(s, recs.join(s, "song_idx"), "mood").select(F.round("kl", 6).alias("kl"))


_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)::DOUBLE"


@query("spearman_pearson", f"WITH r AS (SELECT p_retailprice AS x, p_size AS y, {_RANK.format('p_retailprice')} AS rx, {_RANK.format('p_size')} AS ry FROM part), s AS (SELECT corr(x, y) AS pearson, corr(rx, ry) AS spearman, count(*) AS n FROM r) SELECT round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(tanh(atanh(spearman) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(spearman) + 1.959963984540054 / sqrt(n - 3)), 6) AS high, n FROM s")
def spearman_pearson(spark: SparkSession, d: str) -> DataFrame:
    out = M.correlations(table(spark, d, "part").select(F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y")), "x", "y")
    return out.select(*[F.round(c, 6).alias(c) for c in ("pearson", "spearman", "low", "high")], "n")


@query("bh_adjust", "WITH p AS (SELECT n_nationkey AS test, (n_nationkey * 37 % 25 + 1) / 400.0::DOUBLE AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p), a AS (SELECT test, p, least(1, min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS adjusted FROM r) SELECT test, round(p, 9) AS p, round(adjusted, 9) AS adjusted, adjusted <= 0.05 AS rejected FROM a")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "nation").select(F.col("n_nationkey").alias("test"), ((F.col("n_nationkey") * 37 % 25 + 1) / 400.0).alias("p"))
    return M.bh(p, "p").select("test", F.round("p", 9).alias("p"), F.round("adjusted", 9).alias("adjusted"), "rejected")


@query("ks_uniform", "WITH v AS (SELECT p_size / 51.0::DOUBLE AS v FROM part), c AS (SELECT v, count(*) AS t FROM v GROUP BY v), e AS (SELECT v, t, sum(t) OVER (ORDER BY v) AS u, sum(t) OVER () AS n FROM c) SELECT round(max(greatest(u / n::DOUBLE - v, v - (u - t) / n::DOUBLE)), 6) AS ks, (SELECT round(avg(v), 6) FROM v) AS mean, (SELECT round(stddev_pop(v), 6) FROM v) AS sd, (SELECT count(*) FROM v) AS n FROM e")
def ks_uniform(spark: SparkSession, d: str) -> DataFrame:
    out = M.ks_uniform(table(spark, d, "part").select((F.col("p_size") / 51.0).alias("v")), "v")
    return out.select(*[F.round(c, 6).alias(c) for c in ("ks", "mean", "sd")], "n")


@query("mahalanobis", "WITH v AS (SELECT p_size / 50.0::DOUBLE AS x, p_retailprice / 2000 AS y FROM part), s AS (SELECT var_samp(x) + 1e-6 AS xx, var_samp(y) + 1e-6 AS yy, covar_samp(x, y) AS xy FROM v) SELECT round(avg(sqrt((power(x - 0.5, 2) * yy - 2 * (x - 0.5) * (y - 0.5) * xy + power(y - 0.5, 2) * xx) / (xx * yy - xy * xy))), 6) AS error FROM v, s")
def mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "part").select((F.col("p_size") / 50.0).alias("x"), (F.col("p_retailprice") / 2000).alias("y"))
    return M.mahalanobis(v, "x", "y", F.lit(0.5), F.lit(0.5)).select(F.round("error", 6).alias("error"))


@query("signal_blend", "WITH b AS (SELECT p_partkey, round((0.7 * p_size / 50.0::DOUBLE + coalesce(0.3 * CASE WHEN p_partkey % 3 > 0 THEN p_retailprice / 2000 END, 0)) / (0.7 + CASE WHEN p_partkey % 3 > 0 THEN 0.3 ELSE 0 END)::DOUBLE, 12) AS v FROM part), r AS (SELECT p_partkey, (rank() OVER (ORDER BY v) - 1 + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / (count(*) OVER () - 1)::DOUBLE AS r FROM b) SELECT p_partkey, round(least(greatest(0.5 + (r - avg(r) OVER ()) * 0.18 / stddev_pop(r) OVER (), 0), 1), 6) AS blended FROM r")
def signal_blend(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("x"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice") / 2000).alias("y"))
    return M.blend(p, {"x": 0.7, "y": 0.3}).select("p_partkey", F.round("blended", 6).alias("blended"))


@query("ewe_weights")
def ewe_weights(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select((F.col("p_size") / 50.0).alias("a"), (F.col("p_retailprice") / 2000).alias("b"), (F.length("p_type") / 30.0).alias("c"))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in M.agreement_weights(p, ["a", "b", "c"]).items()], "signal string, weight double")


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    s, recs = _recs(spark, d)
    per_query = _accuracy(recs, s).select(F.lit("fused").alias("system"), "query_id", "ndcg")
    return M.bootstrap(per_query, "system", "query_id", "ndcg")


@query("wilcoxon")
def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    s, recs = _recs(spark, d)
    audio = _accuracy(retrieval.nearest(s, seeds_of(s), 10), s).select("query_id", F.col("ndcg").alias("b"))
    return M.wilcoxon(_accuracy(recs, s).select("query_id", F.col("ndcg").alias("a")).join(audio, "query_id"), "a", "b")


@query("journey_deltas", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events")
def journey_deltas(spark: SparkSession, d: str) -> DataFrame:
    return sequences.deltas(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("delta", 6).alias("delta"))


@query("beat_bpm", "WITH {songs} SELECT song_idx, round(bpm, 4) AS bpm FROM songs")
def beat_bpm(spark: SparkSession, d: str) -> DataFrame:
    """A tempo for each song from made-up downbeats, a gap of 240 over its tempo apart."""
    beats = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: i * 240.0 / F.col("bpm"))
    return songs(spark, d).select("song_idx", F.round(sequences.bpm_of(beats), 4).alias("bpm"))


@query("active_regions", "WITH e AS (SELECT user_id, epoch(ts)::DOUBLE AS t, value > 60 AS o, event_id FROM events), g AS (SELECT *, CASE WHEN o IS DISTINCT FROM lag(o) OVER w THEN 1 ELSE 0 END AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(t) AS start, max(t) AS \"end\", count(*) AS rows FROM r WHERE o GROUP BY user_id, run HAVING max(t) - min(t) >= 60")
def active_regions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return sequences.active_regions(e, "user_id", "t", "value", 60, 60, ["event_id"])


@query("session_counts", "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS n FROM g GROUP BY user_id, run")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return limits.sessions(table(spark, d, "events"), "user_id", "ts", "30 minutes")


@query("tumbling_totals", "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_totals(spark: SparkSession, d: str) -> DataFrame:
    return limits.windowed(table(spark, d, "events"), "ts", "1 day", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("stratified_sample", "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('42/' || event_id), event_id) <= 20")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty events of each type, by a hash of their number."""
    at = Window.partitionBy("event_type").orderBy(F.md5(F.concat(F.lit("42/"), F.col("event_id").cast("string"))), "event_id")
    return table(spark, d, "events").select("event_id", "event_type", F.row_number().over(at).alias("n")).where("n <= 20").drop("n")


@query("rate_limit_sliding_log")
def rate_limit_sliding_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("client"), F.col("event_type").alias("path"), "ts")
    return limits.rate_limited(e, limit=3, window=3600.0)


@query("rollup_counts", "SELECT p_brand AS artist, p_type AS mood, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)")
def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").rollup(F.col("p_brand").alias("artist"), F.col("p_type").alias("mood")).agg(F.count(F.lit(1)).alias("n"))
