"""Similar songs, colours, fusion, re-ranking and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import emotion as E
from ..functions import text as T
from ..functions import vectors as V
from ..operators import crossfade, inverted_file, ranks, rerank, retrieval, search, sequences, trigram_index, vector_join
from .registry import query, songs, table

_FUSED = """seeds AS (SELECT * FROM songs WHERE song_idx % 100 = 0), scored AS (
  SELECT q.song_idx AS query_id, s.song_idx,
         0.08 * (list_cosine_similarity(s.lyrics_vec, q.lyrics_vec) + 1) / 2
         + 0.16 * exp(-0.5 * (power((s.valence - q.valence) / 0.22, 2) + power((s.arousal - q.arousal) / 0.14, 2)))
         + 0.76 * (list_dot_product(s.audio_vec, q.audio_vec) + 1) / 2 AS raw
  FROM songs s, seeds q WHERE s.song_idx <> q.song_idx
), sure AS (SELECT query_id, song_idx, round_even(raw * 1e6, 0) / 1e6 AS score FROM scored WHERE raw >= 0.3)"""


def seeds_of(df: DataFrame) -> DataFrame:
    """The stated query set: every song whose number is divisible by 100."""
    return df.where("song_idx % 100 = 0")


def _pool(spark: SparkSession, d: str, k: int) -> DataFrame:
    s = songs(spark, d)
    top = retrieval.similar_songs(s, seeds_of(s), k)
    return top.join(s, "song_idx")


@query("similar_items_topk", f"WITH {{songs}}, {_FUSED} SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, song_idx, score FROM sure WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, song_idx) QUALIFY row_number() OVER w <= 10")
def similar_items_topk(spark: SparkSession, d: str) -> DataFrame:
    s = songs(spark, d)
    return retrieval.similar_songs(s, seeds_of(s), 10)


@query(
    "similar_items_all_slots",
    """WITH {songs}, t AS (SELECT *, audio_vec[1:8] AS timbre, [valence, arousal] AS rhythm, audio_vec[9:16] AS tonality, audio_vec[17:24] AS instruments FROM songs),
    scored AS (SELECT q.song_idx AS query_id, s.song_idx,
      0.1 * list_cosine_similarity(s.timbre, q.timbre) + 0.1 * (1 - (abs(s.valence - q.valence) + abs(s.arousal - q.arousal)) / 2) + 0.1 * list_cosine_similarity(s.tonality, q.tonality)
      + 0.1 * (list_cosine_similarity(s.lyrics_vec, q.lyrics_vec) + 1) / 2 + 0.1 * exp(-0.5 * (power((s.valence - q.valence) / 0.22, 2) + power((s.arousal - q.arousal) / 0.14, 2)))
      + 0.1 * (list_cosine_similarity(s.instruments, q.instruments) + 1) / 2 + 0.1 * CAST(s.mood = q.mood AS INTEGER) + 0.3 * (list_dot_product(s.audio_vec, q.audio_vec) + 1) / 2 AS raw
      FROM t s, t q WHERE q.song_idx % 100 = 0 AND s.song_idx <> q.song_idx),
    sure AS (SELECT query_id, song_idx, round_even(raw * 1e6, 0) / 1e6 AS score FROM scored WHERE raw >= 0.3)
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, song_idx, score FROM sure WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, song_idx) QUALIFY row_number() OVER w <= 10""",
)
def similar_items_all_slots(spark: SparkSession, d: str) -> DataFrame:
    s = songs(spark, d).withColumns({"timbre": F.slice("audio_vec", 1, 8), "rhythm": F.array("valence", "arousal"), "tonality": F.slice("audio_vec", 9, 8), "instruments": F.slice("audio_vec", 17, 8)})
    return retrieval.similar_songs(s, seeds_of(s), 10, weights=(0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.3))


@query(
    "similar_restrict_candidates",
    f"""WITH {{songs}}, {_FUSED}, near AS (SELECT q.song_idx AS query_id, s.song_idx, round_even(list_cosine_similarity(s.audio_vec, q.audio_vec) * 1e6, 0) AS c FROM songs s, seeds q WHERE s.song_idx <> q.song_idx),
    cands AS (SELECT query_id, song_idx FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, song_idx) <= 50)
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, song_idx, score FROM sure JOIN cands USING (query_id, song_idx) WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, song_idx) QUALIFY row_number() OVER w <= 10""",
)
def similar_restrict_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = songs(spark, d)
    return retrieval.similar_songs(s, seeds_of(s), 10, candidates=retrieval.nearest(s, seeds_of(s), 50))


@query(
    "exclude_played",
    f"WITH {{songs}}, {_FUSED} SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, song_idx, score FROM sure WHERE song_idx % 7 <> 3 OR song_idx >= 100 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, song_idx) QUALIFY row_number() OVER w <= 10",
)
def exclude_played(spark: SparkSession, d: str) -> DataFrame:
    s = songs(spark, d)
    return retrieval.similar_songs(s, seeds_of(s), 10, played=s.where("song_idx % 7 = 3 AND song_idx < 100"))


@query(
    "exclude_covers",
    f"WITH {{songs}}, {_FUSED} SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, song_idx, score FROM sure s WHERE NOT EXISTS (SELECT 1 FROM songs a JOIN songs b ON a.artist = b.artist WHERE a.song_idx = s.query_id AND b.song_idx = s.song_idx) WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, song_idx) QUALIFY row_number() OVER w <= 10",
)
def exclude_covers(spark: SparkSession, d: str) -> DataFrame:
    """For each seed its own list of songs that aren't wanted: here those of its artist."""
    s = songs(spark, d)
    covers = seeds_of(s).select(F.col("song_idx").alias("query_id"), "artist").join(s.select("song_idx", "artist"), "artist").select("query_id", "song_idx")
    return retrieval.similar_songs(s, seeds_of(s), 10, excluded=covers)


@query("knn_pairs", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT a.vec_id AS query_id, b.vec_id AS song_idx, round_even(list_cosine_similarity(a.x, b.x) * 1e6, 0) / 1e6 AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, song_idx, score FROM n WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, song_idx) QUALIFY row_number() OVER w <= 7")
def knn_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("song_idx"), F.transform("embedding", lambda x: x.cast("double")).alias("audio_vec"))
    return retrieval.nearest(v, seeds_of(v), 7)


@query("indexed_neighbours", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT a.vec_id AS query_id, b.vec_id AS song_idx, round_even(list_cosine_similarity(a.x, b.x) * 1e6, 0) / 1e6 AS score FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, song_idx, score FROM n WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, song_idx) QUALIFY row_number() OVER w <= 10")
def indexed_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every twentieth vector from an inverted file over all: lists that can't hold one aren't visited."""
    v = table(spark, d, "embeddings")
    index = inverted_file.build(v, "vec_id", "embedding")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return inverted_file.search(inverted_file.opened(spark, index.path), asked, 10, vector="embedding")


@query("probed_neighbours")
def probed_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The same with a bound: each query visits three lists in four, and a few neighbours may be missed."""
    v = table(spark, d, "embeddings")
    index = inverted_file.build(v, "vec_id", "embedding", lists=32)
    return inverted_file.search(index, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, probes=24, vector="embedding")


@query(
    "knn_fallback_vector",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT a.vec_id AS query_id, b.vec_id AS song_idx, b.x, round_even(list_cosine_similarity(a.x, b.x) * 1e6, 0) / 1e6 AS w FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, song_idx) <= 10),
    e AS (SELECT query_id, w, unnest(x) AS x, generate_subscripts(x, 1) AS dim FROM t)
    SELECT query_id, CAST(dim AS INTEGER) AS dim, round(sum(w * x) / sum(w), 6) AS value FROM e GROUP BY query_id, dim""",
)
def knn_fallback_vector(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("song_idx"), F.transform("embedding", lambda x: x.cast("double")).alias("audio_vec"))
    near = retrieval.nearest(v, seeds_of(v), 10).join(v, "song_idx").select("query_id", "score", F.posexplode("audio_vec").alias("dim", "x"))
    return near.groupBy("query_id", (F.col("dim") + 1).alias("dim")).agg(F.round(F.sum(F.col("score") * F.col("x")) / F.sum("score"), 6).alias("value"))


@query("va_rank_space", "SELECT p_partkey, round((rank() OVER (ORDER BY p_retailprice) - 1 + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0) / (count(*) OVER () - 1), 9) AS valence_rank, round((rank() OVER (ORDER BY p_size) - 1 + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0) / (count(*) OVER () - 1), 9) AS arousal_rank FROM part")
def va_rank_space(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    out = ranks.with_rank(ranks.with_rank(p, "p_retailprice", "v"), "p_size", "a")
    return out.select("p_partkey", F.round("v", 9).alias("valence_rank"), F.round("a", 9).alias("arousal_rank"))


def colors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(C.COLORS.items())], "query_id long, name string, hex string")


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """The twelve colours in mood space: the share of songs below each colour's valence and arousal."""
    c = colors(spark).select("query_id", C.valence_arousal(F.col("hex")).alias("m")).select("query_id", F.round("m.valence", 6).alias("v"), F.round("m.arousal", 6).alias("a"))
    return ranks.target_quantiles(songs(spark, d), c, "query_id", {"t_valence": ("valence", "v"), "t_arousal": ("arousal", "a")})


_COLORS = "colors(query_id, name, hex) AS (VALUES " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(C.COLORS.items())) + ")"
_CHANNELS = """rgb AS (SELECT *, ('0x' || hex[2:3])::INT / 255.0::DOUBLE AS r, ('0x' || hex[4:5])::INT / 255.0::DOUBLE AS g, ('0x' || hex[6:7])::INT / 255.0::DOUBLE AS b FROM colors),
range_ AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM rgb),
hsl AS (SELECT *, (hi + lo) / 2 AS l, CASE WHEN hi = lo THEN 0 ELSE (hi - lo) / (1 - abs(hi + lo - 1)) END AS s,
  60 * CASE WHEN hi = lo THEN 0 WHEN hi = r THEN ((g - b) / (hi - lo) + 6) % 6 WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END AS h FROM range_)"""
_MOOD = """xyz AS (SELECT *, 0.4124 * pow(r, 2.2) + 0.3576 * pow(g, 2.2) + 0.1805 * pow(b, 2.2) AS x, 0.2126 * pow(r, 2.2) + 0.7152 * pow(g, 2.2) + 0.0722 * pow(b, 2.2) AS y, 0.0193 * pow(r, 2.2) + 0.1192 * pow(g, 2.2) + 0.9505 * pow(b, 2.2) AS z FROM hsl),
lms AS (SELECT *, pow(0.8189 * x + 0.3619 * y - 0.1288 * z, 1 / 3.0) AS l1, pow(0.0329 * x + 0.9293 * y + 0.0361 * z, 1 / 3.0) AS m1, pow(0.0482 * x + 0.2643 * y + 0.6338 * z, 1 / 3.0) AS s1 FROM xyz),
lab AS (SELECT *, 0.2104 * l1 + 0.7936 * m1 - 0.0040 * s1 AS ol, 1.9779 * l1 - 2.4285 * m1 + 0.4505 * s1 AS oa, 0.0259 * l1 + 0.7827 * m1 - 0.8086 * s1 AS ob FROM lms),
moods AS (SELECT *, CASE WHEN s < 0.12 THEN least(greatest(0.20 + 0.41 * l, 0), 1) ELSE
    least(greatest(0.686 * ol - 0.7459 * oa / 0.4 + 0.0369 * ob / 0.4 + 0.4956 * sqrt(oa * oa + ob * ob) / 0.4 + 0.1458 * cos(atan2(ob, oa)) - 0.0404 * sin(atan2(ob, oa)), 0), 1) END AS valence,
  least(greatest(0.373 * CASE WHEN s < 0.12 THEN 0.5 ELSE (1 + cos(radians(h))) / 2 END + 0.356 * s + 0.271 * l - 0.10, 0), 1) AS arousal FROM lab)"""


#: A colour for each part, by a digest of its key, and the twelve named ones.
_PAINTED = "colors(query_id, name, hex) AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR), '#' || left(md5(CAST(p_partkey AS VARCHAR)), 6) FROM part UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i}, '{k}', '{v}')" for i, (k, v) in enumerate(C.COLORS.items(), 1)) + ") AS n)"


def painted(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    own = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), key.alias("name"), F.concat(F.lit("#"), F.left(F.md5(key), F.lit(6))).alias("hex"))
    return own.unionByName(colors(spark).withColumn("query_id", -F.col("query_id") - 1))


@query("color_to_va", f"WITH {_PAINTED}, {_CHANNELS}, {_MOOD} SELECT name, hex, round(valence, 6) AS valence, round(arousal, 6) AS arousal, CASE WHEN valence >= 0.5 AND arousal >= 0.5 THEN 'Q1' WHEN arousal >= 0.5 THEN 'Q2' WHEN valence < 0.5 THEN 'Q3' ELSE 'Q4' END AS quadrant FROM moods")
def color_to_va(spark: SparkSession, d: str) -> DataFrame:
    out = painted(spark, d).withColumn("m", C.valence_arousal(F.col("hex")))
    return out.select("name", "hex", F.round("m.valence", 6).alias("valence"), F.round("m.arousal", 6).alias("arousal"), C.quadrant(F.col("m.valence"), F.col("m.arousal")).alias("quadrant"))


_ANCHORS = "anchors(hex, p) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in C.ANCHOR_EMOTIONS.items()) + ")"


@query(
    "color_emotion_probs",
    f"""WITH {_ANCHORS}, {_PAINTED.replace('colors(', 'named(')}, colors AS (SELECT hex, name, NULL::DOUBLE[] AS p FROM named UNION ALL SELECT hex, NULL, p::DOUBLE[] FROM anchors), {_CHANNELS},
    spots AS (SELECT *, cos(radians(h)) * s AS px, sin(radians(h)) * s AS py, l AS pz FROM hsl),
    w AS (SELECT c.name, unnest(a.p) AS p, unnest(range(8)) AS i, 1 / (power(c.px - a.px, 2) + power(c.py - a.py, 2) + power(c.pz - a.pz, 2) + 1e-6) AS w FROM spots c, spots a WHERE c.name IS NOT NULL AND a.name IS NULL),
    t AS (SELECT name, i, sum(w * p) AS x FROM w GROUP BY name, i)
    SELECT name, (['happy', 'excited', 'peaceful', 'calm', 'melancholic', 'sad', 'tense', 'angry'])[i + 1] AS emotion, round(x / sum(x) OVER (PARTITION BY name), 6) AS share FROM t""",
)
def color_emotion_probs(spark: SparkSession, d: str) -> DataFrame:
    return painted(spark, d).select("name", F.explode(C.emotion_shares(F.col("hex"))).alias("emotion", "share")).select("name", "emotion", F.round("share", 6).alias("share"))


_TARGETS = f"""{_COLORS}, {_CHANNELS}, {_MOOD}, targets AS (SELECT m.query_id, (SELECT count(*) FROM songs WHERE valence < round(m.valence, 6)) / (SELECT count(*) FROM songs)::DOUBLE AS t_valence,
  (SELECT count(*) FROM songs WHERE arousal < round(m.arousal, 6)) / (SELECT count(*) FROM songs)::DOUBLE AS t_arousal FROM moods m)"""


@query("color_target_quantile", f"WITH {{songs}}, {_TARGETS} SELECT CAST(query_id AS BIGINT) AS query_id, round(t_valence, 9) AS t_valence, round(t_arousal, 9) AS t_arousal FROM targets")
def color_target_quantile(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d).select("query_id", F.round("t_valence", 9).alias("t_valence"), F.round("t_arousal", 9).alias("t_arousal"))


_RANKED = "SELECT CAST(query_id AS BIGINT) AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, song_idx, score FROM sure WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, song_idx) QUALIFY row_number() OVER w <= 10"


@query("color_rank_topk", f"WITH {{songs}}, {_TARGETS}, sure AS (SELECT query_id, song_idx, round_even(exp(-0.5 * (power((valence - t_valence) / 0.20, 2) + power((arousal - t_arousal) / 0.14, 2))) * 1e6, 0) / 1e6 AS score FROM songs, targets) {_RANKED}")
def color_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.by_targets(songs(spark, d), _targets(spark, d))


@query("color_exclude_played", f"WITH {{songs}}, {_TARGETS}, sure AS (SELECT query_id, song_idx, round_even(exp(-0.5 * (power((valence - t_valence) / 0.20, 2) + power((arousal - t_arousal) / 0.14, 2))) * 1e6, 0) / 1e6 AS score FROM songs, targets WHERE song_idx % 5 <> 2 OR song_idx >= 300) {_RANKED}")
def color_exclude_played(spark: SparkSession, d: str) -> DataFrame:
    s = songs(spark, d)
    return retrieval.by_targets(s, _targets(spark, d), played=s.where("song_idx % 5 = 2 AND song_idx < 300"))


@query(
    "color_adaptive_sigma",
    f"""WITH {{songs}}, {_TARGETS}, met AS (SELECT query_id, song_idx, valence - t_valence AS dv, arousal - t_arousal AS da FROM songs, targets),
    wide AS (SELECT query_id, CASE WHEN count(*) FILTER (abs(dv) <= 0.05 AND abs(da) <= 0.05) < 50 THEN 1.8 WHEN count(*) FILTER (abs(dv) <= 0.05 AND abs(da) <= 0.05) < 200 THEN 1.3 ELSE 1.0 END::DOUBLE AS w FROM met GROUP BY query_id),
    sure AS (SELECT query_id, song_idx, round_even(exp(-0.5 * (power(dv / (0.20::DOUBLE * w), 2) + power(da / (0.14::DOUBLE * w), 2))) * 1e6, 0) / 1e6 AS score FROM met JOIN wide USING (query_id)) {_RANKED}""",
)
def color_adaptive_sigma(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.by_targets(songs(spark, d), _targets(spark, d), adaptive=True)


@query("radius_truth", f"WITH {{songs}}, {_TARGETS} SELECT CAST(query_id AS BIGINT) AS query_id, song_idx, round(sqrt(power(valence - t_valence, 2) + power(arousal - t_arousal, 2)), 9) AS distance FROM songs, targets WHERE sqrt(power(valence - t_valence, 2) + power(arousal - t_arousal, 2)) <= 0.25")
def radius_truth(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.within_radius(songs(spark, d), _targets(spark, d), 0.25).withColumn("distance", F.round("distance", 9))


_LISTS = """audio AS (SELECT q.song_idx AS query_id, s.song_idx, row_number() OVER (PARTITION BY q.song_idx ORDER BY round_even(list_cosine_similarity(s.audio_vec, q.audio_vec) * 1e6, 0) DESC, s.song_idx) AS rank FROM songs s, songs q WHERE q.song_idx % 100 = 0 AND s.song_idx <> q.song_idx),
words AS (SELECT q.song_idx AS query_id, s.song_idx, row_number() OVER (PARTITION BY q.song_idx ORDER BY round_even(list_cosine_similarity(s.lyrics_vec, q.lyrics_vec) * 1e6, 0) DESC, s.song_idx) AS rank FROM songs s, songs q WHERE q.song_idx % 100 = 0 AND s.song_idx <> q.song_idx),
sums AS (SELECT query_id, song_idx, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT *, 1.0::DOUBLE AS w FROM audio WHERE rank <= 40 UNION ALL SELECT *, 0.5::DOUBLE FROM words WHERE rank <= 40) GROUP BY query_id, song_idx)"""


@query("rrf_fusion", f"WITH {{songs}}, {_LISTS} SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, song_idx, score FROM sums WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, song_idx) QUALIFY row_number() OVER w <= 20")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    s = songs(spark, d)
    audio = retrieval.nearest(s, seeds_of(s), 40).withColumn("weight", F.lit(1.0))
    words = retrieval.nearest(s, seeds_of(s), 40, "lyrics_vec").withColumn("weight", F.lit(0.5))
    return retrieval.fuse(audio.unionByName(words), 20)


@query(
    "multi_color_rrf",
    f"""WITH {{songs}}, {_TARGETS}, s AS (SELECT query_id, song_idx, round_even(exp(-0.5 * (power((valence - t_valence) / 0.20, 2) + power((arousal - t_arousal) / 0.14, 2))) * 1e6, 0) / 1e6 AS score FROM songs, targets),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_idx) AS rank FROM s QUALIFY rank <= 50),
    f AS (SELECT query_id // 2 AS query_id, song_idx, round(sum(1 / (60 + rank)::DOUBLE), 9) AS score FROM r GROUP BY query_id // 2, song_idx)
    SELECT CAST(query_id AS BIGINT) AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, song_idx, score FROM f WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, song_idx) QUALIFY row_number() OVER w <= 10""",
)
def multi_color_rrf(spark: SparkSession, d: str) -> DataFrame:
    lists = retrieval.by_targets(songs(spark, d), _targets(spark, d), 50)
    return retrieval.fuse(lists.withColumns({"query_id": F.expr("query_id div 2"), "weight": F.lit(1.0)}), 10)


@query("artist_cap_backfill", f"WITH {{songs}}, {_FUSED}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_idx) AS rank FROM sure QUALIFY rank <= 40), o AS (SELECT query_id, rank, t.song_idx, artist, row_number() OVER (PARTITION BY query_id, artist ORDER BY rank) > 1 AS o FROM top t JOIN songs USING (song_idx)) SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS place, song_idx, artist FROM o WINDOW w AS (PARTITION BY query_id ORDER BY o, rank) QUALIFY row_number() OVER w <= 30")
def artist_cap_backfill(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.cap_per_artist(_pool(spark, d, 40), 1, 30)


for _name, _choose, _k in (("mmr_rerank", rerank.mmr, 40), ("dpp_rerank", rerank.dpp, 40), ("va_mmr", rerank.va_mmr, 50), ("coherent_cluster", rerank.coherent, 50), ("greedy_artist_penalty", rerank.artist_penalty, 40)):
    query(_name)(lambda spark, d, choose=_choose, k=_k: rerank.by_query(_pool(spark, d, k), choose()))


def _ends(spark: SparkSession, d: str) -> DataFrame:
    t = _targets(spark, d)
    return t.alias("a").join(t.alias("b"), F.expr("b.query_id = pmod(a.query_id + 1, 12)")).select("a.query_id", *[F.col(f"{x}.t_{k}").alias(f"{n}_{k[0]}") for x, n in (("a", "from"), ("b", "to")) for k in ("valence", "arousal")])


@query("mood_journey")
def mood_journey(spark: SparkSession, d: str) -> DataFrame:
    """From each colour to the next, without the songs that were played."""
    s = songs(spark, d)
    return retrieval.journeys(s, _ends(spark, d), played=s.where("song_idx % 50 = 7"))


@query("fast_rank_capped")
def fast_rank_capped(spark: SparkSession, d: str) -> DataFrame:
    """The whole way of a query: a pool of four times what is asked for over the floor, re-ranked for variety, two songs of an
    artist at most, filled up in order."""
    s = songs(spark, d)
    pool = retrieval.fast_rank(retrieval.similar_songs(s, seeds_of(s), 40).drop("rank"), 10).drop("rank").join(s, "song_idx")
    ranked = rerank.by_query(pool, rerank.mmr(20)).withColumnRenamed("place", "rank")
    return retrieval.cap_per_artist(ranked.join(s.select("song_idx", "artist"), "song_idx"), 2, 10)


@query("mood_journey_starts", f"WITH {{songs}}, {_TARGETS}, sure AS (SELECT query_id, song_idx, round_even(exp(-0.5 * (power((valence - t_valence) / 0.20, 2) + power((arousal - t_arousal) / 0.14, 2))) * 1e6, 0) / 1e6 AS score FROM songs, targets WHERE song_idx % 50 <> 7) SELECT CAST(query_id AS BIGINT) AS query_id, 1 AS place, song_idx, score FROM sure QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_idx) = 1")
def mood_journey_starts(spark: SparkSession, d: str) -> DataFrame:
    """The first songs of the journeys, which follow nothing."""
    s = songs(spark, d)
    return retrieval.journeys(s, _ends(spark, d), k=1, played=s.where("song_idx % 50 = 7"))


_COPIED = """versions AS (SELECT song_idx, artist, title, audio_vec FROM songs UNION ALL SELECT song_idx + 1000000, artist, title, list_concat([audio_vec[1] + 0.3 * (1 + song_idx % 3)], audio_vec[2:]) FROM songs WHERE song_idx % 5 = 0)"""


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """The songs, and copies of every fifth whose audio is a little different, some more than others."""
    s = songs(spark, d).select("song_idx", "artist", "title", "audio_vec")
    first = F.get("audio_vec", F.lit(0)) + 0.3 * (1 + F.col("song_idx") % 3)
    copies = s.where("song_idx % 5 = 0").select((F.col("song_idx") + 1_000_000).alias("song_idx"), "artist", "title", F.concat(F.array(first), F.slice("audio_vec", 2, 63)).alias("audio_vec"))
    return s.unionByName(copies)


_NEAR = "SELECT a.song_idx AS a, b.song_idx AS b, round_even(list_cosine_similarity(a.audio_vec, b.audio_vec) * 1e6, 0) / 1e6 AS cosine FROM versions a JOIN versions b ON a.song_idx < b.song_idx WHERE round_even(list_cosine_similarity(a.audio_vec, b.audio_vec) * 1e6, 0) / 1e6 > 0.85"


@query("near_duplicate_pairs", f"WITH {{songs}}, {_COPIED} {_NEAR}")
def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return vector_join.near_pairs(_versions(spark, d), 0.85)


@query("cover_index", f"WITH {{songs}}, {_COPIED}, k AS (SELECT song_idx, artist, left(title, 20) AS start, min(song_idx) OVER (PARTITION BY artist, left(title, 20)) AS first FROM versions), p AS (SELECT a, b FROM ({_NEAR}) UNION SELECT first, song_idx FROM k WHERE first < song_idx), e AS (SELECT a AS src, b AS dst FROM p UNION SELECT b, a FROM p) SELECT src, count(*) AS n, min(dst) AS first, max(dst) AS last FROM e GROUP BY src")
def cover_index(spark: SparkSession, d: str) -> DataFrame:
    """Each version with those that sound like it, and with the first of its artist and title: a group of any size is a star."""
    s = _versions(spark, d)
    key = s.select("song_idx", "artist", F.left("title", F.lit(20)).alias("start"))
    first = key.groupBy("artist", "start").agg(F.min("song_idx").alias("a"))
    named = key.join(first, ["artist", "start"]).where("a < song_idx").select("a", F.col("song_idx").alias("b"))
    pairs = vector_join.near_pairs(s, 0.85).select("a", "b").unionByName(named)
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("first"), F.max("dst").alias("last"))


@query("crossfade_plan", """WITH {songs}, n AS (SELECT artist, song_idx, bpm, valence, arousal, popularity / 1000 AS loudness, lead(song_idx) OVER w AS next, lead(bpm) OVER w AS nb, lead(valence) OVER w AS nv, lead(arousal) OVER w AS na, lead(popularity / 1000) OVER w AS nl FROM songs WINDOW w AS (PARTITION BY artist ORDER BY song_idx)),
t AS (SELECT *, abs(bpm - nb) / greatest(bpm, nb) AS tempo, abs(valence - nv) + abs(arousal - na) AS m FROM n WHERE next IS NOT NULL)
SELECT artist, song_idx, next, CASE WHEN tempo <= 0.03 AND m <= 0.25 THEN 12.0 WHEN tempo <= 0.06 AND m <= 0.5 THEN 8.0 WHEN tempo <= 0.12 OR m <= 0.25 THEN 5.0 ELSE 3.0 END::DOUBLE AS overlap, round(least(greatest(loudness - nl, -6.0), 6.0), 6) AS gain_db FROM t""")
def crossfade_plan(spark: SparkSession, d: str) -> DataFrame:
    s = songs(spark, d).withColumns({"loudness": F.col("popularity") / 1000, "at": F.col("song_idx")})
    return sequences.transitions(s, "artist", "at").drop("at").withColumn("gain_db", F.round("gain_db", 6))


@query("camelot", "WITH {songs}, k AS (SELECT song_idx, size % 12 AS key, label % 2 AS mode, (CASE WHEN label % 2 = 1 THEN (size % 12) * 7 + 7 ELSE (size % 12) * 7 + 4 END) % 12 AS hour FROM songs), p AS (SELECT a.song_idx AS a, b.song_idx AS b, a.mode = b.mode AS same, (a.hour - b.hour + 12) % 12 AS t FROM k a JOIN k b ON b.song_idx = a.song_idx + 1) SELECT a, b, CASE WHEN same AND t = 0 THEN 1.0 WHEN t = 0 THEN 0.8 WHEN same AND t IN (1, 11) THEN 0.7 ELSE 0.4 END::DOUBLE AS fit FROM p")
def camelot(spark: SparkSession, d: str) -> DataFrame:
    k = songs(spark, d).select("song_idx", (F.col("size") % 12).alias("key"), (F.col("label") % 2).alias("mode"))
    b = k.select((F.col("song_idx") - 1).alias("song_idx"), F.col("song_idx").alias("b"), F.col("key").alias("bk"), F.col("mode").alias("bm"))
    return k.join(b, "song_idx").select(F.col("song_idx").alias("a"), "b", crossfade.harmony(F.col("key"), F.col("mode"), F.col("bk"), F.col("bm")).alias("fit"))


@query("va_label", "WITH {songs}, l(label8, v, a) AS (VALUES " + ", ".join(f"('{k}', {v}, {a})" for k, (v, a) in E.LABEL_PLACES.items()) + ") SELECT song_idx, label8 AS mood_label, CASE WHEN valence >= 0.5 AND arousal >= 0.5 THEN 'Q1' WHEN arousal >= 0.5 THEN 'Q2' WHEN valence < 0.5 THEN 'Q3' ELSE 'Q4' END AS quadrant FROM songs, l QUALIFY row_number() OVER (PARTITION BY song_idx ORDER BY power(valence - v::DOUBLE, 2) + power(arousal - a::DOUBLE, 2), label8) = 1")
def va_label(spark: SparkSession, d: str) -> DataFrame:
    v, a = F.col("valence"), F.col("arousal")
    return songs(spark, d).select("song_idx", E.nearest_label(v, a).alias("mood_label"), C.quadrant(v, a).alias("quadrant"))


@query("mood_to_color", "WITH {songs}, n(i, v, w, h, s, l) AS (VALUES " + ", ".join(f"({i}, {v}::DOUBLE, {a}::DOUBLE, {h}::DOUBLE, {s}::DOUBLE, {l}::DOUBLE)" for i, (v, a, h, s, l) in enumerate(C.MOOD_ANCHORS)) + "), d AS (SELECT song_idx, i, h, s, l, sqrt(power(valence - v, 2) + power(arousal - w, 2)) AS d FROM songs, n QUALIFY row_number() OVER (PARTITION BY song_idx ORDER BY d, i) <= 3) SELECT song_idx, round(fmod(fmod(sum(h / (d + 1e-6)) / sum(1 / (d + 1e-6)), 360) + 360, 360), 4) AS hue, round(sum(s / (d + 1e-6)) / sum(1 / (d + 1e-6)), 4) AS sat, round(sum(l / (d + 1e-6)) / sum(1 / (d + 1e-6)), 4) AS light FROM d GROUP BY song_idx")
def mood_to_color(spark: SparkSession, d: str) -> DataFrame:
    return songs(spark, d).select("song_idx", C.mood_to_hsl(F.col("valence"), F.col("arousal")).alias("c")).select("song_idx", *[F.round(f"c.{k}", 4).alias(k) for k in ("hue", "sat", "light")])


_LAB = """lin AS (SELECT *, CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END AS rl, CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END AS gl, CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS bl FROM rgb),
cie AS (SELECT *, (0.4124564 * rl + 0.3575761 * gl + 0.1804375 * bl) / 0.95047 AS cx, 0.2126729 * rl + 0.7151522 * gl + 0.0721750 * bl AS cy, (0.0193339 * rl + 0.1191920 * gl + 0.9503041 * bl) / 1.08883 AS cz FROM lin),
f AS (SELECT *, CASE WHEN cx > 216 / 24389.0 THEN pow(cx, 1 / 3.0) ELSE (24389 / 27.0 * cx + 16) / 116 END AS fx, CASE WHEN cy > 216 / 24389.0 THEN pow(cy, 1 / 3.0) ELSE (24389 / 27.0 * cy + 16) / 116 END AS fy, CASE WHEN cz > 216 / 24389.0 THEN pow(cz, 1 / 3.0) ELSE (24389 / 27.0 * cz + 16) / 116 END AS fz FROM cie),
lab2 AS (SELECT name, (116 * fy - 16) / 100 AS cl, sqrt(power(500 * (fx - fy), 2) + power(200 * (fy - fz), 2)) / 130 AS cc FROM f)"""


@query("client_moods", f"WITH {_PAINTED}, {_CHANNELS.split(', range_')[0].split(',\nrange_')[0]}, {_LAB} SELECT name, round(least(greatest(0.69 * cl + 0.22 * cc, 0), 1), 5) AS valence, round(least(greatest(-0.31 * cl + 0.6 * cc, 0), 1), 5) AS arousal FROM lab2")
def client_moods(spark: SparkSession, d: str) -> DataFrame:
    """The guess that a client makes of a colour's mood."""
    return painted(spark, d).select("name", C.client_mood(F.col("hex")).alias("m")).select("name", F.round("m.valence", 5).alias("valence"), F.round("m.arousal", 5).alias("arousal"))


@query("atmosphere", "WITH {songs} SELECT song_idx, round((250 - 215 * valence) / 360, 6) AS hue, round(0.3 + 0.55 * arousal, 6) AS sat, round(0.32 + 0.34 * valence, 6) AS light FROM songs")
def atmosphere(spark: SparkSession, d: str) -> DataFrame:
    return songs(spark, d).select("song_idx", C.mood_atmosphere(F.col("valence"), F.col("arousal")).alias("c")).select("song_idx", *[F.round(f"c.{k}", 6).alias(k) for k in ("hue", "sat", "light")])


_ANGLE = "CASE WHEN {a} = 0 AND {b} = 0 THEN 0 ELSE (degrees(atan2({b}, {a})) + 360) % 360 END"


@query(
    "ciede2000",
    f"""WITH {_PAINTED}, {_CHANNELS.split(', range_')[0].split(',\nrange_')[0]}, {_LAB.split(',\nlab2 AS')[0]},
    lab AS (SELECT query_id AS i, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM f WHERE query_id > 0),
    p AS (SELECT x.i, y.i AS j, x.l AS l1, x.a AS ra1, x.b AS b1, y.l AS l2, y.a AS ra2, y.b AS b2, pow((sqrt(x.a * x.a + x.b * x.b) + sqrt(y.a * y.a + y.b * y.b)) / 2, 7) AS c7 FROM lab x JOIN lab y ON y.i = x.i + 1),
    q AS (SELECT *, ra1 * (1.5::DOUBLE - 0.5::DOUBLE * sqrt(c7 / (c7 + 6103515625))) AS a1, ra2 * (1.5::DOUBLE - 0.5::DOUBLE * sqrt(c7 / (c7 + 6103515625))) AS a2 FROM p),
    h AS (SELECT *, sqrt(a1 * a1 + b1 * b1) AS c1, sqrt(a2 * a2 + b2 * b2) AS c2, {_ANGLE.format(a="a1", b="b1")} AS h1, {_ANGLE.format(a="a2", b="b2")} AS h2 FROM q),
    m AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh,
      CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh, (l1 + l2) / 2 AS ml, (c1 + c2) / 2 AS mc FROM h),
    s AS (SELECT *, 1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6)) - 0.20 * cos(radians(4 * mh - 63)) AS t FROM m),
    w AS (SELECT i, j, (l2 - l1) / (1 + 0.015 * power(ml - 50, 2) / sqrt(20 + power(ml - 50, 2))) AS dl, (c2 - c1) / (1 + 0.045 * mc) AS dc, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * mc * t) AS dd,
      -2 * sqrt(pow(mc, 7) / (pow(mc, 7) + 6103515625)) * sin(radians(60 * exp(-power((mh - 275) / 25, 2)))) AS rt FROM s)
    SELECT i AS name, j AS other, round(sqrt(dl * dl + dc * dc + dd * dd + rt * dc * dd), 4) AS difference FROM w""",
)
def ciede2000(spark: SparkSession, d: str) -> DataFrame:
    """The difference of each part's colour and the next one's."""
    c = painted(spark, d).where("query_id > 0").select(F.col("query_id").alias("name"), C.cielab(F.col("hex")).alias("lab"))
    met = c.join(c.select((F.col("name") - 1).alias("name"), F.col("name").alias("other"), F.col("lab").alias("other_lab")), "name")
    return met.select("name", "other", F.round(C.ciede2000(F.col("lab"), F.col("other_lab")), 4).alias("difference"))


@query("text_search_blocks", "WITH m AS (SELECT p_partkey AS item, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS t, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS b, p_retailprice AS pop FROM part), i AS (SELECT count(*) > 0 AS artist FROM m WHERE a = 'brand 1' OR (contains(a, 'brand 1') AND 7 >= 0.6 * length(a)) OR (contains('brand 1', a) AND length(a) >= 4)), h AS (SELECT item, pop, a = 'brand 1' OR t = 'brand 1' AS eq, CASE WHEN contains(a, 'brand 1') THEN CASE WHEN artist THEN 0 ELSE 1 END WHEN contains(t, 'brand 1') THEN CASE WHEN artist THEN 1 ELSE 0 END WHEN contains(b, 'brand 1') THEN 2 END AS block FROM m, i) SELECT item, block, CAST(row_number() OVER w AS INTEGER) AS place FROM h WHERE block IS NOT NULL WINDOW w AS (ORDER BY block, eq DESC, pop DESC NULLS LAST, item) QUALIFY row_number() OVER w <= 25")
def text_search_blocks(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"), F.col("p_type").alias("body"), F.col("p_retailprice").alias("popularity"))
    return search.blocks(items, "Brand 1", 25)


_SEARCHED = "m AS (SELECT song_idx AS item, trim(regexp_replace(lower(artist), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, popularity AS pop FROM songs), h AS (SELECT item, CASE WHEN contains(t, 'blue gizmo') THEN 0 ELSE 1 END AS block, a = 'blue gizmo' OR t = 'blue gizmo' AS eq, pop FROM m WHERE contains(t, 'blue gizmo') OR contains(a, 'blue gizmo')), p AS (SELECT item, block, row_number() OVER (ORDER BY block, eq DESC, pop DESC, item)::DOUBLE AS o FROM h QUALIFY row_number() OVER (ORDER BY block, eq DESC, pop DESC, item) <= 12)"


@query("smart_search", f"WITH {{songs}}, {_SEARCHED}, v AS (SELECT s.song_idx AS item, round_even(list_cosine_similarity(s.audio_vec, q.audio_vec) * 1e6, 0) / 1e6 AS c FROM songs s, songs q WHERE q.song_idx = 100 AND s.song_idx <> 100), e AS (SELECT item, 3 AS block, -c AS o FROM v WHERE c >= 0.1 QUALIFY row_number() OVER (ORDER BY c DESC, item) <= 12), u AS (SELECT item, block, o FROM p UNION ALL SELECT item, block, o FROM e), f AS (SELECT item, block, o FROM u QUALIFY row_number() OVER (PARTITION BY item ORDER BY block, o) = 1) SELECT item, block, CAST(row_number() OVER (ORDER BY block, o, item) AS INTEGER) AS place FROM f QUALIFY row_number() OVER (ORDER BY block, o, item) <= 12")
def smart_search(spark: SparkSession, d: str) -> DataFrame:
    """Words first, then what is nearest to the query's vector (here that of song 100)."""
    s = songs(spark, d)
    near = retrieval.nearest(s, s.where("song_idx = 100"), 24).select(F.col("song_idx").alias("item"), F.col("score").alias("similarity"))
    return search.smart(search.index(s, "song_idx", "artist", "title", "mood", "popularity").withColumn("body", F.lit("")), "Blue Gizmo", 12, near, 0.1, typos=None)


@query("smart_search_typos")
def smart_search_typos(spark: SparkSession, d: str) -> DataFrame:
    s = songs(spark, d)
    return search.smart(search.index(s, "song_idx", "artist", "title", "mood", "popularity"), "smalll rnig", 12, typos=80.0)


@query("cover_keys", r"""WITH {tracks}, n AS (SELECT track_id, lower(trim(track_name)) AS t, regexp_replace(strip_accents(replace(lower(split_part(artists, ',', 1)), 'đ', 'd')), '[^a-z0-9]+', '', 'g')[1:15] AS artist_key FROM tracks), c AS (SELECT *, list_min(list_filter([strpos(t, '(feat'), strpos(t, '(live'), strpos(t, 'feat.'), strpos(t, ' ft.')], lambda x: x > 1)) AS at1 FROM n) SELECT track_id, trim(regexp_replace(strip_accents(replace(CASE WHEN at1 IS NULL THEN t ELSE left(t, CAST(at1 - 1 AS BIGINT)) END, 'đ', 'd')), '[^a-z0-9]+', ' ', 'g')) AS title_key, artist_key FROM c""")
def cover_keys(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.tracks import tracks

    return tracks(spark, d).select("track_id", T.cover_title(F.col("track_name")).alias("title_key"), T.artist_key(F.col("artists")).alias("artist_key"))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _like(x: str) -> str:
    return f"coalesce(len(list_intersect({_GRAMS.format(x)}, q)) / nullif(len(list_distinct(list_concat({_GRAMS.format(x)}, q))), 0)::DOUBLE, 0)"


@query("trigram_search", f"WITH g AS (SELECT {_GRAMS.format(repr('brand 12'))} AS q), s AS (SELECT p_partkey AS item, greatest({_like('p_name')}, {_like('p_brand')}) AS similarity, p_retailprice AS pop, contains(lower(p_name), 'brand 12') OR contains(lower(p_brand), 'brand 12') AS held FROM part, g) SELECT item, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.3 OR held ORDER BY s.similarity DESC, pop DESC NULLS LAST, item LIMIT 25")
def trigram_search(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("popularity"))
    return trigram_index.search(trigram_index.build(items), "brand 12", 25).withColumn("similarity", F.round("similarity", 6))


@query("fuzzy_typo_recovery")
def fuzzy_typo_recovery(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("popularity"))
    return search.typo_matches(items, "smalll rnig", least=80.0).withColumn("ratio", F.round("ratio", 4))


@query("lyric_snippet", "WITH p AS (SELECT doc_id, trim(regexp_replace(strip_accents(replace(lower(text), 'đ', 'd')), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents), a AS (SELECT *, strpos(t, 'the and') AS pos FROM p WHERE contains(t, 'the and')), c AS (SELECT *, greatest(pos - 25, 1) AS start, substr(t, CAST(greatest(pos - 25, 1) AS BIGINT), CAST(115 - greatest(0, 26 - pos) AS BIGINT)) AS cut FROM a) SELECT doc_id, CASE WHEN start > 1 THEN '...' ELSE '' END || cut || CASE WHEN start + length(cut) - 1 < length(t) THEN '...' ELSE '' END AS snippet FROM c")
def lyric_snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), "the and").alias("snippet")).where("snippet is not null")


@query("centred_vectors", "WITH {songs}, u AS (SELECT song_idx, unnest(audio_vec) AS x, generate_subscripts(audio_vec, 1) AS dim FROM songs), m AS (SELECT dim, avg(x) AS m FROM u GROUP BY dim), c AS (SELECT song_idx, dim, x - m AS x FROM u JOIN m USING (dim)) SELECT song_idx, round(sqrt(sum(x * x)), 6) AS length FROM c GROUP BY song_idx")
def centred_vectors(spark: SparkSession, d: str) -> DataFrame:
    s = songs(spark, d).select("song_idx", "audio_vec")
    mean = s.select(F.posexplode("audio_vec").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("mean"))
    centred = s.join(F.broadcast(mean)).withColumn("c", F.zip_with("audio_vec", "mean", lambda x, m: x - m))
    return centred.select("song_idx", F.round(V.norm(F.col("c")), 6).alias("length"))
