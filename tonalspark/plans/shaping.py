"""Results as clients see them, and features and moods of tracks before they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shaping as S
from ..sources.shared import dealt
from ..sources.tracks import tracks
from .registry import query, songs, table


@query(
    "song_documents",
    """WITH {tracks} SELECT ord AS song_index, track_id, coalesce(track_name, 'Unknown') AS track_name, coalesce(primary_artist, artists, 'Unknown') AS artist, coalesce(album_name, '') AS album_name, coalesce(valence, 0.5::DOUBLE) AS valence,
    coalesce(energy, 0.5::DOUBLE) AS energy, coalesce(tempo, 120.0::DOUBLE) AS tempo, loudness, ord % 5 < 3 AS has_audio, CASE WHEN ord % 5 < 3 THEN '/audio/' || track_id END AS audio_url,
    CASE WHEN ord % 3 = 0 THEN '/art/' || track_id WHEN ord % 3 = 1 THEN 'http://pictures/' || track_id END AS album_art_url, coalesce(nullif(track_duration_ms, 0) / 1000.0::DOUBLE, actual_s) AS duration_s FROM tracks""",
)
def song_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = tracks(spark, d).withColumn("song_idx", F.col("ord"))
    art = S.art_url(F.col("ord") % 3 == 0, F.col("track_id"), F.when(F.col("ord") % 3 == 1, F.concat(F.lit("http://pictures/"), "track_id")))
    length = S.seconds_of(F.lit(None).cast("long"), F.col("track_duration_ms"), F.col("actual_s"))
    doc = S.song_document(rows, F.col("ord") % 5 < 3)
    return rows.select(doc.alias("d"), art.alias("album_art_url"), length.alias("duration_s")).select(*[f"d.{k}" for k in ("song_index", "track_id", "track_name", "artist", "album_name", "valence", "energy", "tempo", "loudness", "has_audio", "audio_url")], "album_art_url", "duration_s")


@query("finite_values", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE p_retailprice END AS price FROM part")
def finite_values(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("p_partkey") % 3 == 0, float("nan")).when(F.col("p_partkey") % 3 == 1, float("-inf")).otherwise(F.col("p_retailprice"))
    return S.allow_listed(S.sanitised(table(spark, d, "part").withColumn("price", price)), ["p_partkey", "price", "not_there"])


@query("id_resolution", "WITH {songs}, w AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id * 2 AS VARCHAR) WHEN doc_id % 3 = 1 THEN 't' || doc_id ELSE '' END AS wanted FROM documents), n AS (SELECT song_idx, CASE WHEN song_idx % 2 = 0 THEN track_id ELSE 't' || track_id END AS track_id FROM songs) SELECT wanted, coalesce(p.song_idx, k.song_idx) AS song_idx FROM w LEFT JOIN n p ON regexp_matches(wanted, '^[0-9]{1,18}$') AND p.song_idx = TRY_CAST(wanted AS BIGINT) LEFT JOIN n k ON NOT regexp_matches(wanted, '^[0-9]{1,18}$') AND k.track_id = wanted")
def id_resolution(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    wanted = table(spark, d, "documents").select(F.when(i % 3 == 0, (i * 2).cast("string")).when(i % 3 == 1, F.concat(F.lit("t"), i.cast("string"))).otherwise("").alias("wanted"))
    named = songs(spark, d).select("song_idx", F.when(F.col("song_idx") % 2 == 0, F.col("track_id")).otherwise(F.concat(F.lit("t"), "track_id")).alias("track_id"))
    return S.resolve_ids(wanted, named)


_MOODS = "CASE ord % 9 WHEN 0 THEN 'Happy' WHEN 1 THEN 'excited' WHEN 2 THEN 'peaceful' WHEN 3 THEN 'calm' WHEN 4 THEN 'melancholic' WHEN 5 THEN 'sad' WHEN 6 THEN 'tense' WHEN 7 THEN 'angry' END"
_THRESHOLD = "CASE WHEN {v} >= 0.5 AND {e} >= 0.5 THEN CASE WHEN {v} > 0.7 AND {e} > 0.7 THEN 'excited' ELSE 'happy' END WHEN {v} < 0.5 AND {e} >= 0.5 THEN CASE WHEN {v} < 0.30 AND {e} > 0.68 THEN 'angry' ELSE 'tense' END WHEN {v} < 0.5 THEN CASE WHEN {v} < 0.3 THEN 'sad' ELSE 'melancholic' END ELSE CASE WHEN {e} < 0.3 THEN 'peaceful' ELSE 'calm' END END"


def _moods():
    out = F.lit(None).cast("string")
    for i, k in enumerate(["Happy", "excited", "peaceful", "calm", "melancholic", "sad", "tense", "angry"]):
        out = F.when(F.col("ord") % 9 == i, k).otherwise(out)
    return out


@query(
    "mood_estimates",
    f"""WITH {{tracks}}, m AS (SELECT *, {_MOODS} AS label8, CASE WHEN ord % 4 = 0 THEN NULL ELSE danceability END AS arousal FROM tracks),
    b AS (SELECT min(coalesce(valence, 0.5)) AS lv, max(coalesce(valence, 0.5)) AS hv, min(coalesce(energy, 0.5)) AS le, max(coalesce(energy, 0.5)) AS he, min(coalesce(arousal, 0.5)) AS la, max(coalesce(arousal, 0.5)) AS ha FROM m),
    c(k, v) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, (v, _) in S.CENTRES.items())}), q(k, quadrant) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in S.QUADRANTS.items())})
    SELECT track_id, coalesce(label8, {_THRESHOLD.format(v="coalesce(valence, 0.5)", e="coalesce(arousal, energy, 0.5)")}) AS label, coalesce(quadrant, CASE WHEN ord % 2 = 0 THEN 'old' END, 'Q3') AS quadrant,
      round(0.5::DOUBLE * coalesce(v, 0.5::DOUBLE) + 0.5::DOUBLE * least(greatest((coalesce(valence, 0.5) - lv) / (hv - lv + 1e-9), 0), 1), 9) AS song_valence,
      round(0.6::DOUBLE * least(greatest((coalesce(energy, 0.5) - le) / (he - le + 1e-9), 0), 1) + 0.4::DOUBLE * least(greatest((coalesce(arousal, 0.5) - la) / (ha - la + 1e-9), 0), 1), 9) AS song_arousal
    FROM m CROSS JOIN b LEFT JOIN c ON c.k = lower(coalesce(label8, 'happy')) LEFT JOIN q ON q.k = lower(label8)""",
)
def mood_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Labels, quadrants and places in mood space of tracks, with what stands in where a label or a number is missing."""
    rows = tracks(spark, d).withColumns({"label8": _moods(), "arousal": F.when(F.col("ord") % 4 != 0, F.col("danceability"))})
    placed = S.with_mood(rows)
    label = S.label_or_estimate(F.col("label8"), F.col("valence"), F.col("arousal"), F.col("energy"))
    return placed.select("track_id", label.alias("label"), S.quadrant_of(F.col("label8"), F.when(F.col("ord") % 2 == 0, "old")).alias("quadrant"), F.round("song_valence", 9).alias("song_valence"), F.round("song_arousal", 9).alias("song_arousal"))


@query(
    "feature_rules",
    f"""WITH {{tracks}}, e AS (SELECT *, round(least(greatest(0.5::DOUBLE + CASE WHEN mode = 1 THEN 0.15::DOUBLE ELSE -0.15::DOUBLE END + (least(greatest((coalesce(tempo, 120) - 60) / 120, 0), 1) - 0.5) * 0.2::DOUBLE + (coalesce(energy, 0.5) - 0.5) * 0.15::DOUBLE + (least(greatest((loudness + 20) / 20, 0), 1) - 0.5) * 0.1::DOUBLE, 0), 1), 4) AS estimate FROM tracks)
    SELECT track_id, estimate, coalesce(CASE WHEN ord % 3 = 0 THEN valence END, CASE WHEN ord % 3 = 1 THEN voice_probability END, estimate) AS valence, coalesce(CASE WHEN ord % 3 = 0 THEN valence END, CASE WHEN ord % 3 = 1 THEN voice_probability END) IS NULL AS valence_estimated,
      CASE WHEN ord % 3 = 0 AND valence IS NOT NULL THEN 'dsp+model' ELSE 'dsp' END AS source, round(CASE WHEN singing_mean IS NOT NULL THEN 0.6::DOUBLE * voice_probability + 0.4::DOUBLE * singing_mean ELSE voice_probability END, 9) AS fused,
      round(pow(10, loudness / 20), 9) AS factor, CASE WHEN loudness BETWEEN -70 AND 0 THEN least(greatest(loudness + 14, -6), 6) ELSE 0 END AS gain, least(greatest(2 * speech_mean, 0), 1) AS share
    FROM e""",
)
def feature_rules(spark: SparkSession, d: str) -> DataFrame:
    """Features of tracks by what is best known of each, and numbers in the bounds that they should have."""
    c, n = F.col, F.col("ord") % 3
    rows = tracks(spark, d)
    estimate = S.estimated_valence(c("mode"), c("tempo"), c("energy"), c("loudness"))
    made = S.merged_features({"valence": F.when(n == 0, c("valence"))}, {"valence": F.when(n == 1, c("voice_probability"))}, estimate, F.lit("dsp"))
    share = S.clipped(rows.withColumn("share", 2 * c("speech_mean")), ["share"]).select("track_id", "share")
    out = rows.select("track_id", estimate.alias("estimate"), made["valence"].alias("valence"), made["valence_estimated"].alias("valence_estimated"), made["feature_source"].alias("source"), F.round(S.fused(c("voice_probability"), c("singing_mean")), 9).alias("fused"), F.round(S.decibels(c("loudness")), 9).alias("factor"), S.loudness_gain(c("loudness"), F.lit(-14.0)).alias("gain"))
    return out.join(share, "track_id")


@query(
    "musical_texts",
    """WITH {tracks}, p AS (SELECT track_id, CASE WHEN ord % 7 = 0 THEN NULL WHEN tempo < 100 THEN 'slow' ELSE 'fast' END AS t, CASE WHEN ord % 4 = 0 THEN '' ELSE 'mid' END AS e, * FROM tracks)
    SELECT track_id, coalesce(nullif(concat_ws(', ', 'tempo ' || nullif(t, '') || coalesce(' (~' || CAST(round_even(tempo, 0) AS INTEGER) || ' BPM)', ''), 'energy ' || nullif(e, ''), 'dance ' || CASE WHEN danceability < 0.34 THEN 'low' WHEN danceability < 0.66 THEN 'medium' WHEN danceability IS NOT NULL THEN 'high' END, CASE WHEN mode = 1 THEN 'major' WHEN mode IS NOT NULL THEN 'minor' END), ''), 'unknown') AS text FROM p""",
)
def musical_texts(spark: SparkSession, d: str) -> DataFrame:
    speed = F.when(F.col("ord") % 7 == 0, None).when(F.col("tempo") < 100, "slow").otherwise("fast")
    return tracks(spark, d).select("track_id", S.musical_text(F.col("tempo"), speed, F.when(F.col("ord") % 4 == 0, "").otherwise("mid"), F.col("danceability"), F.col("mode")).alias("text"))


@query(
    "song_reasons",
    """WITH {songs}, r AS (SELECT q.song_idx AS query_id, s.song_idx, (list_dot_product(s.audio_vec, q.audio_vec) + 1) / 2 AS score, s.mood, q.mood AS q_mood, s.bpm, q.bpm AS q_bpm, s.valence, s.arousal, q.valence AS qv, q.arousal AS qa FROM songs s JOIN songs q ON s.label = q.label AND q.song_idx % 100 = 0 AND s.song_idx <> q.song_idx)
    SELECT query_id, song_idx, CASE WHEN lower(mood) = lower(q_mood) THEN 'it sounds alike and is ' || lower(mood) || ' as well' ELSE 'it sounds alike' END AS reason, round(score, 3) AS similarity, lower(mood) = lower(q_mood) AS same_mood, round(abs(bpm - q_bpm), 1) AS tempo_delta,
      round(exp(-0.5 * (power((valence - qv) / 0.22, 2) + power((arousal - qa) / 0.14, 2))), 3) AS mood_match FROM r""",
)
def song_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why songs of a seed's label are like it."""
    from ..functions import vectors as V

    s = songs(spark, d)
    q = s.where("song_idx % 100 = 0").select("label", *[F.col(c).alias(f"q_{c}") for c in ("song_idx", "mood", "bpm", "valence", "arousal", "audio_vec")])
    met = s.join(q, "label").where("song_idx != q_song_idx")
    why = S.song_why(V.half_up(V.dot(F.col("audio_vec"), F.col("q_audio_vec"))), F.col("mood"), F.col("q_mood"), F.col("bpm"), F.col("q_bpm"), F.col("valence"), F.col("arousal"), F.col("q_valence"), F.col("q_arousal"))
    return met.select(F.col("q_song_idx").alias("query_id"), "song_idx", why.alias("w")).select("query_id", "song_idx", *[f"w.{k}" for k in ("reason", "similarity", "same_mood", "tempo_delta", "mood_match")])


@query(
    "beat_features",
    """WITH {tracks}, b AS (SELECT track_id, ord, tempo, danceability, list_transform(range(0, 24), lambda i: i * 0.5::DOUBLE + ((i * ord) % 5) / 50.0::DOUBLE) AS beats FROM tracks),
    g AS (SELECT *, list_transform(range(1, 24), lambda i: beats[i + 1] - beats[i]) AS gaps, coalesce(tempo, 100) AS bpm FROM b),
    s AS (SELECT *, list_transform(range(0, 7), lambda i: list_sum(gaps[i * 3 + 1 : i * 3 + 3])) AS threes, list_transform(range(0, 5), lambda i: list_sum(gaps[i * 4 + 1 : i * 4 + 4])) AS fours FROM g)
    SELECT track_id, CASE WHEN bpm BETWEEN 70 AND 130 AND list_stddev_pop(threes) < 0.7::DOUBLE * list_stddev_pop(fours) THEN 3 ELSE 4 END AS signature, CASE WHEN coalesce(danceability, 0) >= 0.7 THEN list_transform(range(0, 6), lambda i: round(beats[i * 4 + 1], 3))[2] END AS second_downbeat, len(beats) AS beats FROM s""",
)
def beat_features(spark: SparkSession, d: str) -> DataFrame:
    """Time signatures and downbeats from beat times that come as JSON."""
    beats = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: i * 0.5 + (i * F.col("ord") % 5) / 50)
    rows = dealt(tracks(spark, d).select("track_id", "ord", "tempo", "danceability"), "track_id").withColumn("beats", S.beats_of(F.to_json(beats)))
    gaps = F.zip_with(F.slice("beats", 2, 23), F.slice("beats", 1, 23), lambda b, a: b - a)
    return rows.select("track_id", S.time_signature(gaps, F.coalesce("tempo", F.lit(100.0))).alias("signature"), F.get(S.downbeats(F.col("beats"), F.col("danceability")), F.lit(1)).alias("second_downbeat"), F.size("beats").cast("long").alias("beats"))


@query(
    "signal_features",
    """WITH {tracks}, x AS (SELECT track_id, ord, list_transform(range(0, 400), lambda i: ((i * (ord % 17 + 3)) % 29) / 29.0::DOUBLE * CASE WHEN i < ord % 60 OR i > 400 - ord % 90 THEN 0.001 ELSE 1 END) AS signal FROM tracks),
    e AS (SELECT *, list_transform(range(0, 73), lambda i: sqrt(list_sum(list_transform(signal[i * 5 + 1 : i * 5 + 40], lambda v: v * v)) / 40)) AS levels FROM x),
    w AS (SELECT *, list_filter(range(1, 74), lambda i: levels[i] >= 0.02) AS loud FROM e)
    SELECT track_id, round(list_sum(levels), 6) AS total, round(greatest(0, least(15, greatest((loud[1] - 1) * 0.5, (ord % 40) * 0.5))), 2)::DOUBLE AS fade_in,
      round(greatest(0, least(200, CASE WHEN (loud[-1] - 1) * 0.5 - 1 >= 30 THEN (loud[-1] - 1) * 0.5 - 1 ELSE 180 END)), 2)::DOUBLE AS fade_out FROM w""",
)
def signal_features(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes of made-up signals, and where a song comes in and goes out."""
    o = F.col("ord")
    wave = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: (i * (o % 17 + 3) % 29) / 29 * F.when((i < o % 60) | (i > 400 - o % 90), 0.001).otherwise(1.0))
    rows = dealt(tracks(spark, d).select("track_id", "ord"), "track_id").select("track_id", "ord", wave.alias("signal")).withColumn("levels", S.rms_envelope(F.col("signal"), 40, 5))
    cues = S.cue_points(F.col("levels"), 0.5, F.lit(200.0), (o % 40) * 0.5)
    return rows.select("track_id", F.round(F.aggregate("levels", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), cues.alias("c")).select("track_id", "total", "c.fade_in", "c.fade_out")


@query(
    "frame_quality",
    """WITH f AS (SELECT conv_id, list(turn / 10.0::DOUBLE ORDER BY turn) AS speech, list(((turn * 3) % 7) / 10.0::DOUBLE ORDER BY turn) AS singing, list(((turn + conv_id) % 5) / 20.0::DOUBLE ORDER BY turn) AS music FROM conversations GROUP BY conv_id)
    SELECT conv_id, round(list_avg(speech), 5) AS speech_mean, round(list_avg(singing), 5) AS singing_mean, round(list_avg(music), 5) AS music_mean, round(list_avg(list_transform(range(1, len(speech) + 1), lambda i: CASE WHEN speech[i] >= 0.10 AND speech[i] > music[i] THEN 1 ELSE 0 END)), 5) AS speech_share, round(list_avg(list_transform(music, lambda m: CASE WHEN m < 0.10 THEN 1 ELSE 0 END)), 5) AS low_music FROM f""",
)
def frame_quality(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    listed = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.col("turn") / 10).alias("s"), (F.col("turn") * 3 % 7 / 10).alias("g"), ((F.col("turn") + F.col("conv_id")) % 5 / 20).alias("m")))).alias("f"))
    part = lambda k: F.transform("f", lambda x: x[k])
    return listed.select("conv_id", S.frame_shares(part("s"), part("g"), part("m")).alias("q")).select("conv_id", "q.*")


@query("client_limits", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.0.' || (event_id % 9) WHEN 1 THEN 'host' WHEN 2 THEN 'unknown' ELSE 'host' END AS client, CASE WHEN starts_with('/' || event_type, '/c') THEN 30 WHEN starts_with('/' || event_type, '/p') THEN 5 ELSE 120 END AS most FROM events")
def client_limits(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 4
    forwarded = F.when(n == 0, F.concat(F.lit(" 10.0.0."), (F.col("event_id") % 9).cast("string"), F.lit(", 1.1.1.1"))).when(n == 3, "")
    return table(spark, d, "events").select("event_id", S.client_of(forwarded, F.when(n % 2 == 1, "host")).alias("client"), S.limit_of(F.concat(F.lit("/"), "event_type"), {"/c": 30, "/p": 5}, 120).alias("most"))


@query("sentiment_shares", "WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id % 5 END AS p, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id % 3 END AS n FROM documents), t AS (SELECT *, p + n + CASE WHEN p + n = 0 THEN 0 ELSE 2 END AS t FROM s) SELECT doc_id, CASE WHEN t IS NOT NULL THEN round(CASE WHEN t > 0 THEN p / t::DOUBLE ELSE 0 END, 4) END AS positive, CASE WHEN t IS NOT NULL THEN round(CASE WHEN t > 0 THEN (p - n) / t::DOUBLE ELSE 0 END, 4) END AS compound, CASE WHEN t IS NULL THEN NULL WHEN round(CASE WHEN t > 0 THEN (p - n) / t::DOUBLE ELSE 0 END, 4) >= 0.05 THEN 'Positive' WHEN round(CASE WHEN t > 0 THEN (p - n) / t::DOUBLE ELSE 0 END, 4) <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS category FROM t")
def sentiment_shares(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    p, n = F.when(i % 10 != 0, i % 5), F.when(i % 10 != 0, i % 3)
    s = S.sentiment(p, n, F.when(p + n == 0, 0).otherwise(2))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.positive", "s.compound", "s.category")


@query("prompt_contrast", "SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]) - list_dot_product(e.embedding::DOUBLE[], n.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) p, (SELECT embedding FROM embeddings WHERE vec_id = 2) n")
def prompt_contrast(spark: SparkSession, d: str) -> DataFrame:
    """How much nearer each vector is to one prompt's than to its opposite's."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    prompts = e.where("vec_id IN (1, 2)").agg(F.max_by("embedding", -F.col("vec_id")).alias("yes"), F.max_by("embedding", "vec_id").alias("no"))
    return e.join(F.broadcast(prompts)).select("vec_id", F.round(S.prompt_contrast(F.col("embedding"), F.col("yes"), F.col("no")), 6).alias("score"))
