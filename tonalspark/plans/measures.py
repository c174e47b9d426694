"""Measures of lists, cues of songs, pages and profiles of a catalogue, readers with fallbacks, and checks after a load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import text as T
from ..operators import catalogue as K
from ..operators import enrichment as N
from ..operators import lists as L
from ..operators import retrieval, vector_join, weights
from ..sources import catalogue as S
from ..sources.shared import dealt, scratch
from ..sources.tracks import tracks
from . import quality as Q
from .evaluation import _TOP, _recs
from .experiments import _COLOR_TOP
from .registry import ORACLES, query, songs, table
from .similarity import _ANGLE, _CHANNELS, _COPIED, _MOOD, _NEAR, _PAINTED, _TARGETS, _targets, _versions, painted


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


_SQL_LAB = """hx AS (SELECT song_idx, CASE WHEN song_idx % 11 > 0 THEN left(md5(CAST(song_idx AS VARCHAR)), 6) END AS hex FROM songs),
ch AS (SELECT song_idx, ('0x' || hex[1:2])::INT / 255.0::DOUBLE AS r, ('0x' || hex[3:4])::INT / 255.0::DOUBLE AS g, ('0x' || hex[5:6])::INT / 255.0::DOUBLE AS b FROM hx),
ln AS (SELECT song_idx, CASE WHEN r <= 0.04045 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END AS r, CASE WHEN g <= 0.04045 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END AS g, CASE WHEN b <= 0.04045 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS b FROM ch),
ci AS (SELECT song_idx, (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047 AS x, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b AS y, (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883 AS z FROM ln),
cf AS (SELECT song_idx, CASE WHEN x > 216 / 24389.0 THEN pow(x, 1 / 3.0) ELSE (24389 / 27.0 * x + 16) / 116 END AS x, CASE WHEN y > 216 / 24389.0 THEN pow(y, 1 / 3.0) ELSE (24389 / 27.0 * y + 16) / 116 END AS y, CASE WHEN z > 216 / 24389.0 THEN pow(z, 1 / 3.0) ELSE (24389 / 27.0 * z + 16) / 116 END AS z FROM ci),
lab AS (SELECT song_idx, 116 * y - 16 AS l, 500 * (x - y) AS a, 200 * (y - z) AS b FROM cf)"""

#: From p (l1, ra1, b1, l2, ra2, b2 and other columns) to de with the difference of the two colours, as published.
_SQL_DE = f"""p7 AS (SELECT *, pow((sqrt(ra1 * ra1 + b1 * b1) + sqrt(ra2 * ra2 + b2 * b2)) / 2, 7) AS c7 FROM p),
pg AS (SELECT *, ra1 * (1.5::DOUBLE - 0.5::DOUBLE * sqrt(c7 / (c7 + 6103515625))) AS a1, ra2 * (1.5::DOUBLE - 0.5::DOUBLE * sqrt(c7 / (c7 + 6103515625))) AS a2 FROM p7),
ph AS (SELECT *, sqrt(a1 * a1 + b1 * b1) AS c1, sqrt(a2 * a2 + b2 * b2) AS c2, {_ANGLE.format(a="a1", b="b1")} AS h1, {_ANGLE.format(a="a2", b="b2")} AS h2 FROM pg),
pm AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh, (l1 + l2) / 2 AS ml, (c1 + c2) / 2 AS mc FROM ph),
pt AS (SELECT *, 1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6)) - 0.20 * cos(radians(4 * mh - 63)) AS t FROM pm),
pw AS (SELECT *, (l2 - l1) / (1 + 0.015 * power(ml - 50, 2) / sqrt(20 + power(ml - 50, 2))) AS dl, (c2 - c1) / (1 + 0.045 * mc) AS dc, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * mc * t) AS dd,
  -2 * sqrt(pow(mc, 7) / (pow(mc, 7) + 6103515625)) * sin(radians(60 * exp(-power((mh - 275) / 25, 2)))) AS rt FROM pt),
de AS (SELECT *, sqrt(dl * dl + dc * dc + dd * dd + rt * dc * dd) AS de FROM pw)"""


@query(
    "list_spreads",
    f"""WITH {_TOP}, {_SQL_LAB}, m AS (SELECT query_id, rank, s.*, lab.l AS cl, lab.a AS ca, lab.b AS cb FROM recs JOIN songs s USING (song_idx) JOIN lab USING (song_idx)),
    p AS (SELECT x.query_id, x.rank AS i, y.rank AS j, 1 - list_cosine_similarity(x.audio_vec, y.audio_vec) AS fa, 1 - list_cosine_similarity(x.lyrics_vec, y.lyrics_vec) AS fl, sqrt(power(x.valence - y.valence, 2) + power(x.arousal - y.arousal, 2)) AS fv,
      x.cl AS l1, x.ca AS ra1, x.cb AS b1, y.cl AS l2, y.ca AS ra2, y.cb AS b2 FROM m x JOIN m y ON x.query_id = y.query_id AND x.rank < y.rank), {_SQL_DE},
    e AS (SELECT query_id, avg(fa) AS ia, avg(fl) AS il, avg(fv) AS iv, coalesce(avg(de), 0) AS ic FROM de GROUP BY query_id), t AS (SELECT query_id, count(*) AS n, greatest(0, 1 - stddev_pop(bpm) / avg(bpm)) AS tc FROM m GROUP BY query_id)
    SELECT query_id, n, round(ia, 6) AS ild_audio, round(il, 6) AS ild_lyrics, round(iv, 6) AS ild_va, round(ic, 6) AS ild_color, round(greatest(0, 1 - iv / sqrt(2.0::DOUBLE)), 6) AS mood_coherence, round(tc, 6) AS tempo_coherence, round(greatest(0, 1 - ic / 100), 6) AS color_coherence FROM t JOIN e USING (query_id)""",
)
def list_spreads(spark: SparkSession, d: str) -> DataFrame:
    """How far the songs of each list lie apart, in four ways, and how coherent it is, in three."""
    s, recs = _recs(spark, d)
    hex_ = F.when(F.col("song_idx") % 11 > 0, F.concat(F.lit("#"), F.left(F.md5(F.col("song_idx").cast("string")), F.lit(6))))
    return _rounded(L.spreads(recs, s.withColumn("color_hex", hex_)))


@query("list_jumps", f"WITH {_TOP}, s AS (SELECT query_id, abs(bpm - lag(bpm) OVER w) AS b, 1 - list_cosine_similarity(audio_vec, lag(audio_vec) OVER w) AS t FROM recs JOIN songs USING (song_idx) WINDOW w AS (PARTITION BY query_id ORDER BY rank)) SELECT query_id, round(avg(b), 6) AS bpm_jump, round(avg(t), 6) AS audio_jump FROM s GROUP BY query_id")
def list_jumps(spark: SparkSession, d: str) -> DataFrame:
    """How far tempo and audio jump from a song to the next."""
    s, recs = _recs(spark, d)
    return _rounded(L.jumps(recs, s))


@query(
    "color_targeting",
    f"""WITH {_COLOR_TOP}, s AS (SELECT var_samp(valence) + 1e-6 AS vv, var_samp(arousal) + 1e-6 AS aa, covar_samp(valence, arousal) AS va FROM songs), m AS (SELECT top.query_id, valence - t_valence AS dv, arousal - t_arousal AS da, s.* FROM top JOIN targets ON top.query_id = targets.query_id JOIN songs USING (song_idx), s)
    SELECT query_id, round(avg(sqrt(dv * dv + da * da)), 6) AS euclidean, round(avg(sqrt(greatest((dv * dv * aa - 2 * dv * da * va + da * da * vv) / (vv * aa - va * va), 0))), 6) AS mahalanobis FROM m GROUP BY query_id""",
)
def color_targeting(spark: SparkSession, d: str) -> DataFrame:
    """How far each colour's songs lie from it, plainly and by the songs' own spread."""
    s, t = songs(spark, d), _targets(spark, d)
    return _rounded(L.targeting(retrieval.by_targets(s, t, 10), s, t))


@query(
    "journey_calibration",
    f"""WITH {_COLOR_TOP}, e AS (SELECT CAST(x.query_id AS BIGINT) AS query_id, x.t_valence AS fv, x.t_arousal AS fa, y.t_valence AS tv, y.t_arousal AS ta FROM targets x JOIN targets y ON y.query_id = (x.query_id + 1) % 12),
    p AS (SELECT query_id, song_idx FROM top UNION SELECT (query_id + 11) % 12, song_idx FROM top),
    m AS (SELECT query_id, greatest(0, least(1, ((valence - fv) * (tv - fv) + (arousal - fa) * (ta - fa)) / (power(tv - fv, 2) + power(ta - fa, 2)))) AS t FROM p JOIN e USING (query_id) JOIN songs USING (song_idx)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY t) AS i, count(*) OVER (PARTITION BY query_id) AS n FROM m)
    SELECT query_id, max(n) AS n, round(max(greatest(i / n::DOUBLE - t, t - (i - 1) / n::DOUBLE)), 6) AS ks, round(avg(t), 6) AS mean, round(stddev_pop(t), 6) AS sd, round(count(DISTINCT least(floor(t * 10), 9)) / 10.0::DOUBLE, 6) AS covered FROM r GROUP BY query_id""",
)
def journey_calibration(spark: SparkSession, d: str) -> DataFrame:
    """How evenly the songs of two colours lie on the way from one to the other."""
    s, t = songs(spark, d), _targets(spark, d)
    other = t.select(((F.col("query_id") + 11) % 12).alias("query_id"), F.col("t_valence").alias("to_v"), F.col("t_arousal").alias("to_a"))
    ends = t.withColumnsRenamed({"t_valence": "from_v", "t_arousal": "from_a"}).join(other, "query_id")
    top = retrieval.by_targets(s, t, 10).select("query_id", "song_idx")
    return _rounded(L.journey_fit(top.union(top.select((F.col("query_id") + 11) % 12, "song_idx")).distinct(), s, ends))


_FRAMES = "f AS (SELECT user_id AS song, 2.5::DOUBLE * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS time, CASE event_type WHEN 'error' THEN 0.001::DOUBLE WHEN 'signup' THEN 0.015::DOUBLE ELSE value / 1000 END AS level, event_id FROM events)"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as frames of a song's sound."""
    e, kind = table(spark, d, "events"), F.col("event_type")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("song"), (2.5 * n).alias("time"), F.when(kind == "error", 0.001).when(kind == "signup", 0.015).otherwise(F.col("value") / 1000).alias("level"))


@query(
    "sound_edges",
    f"""WITH {_FRAMES}, o AS (SELECT *, level >= greatest(0.005, 0.08 * max(level) OVER (PARTITION BY song)) AS up FROM f), t AS (SELECT *, CASE WHEN up IS DISTINCT FROM lag(up) OVER (PARTITION BY song ORDER BY time) THEN 1 ELSE 0 END AS turn FROM o),
    r AS (SELECT *, sum(turn) OVER (PARTITION BY song ORDER BY time) AS run FROM t), l AS (SELECT song, run, min(time) AS a, max(time) AS b FROM r WHERE up GROUP BY song, run HAVING max(time) - min(time) >= 5) SELECT song, min(a) AS start, max(b) AS "end" FROM l GROUP BY song""",
)
def sound_edges(spark: SparkSession, d: str) -> DataFrame:
    """Where a song's sustained sound begins and ends."""
    return L.edges_of_sound(_frames(spark, d), "song", "time", "level", least=5.0)


@query(
    "cue_points",
    f"""WITH {_FRAMES}, s AS (SELECT song, max(time) AS length, max(time) FILTER (level >= 0.02) AS last, min(time) FILTER (level >= 0.02) AS first FROM f GROUP BY song),
    b AS (SELECT song, list_sort(list(time * 2.3))[2] AS second FROM f WHERE time < 10 GROUP BY song), g AS (SELECT song, list_sort(list(round(time * 0.2, 3))) AS beats FROM f WHERE song % 3 > 0 GROUP BY song)
    SELECT song, round(greatest(0, least(length, CASE WHEN last - 1 >= 30 THEN last - 1 ELSE greatest(0, length - 20) END)), 2) AS fade_out, round(greatest(0, least(15, greatest(coalesce(first, 0), coalesce(second, 0)))), 2) AS fade_in,
      CASE WHEN len(beats) > 4 THEN CAST((len(beats) + 3) // 4 AS INTEGER) END AS downbeats, CASE WHEN len(beats) > 4 THEN beats[(len(beats) - 1) // 4 * 4 + 1] END AS last_downbeat FROM s LEFT JOIN b USING (song) LEFT JOIN g USING (song)""",
)
def cue_points(spark: SparkSession, d: str) -> DataFrame:
    """Where a song can be faded in and out, and its downbeats."""
    f = _frames(spark, d)
    found = L.cues(f, f.where("time < 10").select("song", (F.col("time") * 2.3).alias("at")), f.where("song % 3 > 0").select("song", (F.col("time") * 0.2).alias("beat")), "song")
    return found.select("song", "fade_out", "fade_in", F.when(F.col("downbeats").isNotNull(), F.size("downbeats")).alias("downbeats"), F.try_element_at("downbeats", F.lit(-1)).alias("last_downbeat"))


@query("neighbour_pairs", f"WITH {{songs}}, {_COPIED}, n AS ({_NEAR}), o AS (SELECT a, b, cosine, a AS x, b AS y FROM n UNION ALL SELECT a, b, cosine, b, a FROM n) SELECT DISTINCT a, b, cosine FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY cosine DESC, y) AS r FROM o WHERE cosine >= 0.86) WHERE r <= 1")
def neighbour_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of versions of which one is the other's nearest, if they are near enough."""
    return vector_join.neighbour_pairs(_versions(spark, d), 1, 0.86)


@query(
    "cross_artist_truth",
    "WITH {songs}, l AS (SELECT DISTINCT l_orderkey AS list_id, l_partkey AS song_idx FROM lineitem JOIN songs ON l_partkey = song_idx) SELECT DISTINCT x.song_idx AS query_id, y.song_idx FROM l x JOIN l y USING (list_id) JOIN songs p ON p.song_idx = x.song_idx JOIN songs q ON q.song_idx = y.song_idx WHERE x.song_idx % 10 = 0 AND x.song_idx <> y.song_idx AND p.artist <> q.artist",
)
def cross_artist_truth(spark: SparkSession, d: str) -> DataFrame:
    """For each tenth song the songs of other artists that share a list with it."""
    s = songs(spark, d).select("song_idx", "artist")
    lists = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_partkey").alias("song_idx")).distinct().join(s.select("song_idx"), "song_idx").withColumn("held_out", F.lit(False))
    return weights.relevant(lists, s.where("song_idx % 10 = 0").withColumnRenamed("song_idx", "query_id"), other=s).select("query_id", "song_idx")


@query(
    "centred_audio",
    """WITH v AS (SELECT vec_id AS song_idx, embedding::DOUBLE[] AS x FROM embeddings), u AS (SELECT song_idx, dim, x[dim] / sqrt(list_dot_product(x, x)) AS x FROM v, range(1, 65) t(dim)), m AS (SELECT dim, avg(x) AS m FROM u GROUP BY dim),
    c AS (SELECT song_idx, dim, x - m AS x FROM u JOIN m USING (dim)), n AS (SELECT song_idx, sqrt(sum(x * x)) AS n FROM c GROUP BY song_idx) SELECT song_idx, round(max(x / n) FILTER (dim = 1), 6) AS first, round(max(x / n) FILTER (dim = 64), 6) AS last FROM c JOIN n USING (song_idx) GROUP BY song_idx""",
)
def centred_audio(spark: SparkSession, d: str) -> DataFrame:
    """Audio vectors of unit length, less their mean, of unit length again: the first and last of their components."""
    v = N.centred(table(spark, d, "embeddings").select(F.col("vec_id").alias("song_idx"), "embedding"), "embedding", "c")
    return v.select("song_idx", F.round(F.get("c", F.lit(0)), 6).alias("first"), F.round(F.get("c", F.lit(63)), 6).alias("last"))


_MOODY = "m AS (SELECT *, CASE WHEN ord % 10 = 0 THEN NULL WHEN valence >= 0.5 AND energy >= 0.5 THEN 'Q1: Happy/Excited' WHEN energy >= 0.5 THEN 'Q2: Angry/Tense' WHEN valence < 0.5 THEN 'Q3: Sad/Melancholic' ELSE 'Q4: Calm/Peaceful' END AS mood_quadrant FROM tracks)"


def _moody(spark: SparkSession, d: str) -> DataFrame:
    high, up = F.col("valence") >= 0.5, F.col("energy") >= 0.5
    quadrant = F.when(F.col("ord") % 10 == 0, None).when(high & up, "Q1: Happy/Excited").when(up, "Q2: Angry/Tense").when(F.col("valence") < 0.5, "Q3: Sad/Melancholic").otherwise("Q4: Calm/Peaceful")
    return tracks(spark, d).withColumn("mood_quadrant", quadrant)


_SORTED = {"name": "track_name ASC NULLS LAST", "artist": "artists ASC NULLS LAST", "energy": "energy DESC NULLS LAST", "valence": "valence DESC NULLS LAST", "danceability": "danceability DESC NULLS LAST", "random": "md5('7/' || ord)"}


@query(
    "browse_sorted",
    f"WITH {{tracks}}, {_MOODY}, k AS (SELECT * FROM m WHERE contains(lower(mood_quadrant), 'q1: happy') AND regexp_matches(artists, '(?i)brand#1.*') AND ord % 3 > 0) "
    + " UNION ALL ".join(f"SELECT sort, place, track_id, (SELECT count(*) FROM m WHERE contains(lower(mood_quadrant), 'q1: happy') AND regexp_matches(artists, '(?i)brand#1.*')) AS total FROM (SELECT '{s}' AS sort, CAST(row_number() OVER (ORDER BY {o}, ord) AS INTEGER) AS place, track_id FROM k) WHERE place BETWEEN 6 AND 10" for s, o in _SORTED.items()),
)
def browse_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The second page of five songs in each order, of a mood, an artist pattern and what a search has found; and how many fit without it."""
    t = _moody(spark, d)
    found = t.where("ord % 3 > 0").select("ord")
    out = None
    for sort in _SORTED:
        page, fits = K.browse(t, "ord", sort, 2, 5, "q1: HAPPY", "brand#1.*", found, seed=7)
        rows = page.select(F.lit(sort).alias("sort"), "place", "track_id")
        out = rows if out is None else out.unionByName(rows)
    return out.join(F.broadcast(t.agg(F.count_if(fits).alias("total"))))


@query(
    "featured_and_new",
    """WITH {tracks}, p AS (SELECT ord, track_id FROM tracks ORDER BY 0.5 * energy + 0.3 * danceability + 0.2 * coalesce(valence, 0.5) DESC NULLS LAST, ord LIMIT 36), f AS (SELECT 'featured' AS shelf, track_id FROM p ORDER BY md5('5/' || ord), ord LIMIT 12),
    q AS (SELECT ord, track_id FROM tracks ORDER BY ord DESC LIMIT 24), n AS (SELECT 'new' AS shelf, track_id FROM q ORDER BY md5('5/' || ord), ord LIMIT 12) SELECT * FROM f UNION ALL SELECT * FROM n""",
)
def featured_and_new(spark: SparkSession, d: str) -> DataFrame:
    """Twelve of the 36 liveliest tracks, and twelve of the 24 newest."""
    t = tracks(spark, d)
    score = 0.5 * F.col("energy") + 0.3 * F.col("danceability") + 0.2 * F.coalesce("valence", F.lit(0.5))
    shelf = lambda name, order, pool: K.sampled(t, "ord", [*order], pool, 12, 5).select(F.lit(name).alias("shelf"), "track_id")
    return shelf("featured", [score.desc_nulls_last(), F.col("ord").asc()], 36).unionByName(shelf("new", [F.col("ord").desc()], 24))


@query(
    "catalogue_profile",
    f"""WITH {{tracks}}, {_MOODY} SELECT 'all' AS part, 'rows' AS name, count(*)::DOUBLE AS value FROM m
    {" ".join(f"UNION ALL SELECT '{c}', '{n}', round({f}({c}), 6) FROM m" for c in ("valence", "energy", "tempo") for n, f in (("mean", "avg"), ("sd", "stddev_samp"), ("min", "min"), ("max", "max")))}
    UNION ALL SELECT 'album_name', 'different', count(DISTINCT album_name) FROM m UNION ALL SELECT 'mood_quadrant', mood_quadrant, count(*) FROM m WHERE mood_quadrant IS NOT NULL GROUP BY mood_quadrant
    UNION ALL SELECT 'top album_name', album_name, n FROM (SELECT album_name, count(*) AS n FROM m WHERE album_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, album_name LIMIT 10)""",
)
def catalogue_profile(spark: SparkSession, d: str) -> DataFrame:
    """What a catalogue has: moods, numbers, and its commonest albums."""
    return K.profile(_moody(spark, d), ["mood_quadrant"], ["valence", "energy", "tempo"], {"album_name": 10}).withColumn("value", F.round("value", 6))


@query(
    "load_validation",
    f"""WITH {{tracks}}, {_MOODY}, al AS (SELECT DISTINCT album_id FROM tracks WHERE ord % 50 <> 7), ar AS (SELECT DISTINCT primary_artist_id FROM tracks WHERE ord % 50 < 25 AND primary_artist_id IS NOT NULL), v AS (SELECT CAST(vec_id AS VARCHAR) AS track_id FROM embeddings)
    SELECT 'songs_rows' AS "check", count(*) AS value, false AS issue FROM m UNION ALL SELECT 'vectors_rows', count(*), false FROM v UNION ALL SELECT 'artists_rows', count(*), false FROM ar UNION ALL SELECT 'albums_rows', count(*), false FROM al
    UNION ALL SELECT 'songs_without_vector', count(*), count(*) > 0 FROM m WHERE track_id NOT IN (SELECT track_id FROM v) UNION ALL SELECT 'unknown_albums', count(*), count(*) > 0 FROM m WHERE album_id IS NOT NULL AND album_id NOT IN (SELECT album_id FROM al)
    UNION ALL SELECT 'unknown_artists', count(*), count(*) > 0 FROM m WHERE primary_artist_id IS NOT NULL AND primary_artist_id NOT IN (SELECT primary_artist_id FROM ar) UNION ALL SELECT 'null_mood_quadrant', count(*), count(*) > 0 FROM m WHERE mood_quadrant IS NULL
    UNION ALL SELECT 'null_track_name', count(*), count(*) > 0 FROM m WHERE track_name IS NULL UNION ALL SELECT 'quadrants', count(DISTINCT mood_quadrant), count(DISTINCT mood_quadrant) < 4 FROM m""",
)
def load_validation(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong after a load: vectors, albums and artists that aren't there, nulls, missing quadrants."""
    t = _moody(spark, d)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("track_id"))
    artists = t.where("ord % 50 < 25 AND primary_artist_id IS NOT NULL").select(F.col("primary_artist_id").alias("artist_id")).distinct()
    return K.loaded(t, vectors, artists, t.where("ord % 50 != 7").select("album_id").distinct(), ["mood_quadrant", "track_name"])


@query(
    "modulated_colors",
    """WITH {tracks}, x AS (SELECT *, coalesce(valence, 0.5) AS va, coalesce(energy, 0.5) AS ar FROM tracks), n(i, v, w, h, s, l) AS (VALUES """
    + ", ".join(f"({i}, {v}::DOUBLE, {a}::DOUBLE, {h}::DOUBLE, {s}::DOUBLE, {l}::DOUBLE)" for i, (v, a, h, s, l) in enumerate(C.MOOD_ANCHORS))
    + """), d AS (SELECT ord, i, h, s, l, sqrt(power(va - v, 2) + power(ar - w, 2)) AS d FROM x, n QUALIFY row_number() OVER (PARTITION BY ord ORDER BY d, i) <= 3),
    b AS (SELECT ord, fmod(fmod(sum(h / (d + 1e-6)) / sum(1 / (d + 1e-6)), 360) + 360, 360) AS h, sum(s / (d + 1e-6)) / sum(1 / (d + 1e-6)) AS s, sum(l / (d + 1e-6)) / sum(1 / (d + 1e-6)) AS l FROM d GROUP BY ord)
    SELECT track_id, round(fmod(fmod(h + coalesce((danceability - 0.5) * -30, 0), 360) + 360, 360), 4) AS hue, round(least(greatest(s + coalesce((least(greatest((tempo - 60) / 140, 0), 1) - 0.5) * 15, 0) + coalesce((energy - 0.5) * 10, 0), 0), 100), 4) AS sat,
      round(least(greatest(l + CASE WHEN mode = 1 THEN 10 ELSE -10 END + coalesce((danceability - 0.5) * 8, 0), 0), 100), 4) AS light FROM x JOIN b USING (ord)""",
)
def modulated_colors(spark: SparkSession, d: str) -> DataFrame:
    """The colour of each track's mood, moved by tempo, mode, energy and timbre."""
    hsl = C.mood_to_hsl(F.coalesce("valence", F.lit(0.5)), F.coalesce("energy", F.lit(0.5)))
    t = tracks(spark, d).withColumn("hsl", hsl)
    out = t.select("track_id", C.modulated(F.col("hsl"), F.col("tempo"), F.col("mode"), F.col("energy"), F.col("danceability")).alias("c"))
    return out.select("track_id", *[F.round(f"c.{k}", 4).alias(k) for k in ("hue", "sat", "light")])


@query("profiles_with_fallback", "SELECT 'json' AS source, s_name AS key, 'http://i/' || s_suppkey AS image_url, CAST(s_suppkey AS BIGINT) AS followers FROM supplier UNION ALL SELECT 'csv', CAST(s_suppkey AS VARCHAR), 'http://t/' || s_suppkey, NULL FROM supplier WHERE s_suppkey % 4 > 0")
def profiles_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Artist profiles from JSON, and, where that file has none, from CSV: once with a full file and once with an empty one."""
    s, root = table(spark, d, "supplier").select("s_suppkey", "s_name"), scratch(spark, "profiles")
    pairs = F.concat(F.lit('"'), "s_name", F.lit('":{"image_url":"http://i/'), F.col("s_suppkey").cast("string"), F.lit('","followers":'), F.col("s_suppkey").cast("string"), F.lit("}"))
    whole = s.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pairs)), ","), F.lit("}")).alias("value"))  # one document, as such a file is
    whole.coalesce(1).write.text(f"{root}/full")
    spark.createDataFrame([("{}",)], "value string").coalesce(1).write.text(f"{root}/empty")
    csv = s.select(F.col("s_suppkey").cast("string").alias("artist_id"), F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("http://t/"), F.col("s_suppkey").cast("string"))).alias("thumbnail_url"))
    csv.coalesce(1).write.option("header", True).csv(f"{root}/artists")
    of = lambda name, path: S.artist_profiles(spark, f"{root}/{path}", f"{root}/artists").select(F.lit(name).alias("source"), "key", "image_url", "followers")
    return of("json", "full").unionByName(of("csv", "empty"))


@query("nested_records", "SELECT CAST(p_partkey AS VARCHAR) AS track_id, p_name AS track_name, p_brand AS primary_artist, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ', guest' ELSE p_brand END AS artists, CASE WHEN p_partkey % 4 > 0 THEN p_type END AS album_name, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size * 1000 AS BIGINT) ELSE CAST((60 + p_size) * 1000 AS BIGINT) END AS track_duration_ms FROM part")
def nested_records(spark: SparkSession, d: str) -> DataFrame:
    """A flat table rebuilt from a file of nested track records, some with seconds and some with a clock."""
    p, key, root = table(spark, d, "part"), F.col("p_partkey"), scratch(spark, "nested")
    person = lambda name, id_: F.struct(name.alias("name"), id_.alias("id"))
    both = F.when(key % 3 == 0, F.array(person(F.col("p_brand"), F.lit("a")), person(F.lit("guest"), F.lit("b")))).otherwise(F.array(person(F.col("p_brand"), F.lit("a"))))
    clock = F.concat(F.lit("1:"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    row = F.struct(key.cast("string").alias("videoId"), F.col("p_name").alias("title"), both.alias("artists"), F.when(key % 4 > 0, F.struct(F.col("p_type").alias("name"))).alias("album"), F.when(key % 2 == 0, F.col("p_size").cast("long")).alias("duration_seconds"), F.when(key % 2 == 1, clock).alias("duration"))
    p.select(F.to_json(row).alias("value")).write.text(root)
    return S.nested_tracks(spark, root).select("track_id", "track_name", "primary_artist", "artists", "album_name", "track_duration_ms")


@query("lyrics_tiers", "WITH {tracks} SELECT track_id, md5(coalesce(CASE WHEN ord % 3 = 0 THEN nullif(trim(plain_lyrics), '') END, CASE WHEN ord % 2 = 0 THEN track_name END, CASE WHEN ord % 5 = 0 THEN album_name END)) AS lyrics, CASE WHEN ord % 3 = 0 AND trim(plain_lyrics) <> '' THEN 'lyrics' WHEN ord % 2 = 0 THEN 'title' WHEN ord % 5 = 0 AND album_name IS NOT NULL THEN 'album' ELSE 'not found' END AS found_in FROM tracks")
def lyrics_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The lyrics that the first of three sources has, which one, and what none of them has."""
    t = tracks(spark, d)
    tier = lambda every, c: t.where(F.col("ord") % every == 0).select("track_id", F.col(c).alias("lyrics"))
    found = S.sought(t.select("track_id"), [("lyrics", tier(3, "plain_lyrics")), ("title", tier(2, "track_name")), ("album", tier(5, "album_name"))], "track_id", "lyrics")
    return found.select("track_id", F.md5("lyrics").alias("lyrics"), "found_in")


_HEARD = ["actual_s", "instrumental_probability", "voice_probability", "singing_mean", "speech_mean", "music_mean", "speech_share", "low_music"]


@query("audited_tracks", f"WITH {{tracks}}, au AS (SELECT track_id, {', '.join(_HEARD)} FROM tracks WHERE ord % 4 > 0), j AS (SELECT t.* EXCLUDE ({', '.join(_HEARD)}), au.* EXCLUDE (track_id) FROM tracks t LEFT JOIN au USING (track_id)) SELECT track_id, {Q._AUDIT} AS reason FROM j")
def audited_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Why recordings are rejected, with the audio audit as a table of its own that some of them aren't in."""
    t = tracks(spark, d)
    rows = t.drop(*_HEARD).join(t.where("ord % 4 > 0").select("track_id", *_HEARD), "track_id", "left")
    return rows.select("track_id", Q.audit(rows).alias("reason"))


@query(
    "fused_colors",
    f"""WITH {{songs}}, {_TARGETS}, s AS (SELECT query_id, song_idx, round_even(exp(-0.5 * (power((valence - t_valence) / 0.20, 2) + power((arousal - t_arousal) / 0.14, 2))) * 1e6, 0) AS score FROM songs, targets),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_idx) AS rank FROM s), f AS (SELECT query_id // 2 AS request, song_idx, sum(1 / (60 + rank)::DOUBLE) AS total, min(struct_pack(s := -score, q := query_id)).q AS color FROM r GROUP BY query_id // 2, song_idx),
    p AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(total, 12) DESC, song_idx) AS place FROM f) SELECT CAST(request AS BIGINT) AS request, CAST(place AS INTEGER) AS place, song_idx, round(total / max(total) OVER (PARTITION BY request), 6) AS score, CAST(color AS BIGINT) AS color FROM p WHERE place <= 10""",
)
def fused_colors(spark: SparkSession, d: str) -> DataFrame:
    """The ten songs that two colours rank highest together, by their places among all songs, and the colour that each is nearer to."""
    t = _targets(spark, d).withColumn("request", F.expr("query_id div 2"))
    return _rounded(retrieval.fused_colors(songs(spark, d), t, 10))


_WORDS = {"happy": "joyful", "sad": "blue", "tense": "uneasy"}


@query(
    "color_bridges",
    f"""WITH {_PAINTED}, {_CHANNELS}, {_MOOD}, e AS (SELECT name, min(struct_pack(s := -share, emotion := emotion)).emotion AS emotion FROM ({ORACLES["color_emotion_probs"]}) GROUP BY name),
    c AS (SELECT name, hex, emotion, CASE emotion WHEN 'happy' THEN 'joyful' WHEN 'sad' THEN 'blue' WHEN 'tense' THEN 'uneasy' ELSE emotion END AS word, round(valence, 2) AS valence, round(arousal, 2) AS arousal FROM moods JOIN e USING (name)),
    a AS (SELECT p_partkey, 1 AS place, CAST(p_partkey AS VARCHAR) AS name FROM part UNION ALL SELECT p_partkey, 2, CASE p_partkey % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE 'grey' END FROM part) SELECT p_partkey, place, hex, emotion, word, valence, arousal FROM a JOIN c USING (name)""",
)
def color_bridges(spark: SparkSession, d: str) -> DataFrame:
    """What the first three of four colours stand for; the second can't be read."""
    k = F.col("p_partkey")
    named = F.when(k % 3 == 0, C.COLORS["red"]).when(k % 3 == 1, C.COLORS["blue"]).otherwise(C.COLORS["grey"])
    own = F.concat(F.lit("#"), F.left(F.md5(k.cast("string")), F.lit(6)))
    b = dealt(table(spark, d, "part").select(k), "p_partkey").select(k, F.posexplode(C.bridge(F.array(own, F.lit("#12"), named, own), _WORDS)).alias("at", "b"))
    return b.select(k, (F.col("at") + 1).alias("place"), "b.*")


@query(
    "color_forms",
    f"""WITH {_PAINTED}, {_CHANNELS.split(", range_")[0]}, k AS (SELECT name, hex, h, s * 100 AS s, l * 100 AS l, (h + 30) % 360 AS h2, least(s * 100 + 5, 100) AS s2, l * 90 AS l2 FROM hsl),
    f AS (SELECT *, l2 / 100 AS x, (1 - abs(2 * l2 / 100 - 1)) * s2 / 100 AS c FROM k), g AS (SELECT *, x - c / 2 * greatest(-1, least((h2 / 30) % 12 - 3, 9 - (h2 / 30) % 12, 1)) AS r, x - c / 2 * greatest(-1, least((8 + h2 / 30) % 12 - 3, 9 - (8 + h2 / 30) % 12, 1)) AS gr, x - c / 2 * greatest(-1, least((4 + h2 / 30) % 12 - 3, 9 - (4 + h2 / 30) % 12, 1)) AS b FROM f)
    SELECT name, round(h, 4) AS hue, round(s, 4) AS sat, round(l, 4) AS light, printf('#%02x%02x%02x', CAST(floor(round(r * 255, 9)) AS BIGINT), CAST(floor(round(gr * 255, 9)) AS BIGINT), CAST(floor(round(b * 255, 9)) AS BIGINT)) AS turned FROM g""",
)
def color_forms(spark: SparkSession, d: str) -> DataFrame:
    """Colours as hue, saturation and lightness, and turned, deepened and darkened as hexadecimal digits again."""
    p = painted(spark, d).select("name", C.hsl(F.col("hex")).alias("c"))
    sat, light = F.col("c.s") * 100, F.col("c.l") * 100
    return p.select("name", F.round("c.h", 4).alias("hue"), F.round(sat, 4).alias("sat"), F.round(light, 4).alias("light"), C.hex_of((F.col("c.h") + 30) % 360, F.least(sat + 5, F.lit(100.0)), light * 0.9).alias("turned"))


_SCALES = {"tempo": (60.0, 200.0), "loudness": (-20.0, 0.0), "key": (0.0, 11.0)}
_GROUPS = {"timbral": ["energy", "loudness", "instrumental_probability"], "rhythmic": ["tempo", "danceability"], "tonal": ["valence", "key", "mode"]}


def _scaled_sql() -> str:
    cut = {c: f"least(greatest(({c} - ({low})) / ({high} - ({low}))::DOUBLE, 0), 1)" for c, (low, high) in _SCALES.items()} | {c: f"{c}::DOUBLE" for c in ("energy", "danceability", "valence", "instrumental_probability")}
    return "s AS (SELECT track_id, mode, " + ", ".join(f"{x} AS {c}" for c, x in cut.items()) + " FROM tracks), m AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in cut) + " FROM s), f AS (SELECT track_id, s.mode::DOUBLE AS mode, " + ", ".join(f"round(coalesce(s.{c}, m.{c}), 6) AS {c}" for c in cut) + " FROM s, m)"


@query("scaled_audio", f"WITH {{tracks}}, {_scaled_sql()} SELECT track_id, " + ", ".join(f"round({' + '.join(f'{i + 1} * {c}' for i, c in enumerate(cs))}, 5) AS {g}" for g, cs in _GROUPS.items()) + " FROM f")
def scaled_audio(spark: SparkSession, d: str) -> DataFrame:
    """Audio features within 0 and 1, medians for missing ones, in three groups, of each of which a weighted sum is shown."""
    t = tracks(spark, d).select("track_id", F.col("mode").cast("double").alias("mode"), *[F.col(c).cast("double").alias(c) for c in [*_SCALES, "energy", "danceability", "valence", "instrumental_probability"]])
    s = K.scaled_audio(t, _SCALES, ["energy", "danceability", "valence", "instrumental_probability"])
    groups = s.select("track_id", *[F.array(*[F.round(c, 6) for c in cs]).alias(g) for g, cs in _GROUPS.items()])
    total = lambda g: F.round(F.aggregate(F.transform(g, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 5)
    return groups.select("track_id", *[total(g).alias(g) for g in _GROUPS])


@query(
    "cover_report",
    f"""WITH {{songs}}, {_COPIED}, n AS ({_NEAR}), k AS (SELECT song_idx, CASE WHEN length(title) > 3 AND artist <> '' THEN left(artist, 8) || '|' || left(title, 20) END AS key FROM versions), t AS (SELECT x.song_idx AS a, y.song_idx AS b FROM k x JOIN k y ON x.key = y.key AND x.song_idx < y.song_idx),
    c AS (SELECT a AS i FROM n UNION SELECT b FROM n UNION SELECT a FROM t UNION SELECT b FROM t) SELECT 'songs' AS name, count(*) AS value FROM versions UNION ALL SELECT 'by_sound', count(*) FROM n UNION ALL SELECT 'more_by_title', count(*) FROM t WHERE (a, b) NOT IN (SELECT (a, b) FROM n) UNION ALL SELECT 'covered', count(*) FROM c""",
)
def cover_report(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs of versions sound alike or share a title and an artist, and how many songs have covers."""
    v = _versions(spark, d)
    return K.cover_report(v, vector_join.near_pairs(v, 0.85), F.col("title"), F.col("artist"))


@query(
    "release_years",
    r"""WITH {tracks}, r AS (SELECT *, CASE ord % 4 WHEN 0 THEN 'uploaded ' || (2001 + ord % 20) || '-05' WHEN 1 THEN '20190304' WHEN 2 THEN '1850' ELSE '' END AS upload_date FROM tracks), y AS (SELECT track_id, TRY_CAST(left(trim(CAST(year AS VARCHAR)), 4) AS INTEGER) AS prefix, TRY_CAST(nullif(regexp_extract(concat_ws(' ', release_date, upload_date), '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:$|[^0-9])', 1), '') AS INTEGER) AS found FROM r)
    SELECT track_id, prefix, found, coalesce(CASE WHEN prefix > 1900 THEN prefix END, CASE WHEN found > 1900 THEN found END) AS year FROM y""",
)
def release_years(spark: SparkSession, d: str) -> DataFrame:
    """The year of each track: the first four digits of one column, else the first year in the text of two others."""
    i = F.col("ord")
    uploaded = F.when(i % 4 == 0, F.concat(F.lit("uploaded "), (2001 + i % 20).cast("string"), F.lit("-05"))).when(i % 4 == 1, "20190304").when(i % 4 == 2, "1850").otherwise("")
    t = tracks(spark, d).withColumn("upload_date", uploaded)
    prefix, found = F.left(F.trim(F.col("year").cast("string")), F.lit(4)).try_cast("int"), T.year(F.concat_ws(" ", "release_date", "upload_date"))
    return t.select("track_id", prefix.alias("prefix"), found.alias("found"), F.coalesce(F.when(prefix > 1900, prefix), found).alias("year"))
