"""Play queues, caches, transitions, loads into versioned tables, and work that is taken up again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy, shaping
from ..functions import text as T
from ..operators import crossfade, ranks, retrieval
from ..sources.shared import scratch
from ..sources.tracks import tracks
from ..sources.versions import VersionedTable, WorkLog
from ..streaming import radio
from .evaluation import _TOP, _recs
from .experiments import _JACCARD, _jaccard, _listed, _sure
from .registry import query, songs, table
from .similarity import seeds_of


@query(
    "radio_queue",
    """WITH {songs}, e AS (SELECT user_id AS session, event_id, user_id % 40 + 1 AS seed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
    p AS (SELECT q.song_idx AS seed, s.song_idx, row_number() OVER (PARTITION BY q.song_idx ORDER BY round_even(list_cosine_similarity(q.audio_vec, s.audio_vec) * 1e6, 0) DESC, s.song_idx) AS r FROM songs q JOIN songs s ON q.song_idx BETWEEN 1 AND 40 AND q.song_idx <> s.song_idx QUALIFY r <= 134),
    c AS (SELECT seed, count(*) AS most FROM p GROUP BY seed)
    SELECT e.session, e.event_id, CASE WHEN n = 0 THEN e.seed ELSE p.song_idx END AS song_idx, CAST(CASE WHEN n = 0 THEN least(14, most) WHEN (n - 12) % 14 = 0 THEN greatest(least(14, most - (n + 2)), 0) ELSE 0 END AS INTEGER) AS added FROM e JOIN c USING (seed) LEFT JOIN p ON p.seed = e.seed AND p.r = n""",
)
def radio_queue(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as songs of an endless queue that grows from a seed's nearest songs."""
    s, e = songs(spark, d), table(spark, d, "events")
    pools = retrieval.nearest(s, s.where("song_idx BETWEEN 1 AND 40"), radio.POOL).groupBy(F.col("query_id").alias("seed")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "song_idx"))), lambda x: x["song_idx"]).alias("pool"))
    first = e.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("user_id", F.col("f.event_id").alias("event_id"), (F.col("user_id") % 40 + 1).alias("seed")).join(pools, "seed")
    events = e.select("user_id", "event_id", "ts").join(first.select("user_id", "event_id", "pool"), ["user_id", "event_id"], "left")
    asked = events.select(F.col("user_id").alias("session"), "event_id", "ts", (F.col("user_id") % 40 + 1).alias("seed"), "pool")
    return radio.played(asked).select("session", "event_id", "song_idx", "added")


@query(
    "cached_requests",
    """WITH RECURSIVE e AS (SELECT event_type || '/' || user_id % 3 AS key, event_id, epoch_us(ts) AS t, 1000000::BIGINT * CASE event_type WHEN 'view' THEN 1800 WHEN 'click' THEN 3000 WHEN 'error' THEN 6000 ELSE 36000 END AS ttl, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT key, event_id, n, t AS made, false AS hit FROM e WHERE n = 1 UNION ALL SELECT e.key, e.event_id, e.n, CASE WHEN e.t < r.made + e.ttl THEN r.made ELSE e.t END, e.t < r.made + e.ttl FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
    SELECT key, event_id, hit, made AS made_us FROM r""",
)
def cached_requests(spark: SparkSession, d: str) -> DataFrame:
    """Which requests find a value in a cache with a time to live for each kind of them."""
    ttl = F.when(F.col("event_type") == "view", 1800).when(F.col("event_type") == "click", 3000).when(F.col("event_type") == "error", 6000).otherwise(36000)
    e = table(spark, d, "events").select(F.concat_ws("/", "event_type", (F.col("user_id") % 3).cast("string")).alias("key"), "event_id", "ts", ttl.alias("ttl_s"))
    return radio.cached(e).select("key", "event_id", "hit", F.unix_micros(F.col("made_at").cast("timestamp")).alias("made_us"))


def cued_songs(spark: SparkSession, d: str) -> DataFrame:
    """Songs with the cues that a transition looks at, some of them missing."""
    c, i = F.col, F.col("song_idx")
    length = 150 + c("size")
    return songs(spark, d).select(
        "artist", "song_idx", c("bpm").alias("tempo"), c("arousal").alias("energy"), length.cast("double").alias("duration_s"), F.when((c("valence") >= 0.5) & (c("arousal") >= 0.5), 1).when(c("arousal") >= 0.5, 2).when(c("valence") < 0.5, 3).otherwise(4).alias("quadrant"),
        (c("size") % 12).alias("key"), (c("label") % 2).alias("mode"), (c("popularity") / 100 - 26).alias("lufs"), F.when(i % 4 > 0, i % 17 * 1.5).alias("vocal_start_s"), F.when(i % 5 > 0, (length - i % 9).cast("double")).alias("vocal_end_s"),
        (i % 6 * 0.7).alias("fade_in_cue_s"), F.when(i % 2 == 0, length - 12.5).alias("fade_out_cue_s"),
    )


_FIT = """CASE WHEN abs(a.tempo - b.tempo) / greatest(a.tempo, 1) > 0.12 OR abs(a.energy - b.energy) > 0.45 THEN 4.0 WHEN m >= 1 AND abs(a.tempo - b.tempo) / greatest(a.tempo, 1) < 0.06 AND k >= 0.8 THEN 11.0
  WHEN (m >= 0.5 AND abs(a.tempo - b.tempo) / greatest(a.tempo, 1) < 0.07 AND k >= 0.7) OR (a.energy > 0.7 AND b.energy > 0.7) THEN 9.0 WHEN m = 0 THEN 5.0 ELSE 7.0 END::DOUBLE"""


@query(
    "crossfade_transitions",
    f"""WITH {{songs}}, c AS (SELECT artist, song_idx, bpm::DOUBLE AS tempo, arousal::DOUBLE AS energy, (150 + size)::DOUBLE AS len, CASE WHEN valence >= 0.5 AND arousal >= 0.5 THEN 1 WHEN arousal >= 0.5 THEN 2 WHEN valence < 0.5 THEN 3 ELSE 4 END AS quad, size % 12 AS key, label % 2 AS mode, popularity / 100 - 26 AS lufs,
      CASE WHEN song_idx % 4 > 0 THEN song_idx % 17 * 1.5::DOUBLE END AS vs, CASE WHEN song_idx % 5 > 0 THEN (150 + size - song_idx % 9)::DOUBLE END AS ve, song_idx % 6 * 0.7::DOUBLE AS ci, CASE WHEN song_idx % 2 = 0 THEN (150 + size - 12.5)::DOUBLE END AS co FROM songs),
    beats AS (SELECT song_idx, 0.3::DOUBLE + i * (240 / tempo) AS t FROM c, range(0, 120) r(i) WHERE song_idx % 7 > 0 AND 0.3::DOUBLE + i * (240 / tempo) < len),
    n AS (SELECT *, lead(song_idx) OVER (PARTITION BY artist ORDER BY song_idx) AS nxt, CASE WHEN mode = 1 THEN key * 7 + 7 ELSE key * 7 + 4 END % 12 AS hour FROM c),
    f AS (SELECT a, b, a.artist, [1.0, 0.5, 0.0, 0.5][(a.quad - b.quad + 4) % 4 + 1]::DOUBLE AS m, CASE WHEN a.hour = b.hour THEN CASE WHEN a.mode = b.mode THEN 1.0 ELSE 0.8 END WHEN a.mode = b.mode AND (a.hour - b.hour + 12) % 12 IN (1, 11) THEN 0.7 ELSE 0.4 END::DOUBLE AS k FROM n a JOIN n b ON b.song_idx = a.nxt),
    w AS (SELECT *, {_FIT} AS wanted FROM f),
    o AS (SELECT *, a.song_idx AS ai, b.song_idx AS bi, coalesce(a.ve, a.co, greatest(0, a.len - wanted - 5)) AS out_, greatest(0, b.vs - greatest(2.5::DOUBLE, least(6, 480 / greatest(60, least(200, b.tempo))))) AS in_ FROM w),
    o1 AS (SELECT o.*, x.t AS oa FROM o ASOF LEFT JOIN beats x ON x.song_idx = o.ai AND o.out_ <= x.t),
    o2 AS (SELECT o1.*, x.t AS ob FROM o1 ASOF LEFT JOIN beats x ON x.song_idx = o1.ai AND o1.out_ >= x.t),
    i1 AS (SELECT o2.*, x.t AS ia FROM o2 ASOF LEFT JOIN beats x ON x.song_idx = o2.bi AND o2.in_ <= x.t),
    i2 AS (SELECT i1.*, x.t AS ib FROM i1 ASOF LEFT JOIN beats x ON x.song_idx = i1.bi AND i1.in_ >= x.t),
    s AS (SELECT *, greatest(out_, least(coalesce(oa, ob, out_), greatest(0, a.len - 0.2::DOUBLE))) AS leaves, CASE WHEN b.vs IS NOT NULL THEN least(greatest(0, coalesce(CASE WHEN ia IS NULL OR in_ - ib <= ia - in_ THEN ib END, ia, in_)), greatest(0, b.vs - 0.4::DOUBLE)) ELSE CASE WHEN b.ci <= 2 THEN b.ci ELSE 0 END END AS enters FROM i2),
    l AS (SELECT *, a.len - leaves < 3.4 AS hold, greatest(3, least(wanted, CASE WHEN a.len - leaves < 3.4 THEN 12 ELSE a.len - leaves END, 12)) AS ov, abs(a.tempo - b.tempo) / greatest(a.tempo, 1) AS dt FROM s)
    SELECT artist, ai AS a_song_idx, bi AS b_song_idx, round(ov, 6) AS overlap_s, round(leaves, 6) AS fade_out_at_s, round(enters, 6) AS fade_in_at_s, round(CASE WHEN b.vs IS NULL THEN ov ELSE greatest(0.5::DOUBLE, least(ov, b.vs - enters - 0.4::DOUBLE)) END, 6) AS fade_in_s,
      round(least(1, greatest(0, 0.5::DOUBLE * least(pow(10, 0.6::DOUBLE), pow(10, (-14 - a.lufs) / 20)))), 6) AS gain_a, round(least(1, greatest(0, 0.5::DOUBLE * least(pow(10, 0.6::DOUBLE), pow(10, (-14 - b.lufs) / 20)))), 6) AS gain_b,
      CASE WHEN m >= 1 AND dt < 0.03 AND k = 1 THEN 'linear' ELSE 'equal-power' END AS curve, hold, round(CASE WHEN dt <= 0.06 THEN greatest(0.94::DOUBLE, least(1.06::DOUBLE, a.tempo / b.tempo)) ELSE 1 END, 6) AS rate, ov >= 6 AND k >= 0.7 AS bass_swap FROM l""",
)
def crossfade_transitions(spark: SparkSession, d: str) -> DataFrame:
    """The whole plan of each transition of an artist's songs: cues meet the downbeats as of their time."""
    s = cued_songs(spark, d)
    step = 240 / F.col("tempo")
    beats = s.where("song_idx % 7 > 0").select("song_idx", "duration_s", F.explode(F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: 0.3 + i * step)).alias("beat")).where("beat < duration_s")
    plan = crossfade.planned(crossfade.neighbours(s, "artist", ["song_idx"]), beats, ["artist"], volume=0.5)
    return plan.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in plan.dtypes])


@query(
    "versioned_rows",
    """WITH u AS (SELECT p_partkey + CASE WHEN p_partkey % 9 = 0 THEN 1000000 ELSE 0 END AS id, CASE WHEN p_partkey % 2 = 0 THEN 'new ' || p_name END AS name, p_size + 1000 AS size FROM part WHERE p_partkey % 3 = 0),
    t AS (SELECT coalesce(u.id, p.p_partkey) AS id, coalesce(u.name, p.p_name) AS name, coalesce(u.size, p.p_size) AS size FROM part p FULL JOIN u ON u.id = p.p_partkey)
    SELECT id, name, size FROM t UNION ALL SELECT p_partkey + 999991, 'late', p_size FROM part WHERE p_partkey + 999991 NOT IN (SELECT id FROM t)""",
)
def versioned_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table in its third version: as loaded, with some rows replaced and added, and with those that weren't there yet."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    t = VersionedTable(spark, scratch(spark, "versioned"), ["id"], buckets=16)
    t.replace(p)
    new = p.where("id % 3 = 0")
    t.upsert(new.select((F.col("id") + F.when(F.col("id") % 9 == 0, 1_000_000).otherwise(0)).alias("id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("new "), "name")).alias("name"), (F.col("size") + 1000).alias("size")))
    t.insert_new(p.select((F.col("id") + 999_991).alias("id"), F.lit("late").alias("name"), "size"))
    return t.read()


@query(
    "song_defaults",
    """WITH {tracks}, t AS (SELECT *, coalesce(CASE WHEN ord % 4 > 0 THEN danceability END, energy, 0.5) AS a, CASE WHEN valence = 0 THEN 0.5 ELSE valence END AS v, CASE ord % 5 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Q2: Angry/Tense' END AS q, CASE WHEN ord % 3 = 0 THEN 'http://t/' || track_id WHEN ord % 3 = 1 THEN '' END AS image FROM tracks)
    SELECT track_id, album_id, primary_artist_id, coalesce(track_popularity, 0) AS popularity, false AS explicit, a AS arousal, '#6366f1' AS color_hex,
      CASE WHEN q <> 'Unknown' THEN q WHEN v >= 0.5 AND a >= 0.5 THEN 'Q1: Happy/Excited' WHEN v < 0.5 AND a >= 0.5 THEN 'Q2: Angry/Tense' WHEN v < 0.5 AND a < 0.5 THEN 'Q3: Sad/Melancholic' ELSE 'Q4: Calm/Peaceful' END AS mood_quadrant,
      instrumental, false AS has_lyrics, nullif(image, '') AS image, coalesce(image <> '', false) AS has_art, ord % 2 = 0 AS has_audio, CASE WHEN ord % 2 = 0 THEN track_id || '.mp3' END AS audio_file FROM t""",
)
def song_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Tracks as they are loaded, with defaults for what is missing."""
    t, i = tracks(spark, d), F.col("ord")
    rows = t.withColumns({"arousal": F.when(i % 4 > 0, F.col("danceability")), "mood_quadrant": F.when(i % 5 == 0, "Unknown").when(i % 5 == 1, "Q2: Angry/Tense"), "thumbnail_url": F.when(i % 3 == 0, F.concat(F.lit("http://t/"), "track_id")).when(i % 3 == 1, "")})
    return shaping.defaulted(rows, t.where("ord % 2 = 0"))


@query("resumed_work", "SELECT doc_id, length(text) AS letters FROM documents")
def resumed_work(spark: SparkSession, d: str) -> DataFrame:
    """The results of work in batches that stopped after the first of them and was taken up again."""
    docs = table(spark, d, "documents")
    log = WorkLog(spark, scratch(spark, "work"), "doc_id")
    work = lambda df: df.select("doc_id", F.length("text").cast("long").alias("letters"))
    log.run(docs, work, every=max(100, docs.count() // 4), limit=1)
    log.run(docs, work, every=max(100, docs.count() // 2))
    return log.results()


@query("popularity_proxy", "WITH {songs}, f AS (SELECT artist, count(*) AS n FROM songs GROUP BY artist) SELECT song_idx, round(n / (SELECT max(n) FROM f)::DOUBLE, 6) AS popularity FROM songs JOIN f USING (artist)")
def popularity_proxy(spark: SparkSession, d: str) -> DataFrame:
    """A song's artist's songs, over the most that an artist has."""
    s = songs(spark, d).select("song_idx", "artist")
    counts = s.groupBy("artist").agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return s.join(counts.join(F.broadcast(most)), "artist").select("song_idx", F.round(F.col("n") / F.col("most"), 6).alias("popularity"))


@query(
    "proportional_sample",
    """WITH e AS (SELECT event_id, event_type, md5('42/' || event_id) AS h FROM events WHERE event_type <> 'view' OR event_id % 50 = 0), q AS (SELECT event_type, count(*) AS n, least(count(*), greatest(1, round_even(100 * count(*) / (SELECT count(*) FROM e)::DOUBLE, 0))) AS quota FROM e GROUP BY event_type),
    s AS (SELECT event_id, event_type, h, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) <= quota AS chosen FROM e JOIN q USING (event_type))
    SELECT event_id, event_type FROM s ORDER BY chosen DESC, h, event_id LIMIT 100""",
)
def proportional_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred events, from each type in proportion to how many it has, one at least."""
    return ranks.stratified(table(spark, d, "events").select("event_id", "event_type").where("event_type != 'view' OR event_id % 50 = 0"), "event_type", "event_id", 100)


_UNIT = "(('0x' || left(md5('{0}/' || song_idx || '/' || dim), 8))::BIGINT + 0.5::DOUBLE) / 4294967296"


def gaussian(key: Column, dim: Column) -> Column:
    """A number of the standard normal distribution that follows from a key and a place (Box and Muller, of two digests)."""
    unit = lambda s: (F.conv(F.left(F.md5(F.concat_ws("/", F.lit(s), key.cast("string"), dim.cast("string"))), F.lit(8)), 16, 10).cast("double") + 0.5) / 4294967296
    return F.sqrt(-2 * F.log(unit("a"))) * F.cos(2 * F.pi() * unit("b"))


@query(
    "noisy_consistency",
    f"""WITH {_TOP}, a AS (SELECT query_id, list(song_idx) AS l FROM recs GROUP BY query_id),
    u AS (SELECT song_idx, unnest(audio_vec) AS x, generate_subscripts(audio_vec, 1) AS dim FROM seeds), g AS (SELECT song_idx, list(x + 0.02::DOUBLE * sqrt(-2 * ln({_UNIT.format('a')})) * cos(2 * pi() * {_UNIT.format('b')}) ORDER BY dim) AS v FROM u GROUP BY song_idx),
    o AS (SELECT s.* REPLACE (g.v AS audio_vec) FROM seeds s JOIN g USING (song_idx)), r AS (SELECT query_id, list(song_idx) AS m FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_idx) AS n FROM ({_sure('o')}) WHERE score >= 0.3) WHERE n <= 10 GROUP BY query_id)
    SELECT query_id, round({_JACCARD.format('l', 'm')}, 6) AS overlap FROM a JOIN r USING (query_id)""",
)
def noisy_consistency(spark: SparkSession, d: str) -> DataFrame:
    """How much of a list stays under Gaussian noise on each component of its seed's audio."""
    s, recs = _recs(spark, d)
    noisy = seeds_of(s).withColumn("audio_vec", F.transform("audio_vec", lambda x, i: x + 0.02 * gaussian(F.col("song_idx"), i + 1)))
    return _listed(recs, "l").join(_listed(retrieval.similar_songs(s, noisy, 10), "m"), "query_id").select("query_id", F.round(_jaccard("l", "m"), 6).alias("overlap"))


_HIT = r"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(replace(lower({0}), 'đ', 'd')), '[\(\[][^\)\]]*[\)\]]', ' ', 'g'), '(^|[^\p{{L}}\p{{N}}_])(feat|ft|featuring)($|[^\p{{L}}\p{{N}}_]).*$', ' '), '[^a-z0-9]+', ' ', 'g'))"


@query("hit_texts", f"WITH {{tracks}} SELECT track_id, {_HIT.format('track_name')} AS title, {_HIT.format('artists')} AS artist, trim(regexp_replace(regexp_replace(lower(strip_accents(track_name)), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS compared FROM tracks WHERE NOT regexp_matches(track_name, '[đĐЀ-ӿ]')")
def hit_texts(spark: SparkSession, d: str) -> DataFrame:
    """Titles and credits as lyrics searches and playlists compare them."""
    t = tracks(spark, d).where(~F.col("track_name").rlike("[đĐЀ-ӿ]"))
    return t.select("track_id", T.hit_text(F.col("track_name")).alias("title"), T.hit_text(F.col("artists")).alias("artist"), T.compared_text(F.col("track_name")).alias("compared"))


@query("lyrics_hits")
def lyrics_hits(spark: SparkSession, d: str) -> DataFrame:
    """Which tracks would be taken for the one before them by a lyrics search."""
    t = tracks(spark, d).select("ord", "track_id", "track_name", "artists")
    before = t.select((F.col("ord") + 20).alias("ord"), F.col("track_id").alias("found_id"), F.col("track_name").alias("found_name"), F.col("artists").alias("found_artists"))
    ratio = lambda a, b: fuzzy.sequence_ratio(a, b, 0.90)
    return t.join(before, "ord").select("track_id", "found_id", T.is_hit(F.col("track_name"), F.col("artists"), F.col("found_name"), F.col("found_artists"), ratio).alias("hit"))
