"""The cleaning chain as a whole, from raw rows with every kind of repeat to a report of its stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import text as T
from ..operators import chain, entities, filters
from ..sources.tracks import tracks
from . import quality as Q
from .registry import query

REQUIRED = ["track_id", "track_name", "primary_artist"]
STAGES = ["required", "same_id", "same_name", "same_recording", "duration", *[n for n, _ in Q._ROW_RULES], "blocked_artist", "obscure_artist", "same_after_cleanup", "low_popularity", "low_views", "few_features"]


#: What the first stages need of a track; what the copies change is among it.
EARLY = ["ord", "track_id", "track_name", "primary_artist", "primary_artist_id", "artists", "album_name", "track_duration_ms", "track_popularity", "view_count"]
LYRICS = ("plain_lyrics", "synced_lyrics")


def raw_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The tracks, and copies of some of them: the same id, the same name in capitals, another uploader's, one without a title,
    another spelling of the artist, another name for the artist's id. Only what the first stages need, and ``of``, the ord of the track."""
    c, copied = F.col, {1: (37, ""), 2: (43, "n"), 3: (31, "e"), 4: (47, "b"), 5: (23, "s"), 6: (61, "m")}
    t = tracks(spark, d).select(*EARLY).withColumns({"primary_artist_id": F.when(c("ord") % 29 != 0, F.concat(F.lit("a"), "primary_artist")), "of": c("ord")})
    t = t.withColumn("_copy", F.explode(F.array_compact(F.array(F.lit(0), *[F.when(c("ord") % every == 0, n) for n, (every, _) in copied.items()]))))
    plain = lambda x: F.regexp_replace(x, "Sơn", "Son")

    def made(column: str, **of: Column) -> Column:
        out = c(column)
        for n, value in of.items():
            out = F.when(c("_copy") == int(n[1:]), value).otherwise(out)
        return out

    return t.withColumns({
        "ord": c("ord") + c("_copy").cast("long") * 1_000_000_000,
        "track_id": made("track_id", **{f"_{n}": F.concat("track_id", F.lit(mark)) for n, (_, mark) in copied.items() if mark}),
        "track_popularity": made("track_popularity", _1=c("track_popularity") - 1),
        "view_count": made("view_count", _2=F.coalesce("view_count", F.lit(0)) + 1),
        "track_name": made("track_name", _2=F.upper("track_name"), _4=F.lit(" "), _5=F.concat("track_name", F.lit(" two")), _6=F.concat("track_name", F.lit(" three"))),
        "primary_artist": made("primary_artist", _3=F.lit("Uploader"), _5=plain("primary_artist"), _6=F.concat(F.lit("MC "), "primary_artist")),
        "artists": made("artists", _3=F.concat(F.lit("Uploader, "), "artists"), _5=plain("artists"), _6=F.concat(F.lit("MC "), "artists")),
        "primary_artist_id": made("primary_artist_id", _3=F.lit("aUp"), _5=F.concat(F.lit("a"), plain("primary_artist"))),
    }).drop("_copy")


def with_details(rows: DataFrame, spark: SparkSession, d: str, fits: Column) -> DataFrame:
    """Adds the other columns of the tracks, and instead of the lyrics what they tell: ``sung``, their digest or ``nan``; whether there are
    plain and synced ones; and, where the length ``fits``, what rules by lyrics say. Lyrics are met once, by the track, normalised once,
    and go no further."""
    others = tracks(spark, d).withColumnRenamed("ord", "of").drop(*EARLY).join(rows.select("of"), "of", "left_semi").dropDuplicates(["of"])
    there = {f"has_{c}": F.when(F.trim(c) != "", True) for c in LYRICS}
    met = rows.join(others, "of").withColumns({"_words": entities.words_of(*map(F.col, LYRICS))} | there | {c: F.when(fits, F.col(c)) for c in LYRICS})
    lyrics = entities.long_enough(F.col("_words"))
    return met.withColumns({"sung": F.when(lyrics != "", F.md5(lyrics)).otherwise("nan")} | Q.rules_of_lyrics()).drop(*LYRICS, "_words")


def same_title_and_lyrics(rows: DataFrame) -> DataFrame:
    """Pairs of rows that are one recording by title and lyrics: the decision on tracks whose lyrics' digest is their lyrics' id."""
    none = F.lit(None).cast("string")
    return entities.titled_pairs(rows.select(F.col("ord").alias("id"), "track_name", "artists", none.alias("artist_ids"), "primary_artist", "primary_artist_id", F.lit(None).cast("long").alias("track_duration_ms"), none.alias("plain_lyrics"), none.alias("synced_lyrics"), F.col("sung").alias("lyrics_id")))


def cleaned_raw(spark: SparkSession, d: str) -> DataFrame:
    names, years = Q.names_table(spark), Q.album_years(spark)
    variant = C.variant_release(F.col("track_name"), F.col("album_name"), Q.VARIANT, Q.CONTEXT, Q.TOUR, Q.KEPT)
    raw = raw_tracks(spark, d)
    better = entities.quality_keys(raw, variant, ["has_synced_lyrics", "has_plain_lyrics", "album_id", "track_duration_ms"], Q.SAMPLER, Q.GUESTS)
    short = C.allowed_short(F.col("track_id"), F.col("track_name"), ["5", "6"], ["small ring 2"])
    fits = C.duration_fits(F.col("track_duration_ms"), short)
    hot = F.col("hot_source").isNotNull() | F.coalesce(F.col("view_count") >= 100_000, F.lit(False)) | F.coalesce(F.col("track_popularity") >= 20, F.lit(False))
    popularity = F.when(F.col("rated"), F.coalesce("track_popularity", F.lit(0))).otherwise(F.col("track_popularity"))
    released = F.coalesce(T.year(F.col("year")), T.year(F.col("release_date")))

    def by_artist(df: DataFrame) -> list:
        return [r for r in Q.rules_of_artists() if r[0] in ("blocked_artist", "obscure_artist")]

    def by_count(df: DataFrame) -> list:
        views, charts = F.col("view_count"), F.col("hot_source")
        return [("low_popularity", C.low_popularity(popularity, views, charts)), ("low_views", C.low_views(views, popularity, charts, released)), ("few_features", C.present([F.col(k) for k in ("valence", "energy", "danceability")]) < 2)]

    return chain.clean(
        raw, REQUIRED, variant, lambda df: with_details(df, spark, d, fits), same_title_and_lyrics, better, fits, lambda df: Q.with_flags(df, names).join(years, "album_id", "left"),
        lambda df: Q.rules_of_rows(df, {k: F.col(k) for k in Q.rules_of_lyrics()}),
        lambda df: filters.with_artist_sums(df, F.col("primary_artist"), F.col("track_popularity"), hot), by_artist, by_count,
    )


_BARE = "strip_accents(replace(lower({0}), 'đ', 'd'))"
_WORDS = f"trim(regexp_replace({_BARE}, '[^a-z0-9]+', ' ', 'g'))"
_CANONICAL = _WORDS.format(r"regexp_replace(regexp_replace(lower(track_name), '[\(\[](?:[^\)\]]*[^\p{L}\p{N}_\)\]])?(?:feat|ft|prod|with|w/)[^\)\]]*[\)\]]', ' ', 'g'), '\s(?:feat\.?|ft\.?|prod\.?|w/)\s.*$', ' ')".replace("{L}", "{{L}}").replace("{N}", "{{N}}")).replace("{{", "{").replace("}}", "}")
_SUNG = _WORDS.format("coalesce(nullif(trim(plain_lyrics), ''), nullif(trim(synced_lyrics), ''), '')")
_FIRST_NAME = f"trim(regexp_replace({_BARE}, '\\s+', ' ', 'g'))"
_ORDER = f"({dict(Q._ROW_RULES)['variant']}), coalesce(track_popularity, -1) DESC, coalesce(view_count, -1) DESC, track_popularity DESC NULLS LAST, ord"
_RULE = dict(Q._ARTIST_RULES)
_FILLED = _RULE["low_popularity"].replace("track_popularity", "pop"), _RULE["low_views"].replace("track_popularity", "pop")

_STAGES_SQL = f"""WITH {{tracks}}, c0 AS (SELECT * REPLACE (CASE WHEN ord % 29 <> 0 THEN 'a' || primary_artist END AS primary_artist_id) FROM tracks),
raw AS (SELECT * FROM c0
  UNION ALL SELECT * REPLACE (ord + 1000000000 AS ord, track_popularity - 1 AS track_popularity) FROM c0 WHERE ord % 37 = 0
  UNION ALL SELECT * REPLACE (ord + 2000000000 AS ord, track_id || 'n' AS track_id, upper(track_name) AS track_name, coalesce(view_count, 0) + 1 AS view_count) FROM c0 WHERE ord % 43 = 0
  UNION ALL SELECT * REPLACE (ord + 3000000000 AS ord, track_id || 'e' AS track_id, 'Uploader' AS primary_artist, 'Uploader, ' || artists AS artists, 'aUp' AS primary_artist_id) FROM c0 WHERE ord % 31 = 0
  UNION ALL SELECT * REPLACE (ord + 4000000000 AS ord, track_id || 'b' AS track_id, ' ' AS track_name) FROM c0 WHERE ord % 47 = 0
  UNION ALL SELECT * REPLACE (ord + 5000000000 AS ord, track_id || 's' AS track_id, track_name || ' two' AS track_name, replace(primary_artist, 'Sơn', 'Son') AS primary_artist, replace(artists, 'Sơn', 'Son') AS artists, 'a' || replace(primary_artist, 'Sơn', 'Son') AS primary_artist_id) FROM c0 WHERE ord % 23 = 0
  UNION ALL SELECT * REPLACE (ord + 6000000000 AS ord, track_id || 'm' AS track_id, track_name || ' three' AS track_name, 'MC ' || primary_artist AS primary_artist, 'MC ' || artists AS artists) FROM c0 WHERE ord % 61 = 0),
r1 AS (SELECT *, CASE WHEN {" OR ".join(f"trim(coalesce({c}, '')) = ''" for c in REQUIRED)} THEN 'required' END AS reason FROM raw),
r2 AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, track_id ORDER BY track_popularity DESC NULLS LAST, ord) > 1 THEN 'same_id' ELSE reason END AS reason) FROM r1),
a2 AS MATERIALIZED (SELECT * FROM r2 WHERE reason IS NULL),
nm AS (SELECT primary_artist AS name, trim(coalesce(primary_artist_id, '')) AS id, {_BARE.format('trim(primary_artist)')} AS k, lower(primary_artist) <> {_BARE.format('primary_artist')} AS marked, count(*) AS n FROM a2 GROUP BY ALL),
ks AS (SELECT k, name, marked, sum(n) AS n FROM nm GROUP BY ALL), k1 AS (SELECT k, min(struct_pack(u := NOT marked, m := -n, name := name)).name AS meant FROM ks GROUP BY k HAVING count(*) > 1 AND NOT bool_and(marked)),
k2 AS (SELECT id, min(struct_pack(u := NOT marked, m := -n, name := name)).name AS meant FROM nm WHERE id <> '' GROUP BY id HAVING count(*) > 1 AND NOT (bool_and(marked) AND count(DISTINCT k) = 1)),
chg AS (SELECT name, max_by(meant, id) AS meant FROM (SELECT name, '' AS id, meant FROM ks JOIN k1 USING (k) WHERE name <> meant UNION ALL SELECT name, id, meant FROM nm JOIN k2 USING (id) WHERE name <> meant) GROUP BY name),
a3 AS (SELECT a2.* REPLACE (coalesce(meant, primary_artist) AS primary_artist) FROM a2 LEFT JOIN chg ON name = primary_artist),
ids AS (SELECT primary_artist AS pa, min(struct_pack(m := -n, i := primary_artist_id)).i AS best FROM (SELECT primary_artist, primary_artist_id, count(*) AS n FROM a3 WHERE primary_artist IN (SELECT meant FROM chg) AND primary_artist_id IS NOT NULL GROUP BY ALL) GROUP BY primary_artist),
spl AS (SELECT ord AS o, string_agg(coalesce(meant, x), ', ' ORDER BY pos) AS spelt FROM (SELECT ord, unnest({Q._ARTISTS}) AS x, generate_subscripts({Q._ARTISTS}, 1) AS pos FROM a3) LEFT JOIN chg ON name = x GROUP BY ord),
a4 AS MATERIALIZED (SELECT a3.* REPLACE (coalesce(best, primary_artist_id) AS primary_artist_id, coalesce(spelt, artists) AS artists) FROM a3 LEFT JOIN ids ON pa = primary_artist LEFT JOIN spl ON o = ord),
r3 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN row_number() OVER (PARTITION BY {_FIRST_NAME.format('track_name')}, {_FIRST_NAME.format('primary_artist')} ORDER BY {_ORDER}) > 1 THEN 'same_name' END AS reason) FROM a4),
en AS (SELECT *, {_CANONICAL} AS ct, md5({_SUNG}) AS lm FROM r3 WHERE reason IS NULL AND length({_SUNG}) >= 100 AND {_CANONICAL} <> ''),
grp AS (SELECT *, min(ord) OVER w AS label, count(*) OVER w AS many FROM en WINDOW w AS (PARTITION BY ct, lm)),
win AS (SELECT ord AS wo, label, row_number() OVER (PARTITION BY label ORDER BY {", ".join(f"({x})" for _, x in Q._RANK)}, ord) = 1 AS first FROM grp WHERE many > 1),
crd AS (SELECT label, string_agg(b.x, ', ' ORDER BY b.ord, b.pos) AS merged FROM (SELECT label, {_WORDS.format('x')} AS name, min(struct_pack(ord := ord, pos := pos, x := x)) AS b FROM (SELECT label, ord, unnest({Q._ARTISTS}) AS x, generate_subscripts({Q._ARTISTS}, 1) AS pos FROM grp WHERE many > 1) GROUP BY ALL) GROUP BY label),
r4 AS MATERIALIZED (SELECT r3.* REPLACE (CASE WHEN reason IS NULL AND first = false THEN 'same_recording' ELSE reason END AS reason, CASE WHEN first THEN merged ELSE artists END AS artists) FROM r3 LEFT JOIN win ON wo = ord LEFT JOIN crd USING (label)),
r5 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN reason IS NULL AND NOT (track_duration_ms IS NULL OR track_duration_ms BETWEEN 150000 AND 360000 OR ((track_id IN ('5', '6') OR {Q._norm('track_name')} = 'small ring 2') AND track_duration_ms < 150000)) THEN 'duration' ELSE reason END AS reason) FROM r4),
kept AS MATERIALIZED (SELECT * EXCLUDE (reason) FROM r5 WHERE reason IS NULL), {Q._KINDS.replace("FROM tracks)", "FROM kept)")}, {Q._DISCOVERED.format(of="kept")}, {Q._ALBUM_YEARS},
flagged AS (SELECT * FROM kept LEFT JOIN kinds USING (track_id) JOIN discovered ON a = lower(trim(primary_artist)) LEFT JOIN album_years USING (album_id)),
r6 AS MATERIALIZED (SELECT *, {Q._FIRST} AS reason FROM flagged),
left_ AS (SELECT * EXCLUDE (reason) FROM r6 WHERE reason IS NULL), sums AS (SELECT lower(trim(primary_artist)) AS s, coalesce(max(track_popularity), 0) AS best, bool_or(hot_source IS NOT NULL OR coalesce(view_count >= 100000, false) OR coalesce(track_popularity >= 20, false)) AS hot FROM left_ GROUP BY 1),
l2 AS (SELECT *, (SELECT count(track_popularity) > 0 FROM left_) AS rated FROM left_ JOIN sums ON s = lower(trim(primary_artist))),
r7 AS (SELECT *, CASE WHEN {_RULE["blocked_artist"]} THEN 'blocked_artist' WHEN {_RULE["obscure_artist"]} THEN 'obscure_artist' END AS reason, CASE WHEN rated THEN coalesce(track_popularity, 0) ELSE track_popularity END AS pop, lower(trim(regexp_extract(track_name, '^(.+?)\\s*\\|\\s*(.+)$', 1))) AS prefix FROM l2),
r8 AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND prefix <> '' AND (starts_with(lower(trim(primary_artist)), prefix) OR starts_with(prefix, lower(trim(primary_artist)))) THEN trim(regexp_extract(track_name, '^(.+?)\\s*\\|\\s*(.+)$', 2)) ELSE track_name END AS track_name) FROM r7),
r9 AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, lower(trim(track_name)), lower(trim(primary_artist)) ORDER BY {_ORDER}) > 1 THEN 'same_after_cleanup' ELSE reason END AS reason) FROM r8),
r10 AS (SELECT * REPLACE (coalesce(reason, CASE WHEN {_FILLED[0]} THEN 'low_popularity' WHEN {_FILLED[1]} THEN 'low_views' WHEN {_RULE["few_features"]} THEN 'few_features' END) AS reason) FROM r9),
done AS MATERIALIZED (SELECT ord, track_id, track_name, primary_artist, primary_artist_id, artists, reason FROM r2 WHERE reason IS NOT NULL UNION ALL SELECT ord, track_id, track_name, primary_artist, primary_artist_id, artists, reason FROM r5 WHERE reason IS NOT NULL
  UNION ALL SELECT ord, track_id, track_name, primary_artist, primary_artist_id, artists, reason FROM r6 WHERE reason IS NOT NULL UNION ALL SELECT ord, track_id, track_name, primary_artist, primary_artist_id, artists, reason FROM r10)"""


@query("cleaning_chain", f"{_STAGES_SQL} SELECT * FROM done")
def cleaning_chain(spark: SparkSession, d: str) -> DataFrame:
    """What drops each raw row, as the first stage that does, and what the rows that live on look like."""
    return cleaned_raw(spark, d).select("ord", "track_id", "track_name", "primary_artist", "primary_artist_id", "artists", "reason")


@query(
    "cleaning_report",
    f"""{_STAGES_SQL}, st(place, stage) AS (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(STAGES, 1))}), n AS (SELECT reason, count(*) AS n FROM done GROUP BY reason)
    SELECT place, stage, coalesce(n, 0) AS removed, CAST((SELECT count(*) FROM done) - sum(coalesce(n, 0)) OVER (ORDER BY place) AS BIGINT) AS remaining FROM st LEFT JOIN n ON reason = stage""",
)
def cleaning_report(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each stage drops and leaves."""
    return chain.report(cleaned_raw(spark, d), STAGES)
