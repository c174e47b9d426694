"""The cleaning chain over raw tracks, step by step, and its gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import predicates as P
from ..functions import text as T
from ..operators import catalogue as K
from ..operators import entities, filters
from ..sources.shared import dealt, stored
from ..sources.tracks import tracks
from .registry import query

# Lists and patterns of these queries: invented, as are the tracks. A user's own lists are tables or parameters.
NAMES = [("Brand#3", "known"), ("sơn brand#7", "known"), ("BRAND #5", "known"), ("Brand#9", "current"), ("brand#11", "old"), ("Brand#9", "old"), ("brand#13", "channel"), ("Brand#20", "foreign"), ("Brand#21", "blocked"), ("Brand#9", "blocked")]
UNIQUE = "ăđơưắằẳẵặấầẩẫậếềểễệốồổỗộớờởỡợứừửữự"
MARKS = UNIQUE + "âêôàáảãạèéẻẽẹìíỉĩịòóỏõọùúủũụỳýỷỹỵ"
SHARED = "âêôàáèéìíòóùúýãõ"
LANG = C.Language(
    unique=f"[{UNIQUE}]", own=f"[{UNIQUE}âêô]", accents=f"[{MARKS}]", unshared=f"[{''.join(c for c in MARKS if c not in SHARED)}]", other="[äöüßøåæçñ]", scripts="[Ѐ-ӿ぀-ヿ㐀-鿿가-힯]",
    words=P.edged(r"\b(?:la|mot|cua|khong)\b"), lookalike="đ", lookalike_words=P.edged(r"\b(?:moja|ljubav)\b"), garbage=r"^\d{4}-\d{2}-\d{2}$|^[\d.,]+$",
)
WORDS, PLAIN = ["mưa", "đêm"], ["khong", "cua"]
KIDS, CHANNEL, OLD, VARIANT, CONTEXT, TOUR, KEPT = map(P.edged, (r"(?i)\bnursery\b|\bfor kids\b", r"(?i)\bchannel$|\btv\b", r"\bbolero\b|\bold ballads\b", r"(?i)\((?:live|cover)\b", r"(?i)\bremix\b", r"(?i)\btour(?:\s+\d{4})?\b", r"(?i)\bworld tour\b"))
TRACKS_OF, SCORE, DJ = map(P.edged, (r"(?i)\bost\b|\bsoundtrack\b", r"(?i)\bscore\b", r"^(?:DJ|MC)\s+[A-Z]"))
SEASON = {k: P.edged(v) for k, v in {"strong": r"\bchristmas\b", "album_strong": r"\bsongs for winter\b", "marker": r"\bthe\b", "context": r"\bwinter\b", "weak": r"\bspringtime\b", "hint": r"\bstandard\b|\bpromo\b", "lyrics_strong": r"\bnew year\b", "exception": r"\barena\b"}.items()}
SAMPLER, GUESTS = map(P.edged, (r"\b(?:sampler|promo|economy)\b", r"(?i)\b(?:feat|guest)\b"))
RUDE, HARD, MILD = map(P.edged, (r"(?i)\bdamn\b", r"(?i)\bthest\b", r"(?i)\bes\b"))

_ARTISTS = "list_filter(list_transform(string_split(artists, ','), lambda x: trim(x)), lambda x: x <> '')"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(replace(lower(coalesce({x}, '')), 'đ', 'd')), '[^a-z0-9]+', ' ', 'g'))"


def _sql(pattern: str) -> str:
    """DuckDB's patterns can't look around: the edge of a word is a character of no word, which they take, or an end."""
    return pattern.replace(P.EDGE, r"(?:^|$|[^\p{L}\p{N}_])")


def _rx(x: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), '{_sql(pattern)}')"


def _n(x: str, pattern: str) -> str:
    """How often; as edges are taken, characters between words are doubled, one for each of two neighbours."""
    text = rf"regexp_replace(coalesce({x}, ''), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')" if P.EDGE in pattern else f"coalesce({x}, '')"
    return f"len(regexp_extract_all({text}, '{_sql(pattern)}'))"


def _evidence(x: str) -> str:
    return f"({_rx(f'lower({x})', LANG.unique)} OR list_has_any(string_split_regex(lower(coalesce({x}, '')), '\\s+'), {WORDS}) OR list_has_any(string_split({_norm(x)}, ' '), {PLAIN}))"


def evidence(text: Column) -> Column:
    return C.local_evidence(F.lower(text), LANG.unique, WORDS, PLAIN)


def names_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAMES, "name string, kind string")


_KEY = "CASE WHEN kind IN ('current', 'old', 'channel', 'blocked') THEN '~' || strip_accents(replace(lower(trim(name)), 'đ', 'd')) ELSE '=' || regexp_replace(lower(trim(name)), '[\\s-]+', '', 'g') END"
_KINDS = f"""names(name, kind) AS (VALUES {", ".join(f"('{n}', '{k}')" for n, k in NAMES)}), listed AS (SELECT DISTINCT kind, {_KEY} AS k FROM names),
credits AS (SELECT track_id, unnest({_ARTISTS}) AS name, generate_subscripts({_ARTISTS}, 1) AS pos FROM tracks),
told AS (SELECT DISTINCT track_id, pos, name, kind FROM credits JOIN listed ON k = '=' || regexp_replace(lower(trim(name)), '[\\s-]+', '', 'g') OR k = '~' || strip_accents(replace(lower(trim(name)), 'đ', 'd'))),
kinds AS (SELECT track_id, list(DISTINCT kind) AS kinds, list(DISTINCT kind) FILTER (pos = 1) AS primary_kinds,
  bool_or(kind = 'old' AND NOT EXISTS (SELECT 1 FROM told u WHERE u.track_id = told.track_id AND u.pos = told.pos AND u.kind = 'current')) AS old FROM told GROUP BY track_id)"""
_HAS = lambda kind, of="kinds": f"coalesce(list_contains({of}, '{kind}'), false)"
_FOREIGN = f"({_HAS('foreign')} OR len(list_filter({_ARTISTS}, lambda x: {_rx('x', DJ)} AND NOT {_rx('lower(x)', LANG.unique)})) > 0)"


def flags(df: DataFrame) -> dict[str, Column]:
    """The flags of ``language_decision`` from what ``with_kinds`` and ``with_discovered`` have added."""
    dj = F.exists("credits", lambda x: x.rlike(DJ) & ~F.lower(x).rlike(LANG.unique))
    return {"old": filters.blocked_name(F.col("by_artist"), "old", "current"), "known": F.array_contains("kinds", "known"), "foreign": F.array_contains("kinds", "foreign") | dj, "discovered": F.col("discovered")}


def with_flags(df: DataFrame, names: DataFrame) -> DataFrame:
    found = filters.with_discovered(df, F.col("primary_artist"), F.lower("track_name").rlike(LANG.own))
    return filters.with_kinds(found.withColumn("credits", T.artists(F.col("artists"))), "track_id", F.col("credits"), names)


_WHOLE, _RELEASE = f"lower(concat_ws(' ', track_name, array_to_string({_ARTISTS}, ' '), album_name))", "lower(concat_ws(' ', track_name, album_name))"
_PRIMARY = f"lower(coalesce(({_ARTISTS})[1], ''))"
_OWN_MARKS = _rx(_WHOLE, LANG.unshared)
_DECISIONS = [
    ("coalesce(old, false)", False, "old_genre"),
    (f"{_HAS('known')} AND (NOT (length({_PRIMARY}) <= 5 AND NOT {_rx(_PRIMARY, '[^\\x00-\\x7F]')}) OR {_rx(_RELEASE, LANG.own)} OR {_rx(_RELEASE, LANG.words)} OR {_rx(_RELEASE, LANG.accents)})", True, "known_artist"),
    (_FOREIGN, False, "foreign_artist"),
    (f"len(list_filter({_ARTISTS}, lambda x: {_rx('x', LANG.garbage)})) > 0", False, "garbage_name"),
    (f"{_n(_WHOLE, LANG.scripts)} >= 2 AND NOT {_rx(_WHOLE, LANG.unique)}", False, "foreign_script"),
    (f"{_rx(_WHOLE, LANG.other)} AND NOT {_rx(_WHOLE, LANG.unique)}", False, "other_accents"),
    (f"{_rx(_WHOLE, LANG.unique)} AND NOT {_rx(f'''replace({_WHOLE}, 'đ', '')''', LANG.unique)} AND {_rx(_WHOLE, LANG.lookalike_words)}", False, "lookalike_language"),
    (_rx(_WHOLE, LANG.unique), True, "own_letters"),
    (f"{_rx(_WHOLE, LANG.own)} AND {_rx(_WHOLE, LANG.words)}", True, "own_letters_and_words"),
    ("discovered", True, "discovered_artist"),
    (f"{_n(_WHOLE, LANG.accents)} >= 3 AND NOT {_rx(_WHOLE, LANG.other)} AND {_OWN_MARKS}", True, "many_accents"),
    (f"{_rx('lower(track_name)', LANG.words)} AND ({_n(_WHOLE, LANG.words)} >= 2 OR ({_n(_WHOLE, LANG.accents)} >= 1 AND {_OWN_MARKS}))", True, "common_words"),
    (f"lyrics_lang = 'de' AND NOT {_rx(_WHOLE, LANG.other)} AND {_OWN_MARKS}", True, "detected"),
    (f"length(trim(track_name)) >= 10 AND lyrics_lang = 'es' AND {_rx('lower(track_name)', LANG.words)} AND NOT {_rx(_WHOLE, LANG.other)}", True, "detected_title"),
]
_LOCAL = "CASE " + " ".join(f"WHEN {c} THEN {str(v).lower()}" for c, v, _ in _DECISIONS) + " ELSE false END"
_WHY = "CASE " + " ".join(f"WHEN {c} THEN '{w}'" for c, _, w in _DECISIONS) + " ELSE 'no_evidence' END"
_DISCOVERED = f"discovered AS (SELECT lower(trim(primary_artist)) AS a, count(*) FILTER ({_rx('lower(track_name)', LANG.own)}) >= 3 AS discovered FROM {{of}} GROUP BY 1)"


def decision(df: DataFrame) -> Column:
    is_lang = lambda k: F.coalesce(F.col("lyrics_lang") == k, F.lit(False))
    return C.language_decision(F.col("track_name"), F.col("credits"), F.col("album_name"), flags(df), is_lang("de"), is_lang("es"), LANG)


@query("track_language", f"WITH {{tracks}}, {_KINDS}, {_DISCOVERED.format(of='tracks')} SELECT t.track_id, {_LOCAL} AS local, {_WHY} AS reason FROM tracks t LEFT JOIN kinds USING (track_id) JOIN discovered ON a = lower(trim(primary_artist))")
def track_language(spark: SparkSession, d: str) -> DataFrame:
    """Is each track in the catalogue's language, and by which of the ordered rules?"""
    rows = with_flags(tracks(spark, d), names_table(spark))
    return rows.select("track_id", decision(rows).alias("d")).select("track_id", "d.local", "d.reason")


@query("artist_kinds", f"WITH {{tracks}}, {_KINDS} SELECT track_id, array_to_string(list_sort(kinds), ',') AS kinds, coalesce(array_to_string(list_sort(primary_kinds), ','), '') AS primary_kinds FROM kinds")
def artist_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The lists on which a track's artists stand."""
    rows = filters.with_kinds(tracks(spark, d).select("track_id", "artists"), "track_id", T.artists(F.col("artists")), names_table(spark))
    return rows.where(F.size("kinds") > 0).select("track_id", F.array_join("kinds", ",").alias("kinds"), F.array_join("primary_kinds", ",").alias("primary_kinds"))


AUDIT = C.Audited(wrong_ids=("77", "78"), legacy_artists=("aBrand#1",), composers=("aBrand#2",), legacy_albums=(("aBrand#4", "winter songs"),), fragment=P.edged(r"(?i)\bnursery\b"))
_AUDIO = {"actual_s": "actual_s", "instrumental": "instrumental_probability", "voice": "voice_probability", "singing": "singing_mean", "speech": "speech_mean", "music": "music_mean", "speech_share": "speech_share", "low_music": "low_music"}
_AUDIT = f"""CASE WHEN track_id IN ('77', '78') THEN 'verified_wrong_content' WHEN primary_artist_id = 'aBrand#1' THEN 'legacy_artist_identity' WHEN primary_artist_id = 'aBrand#2' THEN 'soundtrack_score_catalog'
  WHEN primary_artist_id = 'aBrand#4' AND {_norm('album_name')} = 'winter songs' THEN 'legacy_release'
  WHEN {_rx("concat_ws(' ', track_name, album_name)", AUDIT.programme)} OR ({_rx("concat_ws(' ', track_name, album_name)", AUDIT.fragment)} AND (track_duration_ms IS NULL OR track_duration_ms < 180000)) THEN 'fragment_or_program_excerpt'
  WHEN actual_s > 360 THEN 'actual_duration_out_of_range' WHEN instrumental_probability >= 0.82 OR (instrumental_probability >= 0.70 AND singing_mean < 0.018) THEN 'instrumental_audio'
  WHEN (speech_share >= 0.30 AND (singing_mean IS NULL OR singing_mean < 0.04)) OR (speech_mean >= 0.18 AND (music_mean IS NULL OR speech_mean > 0.30::DOUBLE * music_mean)) THEN 'spoken_audio'
  WHEN low_music >= 0.55 AND (voice_probability IS NULL OR voice_probability < 0.65) THEN 'non_music_audio' END"""


def audit(df: DataFrame) -> Column:
    return C.audit_reason(F.col("track_id"), F.col("primary_artist_id"), F.col("track_name"), F.col("album_name"), F.col("track_duration_ms") / 1000, {k: F.col(v) for k, v in _AUDIO.items()}, AUDIT)


@query("audit_reasons", f"WITH {{tracks}} SELECT track_id, {_AUDIT} AS reason FROM tracks")
def audit_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a recording is rejected by what is known of it and by its audio, as the first of nine rules."""
    rows = tracks(spark, d)
    return rows.select("track_id", audit(rows).alias("reason"))


_YEAR = "coalesce(nullif(TRY_CAST(left(trim(CAST(year AS VARCHAR)), 4) AS INTEGER), 0), nullif(TRY_CAST(left(trim(release_date), 4) AS INTEGER), 0), album_year)"
_ALBUM_YEARS = "album_years AS (SELECT CAST(i AS VARCHAR) AS album_id, CAST(1990 + i AS INTEGER) AS album_year FROM range(0, 40, 3) t(i))"


def album_years(spark: SparkSession) -> DataFrame:
    return spark.range(0, 40, 3).select(F.col("id").cast("string").alias("album_id"), (F.col("id") + 1990).cast("int").alias("album_year"))


def rules_of_lyrics() -> dict[str, Column]:
    """What rules by row ask of a track's lyrics; nothing else of these is needed."""
    c, lyrics = F.col, F.coalesce(F.nullif(F.trim("plain_lyrics"), F.lit("")), F.col("synced_lyrics"))
    foreign = C.foreign_lyrics(lyrics, c("lyrics_lang"), c("lyrics_probability"), c("local_probability"), "de")
    return {"season": C.seasonal_release(c("track_name"), c("album_name"), lyrics, **SEASON), "rude_lyrics": P.profane(lyrics, HARD, MILD), "foreign_lyrics": foreign.isNotNull()}


def rules_of_rows(df: DataFrame, of_lyrics: dict[str, Column] | None = None) -> list[tuple[str, Column]]:
    """What drops a track on its own, in the order of the chain; ``df`` has flags, names, the album's year and lyrics, or what
    ``rules_of_lyrics`` said of them."""
    c, title, album, of_lyrics = F.col, F.col("track_name"), F.col("album_name"), of_lyrics or rules_of_lyrics()
    f = flags(df)
    any_evidence = evidence(title) | evidence(c("primary_artist")) | F.exists("credits", evidence)
    local_primary = c("discovered") | F.array_contains("primary_kinds", "known") | evidence(c("primary_artist"))
    return [
        ("language", ~(any_evidence | evidence(album)) & ~decision(df)["local"] & ~c("discovered")),
        ("children", C.has(title, KIDS) | C.has(c("artists"), KIDS) | C.has(album, KIDS)),
        ("channel", filters.non_artist_channel(c("primary_artist"), c("primary_kinds"), CHANNEL)),
        ("old_genre", f["old"] | C.old_genre(title, album, F.lit(None).cast("string"), OLD)),
        ("variant", C.variant_release(title, album, VARIANT, CONTEXT, TOUR, KEPT)),
        ("soundtrack", C.minor_soundtrack(title, album, F.array_contains("kinds", "known"), c("view_count"), c("hot_source"), TRACKS_OF)),
        ("audit", audit(df).isNotNull()),
        ("foreign_artist", f["foreign"]),
        ("season", of_lyrics["season"]),
        ("year", F.coalesce(C.release_year(c("year"), c("release_date"), c("album_year")) < 2013, F.lit(False))),
        ("rude_title", C.has(title, RUDE)),
        ("rude_lyrics", of_lyrics["rude_lyrics"]),
        ("script", P.foreign_script(F.concat_ws(" ", title, "primary_artist", album), LANG.scripts, f"[{UNIQUE}âêô]")),
        ("no_evidence", ~any_evidence & ~c("discovered") & ~F.array_contains("kinds", "known")),
        ("foreign_lyrics", ~c("instrumental") & of_lyrics["foreign_lyrics"] & ~(local_primary & ~C.foreign_identity(c("primary_artist"), album, ["brand#20"], "brand#6", ["winter songs"]))),
    ]


_LYRICS = "coalesce(nullif(trim(plain_lyrics), ''), synced_lyrics)"
_ANY = f"({_evidence('track_name')} OR {_evidence('primary_artist')} OR len(list_filter({_ARTISTS}, lambda x: {_evidence('x')})) > 0)"
_OLD_TEXT = _rx(f"concat_ws(' ', {_norm('track_name')}, {_norm('album_name')}, '')", OLD)
_T, _A, _L = _norm("track_name"), _norm("album_name"), _norm(_LYRICS)
_SEASONAL = f"(NOT {_rx(_T, SEASON['exception'])} AND ({_rx(_T, SEASON['strong'])} OR {_rx(_A, SEASON['album_strong'])} OR ({_n(_L, SEASON['marker'])} >= 2 AND {_rx(f'''concat_ws(' ', {_T}, {_A})''', SEASON['context'])}) OR ({_rx(_T, SEASON['weak'])} AND ({_rx(_A, SEASON['hint'])} OR {_rx(_L, SEASON['lyrics_strong'])}))))"
_SCRIPT = "concat_ws(' ', track_name, primary_artist, album_name)"
_ROW_RULES = [
    ("language", f"NOT ({_ANY} OR {_evidence('album_name')}) AND NOT ({_LOCAL}) AND NOT discovered"),
    ("children", f"{_rx('track_name', KIDS)} OR {_rx('artists', KIDS)} OR {_rx('album_name', KIDS)}"),
    ("channel", f"NOT {_HAS('current', 'primary_kinds')} AND ({_HAS('channel', 'primary_kinds')} OR (NOT {_HAS('known', 'primary_kinds')} AND {_rx('primary_artist', CHANNEL)}))"),
    ("old_genre", f"coalesce(old, false) OR {_OLD_TEXT}"),
    ("variant", f"{_rx('track_name', VARIANT)} OR {_rx('track_name', CONTEXT)} OR (({_rx('album_name', VARIANT)} OR {_rx('album_name', CONTEXT)} OR {_rx('album_name', TOUR)}) AND NOT {_rx('album_name', KEPT)})"),
    ("soundtrack", f"{_rx(_RELEASE, TRACKS_OF)} AND NOT {_HAS('known')} AND NOT (coalesce(view_count >= 100000, false) OR trim(coalesce(hot_source, '')) <> '')"),
    ("audit", f"({_AUDIT}) IS NOT NULL"),
    ("foreign_artist", _FOREIGN),
    ("season", _SEASONAL),
    ("year", f"coalesce({_YEAR} < 2013, false)"),
    ("rude_title", _rx("track_name", RUDE)),
    ("rude_lyrics", f"{_n(_LYRICS, HARD)} >= 3 OR {_n(_LYRICS, MILD)} >= 10 OR 4 * {_n(_LYRICS, HARD)} + {_n(_LYRICS, MILD)} >= 15"),
    ("script", f"{_n(_SCRIPT, LANG.scripts)} >= 3 AND {_n(_SCRIPT, LANG.scripts)} > {_n(_SCRIPT, f'[{UNIQUE}âêô]')}"),
    ("no_evidence", f"NOT {_ANY} AND NOT discovered AND NOT {_HAS('known')}"),
    ("foreign_lyrics", f"NOT instrumental AND coalesce(length(trim({_LYRICS})) >= 120 AND lyrics_lang <> 'de' AND lyrics_probability >= 0.85 AND local_probability < 0.10, false) AND NOT ((discovered OR {_HAS('known', 'primary_kinds')} OR {_evidence('primary_artist')}) AND NOT (lower(trim(primary_artist)) = 'brand#20' OR (lower(trim(primary_artist)) = 'brand#6' AND {_norm('album_name')} = 'winter songs')))"),
]


def _flagged(of: str, before: str = "") -> str:
    found = _DISCOVERED.format(of=of)
    return f"WITH {{tracks}}, {_KINDS}, {before}{found}, {_ALBUM_YEARS}, flagged AS (SELECT * FROM {of} LEFT JOIN kinds USING (track_id) JOIN discovered ON a = lower(trim(primary_artist)) LEFT JOIN album_years USING (album_id))"


@query("filter_rule_hits", _flagged("tracks") + " " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS tracks FROM flagged" for n, c in _ROW_RULES))
def filter_rule_hits(spark: SparkSession, d: str) -> DataFrame:
    """For each rule of the chain the tracks that it would drop by itself; one pass."""
    rows = with_flags(tracks(spark, d), names_table(spark)).join(album_years(spark), "album_id", "left")
    sums = rows.agg(*[F.count_if(c).alias(n) for n, c in rules_of_rows(rows)])
    return sums.unpivot([], [n for n, _ in rules_of_rows(rows)], "rule", "tracks")


def rules_of_artists() -> list[tuple[str, Column]]:
    """What drops a track by its artist or by how few know it; ``with_artist_sums`` has been there."""
    views, hot, popularity = F.col("view_count"), F.col("hot_source"), F.col("track_popularity")
    return [
        ("blocked_artist", F.array_contains("primary_kinds", "blocked") & ~F.array_contains("primary_kinds", "current")),
        ("obscure_artist", F.col("rated") & (F.col("best_popularity") < 15) & ~F.col("any_hot")),
        ("low_popularity", C.low_popularity(popularity, views, hot)),
        ("low_views", C.low_views(views, popularity, hot, F.coalesce(T.year(F.col("year")), T.year(F.col("release_date"))))),
        ("few_features", C.present([F.col(k) for k in ("valence", "energy", "danceability")]) < 2),
    ]


def cleaned(rows: DataFrame, names: DataFrame, years: DataFrame) -> DataFrame:
    """(track_id, reason): the rule that drops each track, or null. Rules by artists look at what the ones before have kept, as
    do the counts that discover artists."""
    short = C.allowed_short(F.col("track_id"), F.col("track_name"), ["5", "6"], ["small ring 2"])
    a = rows.withColumn("reason", F.when(~C.duration_fits(F.col("track_duration_ms"), short), "duration"))
    b = with_flags(a.where("reason IS NULL"), names).join(years, "album_id", "left")
    b = stored(b.withColumn("reason", C.first_reason(rules_of_rows(b))).drop("plain_lyrics", "synced_lyrics"), "judged")  # the rules by row are run once
    hot = F.col("hot_source").isNotNull() | F.coalesce(F.col("view_count") >= 100_000, F.lit(False)) | F.coalesce(F.col("track_popularity") >= 20, F.lit(False))
    c = filters.with_artist_sums(b.where("reason IS NULL"), F.col("primary_artist"), F.col("track_popularity"), hot)
    c = c.withColumn("reason", C.first_reason(rules_of_artists()))
    parts = [x.select("track_id", "reason") for x in (a.where("reason IS NOT NULL"), b.where("reason IS NOT NULL"), c)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FIRST = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _ROW_RULES) + " END"
_YEAR_ANY = "coalesce(nullif(regexp_extract(CAST(year AS VARCHAR), '(19|20)[0-9][0-9]'), ''), nullif(regexp_extract(release_date, '(19|20)[0-9][0-9]'), ''))::INTEGER"
_ARTIST_RULES = [
    ("blocked_artist", f"{_HAS('blocked', 'primary_kinds')} AND NOT {_HAS('current', 'primary_kinds')}"),
    ("obscure_artist", "rated AND best < 15 AND NOT hot"),
    ("low_popularity", "coalesce(track_popularity < 20, false) AND NOT coalesce(view_count >= 100000, false) AND hot_source IS NULL"),
    ("low_views", f"coalesce(view_count < 100000, false) AND NOT coalesce({_YEAR_ANY} >= 2022 AND view_count >= 50000, false) AND NOT coalesce(track_popularity >= 20, false) AND hot_source IS NULL"),
    ("few_features", "(valence IS NOT NULL)::INT + (energy IS NOT NULL)::INT + (danceability IS NOT NULL)::INT < 2"),
]
_TIMED = f"timed AS (SELECT *, track_duration_ms IS NULL OR track_duration_ms BETWEEN 150000 AND 360000 OR ((track_id IN ('5', '6') OR {_norm('track_name')} = 'small ring 2') AND track_duration_ms < 150000) AS fits FROM tracks), kept AS (SELECT * FROM timed WHERE fits), "
_CHAIN = f"""{_flagged("kept", _TIMED)},
judged AS (SELECT *, {_FIRST} AS reason FROM flagged),
left_ AS (SELECT * FROM judged WHERE reason IS NULL), sums AS (SELECT lower(trim(primary_artist)) AS s, coalesce(max(track_popularity), 0) AS best, bool_or(hot_source IS NOT NULL OR coalesce(view_count >= 100000, false) OR coalesce(track_popularity >= 20, false)) AS hot FROM left_ GROUP BY 1),
last_ AS (SELECT * EXCLUDE (reason), (SELECT count(track_popularity) > 0 FROM left_) AS rated FROM left_ JOIN sums ON s = lower(trim(primary_artist)))
SELECT track_id, 'duration' AS reason FROM timed WHERE NOT fits UNION ALL SELECT track_id, reason FROM judged WHERE reason IS NOT NULL
UNION ALL SELECT track_id, CASE {" ".join(f"WHEN {c} THEN '{n}'" for n, c in _ARTIST_RULES)} END FROM last_"""


@query("filter_chain", _CHAIN)
def filter_chain(spark: SparkSession, d: str) -> DataFrame:
    return cleaned(dealt(tracks(spark, d), "track_id"), names_table(spark), album_years(spark))


@query("filter_artist_rules", f"""{_flagged("tracks")}, sums AS (SELECT lower(trim(primary_artist)) AS s, coalesce(max(track_popularity), 0) AS best, bool_or(hot_source IS NOT NULL) AS hot FROM tracks GROUP BY 1), last_ AS (SELECT *, true AS rated FROM flagged JOIN sums ON s = lower(trim(primary_artist))) """ + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS tracks FROM last_" for n, c in _ARTIST_RULES))
def filter_artist_rules(spark: SparkSession, d: str) -> DataFrame:
    """For each rule by artists and counts the tracks that it would drop by itself."""
    rows = filters.with_artist_sums(with_flags(tracks(spark, d), names_table(spark)), F.col("primary_artist"), F.col("track_popularity"), F.col("hot_source").isNotNull())
    return rows.agg(*[F.count_if(c).alias(n) for n, c in rules_of_artists()]).unpivot([], [n for n, _ in rules_of_artists()], "rule", "tracks")


@query("pipe_cleanup", r"""WITH {tracks}, p AS (SELECT *, lower(trim(regexp_extract(track_name, '^(.+?)\s*\|\s*(.+)$', 1))) AS prefix, lower(trim(primary_artist)) AS a FROM tracks),
c AS (SELECT ord, track_id, a, CASE WHEN prefix <> '' AND (starts_with(a, prefix) OR starts_with(prefix, a)) THEN trim(regexp_extract(track_name, '^(.+?)\s*\|\s*(.+)$', 2)) ELSE track_name END AS track_name FROM p)
SELECT track_id, track_name FROM c QUALIFY row_number() OVER (PARTITION BY lower(trim(track_name)), a ORDER BY ord) = 1""")
def pipe_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Titles without their artist's name in front, then the first of each title and artist."""
    rows = tracks(spark, d).withColumn("track_name", C.without_artist_prefix(F.col("track_name"), F.col("primary_artist")))
    return K.keep_first(rows, [F.lower(F.trim("track_name")), F.lower(F.trim("primary_artist"))], [F.col("ord").asc()]).select("track_id", "track_name")


_BASE = r"(?i)\s*(?:\(live\)|remix|ost)\s*$"


@query(
    "collection_filter",
    f"""{_flagged("tracks")}, ok AS (SELECT *, regexp_replace(track_name, '{_BASE}', '') AS base FROM flagged WHERE trim(coalesce(track_name, '')) <> '' AND primary_artist_id IS NOT NULL AND coalesce(track_duration_ms BETWEEN 10000 AND 600000, true)
      AND coalesce(TRY_CAST(left(release_date, 4) AS INTEGER) >= 2009, true) AND NOT ({dict(_ROW_RULES)['channel']}) AND NOT coalesce(old, false) AND NOT {_rx('track_name', '(?i)karaoke')} AND NOT ({dict(_ROW_RULES)['children']}) AND ({_LOCAL})),
    once AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY lower(trim(track_name)), lower(trim(primary_artist)) ORDER BY ord) = 1),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(base)), lower(trim(primary_artist)) ORDER BY ord) AS n FROM once)
    SELECT track_id FROM placed WHERE lower(trim(base)) = lower(trim(track_name)) OR n <= 3""",
)
def collection_filter(spark: SparkSession, d: str) -> DataFrame:
    """What is taken at collection: complete, of a sensible length and year, by an artist, in the language, each title once and
    few variants of a song."""
    rows = with_flags(tracks(spark, d), names_table(spark)).join(album_years(spark), "album_id", "left")
    rules = dict(rules_of_rows(rows))
    ok = (F.trim(C.text_of(F.col("track_name"))) != "") & F.col("primary_artist_id").isNotNull() & F.coalesce(F.col("track_duration_ms").between(10_000, 600_000), F.lit(True))
    ok &= F.coalesce(F.substring("release_date", 1, 4).try_cast("int") >= 2009, F.lit(True)) & ~rules["channel"] & ~flags(rows)["old"] & ~C.has(F.col("track_name"), "(?i)karaoke") & ~rules["children"] & decision(rows)["local"]
    kept = rows.where(ok)
    return filters.collected(kept, F.col("track_name"), F.regexp_replace("track_name", _BASE, ""), F.col("primary_artist"), "ord").select("track_id")


FEATURES = ["valence", "energy", "danceability", "tempo", "key", "mode", "loudness"]


@query(
    "gates",
    f"""WITH {{tracks}}, media AS (SELECT CAST(vec_id * 3 AS VARCHAR) AS track_id, label AS seen FROM embeddings),
    m AS (SELECT t.*, coalesce(view_count, seen) AS views FROM tracks t JOIN media USING (track_id)),
    l AS (SELECT * FROM m WHERE {_LYRICS} IS NOT NULL AND NOT ({dict(_ROW_RULES)['rude_lyrics']})),
    f AS (SELECT * FROM l WHERE {" AND ".join(f'{c} IS NOT NULL' for c in FEATURES)})
    SELECT track_id, views FROM f WHERE ({_AUDIT}) IS NULL""",
)
def gates(spark: SparkSession, d: str) -> DataFrame:
    """The tracks that have media, decent lyrics, all features and pass the audit."""
    from .registry import table

    media = table(spark, d, "embeddings").select((F.col("vec_id") * 3).cast("string").alias("track_id"), F.col("label").cast("long").alias("view_count"), F.col("vec_id").alias("at"))
    lyrics = F.coalesce(F.nullif(F.trim("plain_lyrics"), F.lit("")), F.col("synced_lyrics"))
    rows = filters.media_gate(tracks(spark, d), media, "track_id", ["view_count"])
    rows = filters.feature_gate(filters.lyrics_gate(rows, lyrics, P.profane(lyrics, HARD, MILD)), FEATURES)
    return rows.where(audit(rows).isNull()).select("track_id", F.col("view_count").alias("views"))


@query("feature_fill", "WITH {tracks} SELECT track_id, valence, energy, danceability FROM tracks WHERE coalesce(valence, energy, danceability) IS NOT NULL")
def feature_fill(spark: SparkSession, d: str) -> DataFrame:
    """Rows with at least one feature (all of them, filled, if no row has any)."""
    return filters.with_features(tracks(spark, d), ["valence", "energy", "danceability"]).select("track_id", "valence", "energy", "danceability")


@query("resume_fill", "WITH {tracks}, before AS (SELECT CAST(p_partkey % 300 AS VARCHAR) AS track_id, max_by(p_size, p_partkey)::DOUBLE AS tempo FROM part GROUP BY 1) SELECT t.track_id, coalesce(t.tempo, b.tempo) AS tempo, b.track_id IS NULL AS pending FROM tracks t LEFT JOIN before b USING (track_id)")
def resume_fill(spark: SparkSession, d: str) -> DataFrame:
    """Nulls filled from the last row that an earlier output has of a track, and the tracks that it has no row of."""
    from .registry import table

    before = table(spark, d, "part").select((F.col("p_partkey") % 300).cast("string").alias("track_id"), F.col("p_size").cast("double").alias("tempo"), F.col("p_partkey").alias("at"))
    rows = tracks(spark, d).select("track_id", "tempo")
    waiting = filters.pending(rows, [before], "track_id").select("track_id", F.lit(True).alias("pending"))
    return filters.resumed(rows, before, "track_id", ["tempo"], "at").join(waiting, "track_id", "left").withColumn("pending", F.coalesce("pending", F.lit(False)))


_RANK = [
    ("variant", dict(_ROW_RULES)["variant"]), ("unseen", "view_count IS NULL"), ("views", "-coalesce(view_count, 0)"), ("no_single", f"NOT ({_norm('album_name')} <> '' AND {_norm('album_name')} = {_norm('track_name')})"),
    ("compilation", _rx(_norm("album_name"), SAMPLER)), ("short", "coalesce(track_duration_ms < 120000, false)"), ("credits", f"-len({_ARTISTS})"),
    ("known", "-((nullif(trim(synced_lyrics), '') IS NOT NULL)::INT + (nullif(trim(plain_lyrics), '') IS NOT NULL)::INT + (nullif(trim(album_id), '') IS NOT NULL)::INT + (track_duration_ms IS NOT NULL)::INT)"),
    ("annotated", _rx("track_name", GUESTS)), ("length", "-coalesce(track_duration_ms, 0)"), ("title", "length(track_name)"),
]


@query("winner_rank", f"WITH {{tracks}} SELECT lower(trim(primary_artist)) AS entity, track_id, CAST(row_number() OVER (PARTITION BY lower(trim(primary_artist)) ORDER BY {', '.join(f'({x})' for _, x in _RANK)}, ord) AS INTEGER) AS place FROM tracks")
def winner_rank(spark: SparkSession, d: str) -> DataFrame:
    """The order in which the tracks of an entity (here an artist) would win, by eleven keys."""
    from pyspark.sql import Window

    rows = tracks(spark, d)
    variant = C.variant_release(F.col("track_name"), F.col("album_name"), VARIANT, CONTEXT, TOUR, KEPT)
    keys = entities.quality_keys(rows, variant, ["synced_lyrics", "plain_lyrics", "album_id", "track_duration_ms"], SAMPLER, GUESTS)
    order = Window.partitionBy("entity").orderBy(*keys, "ord")
    return rows.withColumn("entity", F.lower(F.trim("primary_artist"))).select("entity", "track_id", F.row_number().over(order).alias("place"))


@query("request_validation", "WITH r AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ['#12ab9F'] WHEN 1 THEN ['#12ab9F', '#000000'] WHEN 2 THEN ['red'] WHEN 3 THEN [] WHEN 4 THEN NULL ELSE ['#123456', '#1', '#2'] END AS colors, doc_id % 60 AS k, (doc_id % 13) / 10.0::DOUBLE AS penalty FROM documents) SELECT doc_id, CASE WHEN coalesce(NOT (len(colors) BETWEEN 1 AND 2), true) THEN 'colors' WHEN len(list_filter(colors, lambda c: NOT regexp_matches(c, '^#[0-9A-Fa-f]{6}$'))) > 0 THEN 'hex' WHEN NOT (k BETWEEN 1 AND 50) THEN 'k' WHEN NOT (penalty BETWEEN 0 AND 1) THEN 'penalty' END AS error FROM r")
def request_validation(spark: SparkSession, d: str) -> DataFrame:
    from .registry import table

    n = F.col("doc_id") % 6
    lists = {0: ["#12ab9F"], 1: ["#12ab9F", "#000000"], 2: ["red"], 3: [], 5: ["#123456", "#1", "#2"]}
    colors = F.lit(None).cast("array<string>")
    for i, x in lists.items():
        colors = F.when(n == i, F.array(*map(F.lit, x)).cast("array<string>")).otherwise(colors)
    rows = table(spark, d, "documents")
    return rows.select("doc_id", C.color_request_error(colors, F.col("doc_id") % 60, (F.col("doc_id") % 13) / 10, F.lit(None).cast("array<string>")).alias("error"))


@query("artist_frontier", "WITH RECURSIVE e AS (SELECT DISTINCT p_size AS src, (p_partkey % 50 + 1)::INTEGER AS dst FROM part WHERE p_partkey % 7 = 0), r(node, depth) AS (SELECT 1, 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 12) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node")
def artist_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Who is found from one artist by what others are credited with, and in how many steps."""
    from .registry import table

    edges = table(spark, d, "part").where("p_partkey % 7 = 0").select(F.col("p_size").alias("src"), (F.col("p_partkey") % 50 + 1).cast("int").alias("dst")).distinct()
    return filters.frontier(edges, spark.range(1, 2).select(F.col("id").cast("int").alias("node")))
