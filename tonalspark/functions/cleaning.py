"""Conditions by which raw tracks are kept or dropped. Word lists, names and patterns are parameters; null counts as empty."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import edged, hits
from .text import match_text


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def has(text: Column, pattern: str) -> Column:
    return text_of(text).rlike(pattern)


def has_words(text: Column, words: list[str]) -> Column:
    """Is one of the words among those of a text, as they stand but for case?"""
    return F.arrays_overlap(F.split(F.lower(text_of(text)), r"\s+"), F.array(*map(F.lit, words)))


def local_evidence(text: Column, letters: str, words: list[str], plain_words: list[str]) -> Column:
    """A letter that only the catalogue's language has, one of its words, or one of those that tell it without marks."""
    return has(text, letters) | has_words(text, words) | F.arrays_overlap(F.split(match_text(text), " "), F.array(*map(F.lit, plain_words)))


def seasonal_release(title: Column, album: Column, lyrics: Column, strong: str, album_strong: str, marker: str, context: str, weak: str, hint: str, lyrics_strong: str, exception: str) -> Column:
    """Songs for a season, by normalised title, album and lyrics. Titles with an exception never; a strong title or album, or two
    markers in the lyrics with a context in title or album, always; a weak title with a hint in the album or strong lyrics."""
    t, a, words = match_text(title), match_text(album), match_text(lyrics)
    marked = F.when(F.concat_ws(" ", t, a).rlike(context), hits(words, marker) >= 2).otherwise(False)
    weakly = F.when(t.rlike(weak), words.rlike(lyrics_strong)).otherwise(False)
    sure = t.rlike(strong) | a.rlike(album_strong) | (t.rlike(weak) & a.rlike(hint))
    return F.when(t.rlike(exception), False).when(sure, True).when(marked, True).otherwise(weakly)  # lyrics are read only where it is up to them


def old_genre(title: Column, album: Column, genres: Column, pattern: str) -> Column:
    return F.concat_ws(" ", match_text(title), match_text(album), match_text(genres)).rlike(pattern)


def foreign_lyrics(text: Column, lang: Column, probability: Column, local_probability: Column, local: str, least_chars: int = 120) -> Column:
    """The language of lyrics if a detector is sure that it isn't the local one; else null. Short lyrics tell nothing."""
    sure = (F.length(F.trim(text_of(text))) >= least_chars) & (lang != local) & (probability >= 0.85) & (F.coalesce(local_probability, F.lit(0.0)) < 0.10)
    return F.when(sure, lang)


def foreign_identity(artist: Column, album: Column, foreign: list[str], shared_name: str, other_albums: list[str]) -> Column:
    """An artist who is known to be a foreign one, or a name shared with one, by the albums of the other."""
    name = F.lower(F.trim(text_of(artist)))
    return name.isin(foreign) | ((name == shared_name) & match_text(album).isin(other_albums))


def allowed_short(track_id: Column, title: Column, ids: list[str], titles: list[str]) -> Column:
    return track_id.isin(ids) | match_text(title).isin(titles)


def duration_fits(ms: Column, allowed: Column, low: int = 150_000, high: int = 360_000) -> Column:
    """Unknown, between the bounds, or shorter and allowed to be."""
    return ms.isNull() | ms.between(low, high) | (allowed & (ms < low))


def variant_release(title: Column, album: Column, strong: str, context: str, tour: str, kept_albums: str) -> Column:
    """Live takes, remixes and the like, by the title, or by an album that is none of those to keep."""
    of_album = (has(album, strong) | has(album, context) | has(album, tour)) & ~has(album, kept_albums)
    return has(title, strong) | has(title, context) | of_album


def minor_soundtrack(title: Column, album: Column, known: Column, views: Column, hot: Column, pattern: str, least_views: int = 100_000) -> Column:
    """Music from films and series that no known artist sings, few people watched and no chart has."""
    seen = F.coalesce(views >= least_views, F.lit(False)) | (F.trim(text_of(hot)) != "")
    return has(F.concat_ws(" ", title, album), pattern) & ~known & ~seen


@dataclass(frozen=True)
class Audited:
    """Names of the columns of an audio audit (any may be null) and what is rejected whatever it sounds like."""

    wrong_ids: tuple[str, ...] = ()
    legacy_artists: tuple[str, ...] = ()
    composers: tuple[str, ...] = ()
    legacy_albums: tuple[tuple[str, str], ...] = ()
    programme: str = edged(r"(?i)\btalk ?show\b")
    fragment: str = edged(r"(?i)\b(?:snippet|excerpt|teaser)\b")
    most_seconds: float = 360.0


def audit_reason(track_id: Column, artist_id: Column, title: Column, album: Column, duration_s: Column, audio: dict[str, Column], known: Audited) -> Column:
    """The first reason for rejecting a recording that applies, or null. ``audio`` has the columns actual_s, instrumental,
    voice, singing, speech, music, speech_share and low_music; a null says nothing, where it isn't said otherwise."""
    context = F.concat_ws(" ", title, album)
    old_album = F.lit(False)
    for artist, name in known.legacy_albums:
        old_album |= (artist_id == artist) & (match_text(album) == name)
    a = audio
    rules = [
        ("verified_wrong_content", track_id.isin(*known.wrong_ids)),
        ("legacy_artist_identity", artist_id.isin(*known.legacy_artists)),
        ("soundtrack_score_catalog", artist_id.isin(*known.composers)),
        ("legacy_release", old_album),
        ("fragment_or_program_excerpt", context.rlike(known.programme) | (context.rlike(known.fragment) & (duration_s.isNull() | (duration_s < 180)))),
        ("actual_duration_out_of_range", a["actual_s"] > known.most_seconds),
        ("instrumental_audio", (a["instrumental"] >= 0.82) | ((a["instrumental"] >= 0.70) & (a["singing"] < 0.018))),
        ("spoken_audio", ((a["speech_share"] >= 0.30) & (a["singing"].isNull() | (a["singing"] < 0.04))) | ((a["speech"] >= 0.18) & (a["music"].isNull() | (a["speech"] > 0.30 * a["music"])))),
        ("non_music_audio", (a["low_music"] >= 0.55) & (a["voice"].isNull() | (a["voice"] < 0.65))),
    ]
    return first_reason(rules)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that is true, or null."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


@dataclass(frozen=True)
class Language:
    """What tells the catalogue's language: classes of letters and patterns, for lower-case text (names as they stand)."""

    unique: str  # letters that it alone has
    own: str  # its special letters, also those that others have
    accents: str  # all its letters with marks
    unshared: str  # letters with marks that the usual neighbours don't have
    other: str  # letters with marks that it doesn't have
    scripts: str  # letters of other scripts
    words: str  # common words
    lookalike: str  # those of the unique letters that another language has as well
    lookalike_words: str  # and common words of that one
    garbage: str  # names that are no names


def language_decision(title: Column, artists: Column, album: Column, flags: dict[str, Column], detected: Column, detected_title: Column, lang: Language) -> Column:
    """struct<local boolean, reason string>: is a track in the catalogue's language, by the first of thirteen rules that speaks?

    flags: booleans old, known, foreign and discovered of the credited artists; detected and detected_title: what a detector
    says of the whole and of the title alone.
    """
    name, primary = F.lower(text_of(title)), F.lower(F.trim(text_of(F.get(artists, 0))))
    whole, release = F.lower(F.concat_ws(" ", title, F.array_join(artists, " "), album)), F.lower(F.concat_ws(" ", title, album))
    unique, other, marks = whole.rlike(lang.unique), whole.rlike(lang.other), hits(whole, lang.accents)
    own_marks = whole.rlike(lang.unshared)
    words = name.rlike(lang.words)
    short = (F.length(primary) <= 5) & ~primary.rlike(r"[^\x00-\x7F]")
    evident = release.rlike(lang.own) | release.rlike(lang.words) | release.rlike(lang.accents)
    only_lookalike = ~F.regexp_replace(whole, lang.lookalike, "").rlike(lang.unique)
    rules = [
        (flags["old"], False, "old_genre"),
        (flags["known"] & (~short | evident), True, "known_artist"),
        (flags["foreign"], False, "foreign_artist"),
        (F.exists(artists, lambda x: F.trim(x).rlike(lang.garbage)), False, "garbage_name"),
        ((hits(whole, lang.scripts) >= 2) & ~unique, False, "foreign_script"),
        (other & ~unique, False, "other_accents"),
        (unique & only_lookalike & whole.rlike(lang.lookalike_words), False, "lookalike_language"),
        (unique, True, "own_letters"),
        (whole.rlike(lang.own) & whole.rlike(lang.words), True, "own_letters_and_words"),
        (flags["discovered"], True, "discovered_artist"),
        ((marks >= 3) & ~other & own_marks, True, "many_accents"),
        (words & ((hits(whole, lang.words) >= 2) | ((marks >= 1) & own_marks)), True, "common_words"),
        (detected & ~other & own_marks, True, "detected"),
        ((F.length(F.trim(name)) >= 10) & detected_title & words & ~other, True, "detected_title"),
    ]
    local, reason = F.lit(False), F.lit("no_evidence")
    for condition, is_local, why in reversed(rules):
        local, reason = F.when(condition, F.lit(is_local)).otherwise(local), F.when(condition, F.lit(why)).otherwise(reason)
    return F.struct(local.alias("local"), reason.alias("reason"))


def release_year(*columns: Column) -> Column:
    """The first column whose first four characters are a number; 0 says nothing."""
    return F.coalesce(*[F.nullif(F.substring(F.trim(c.cast("string")), 1, 4).try_cast("int"), F.lit(0)) for c in columns])


def without_artist_prefix(title: Column, artist: Column) -> Column:
    """Of ``Artist | Title`` the title, where the prefix and the artist's name begin alike."""
    prefix = F.lower(F.trim(F.regexp_extract(title, r"^(.+?)\s*\|\s*(.+)$", 1)))
    name, rest = F.lower(F.trim(text_of(artist))), F.trim(F.regexp_extract(title, r"^(.+?)\s*\|\s*(.+)$", 2))
    return F.when((prefix != "") & (F.startswith(name, prefix) | F.startswith(prefix, name)), rest).otherwise(title)


def low_popularity(popularity: Column, views: Column, hot: Column, least: int = 20, least_views: int = 100_000) -> Column:
    """Known to be unpopular, without views that speak against it or a chart that has it."""
    return F.coalesce(popularity < least, F.lit(False)) & ~F.coalesce(views >= least_views, F.lit(False)) & hot.isNull()


def low_views(views: Column, popularity: Column, hot: Column, year: Column, least: int = 100_000, recent: int = 2022, recent_views: int = 50_000, popular: int = 20) -> Column:
    """Known to have few views, and neither recent with some views nor popular nor in a chart."""
    momentum = F.coalesce((year >= recent) & (views >= recent_views), F.lit(False))
    return F.coalesce(views < least, F.lit(False)) & ~momentum & ~F.coalesce(popularity >= popular, F.lit(False)) & hot.isNull()


def present(columns: list[Column]) -> Column:
    """How many of the columns aren't null."""
    out = F.lit(0)
    for c in columns:
        out += c.isNotNull().cast("int")
    return out


def color_request_error(colors: Column, k: Column, penalty: Column, excluded: Column) -> Column:
    """What is wrong with a request, or null: one or two colours as #RRGGBB, 1 to 50 results, a penalty of 0 to 1, 120 exclusions."""
    return first_reason([
        ("colors", F.coalesce(~F.size(colors).between(1, 2), F.lit(True))),
        ("hex", F.exists(colors, lambda c: ~text_of(c).rlike(r"^#[0-9A-Fa-f]{6}$"))),
        ("k", ~F.coalesce(k.between(1, 50), F.lit(False))),
        ("penalty", ~F.coalesce(penalty.between(0, 1), F.lit(False))),
        ("exclude", F.size(F.coalesce(excluded, F.array().cast("array<string>"))) > 120),
    ])
