"""Conditions that decide what stays in a catalogue. Word lists and patterns are parameters or input tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A character of a word, in any script, and the edge of a word: what ``\\b`` means depends on the JDK.
LETTER = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<!{LETTER})(?={LETTER})|(?<={LETTER})(?!{LETTER}))"


def edged(pattern: str) -> str:
    r"""The pattern with each ``\b`` spelt out as the edge of a word in any script."""
    return pattern.replace(r"\b", EDGE)


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def hits(text: Column, pattern: str) -> Column:
    """How often a pattern is found; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def words_pattern(words: list[str]) -> str:
    """Any of the words as a whole, without case."""
    import re

    return r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(w) for w in words) + r")(?![\p{L}\p{N}])"


def profane(text: Column, hard: str, mild: str) -> Column:
    """Three hard hits, ten mild ones, or four times the hard and the mild ones together fifteen."""
    h, m = hits(text, hard), hits(text, mild)
    return (h >= 3) | (m >= 10) | (4 * h + m >= 15)


def seasonal(title: Column, album: Column, text: Column, strong: str, marker: str, context: str, exception: str) -> Column:
    """A strong marker in title or album, or two in the text with a context word; titles with an exception never."""
    named = F.coalesce(title, F.lit("")).rlike(strong) | F.coalesce(album, F.lit("")).rlike(strong)
    return ~F.coalesce(title, F.lit("")).rlike(exception) & (named | ((hits(text, marker) >= 2) & (hits(text, context) > 0)))


def variant(title: Column, album: Column, strong: str, kept_albums: str) -> Column:
    """Remixes, live takes and the like by title, or by album unless the album is one of those kept."""
    return F.coalesce(title, F.lit("")).rlike(strong) | (F.coalesce(album, F.lit("")).rlike(strong) & ~F.coalesce(album, F.lit("")).rlike(kept_albums))


def foreign_script(text: Column, foreign: str = r"[Ѐ-ӿ؀-ۿ฀-๿぀-ヿ㐀-鿿가-힯]", accented: str = r"[À-ɏḀ-ỿ]") -> Column:
    """Three letters of foreign scripts or more, and more than accented ones."""
    return (hits(text, foreign) >= 3) & (hits(text, foreign) > hits(text, accented))


def audio_reason(duration_s: Column, actual_s: Column, album: Column, instrumental: Column, voice: Column, singing: Column, speech: Column, speech_share: Column, low_music: Column, excerpt: str) -> Column:
    """The first reason that applies for rejecting a recording, or null."""
    d = F.coalesce(actual_s, duration_s)
    return (
        F.when(F.coalesce(album, F.lit("")).rlike(excerpt) & (d < 180), "fragment_or_program_excerpt")
        .when(actual_s > 360, "actual_duration_too_long")
        .when((instrumental >= 0.82) | ((instrumental >= 0.70) & (singing < 0.018)), "instrumental_audio")
        .when(((speech >= 0.20) & (singing < 0.02)) | (speech_share >= 0.50), "spoken_audio")
        .when((low_music >= 0.55) & (voice < 0.65), "low_music_audio")
    )


def duration_class(actual: Column, expected: Column) -> Column:
    ratio = actual / F.nullif(expected, F.lit(0))
    return F.when(ratio.between(0.85, 1.15), "clean").when(ratio > 1.15, "has_extra").when(ratio < 0.85, "low").otherwise("unknown")
