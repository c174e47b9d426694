"""Titles, names, words and times."""

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import EDGE


def _marked() -> tuple[str, str]:
    """The lower-case Latin letters that Unicode takes apart into a letter and marks, and those letters; and đ."""
    pairs = {"đ": "d"}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if c == c.lower() and bare != c and len(bare) == 1:
            pairs[c] = bare
    return "".join(pairs), "".join(pairs.values())


MARKED, PLAIN = _marked()


def no_marks(text: Column) -> Column:
    """Lower case without diacritics, whether they are part of a letter or stand behind it."""
    return F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[\u0300-\u036f]+", "")


def match_text(text: Column) -> Column:
    """For comparing: no marks, other than a-z and 0-9 to one space, trimmed; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(no_marks(text), "[^a-z0-9]+", " ")), F.lit(""))


def canonical_title(title: Column) -> Column:
    """Without featured artists and producers, in brackets or as a tail."""
    bare = F.regexp_replace(F.lower(title), rf"[\(\[][^\)\]]*{EDGE}(?:feat|ft|prod|with|w/)[^\)\]]*[\)\]]", " ")
    return match_text(F.regexp_replace(bare, r"\s(?:feat\.?|ft\.?|prod\.?|w/)\s.*$", " "))


#: What begins the note of a version behind a title.
VERSIONS = ["(feat", "(ft.", "(ft ", "feat.", " ft.", "(remix", "(acoustic", "(live", "(cover", "(piano", "(instrumental", "(karaoke", "(ost", "(ver.", "(version", "(prod.", "(prod ", "(theme"]


def cover_title(title: Column) -> Column:
    """Cut before the first note of a version that doesn't begin it, and normalised."""
    low = F.lower(F.trim(title))
    at = F.array_min(F.filter(F.array(*[F.locate(k, low, 2) for k in VERSIONS]), lambda i: i > 1))
    return match_text(F.when(at.isNotNull(), F.substring(low, F.lit(1), at - 1)).otherwise(low))


def artist_key(names: Column, letters: int = 15) -> Column:
    """The first letters and digits of the first of a credit's names, without marks."""
    return F.substring(F.regexp_replace(F.coalesce(no_marks(F.get(F.split(names, ","), F.lit(0))), F.lit("")), "[^a-z0-9]+", ""), 1, letters)


def base_title(title: Column) -> Column:
    """Without anything in brackets and without a leading track number."""
    return match_text(F.regexp_replace(F.regexp_replace(title, r"[\(\[][^\)\]]*[\)\]]", " "), r"^\s*\d{1,3}\s*[\.\-]\s*", ""))


def artists(names: Column) -> Column:
    """The list of a comma-separated credit, without topic suffixes and blanks."""
    return F.filter(F.transform(F.split(names, ","), lambda x: F.trim(F.regexp_replace(x, r"\s+-\s+Topic\s*$", ""))), lambda x: x != "")


def tokens(text: Column) -> Column:
    """The distinct words of a normalised text."""
    return F.array_distinct(F.filter(F.split(match_text(text), " "), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the words, each padded with two spaces before and one behind."""
    padded = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def hit_text(text: Column) -> Column:
    """For comparing what a lyrics search returns: no marks, nothing in brackets, nothing from a featured artist on, a-z and 0-9."""
    bare = F.regexp_replace(F.regexp_replace(no_marks(F.coalesce(text.cast("string"), F.lit(""))), r"[\(\[][^\)\]]*[\)\]]", " "), rf"{EDGE}(?:feat|ft|featuring){EDGE}.*$", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def is_hit(title: Column, artist: Column, found_title: Column, found_artist: Column, ratio: Callable[[Column, Column], Column], least: float = 0.90) -> Column:
    """Is a search result the song that was looked for? Its title is the same or has a ratio of ``least`` with it, and the artists have a
    word in common, if both are known; without a title never."""
    a, b, x, y = hit_text(title), hit_text(found_title), hit_text(artist), hit_text(found_artist)
    words = lambda c: F.split(c, " ")
    same = (a == b) | (ratio(F.when(a != b, a), F.when(a != b, b)) >= least)
    return (a != "") & (b != "") & same & ((x == "") | (y == "") | F.arrays_overlap(words(x), words(y)))


def compared_text(text: Column) -> Column:
    """Compatibility forms and marks resolved (NFKD), lower case, letters, digits and underscores of any script as words. Only texts beyond
    ASCII go to Python."""

    @F.pandas_udf("string")
    def resolved(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

    ascii_ = text.rlike(r"\A[\x00-\x7F]*\z")
    plain = F.when(ascii_, text).otherwise(resolved(F.when(~ascii_, text)))
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " ")), F.lit(""))


def snippet(text: Column, query: str, before: int = 25, after: int = 90) -> Column:
    """What stands around the first match of a normalised query, with ellipses where it was cut; null without a match."""
    plain = match_text(text)
    at = F.locate(query, plain)
    start = F.greatest(at - before, F.lit(1))
    cut = F.substring(plain, start, F.lit(before + after) - F.greatest(F.lit(0), before + 1 - at))
    end = start + F.length(cut) - 1
    return F.when(at > 0, F.concat(F.when(start > 1, F.lit("...")).otherwise(F.lit("")), cut, F.when(end < F.length(plain), F.lit("...")).otherwise(F.lit(""))))


def clean_lyrics(text: Column) -> Column:
    """Without [mm:ss] stamps and addresses, white space to single spaces."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\[\d{1,2}:\d{2}(?:[.:]\d{1,3})?\]", " "), r"https?://\S+", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def year(value: Column) -> Column:
    """The first year from 1901 to 2099 in a text or number; null without."""
    found = F.regexp_extract(value.cast("string"), r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1).try_cast("int")
    return F.when(found > 1900, found)


def seconds(clock: Column) -> Column:
    """``mm:ss`` or ``hh:mm:ss`` in seconds; null for anything else."""
    parts = F.split(clock, ":")
    total = F.aggregate(F.transform(parts, lambda x: x.try_cast("long")), F.lit(0).cast("long"), lambda s, x: s * 60 + x)
    return F.when(clock.rlike(r"^\d{1,2}(:\d{1,2}){1,2}$"), total)
