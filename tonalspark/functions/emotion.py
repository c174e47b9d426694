"""Emotions from words, and labels from valence and arousal."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

#: Fixed values: (valence, arousal) of each emotion.
EMOTION_VA = {
    "happy": (0.8, 0.6), "sad": (0.2, 0.3), "love": (0.7, 0.5), "angry": (0.3, 0.8), "peaceful": (0.6, 0.2), "excited": (0.8, 0.9), "melancholic": (0.35, 0.4),
    "longing": (0.4, 0.5), "hope": (0.7, 0.6), "nostalgia": (0.4, 0.35), "disgust": (0.2, 0.6), "fear": (0.2, 0.7), "surprise": (0.6, 0.8),
}


@dataclass(frozen=True)
class Lexicon:
    """Words of each emotion, and words that change what stands behind them. The two sets name what negation turns into sad and into happy."""

    words: dict[str, tuple[str, ...]]
    stronger: tuple[str, ...] = ()
    negations: tuple[str, ...] = ()
    turns: tuple[str, ...] = ()
    positive: frozenset[str] = field(default_factory=frozenset)
    negative: frozenset[str] = field(default_factory=frozenset)


@lru_cache(maxsize=16)
def _terms(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds the words of a lexicon by their numbers; made once in each worker."""
    found = ahocorasick.Automaton()
    for k, w in enumerate(words):
        found.add_word(w, k)
    found.make_automaton()
    return found


def lexicon_scores(text: Column, lexicon: Lexicon) -> Column:
    """A map of emotions to shares of the weighted occurrences of their words; empty for null texts and without any.

    An occurrence weighs 1; 1.5 times that behind a strengthening word within 24 characters of the same clause; 1.4 times
    behind an adversative within 40 characters; behind a negation in that clause .7 times, for the opposite pole.
    """
    owners: dict[str, list[str]] = {}
    for emotion, words in lexicon.words.items():
        for w in words:
            owners.setdefault(w, []).append(emotion)
    words = tuple(owners)
    clause = re.compile(r"[,.;:!?\n]")

    def score(text: str | None) -> dict[str, float]:
        low, sums = (text or "").lower(), {}
        inner = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
        # all terms in one pass over the text, then in the order of the lexicon
        met = sorted((k, end - len(words[k]) + 1) for end, k in _terms(words).iter(low)) if words and low else []
        for k, at in met:
            word = words[k]
            if not inner(at - 1) and not inner(at + len(word)):
                near = clause.split(low[max(0, at - 24) : at])[-1]
                weight = (1.5 if any(w in near for w in lexicon.stronger) else 1.0) * (1.4 if any(w in low[max(0, at - 40) : at] for w in lexicon.turns) else 1.0)
                negated = any(w in near for w in lexicon.negations)
                for emotion in owners[word]:
                    if not negated:
                        sums[emotion] = sums.get(emotion, 0.0) + weight
                    elif emotion in lexicon.positive:
                        sums["sad"] = sums.get("sad", 0.0) + 0.7 * weight
                    elif emotion in lexicon.negative:
                        sums["happy"] = sums.get("happy", 0.0) + 0.7 * weight
        total = sum(sums.values())
        return {k: v / total for k, v in sums.items()} if total else {}

    @F.pandas_udf("map<string,double>")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(score, na_action=None)

    return scored(text)


def scores_to_va(scores: Column) -> Column:
    """struct(valence, arousal): the emotions' places weighted by their scores, with .5 weighing one."""
    places = F.create_map(*[x for k, (v, a) in EMOTION_VA.items() for x in (F.lit(k), F.array(F.lit(v), F.lit(a)))])
    entries = F.filter(F.map_entries(scores), lambda e: F.element_at(places, e["key"]).isNotNull())
    total = F.aggregate(entries, F.lit(1.0), lambda s, e: s + e["value"])
    axis = lambda i: F.aggregate(entries, F.lit(0.5), lambda s, e: s + e["value"] * F.element_at(F.element_at(places, e["key"]), i)) / total
    return F.struct(axis(1).alias("valence"), axis(2).alias("arousal"))


#: The 8 labels' places.
LABEL_PLACES = {"happy": (0.80, 0.60), "excited": (0.75, 0.85), "peaceful": (0.70, 0.20), "calm": (0.60, 0.30), "melancholic": (0.35, 0.35), "sad": (0.20, 0.25), "tense": (0.35, 0.75), "angry": (0.20, 0.85)}


def nearest_label(valence: Column, arousal: Column) -> Column:
    """The label whose place is nearest; of equally near ones the first by name."""
    near = F.array_min(F.array(*[F.struct((F.pow(valence - v, F.lit(2)) + F.pow(arousal - a, F.lit(2))).alias("d"), F.lit(k).alias("label")) for k, (v, a) in LABEL_PLACES.items()]))
    return near["label"]


def sentiment_category(compound: Column) -> Column:
    return F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")


def grounded_valence(text: Column, valence: dict[str, float], negators: tuple[str, ...], least: int = 2) -> Column:
    """The mean valence of the words of a lexicon of one- and two-word terms, read left to right, two-word terms first.

    A negator among the three words before a term turns its valence v into 1 - v. Null with fewer than ``least`` terms. Only words
    that a term begins with are looked at with their neighbours.
    """
    terms = F.create_map(*[x for k, v in sorted(valence.items()) for x in (F.lit(k), F.lit(float(v)))])
    all_words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(-1).alias("taken"))
    firsts = sorted({k.split(" ")[0] for k in valence})
    not_ = F.array(*map(F.lit, negators))

    def scan(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(firsts), i)), lambda i: i.isNotNull())

        def step(s: Column, i: Column) -> Column:
            two, one = F.try_element_at(terms, F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))), F.try_element_at(terms, F.get(words, i))
            v = F.coalesce(two, one)
            turned = F.arrays_overlap(F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), not_)
            hit = (i > s["taken"]) & v.isNotNull()
            return F.struct(
                F.when(hit, s["sum"] + F.when(turned, 1 - v).otherwise(v)).otherwise(s["sum"]).alias("sum"),
                F.when(hit, s["n"] + 1).otherwise(s["n"]).alias("n"),
                F.when(hit & two.isNotNull(), i + 1).otherwise(s["taken"]).alias("taken"),
            )

        return F.aggregate(places, start, step)

    out = let(all_words, scan)
    return F.when(out["n"] >= least, out["sum"] / out["n"])
