"""Text search: blocks by priority, trigrams, fuzzy words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stored

#: Rows of a word up to which those that have it as their rarest meet first.
FEW = 1000


def blocks(items: DataFrame, query: str, limit: int, order: tuple[str, ...] | None = None) -> DataFrame:
    """(item, block, place) of items (item, artist, title, body, popularity) found by a query; an item is in its first block.

    Blocks are artist, title and body. If the query names an artist (equal to one, within one of at most 5/3 its length, or
    around one of at least 4 letters) artists come first, else titles. Within a block equal ones come first, then popular ones.
    """
    q = F.trim(F.regexp_replace(T.no_marks(F.lit(query)), "[^a-z0-9]+", " "))
    artist, title, body = (T.match_text(F.col(c)) for c in ("artist", "title", "body"))
    named = (artist == q) | (artist.contains(q) & (F.length(q) >= 0.6 * F.length(artist))) | (q.contains(artist) & (F.length(artist) >= 4))
    found = {"artist": artist.contains(q), "title": title.contains(q), "body": body.contains(q)}

    def block_in(names: tuple[str, ...]) -> Column:
        out = F.lit(None).cast("int")
        for i, name in reversed([*enumerate(names)]):
            out = F.when(found[name], i).otherwise(out)
        return out

    if order is None:  # a row that says whether any artist is named; found when the search runs
        items = items.join(F.broadcast(items.agg(F.coalesce(F.bool_or(named), F.lit(False)).alias("_named"))))
        block = F.when(F.col("_named"), block_in(("artist", "title", "body"))).otherwise(block_in(("title", "artist", "body")))
    else:
        block = block_in(order)
    equal = ((artist == q) | (title == q)).cast("int")
    hits = items.withColumns({"block": block, "_equal": equal}).where("block is not null")
    keys = [F.col("block").asc(), F.col("_equal").desc(), F.col("popularity").desc_nulls_last(), F.col("item").asc()]
    top = hits.orderBy(*keys).limit(limit)  # each task keeps its first ``limit`` rows
    return top.withColumn("place", F.row_number().over(Window.orderBy(*keys))).select("item", "block", "place")


def of_artist(songs: DataFrame, name: str) -> DataFrame:
    """The songs of an artist of that name in whatever case; if there are none, of artists whose name contains it."""
    low = F.lower(F.trim(F.lit(name)))
    near = songs.where(F.lower("artist").contains(low)).withColumn("_equal", F.lower(F.trim("artist")) == low)
    any_ = near.agg(F.coalesce(F.bool_or("_equal"), F.lit(False)).alias("_any"))
    return near.join(F.broadcast(any_)).where(F.col("_equal") | ~F.col("_any")).drop("_equal", "_any")


def by_trigrams(items: DataFrame, query: str, limit: int, least: float = 0.3) -> DataFrame:
    """(item, similarity) of items (item, title, artist, popularity) that hold the query or share trigrams with it."""
    q = T.trigrams(F.lit(query))
    like = F.greatest(T.jaccard(T.trigrams(F.col("title")), q), T.jaccard(T.trigrams(F.col("artist")), q))
    found = items.withColumn("similarity", like).where((F.col("similarity") >= least) | F.lower("title").contains(query.lower()) | F.lower("artist").contains(query.lower()))
    return found.orderBy(F.col("similarity").desc(), F.col("popularity").desc_nulls_last(), "item").limit(limit).select("item", "similarity")


def best_token_match(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """(left_id, right_id, score): the best row of ``right`` for each of ``left`` (id, title, artist), by .7 of the Jaccard of
    the titles' words and .3 if the artists are equal.

    A score of ``least`` takes a Jaccard of t = (least - .3) / .7, and two sets that alike have a word in common among the
    n - ceil(t n) + 1 rarest of each. Rows whose rarest word is the same meet first, if it isn't common; what the best of them
    has reached is a row's least from then on, so that few rows look at their commoner words. Whole sets decide.
    """
    share = lambda score: F.greatest((score - 0.3 - 1e-9) / 0.7, F.lit(1e-9))
    words = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("artist").alias(f"{p}_artist"), T.tokens(F.col("title")).alias(f"{p}_words")).where(F.size(f"{p}_words") > 0)
    l, r = words(left, "left"), words(right, "right")
    counts = l.select(F.explode("left_words").alias("word")).unionByName(r.select(F.explode("right_words").alias("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def rare(df: DataFrame, p: str) -> DataFrame:
        flat = df.select(f"{p}_id", F.explode(f"{p}_words").alias("word")).join(counts, "word")
        sorted_ = flat.groupBy(f"{p}_id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
        return stored(sorted_.select(f"{p}_id", F.size("w").alias(f"{p}_size"), F.posexplode("w").alias(f"{p}_at", "w")).select(f"{p}_id", f"{p}_size", f"{p}_at", "w.word", "w.n"), "words")

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.select("left_id", "right_id").distinct().join(l, "left_id").join(r, "right_id")
        score = 0.7 * T.jaccard(F.col("left_words"), F.col("right_words")) + F.when(F.col("left_artist") == F.col("right_artist"), 0.3).otherwise(0.0)
        return met.withColumn("score", F.round(score, 9)).where(F.col("score") >= least)

    of_left, of_right = rare(l, "left"), rare(r, "right").drop("n")
    first = of_left.where(f"left_at = 0 AND n <= {FEW}").join(of_right.where("right_at = 0"), "word")
    reached = scored(first).groupBy("left_id").agg(F.max("score").alias("reached"))
    wanted = stored(of_left.join(reached, "left_id", "left").withColumn("t", share(F.coalesce("reached", F.lit(float(least))))), "wanted")
    looked = lambda p: F.col(f"{p}_at") <= F.col(f"{p}_size") - F.ceil(F.col("t") * F.col(f"{p}_size") - 1e-9)
    best = scored(wanted.where(looked("left")).join(of_right, "word").where(looked("right")))
    return best.groupBy("left_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "right_id")).alias("b")).select("left_id", F.col("b.right_id").alias("right_id"), (-F.col("b.s")).alias("score"))


def index(songs: DataFrame, item: str, artist: str, title: str, body: str, popularity: str) -> DataFrame:
    """(item, artist, title, body, popularity) with normalised texts, made once and searched often."""
    return songs.select(F.col(item).alias("item"), *[T.match_text(F.col(c)).alias(n) for c, n in ((artist, "artist"), (title, "title"), (body, "body"))], F.col(popularity).alias("popularity"))


def smart(items: DataFrame, query: str, limit: int, semantic: DataFrame | None = None, least_similarity: float = 0.3, typos: float | None = 82.0) -> DataFrame:
    """(item, block, place) of an index: what the query's words find (blocks 0 to 2, see ``blocks``), then what means the same
    (3; semantic: item, similarity), then titles and artists that are spelt nearly so (4). An item is in its first block."""
    text = blocks(items, query, limit).select("item", "block", F.col("place").cast("double").alias("order"))
    parts = [text]
    if semantic is not None:
        parts.append(semantic.where(F.col("similarity") >= least_similarity).orderBy(F.col("similarity").desc(), "item").limit(limit).select("item", F.lit(3).alias("block"), (-F.col("similarity")).alias("order")))
    if typos is not None:
        names = items.select("artist").where("artist != ''").distinct().select(F.col("artist").alias("item"), F.col("artist").alias("title"), F.lit(0.0).alias("popularity"))
        near = typo_matches(names, query, typos, 1).select(F.col("item").alias("artist"), "ratio")
        of_artists = items.join(near, "artist").select("item", "ratio").orderBy("item").limit(limit)
        titles = typo_matches(items.select("item", "title", "popularity"), query, typos, limit).select("item", "ratio")
        parts += [x.select("item", F.lit(4).alias("block"), (-F.col("ratio")).alias("order")) for x in (of_artists, titles)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    first = found.groupBy("item").agg(F.min(F.struct("block", "order")).alias("b")).select("item", F.col("b.block").alias("block"), F.col("b.order").alias("order"))
    keys = ["block", "order", "item"]
    top = first.orderBy(*keys).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*keys))).select("item", "block", "place")


def indel_ratio(a: str, b: str) -> float:
    """100 (1 - d / (|a| + |b|)) with d the insertions and deletions between two short texts."""
    if not a and not b:
        return 100.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return 100.0 * (1 - row[-1] / (len(a) + len(b)))


def token_sort_ratio(column: Column, query: str) -> Column:
    """The indel ratio of the sorted words of a normalised text and of the query."""
    wanted = " ".join(sorted(query.lower().split()))

    @F.pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: indel_ratio(" ".join(sorted((t or "").split())), wanted))

    return ratio(T.match_text(column))


def typo_matches(items: DataFrame, query: str, least: float = 82.0, limit: int = 10) -> DataFrame:
    """(item, ratio) of the items (item, title, popularity) whose title is nearest to a misspelt query. Titles that differ
    too much in length, or have too few characters in common with it, can't reach ``least`` and are left out before Python sees them."""
    wanted = " ".join(sorted(query.lower().split()))
    title = F.array_join(F.array_sort(F.split(T.match_text(F.col("title")), " ")), " ")
    n = F.length(title)
    common = F.lit(0)  # what is in common in order is no more than what is in common at all
    for c in sorted(set(wanted)):
        common += F.least(n - F.length(F.translate(title, c, "")), F.lit(wanted.count(c)))
    near = items.where(200 * common >= least * (n + len(wanted)))
    scored = near.withColumn("ratio", token_sort_ratio(F.col("title"), query)).where(F.col("ratio") >= least)
    return scored.orderBy(F.col("ratio").desc(), F.col("popularity").desc_nulls_last(), "item").limit(limit).select("item", "ratio")
