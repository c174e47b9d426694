"""A cleaning chain whose stages each look at what the ones before have kept, with the reason of every row and a report of stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import text as T
from ..sources.shared import dealt, stored
from . import entities

Rules = Callable[[DataFrame], list[tuple[str, Column]]]


def spelt_once(df: DataFrame) -> DataFrame:
    """Rows with one spelling of each artist in primary_artist and artists, and one primary_artist_id for it.

    Of names that are equal without case and marks, if one has none, the one with marks that most rows have is meant, else the one that
    most rows have; then the same among the names of one id, unless all of them have marks and are equal without. What an id says goes
    before; of several ids the greatest. Ties: the smaller name. The id of a spelling that was chosen is the one that most of
    its rows have.
    """
    marked = F.lower("name") != T.no_marks(F.col("name"))
    names = df.where("primary_artist IS NOT NULL").select(F.col("primary_artist").alias("name"), F.trim(F.coalesce("primary_artist_id", F.lit(""))).alias("id")).groupBy("name", "id").agg(F.count(F.lit(1)).alias("n"))
    known = stored(names.withColumns({"key": T.no_marks(F.trim("name")), "marked": marked}), "names")

    def meant(groups: DataFrame, by: str) -> DataFrame:
        first = F.min(F.struct((~F.col("marked")).alias("u"), (-F.col("n")).alias("m"), "name"))
        sums = groups.groupBy(by).agg(first["name"].alias("to"), F.count(F.lit(1)).alias("names"), F.bool_and("marked").alias("all_marked"), F.count_distinct("key").alias("keys"))
        left = sums.where("names > 1").where(~F.col("all_marked") if by == "key" else ~(F.col("all_marked") & (F.col("keys") == 1)))
        return groups.join(left.select(by, "to"), by).where("name != to").select("name", "to", by)

    by_key = meant(known.groupBy("key", "name", "marked").agg(F.sum("n").alias("n")), "key").select("name", F.lit("").alias("id"), "to")
    by_id = meant(known.where("id != ''"), "id").select("name", "id", "to")
    change = by_key.unionByName(by_id).groupBy("name").agg(F.max_by("to", "id").alias("to"))
    change = stored(change, "spellings")
    renamed = df.join(change.select(F.col("name").alias("primary_artist"), "to"), "primary_artist", "left").withColumn("primary_artist", F.coalesce("to", "primary_artist")).drop("to")
    ids = renamed.join(change.select(F.col("to").alias("primary_artist")).distinct(), "primary_artist", "left_semi").where("primary_artist_id IS NOT NULL").groupBy("primary_artist", "primary_artist_id").agg(F.count(F.lit(1)).alias("n"))
    best = ids.groupBy("primary_artist").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("primary_artist_id").alias("i")))["i"].alias("best_id"))
    renamed = renamed.join(best, "primary_artist", "left").withColumn("primary_artist_id", F.coalesce("best_id", "primary_artist_id")).drop("best_id")
    flat = renamed.select("artists").distinct().select("artists", F.posexplode(T.artists(F.col("artists"))).alias("at", "name")).join(change, "name", "left")
    lists = flat.groupBy("artists").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("to", "name").alias("name")))), lambda x: x["name"]), ", ").alias("spelt"))
    return renamed.join(lists.where("spelt != artists"), "artists", "left").withColumn("artists", F.coalesce("spelt", "artists")).drop("spelt").select(*df.columns)


def without_later(df: DataFrame, keys: list[Column], order: list[Column], reason: str) -> DataFrame:
    """Gives the reason to all but the first living row of each key; rows that have one already count for nothing."""
    living = F.col("reason").isNull()
    named = df.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    place = F.row_number().over(Window.partitionBy(living, *[f"_k{i}" for i in range(len(keys))]).orderBy(*order))
    return named.withColumn("_n", place).withColumn("reason", F.when(living & (F.col("_n") > 1), F.lit(reason)).otherwise(F.col("reason"))).drop("_n", *[f"_k{i}" for i in range(len(keys))])


def best_of_recordings(living: DataFrame, pairs: Callable[[DataFrame], DataFrame], order: list[Column], reason: str) -> DataFrame:
    """Of the rows that ``pairs`` (a, b) connect to one recording the first in ``order`` lives on, with the credits of all; adds reason."""
    labels = entities.components(pairs(living)).select(F.col("node").alias("ord"), "label")
    grouped = living.join(labels, "ord")
    first = F.row_number().over(Window.partitionBy("label").orderBy(*order, "ord")) == 1
    credits = entities.merged_credits(grouped, "label", "artists", "ord")
    told = grouped.withColumn("first", first).select("ord", "label", "first").join(credits, "label").select("ord", "first", "credits")
    met = living.join(told, "ord", "left")
    return met.withColumns({"reason": F.when(~F.coalesce("first", F.lit(True)), F.lit(reason)), "artists": F.when(F.col("first"), F.col("credits")).otherwise(F.col("artists"))}).drop("first", "credits")


def judged(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Gives living rows the first of the rules that applies."""
    return df.withColumn("reason", F.coalesce("reason", C.first_reason(rules)))


def clean(
    raw: DataFrame, required: list[str], variant: Column, details: Callable[[DataFrame], DataFrame], pairs: Callable[[DataFrame], DataFrame], better: list[Column], fits: Column, flagged: Callable[[DataFrame], DataFrame], by_row: Rules, summed: Callable[[DataFrame], DataFrame], by_artist: Rules, by_count: Rules
) -> DataFrame:
    """``raw`` (with ord, a number of its own for each row) with reason: what drops each row, or null; what lives on has its spellings, merged
    credits and cleaned title.

    The stages: required fields; the most popular row of an id; one spelling; the original of a title and artist; the best of a
    recording; lengths; rules by row, with flags that are found among the rows that live then; rules by artist, with sums of
    those that live then; titles without the artist in front, and their first; rules by counts. What a stage needs of a table
    is written once, and rows that are dropped are written with that stage and not moved again.

    ``raw`` has what the stages up to the original need; ``details`` adds to the rows that live then what the others need, and of long
    texts only what they tell, so no stage moves these.
    """
    popularity, views = F.coalesce("track_popularity", F.lit(-1)), F.coalesce("view_count", F.lit(-1))
    blank = F.lit(False)
    for c in required:
        blank |= F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    parts = []

    def split(df: DataFrame) -> DataFrame:
        """The living of rows that are written; the others are done."""
        parts.append(df.where("reason IS NOT NULL").select(*raw.columns, "reason"))
        return df.where("reason IS NULL")

    df = raw.withColumn("reason", F.when(blank, "required"))
    df = without_later(df, [F.col("track_id")], [F.col("track_popularity").desc_nulls_last(), F.col("ord").asc()], "same_id")
    living = spelt_once(split(stored(df, "chain")))
    normal = lambda c: F.trim(F.regexp_replace(T.no_marks(F.col(c)), r"\s+", " "))
    original = [variant.asc(), popularity.desc(), views.desc(), F.col("track_popularity").desc_nulls_last(), F.col("ord").asc()]
    df = without_later(living, [normal("track_name"), normal("primary_artist")], original, "same_name")
    living = stored(details(split(stored(df, "chain")).drop("reason")), "living")
    df = best_of_recordings(living, pairs, better, "same_recording")
    df = stored(df.withColumn("reason", F.when(F.col("reason").isNull() & ~fits, "duration").otherwise(F.col("reason"))), "chain")
    alive = dealt(flagged(split(df)), "ord")
    alive = split(stored(judged(alive, by_row(alive)), "chain"))
    alive = summed(alive)
    alive = judged(alive, by_artist(alive))
    alive = alive.withColumn("track_name", F.when(F.col("reason").isNull(), C.without_artist_prefix(F.col("track_name"), F.col("primary_artist"))).otherwise(F.col("track_name")))
    alive = without_later(alive, [F.lower(F.trim("track_name")), F.lower(F.trim("primary_artist"))], original, "same_after_cleanup")
    out = judged(alive, by_count(alive)).select(*raw.columns, "reason")
    for p in parts:
        out = out.unionByName(p)
    return out


def report(cleaned: DataFrame, stages: list[str]) -> DataFrame:
    """(place, stage, removed, remaining) of each stage in its order; a row a stage, from one count by reason."""
    counts = stored(cleaned.groupBy("reason").agg(F.count(F.lit(1)).alias("n")), "counts")  # read twice
    names = cleaned.sparkSession.createDataFrame(list(enumerate(stages, 1)), "place int, stage string")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    removed = F.coalesce("n", F.lit(0)).cast("long")
    rows = names.join(counts, names["stage"] == counts["reason"], "left").select("place", "stage", removed.alias("removed")).join(F.broadcast(total))
    sofar = F.sum("removed").over(Window.orderBy("place"))  # a row a stage
    return rows.select("place", "stage", "removed", (F.col("total") - sofar).alias("remaining"))
