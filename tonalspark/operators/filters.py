"""Steps of the cleaning chain that look at more than one row: names against lists, artists by their best track, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.cleaning import text_of
from ..sources.shared import stored

#: Kinds of names that match without marks; the others match as they are written, but for case, spaces and hyphens.
UNMARKED = ("current", "old", "channel", "blocked")


def _keys(name: Column, kind: Column) -> Column:
    exact = F.concat(F.lit("="), F.regexp_replace(F.lower(F.trim(name)), r"[\s-]+", ""))
    return F.when(kind.isin(*UNMARKED), F.concat(F.lit("~"), T.no_marks(F.trim(name)))).otherwise(exact)


def with_kinds(df: DataFrame, key: str, artists: Column, names: DataFrame) -> DataFrame:
    """Adds kinds and primary_kinds array<string>: the kinds under which ``names`` (name, kind) lists any credited artist, and
    the first one; and by_artist array<array<string>>, the kinds of each.

    Names are distinct before they meet the list, so an artist with very many tracks is looked up once, and lists of any
    length are joined; what comes back is a row for each distinct credit.
    """
    rows = df.withColumn("_credit", artists)
    credits = rows.select("_credit").distinct()
    flat = credits.select("_credit", F.posexplode("_credit").alias("at", "name"))
    both = F.array(_keys(F.col("name"), F.lit("known")), _keys(F.col("name"), F.lit("old")))
    people = flat.select("name").distinct().select("name", F.explode(both).alias("key"))
    listed = names.select("kind", _keys(F.col("name"), F.col("kind")).alias("key")).distinct()
    told = people.join(listed, "key").groupBy("name").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    per = flat.join(told, "name", "left").groupBy("_credit").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("kinds", F.array().cast("array<string>")).alias("k")))).alias("_k"))
    per = per.select("_credit", F.transform("_k", lambda x: x["k"]).alias("by_artist"))
    none = F.array().cast("array<array<string>>")
    out = rows.join(per, "_credit", "left").drop("_credit").withColumn("by_artist", F.coalesce("by_artist", none))
    return out.withColumns({"kinds": F.sort_array(F.array_distinct(F.flatten("by_artist"))), "primary_kinds": F.coalesce(F.get("by_artist", F.lit(0)), F.array().cast("array<string>"))})


def blocked_name(by_artist: Column, kind: str, unless: str) -> Column:
    """Is any artist listed as ``kind`` who isn't listed as ``unless``?"""
    return F.exists(by_artist, lambda k: F.array_contains(k, kind) & ~F.array_contains(k, unless))


def non_artist_channel(name: Column, kinds: Column, pattern: str) -> Column:
    """A channel by the list, or by its name unless the artist is known; never a current artist."""
    listed = F.array_contains(kinds, "channel")
    return ~F.array_contains(kinds, "current") & (listed | (~F.array_contains(kinds, "known") & text_of(name).rlike(pattern)))


def with_artist_sums(df: DataFrame, artist: Column, popularity: Column, hot: Column) -> DataFrame:
    """Adds best_popularity and any_hot of the artist's tracks and rated, whether any track at all has a popularity."""
    keyed = df.withColumns({"_artist": F.lower(F.trim(text_of(artist))), "_popularity": popularity, "_hot": F.coalesce(hot, F.lit(False))})
    sums = keyed.groupBy("_artist").agg(F.coalesce(F.max("_popularity"), F.lit(0)).alias("best_popularity"), F.bool_or("_hot").alias("any_hot"), F.count("_popularity").alias("_rated"))
    rated = sums.agg((F.sum("_rated") > 0).alias("rated"))
    return keyed.join(sums.drop("_rated"), "_artist").join(F.broadcast(rated)).drop("_artist", "_popularity", "_hot")


def with_discovered(df: DataFrame, artist: Column, evidence: Column, least: int = 3) -> DataFrame:
    """Adds discovered: has the artist at least ``least`` tracks with evidence?"""
    keyed = df.withColumn("_artist", F.lower(F.trim(text_of(artist))))
    sums = keyed.groupBy("_artist").agg(((F.count_if(evidence) >= least) & (F.col("_artist") != "")).alias("discovered"))
    return keyed.join(sums, "_artist").drop("_artist")


def collected(df: DataFrame, title: Column, base: Column, artist: Column, order: str, most: int = 3) -> DataFrame:
    """Of rows with one title and artist the first; a variant (whose base isn't its title) only while fewer than ``most`` rows of
    its base were met before it."""
    name = lambda c: F.lower(F.trim(text_of(c)))
    keyed = df.withColumns({"_t": name(title), "_b": name(base), "_a": name(artist)})
    first = Window.partitionBy("_t", "_a").orderBy(order)
    rest = keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy("_b", "_a").orderBy(order))
    return rest.withColumn("_n", place).where((F.col("_b") == F.col("_t")) | (F.col("_n") <= most)).drop("_n", "_t", "_b", "_a")


def media_gate(df: DataFrame, media: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """Rows whose media exist, with nulls of ``fill`` taken from the last entry (by ``at``) that the download log has of a key."""
    logs = media.groupBy(key).agg(*[F.max_by(c, "at").alias(f"_{c}") for c in fill])
    return df.join(logs, key).withColumns({c: F.coalesce(c, f"_{c}") for c in fill}).drop(*[f"_{c}" for c in fill])


def lyrics_gate(df: DataFrame, lyrics: Column, profane: Column) -> DataFrame:
    return df.where((F.trim(text_of(lyrics)) != "") & ~profane)


def feature_gate(df: DataFrame, features: list[str], least: int = 5) -> DataFrame:
    """Rows with all of the features that the table has; all rows, if it has fewer than ``least`` of them."""
    there = [c for c in features if c in df.columns]
    return df.dropna(how="any", subset=there) if len(there) >= least else df


def with_features(df: DataFrame, features: list[str], neutral: float = 0.5) -> DataFrame:
    """Rows that have at least one of the features; where no row of the table has any, all are filled with a neutral value.
    One count decides, taken with the rows and not before them."""
    some = F.coalesce(*[F.col(c).cast("double") for c in features]).isNotNull()
    total = df.agg((F.count_if(some) > 0).alias("_any"))
    met = df.withColumn("_some", some).join(F.broadcast(total))
    return met.where(F.col("_some") | ~F.col("_any")).withColumns({c: F.when(F.col("_any"), F.col(c)).otherwise(F.lit(neutral)) for c in features}).drop("_some", "_any")


def resumed(df: DataFrame, before: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Fills nulls from the last row that an earlier output has of a key."""
    last = before.groupBy(key).agg(*[F.max_by(c, order).alias(f"_{c}") for c in columns])
    return df.join(last, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def pending(df: DataFrame, done: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key none of the earlier outputs has."""
    for d in done:
        df = df.join(d.select(key).distinct(), key, "left_anti")
    return df


def frontier(edges: DataFrame, start: DataFrame, most_rounds: int = 20) -> DataFrame:
    """(node, depth) reached from ``start`` (node) along edges (src, dst), breadth first; each round meets only what the last
    one found, and what was found is written to the shared folder."""
    found = new = stored(start.select("node").distinct().withColumn("depth", F.lit(0)), "found")
    for depth in range(1, most_rounds + 1):
        ahead = edges.join(new.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        new = stored(ahead.join(found, "node", "left_anti").withColumn("depth", F.lit(depth)), "found")
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found
