"""Preparing and cleaning a catalogue: each step reads what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stored
from .ranks import percentiles


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in a total order. The first row of each task is found before the shuffle."""
    named = df.withColumns({f"_k{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(keys)})
    window = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(*order)
    return named.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n", *[f"_k{i}" for i in range(len(keys))])


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep &= F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return df.where(keep)


def canonical_values(df: DataFrame, key: Column, value: str) -> DataFrame:
    """(key, value, n) of the spelling of each key that is found most; accented ones before plain ones, then by name."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key.alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    accented = (F.lower("value") != T.no_marks(F.col("value"))).cast("int")
    best = keep_first(counts, ["key"], [accented.desc(), F.col("n").desc(), F.col("value").asc()])
    return best.select("key", "value", "n")


def chain(df: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """Applies the steps in order; returns the result and the table after each step, for reports."""
    after = []
    for name, step in steps:
        df = step(df)
        after.append((name, df))
    return df, after


def counts_by_reason(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """(reason, rows): how many rows each ordered reason takes, as the first that applies, and how many are kept; one pass."""
    reason = F.lit("kept")
    for name, condition in reversed(reasons):
        reason = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(reason)
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def blocked_artists(df: DataFrame, artist: str, popularity: str, hot: str, least: float | Column = 15) -> DataFrame:
    """Drops the rows of artists none of whose rows has a popularity of ``least`` (a number, or a column of the rows) or is hot."""
    sums = df.groupBy(artist).agg(F.bool_or(F.col(popularity) >= least).alias("_best"), F.bool_or(hot).alias("_hot"))
    gone = sums.where(~F.coalesce("_best", F.lit(False)) & ~F.coalesce("_hot", F.lit(False))).select(artist)
    return df.join(gone, artist, "left_anti")


def discovered(df: DataFrame, artist: str, evidence: Column, least: int = 3) -> DataFrame:
    """Artists with at least ``least`` rows that give evidence."""
    return df.where(evidence).groupBy(artist).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(artist)


def limit_variants(df: DataFrame, key: Column, is_variant: Column, order: list[Column], most: int = 3) -> DataFrame:
    """Others pass; of the variants of a key the first ``most`` stay."""
    window = Window.partitionBy("_key", "_variant").orderBy(*order)
    marked = df.withColumns({"_key": key, "_variant": is_variant}).withColumn("_n", F.row_number().over(window))
    return marked.where(~F.col("_variant") | (F.col("_n") <= most)).drop("_key", "_variant", "_n")


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Drops columns that are null or zero in every row; one pass."""
    zero = lambda c, t: F.col(c) == 0 if t in ("int", "bigint", "double", "float", "smallint", "tinyint") else F.lit(False)
    row = df.agg(*[F.count_if(F.col(c).isNotNull() & ~zero(c, t)).alias(c) for c, t in df.dtypes]).first()
    return df.drop(*[c for c in df.columns if row[c] == 0])


def contract(df: DataFrame, key: str, needed: list[str], least: int = 10) -> DataFrame:
    """(check, failures) of a table: too few rows, missing columns, null keys, repeated keys."""
    sums = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("nulls"), F.count_distinct(key).alias("keys"))
    missing = len([c for c in needed if c not in df.columns])
    checks = F.array(
        F.struct(F.lit("least_rows").alias("check"), F.greatest(least - F.col("rows"), F.lit(0)).cast("long").alias("failures")),
        F.struct(F.lit("missing_columns").alias("check"), F.lit(missing).cast("long").alias("failures")),
        F.struct(F.lit("null_keys").alias("check"), F.col("nulls").alias("failures")),
        F.struct(F.lit("repeated_keys").alias("check"), (F.col("rows") - F.col("nulls") - F.col("keys")).alias("failures")),
    )
    return sums.select(F.explode(checks).alias("c")).select("c.check", "c.failures")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose non-null key ``parent`` doesn't have."""
    keys = parent.select(F.col(parent_key).alias("_key")).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_key"), "left_anti")


def enrich(df: DataFrame, more: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fills nulls of ``columns`` from ``more`` (one row for each key)."""
    names = {c: f"_{c}" for c in columns}
    met = df.join(more.select(key, *[F.col(c).alias(n) for c, n in names.items()]), key, "left")
    return met.withColumns({c: F.coalesce(c, n) for c, n in names.items()}).drop(*names.values())


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` by key, null values of ``new`` keep the old ones; other keys stay or are added."""
    rest = [c for c in old.columns if c != key]
    met = old.alias("o").join(new.alias("n"), key, "full_outer")
    return met.select(key, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in new.columns else F.col(f"o.{c}") for c in rest])


def exploded_credits(df: DataFrame, item: str, names: str) -> DataFrame:
    """(item, position from 0, artist): the bridge table of comma-separated credits, each artist once for an item."""
    flat = df.select(item, F.posexplode(T.artists(F.col(names))).alias("position", "artist"))
    return flat.groupBy(item, "artist").agg(F.min("position").alias("position"))


def winsorised(df: DataFrame, column: str, low: float, high: float, out: str) -> DataFrame:
    """Scales a column to 0..1 between two bounds and fills nulls with its median (found by places, joined as one row)."""
    scaled = df.withColumn(out, F.least(F.greatest((F.col(column) - low) / (high - low), F.lit(0.0)), F.lit(1.0)))
    middle = percentiles(scaled, out, {"_middle": 0.5})
    return scaled.join(F.broadcast(middle)).withColumn(out, F.coalesce(out, "_middle")).drop("_middle")


#: Ways to sort: column and whether it falls.
SORTS = {"name": ("track_name", False), "artist": ("artists", False), "energy": ("energy", True), "valence": ("valence", True), "danceability": ("danceability", True)}


def browse(df: DataFrame, key: str, sort: str = "name", page: int = 1, limit: int = 20, mood: str | None = None, artist: str | None = None, search: DataFrame | None = None, seed: int = 0) -> tuple[DataFrame, Column]:
    """(a page of rows with their place, the condition that rows meet): rows whose mood_quadrant holds ``mood`` as it stands, whose artists match
    the pattern ``artist``, both in any case, and that a search has found (key). Sorted by one of SORTS, nulls last, or at random by a
    digest of key and seed; ties by key. Each task keeps page times limit rows.
    """
    fits = F.lit(True)
    if mood:
        fits &= F.coalesce(F.contains(F.lower("mood_quadrant"), F.lit(mood.lower())), F.lit(False))
    if artist:
        fits &= F.coalesce(F.col("artists").rlike(f"(?i){artist}"), F.lit(False))
    rows = df.where(fits)
    if search is not None:
        rows = rows.join(search.select(key).distinct(), key, "left_semi")
    if sort == "random":
        first = F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))).asc()
    else:
        column, falls = SORTS[sort]
        first = F.col(column).desc_nulls_last() if falls else F.col(column).asc_nulls_last()
    top = rows.orderBy(first, key).limit(page * limit)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(first, key)))  # page times limit rows
    return placed.where(F.col("place") > (page - 1) * limit), fits


def sampled(df: DataFrame, key: str, order: list[Column], pool: int, n: int, seed: int) -> DataFrame:
    """n of the first ``pool`` rows in an order, chosen by a digest of key and seed."""
    return df.orderBy(*order).limit(pool).orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), key).limit(n)


def profile(df: DataFrame, shares: list[str], numbers: list[str], tops: dict[str, int]) -> DataFrame:
    """(part, name, value): how many rows there are; how many have each value of the columns in ``shares``; mean, deviation (of a sample), least and
    most of numbers; how many different values columns in ``tops`` have, and the commonest of them (ties: the smaller)."""
    stats = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(F.count(F.lit(1)).cast("double").alias("rows"), *[f(F.col(c).cast("double")).alias(f"{c}/{n}") for c in numbers for n, f in stats.items()], *[F.count_distinct(c).cast("double").alias(f"{c}/different") for c in tops])
    out = row.unpivot([], row.columns, "name", "value").select(F.when(F.col("name").contains("/"), F.split("name", "/")[0]).otherwise("all").alias("part"), F.element_at(F.split("name", "/"), -1).alias("name"), "value")
    for c in shares:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        out = out.unionByName(counts.select(F.lit(c).alias("part"), "name", "value"))
    for c, n in tops.items():
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        out = out.unionByName(counts.orderBy(F.col("value").desc(), "name").limit(n).select(F.lit(f"top {c}").alias("part"), "name", "value"))
    return out


def loaded(songs: DataFrame, vectors: DataFrame, artists: DataFrame, albums: DataFrame, needed: list[str]) -> DataFrame:
    """(check, value, issue) after a load: rows of each table; songs without vectors, album or artist ids that aren't there; quadrants with
    songs, four expected; nulls of columns that mustn't have any."""
    counts = [(f"{n}_rows", df.agg(F.count(F.lit(1)).alias("value"))) for n, df in (("songs", songs), ("vectors", vectors), ("artists", artists), ("albums", albums))]
    missing = songs.join(vectors.select("track_id").distinct(), "track_id", "left_anti")
    wrong = [("songs_without_vector", missing), ("unknown_albums", orphans(songs, albums, "album_id", "album_id")), ("unknown_artists", orphans(songs, artists, "primary_artist_id", "artist_id"))]
    wrong += [(f"null_{c}", songs.where(F.col(c).isNull())) for c in needed]
    quadrants = songs.agg(F.count_distinct("mood_quadrant").alias("value"))
    parts = [df.select(F.lit(n).alias("check"), "value", F.lit(False).alias("issue")) for n, df in counts]
    parts += [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(n).alias("check"), "value", (F.col("value") > 0).alias("issue")) for n, df in wrong]
    parts.append(quadrants.select(F.lit("quadrants").alias("check"), "value", (F.col("value") < 4).alias("issue")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scaled_audio(df: DataFrame, scales: dict[str, tuple[float, float]], plain: list[str]) -> DataFrame:
    """Columns between two bounds as 0..1, cut there, others as they are, all with their median where they are null (of the scaled values;
    found by places of values, sent as one row)."""
    cut = {c: F.least(F.greatest((F.col(c) - low) / (high - low), F.lit(0.0)), F.lit(1.0)) for c, (low, high) in scales.items()}
    names = [*scales, *plain]
    scaled = stored(df.withColumns(cut), "scaled")
    out = scaled
    for c in names:
        out = out.join(F.broadcast(percentiles(scaled.select(c), c, {f"_m_{c}": 0.5})))
    return out.withColumns({c: F.coalesce(c, f"_m_{c}") for c in names}).drop(*[f"_m_{c}" for c in names])


def cover_report(songs: DataFrame, pairs: DataFrame, title: Column, artist: Column, item: str = "song_idx") -> DataFrame:
    """(name, value) of covers: songs, pairs by sound (a, b), pairs more by title (the same first 20 letters of a title of more than three
    and first eight of the artist), and songs that have covers. Pairs by title are counted from the sizes of their groups, not made; pairs by
    sound are found once and written. Neither they nor the songs' keys are broadcast, however few bytes they are in a shuffle."""
    keyed = songs.select(F.col(item).alias("id"), F.when((F.length(title) > 3) & (artist != ""), F.concat_ws("|", F.left(artist, F.lit(8)), F.left(title, F.lit(20)))).alias("key"))
    groups = keyed.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    of = lambda c: keyed.select(F.col("id").alias(c), F.col("key").alias(f"{c}_key"))
    known = stored(pairs.select("a", "b").distinct(), "pairs")
    both = known.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").agg(F.count_if(F.col("a_key") == F.col("b_key")).alias("both"), F.count(F.lit(1)).alias("sound"))
    titled = groups.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("titled"))
    grouped = keyed.join(groups.hint("merge"), "key", "left_semi").select("id")
    covered = grouped.unionByName(known.select(F.col("a").alias("id"))).unionByName(known.select(F.col("b").alias("id"))).distinct().agg(F.count(F.lit(1)).alias("covered"))
    row = songs.agg(F.count(F.lit(1)).alias("songs")).join(both).join(titled).join(covered)
    out = row.select("songs", F.col("sound").alias("by_sound"), (F.col("titled") - F.col("both")).alias("more_by_title"), "covered")
    return out.unpivot([], out.columns, "name", "value")
