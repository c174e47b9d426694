"""Side tables onto a catalogue: lookups that replace, fill or default columns, and vectors aligned by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V


def one_per_key(df: DataFrame, key: str, order: str, last: bool = True) -> DataFrame:
    """The last (or first) row of each key by ``order``, found by a partial aggregate and not by a window."""
    rest = [c for c in df.columns if c != key]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), order)
    return df.groupBy(key).agg(pick.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def with_side(df: DataFrame, side: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns of a side table (one row for each key) replace those of the same name; null where it has no row."""
    return df.drop(*columns).join(side.select(key, *columns), key, "left")


def with_lyrics(df: DataFrame, lyrics: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Lyrics onto tracks: overlapping columns are those of the lyrics, and flags are false where there are none."""
    columns = [c for c in lyrics.columns if c != key]
    return with_side(df, lyrics, key, columns).withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in flags})


def with_defaults(df: DataFrame, side: DataFrame, key: str, defaults: dict[str, float]) -> DataFrame:
    """Numbers of a side table by key, with defaults where it has no row or a null."""
    return with_side(df, side, key, list(defaults)).withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def with_profile(df: DataFrame, artist: Column, profiles: DataFrame, name: str, order: str, columns: list[str]) -> DataFrame:
    """The first profile of an artist's name, in whatever case it is written."""
    named = one_per_key(profiles.withColumn("_name", F.lower(F.trim(name))).select("_name", order, *columns), "_name", order, last=False).drop(order)
    return df.withColumn("_name", F.lower(F.trim(artist))).join(named, "_name", "left").drop("_name")


def with_bpm(df: DataFrame, tempos: DataFrame, key: str) -> DataFrame:
    """Adds bpm by key; nothing and zero are null."""
    return df.drop("bpm").join(tempos.select(key, F.nullif(F.col("bpm"), F.lit(0.0)).alias("bpm")), key, "left")


def aligned_vectors(df: DataFrame, vectors: DataFrame, key: str, vector: str, out: str) -> DataFrame:
    """Adds a vector less the mean of all that the catalogue has, of unit length; zeros where it has none.

    The mean is of the raw vectors that are there (partial sums by dimension, one row joined back), before gaps are filled.
    """
    met = df.join(vectors.select(key, F.col(vector).alias("_v")), key, "left")
    sums = met.select(F.posexplode("_v").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"))
    mean = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("_mean"))
    centred = F.zip_with("_v", "_mean", lambda x, m: x.cast("double") - m)
    length = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(centred, lambda x: x / F.coalesce(F.nullif(length, F.lit(0.0)), F.lit(1.0)))
    zeros = F.transform("_mean", lambda m: F.lit(0.0))
    return met.join(F.broadcast(mean)).withColumn(out, F.coalesce(unit, zeros)).drop("_v", "_mean")


def tag_vectors(df: DataFrame, tags: str, vector: Column, out: str, least: float = 0.5) -> DataFrame:
    """Adds the vector of tags, if at least the share ``least`` of the rows have tags; else null in all rows."""
    share = df.agg(F.avg((F.col(tags).isNotNull() & (F.trim(tags) != "") & (F.trim(tags) != "{}")).cast("double")).alias("_share"))
    return df.join(F.broadcast(share)).withColumn(out, F.when(F.col("_share") >= least, vector)).drop("_share")


def known_edges(edges: DataFrame, songs: DataFrame, src: str, dst: str) -> DataFrame:
    """(a, b) places in the catalogue of edges between tracks; those with an end that it hasn't are left out."""
    at = lambda k, o: songs.select(F.col("track_id").alias(k), F.col("song_idx").alias(o))
    return edges.join(at(src, "a"), src).join(at(dst, "b"), dst).select("a", "b").distinct()


def artist_rows(artists: DataFrame, refused: str) -> DataFrame:
    """(artist_id, name, subscribers, image_url) of nested artist records: none without id or name, none whose name the pattern
    refuses; of a repeated id the one with most subscribers."""
    flat = artists.select(F.col("id").alias("artist_id"), F.trim(F.regexp_replace("name", r"\s+-\s+Topic\s*$", "")).alias("name"), F.coalesce(F.col("subscribers").cast("long"), F.lit(0)).alias("subscribers"), F.try_element_at(F.transform("thumbnails", lambda t: t["url"]), F.lit(-1)).alias("image_url"))
    kept = flat.where(F.col("artist_id").isNotNull() & (F.trim("artist_id") != "") & F.col("name").isNotNull() & (F.col("name") != "") & ~F.col("name").rlike(refused))
    return one_per_key(kept.withColumn("_order", F.struct("subscribers", "name", "image_url")), "artist_id", "_order").drop("_order")


def annotations(parts: list[DataFrame], low: float = 1.0, width: float = 8.0) -> DataFrame:
    """Annotation tables as one: (song_id, valence, arousal), their column names trimmed, ratings scaled to 0..1."""
    out = None
    for df in parts:
        named = df.toDF(*[c.strip() for c in df.columns])
        rows = named.select("song_id", *[((F.col(c).cast("double") - low) / width).alias(c) for c in ("valence", "arousal")])
        out = rows if out is None else out.unionByName(rows)
    return out


def media_matches(hits: DataFrame, variant: str, tolerance_s: float = 15.0) -> DataFrame:
    """(track_id, media_id, score) of the best of (track_id, title, wanted_s, found_s, media_id, at): variants are left out; 1000
    less the difference in seconds where that is within the tolerance, 500 where it isn't known; then the first found."""
    apart = F.abs(F.col("wanted_s") - F.col("found_s"))
    score = F.when(apart.isNull(), 500.0).when(apart <= tolerance_s, 1000.0 - apart)
    rows = hits.where(~F.coalesce(F.col("title").rlike(variant), F.lit(False))).withColumn("score", score).where("score IS NOT NULL")
    best = rows.groupBy("track_id").agg(F.min_by(F.struct("media_id", "score"), F.struct(-F.col("score"), "at")).alias("b"))
    return best.select("track_id", "b.media_id", "b.score")


def ordered_credits(rows: DataFrame, names: str, ids: str, key: str) -> DataFrame:
    """(key, artists, artist_ids): names and ids of a credit in step, each name once by its normalised form."""
    pairs = F.transform(F.arrays_zip(T.artists(F.col(names)), F.split(F.coalesce(F.col(ids), F.lit("")), ",")), lambda x: F.struct(x["0"].alias("name"), F.trim(F.coalesce(x["1"], F.lit(""))).alias("id")))
    named = F.filter(pairs, lambda x: x["name"].isNotNull() & (T.match_text(x["name"]) != ""))
    once = F.filter(named, lambda x, i: ~F.exists(F.slice(named, F.lit(1), i), lambda y: T.match_text(y["name"]) == T.match_text(x["name"])))
    return rows.select(key, F.array_join(F.transform(once, lambda x: x["name"]), ", ").alias("artists"), F.array_join(F.transform(once, lambda x: x["id"]), ",").alias("artist_ids"))


def media_flags(df: DataFrame, manifest: DataFrame | None, listing: DataFrame, key: str) -> DataFrame:
    """Adds has_media: is the key in the manifest, or, where there is none or an empty one, in a listing of file paths?"""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    files = listing.select(stem.alias(key)).distinct()
    found = files
    if manifest is not None:
        any_ = manifest.agg((F.count(F.lit(1)) > 0).alias("_any"))
        found = manifest.select(key).distinct().unionByName(files.join(F.broadcast(any_)).where("NOT _any").select(key))
    return df.join(found.withColumn("has_media", F.lit(True)), key, "left").withColumn("has_media", F.coalesce("has_media", F.lit(False)))


def without_urls(df: DataFrame) -> DataFrame:
    """Without the columns whose name says that they hold addresses."""
    return df.drop(*[c for c in df.columns if c.lower().endswith(("_url", "_urls")) or c.lower() == "url"])


def upsert_known(old: DataFrame, new: DataFrame, songs: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` by key, where the catalogue has the key; others of ``old`` stay."""
    known = new.join(songs.select(key).distinct(), key, "left_semi")
    return old.join(known.select(key), key, "left_anti").unionByName(known)


def checked_vectors(df: DataFrame, vectors: DataFrame, key: str, vector: str, out: str) -> DataFrame:
    """Adds a unit vector by key if there are as many vectors as rows; else the signal is off: null in all rows."""
    sizes = df.agg(F.count(F.lit(1)).alias("_rows")).join(vectors.agg(F.count(F.lit(1)).alias("_vectors")))
    fits = sizes.select((F.col("_rows") == F.col("_vectors")).alias("_fits"))
    met = df.join(vectors.select(key, F.col(vector).alias("_v")), key, "left").join(F.broadcast(fits))
    return met.withColumn(out, F.when(F.col("_fits"), V.unit(F.col("_v")))).drop("_v", "_fits")


def canonical_credits(df: DataFrame, key: str, names: str) -> DataFrame:
    """(key, credits): credits in which each artist has one spelling: of those that are equal without marks the one with marks, then
    the one that is used most; where all spellings have marks, they stay. Spellings are counted over the whole table."""
    flat = df.select(key, F.posexplode(T.artists(F.col(names))).alias("at", "name")).withColumn("plain", T.match_text(F.col("name")))
    marked = F.lower("name") != T.no_marks(F.col("name"))
    counts = flat.groupBy("plain", "name").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("plain").agg(F.min(F.struct((~marked).alias("unmarked"), (-F.col("n")).alias("n"), "name")).alias("b"), F.bool_and(marked).alias("all_marked"))
    chosen = best.where("plain != '' AND NOT all_marked").select("plain", F.col("b.name").alias("to"))
    new = flat.join(chosen, "plain", "left").withColumn("name", F.coalesce("to", "name"))
    return new.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), ", ").alias("credits"))


def centred(df: DataFrame, vector: str, out: str) -> DataFrame:
    """Adds the vector of unit length less the mean of all, of unit length again; null stays null, zeros count as they are. The mean, as
    many numbers as a vector has, is a row that is sent with the tasks."""
    rows = df.withColumn("_u", V.unit(F.col(vector)))
    mean = rows.select(F.posexplode("_u").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("_mean"))
    return rows.join(F.broadcast(mean)).withColumn(out, V.unit(F.zip_with("_u", "_mean", lambda x, m: x - m))).drop("_u", "_mean")
