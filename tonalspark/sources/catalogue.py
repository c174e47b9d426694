"""Readers: the test tables, the song catalogue, and files of the kinds a catalogue comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators.ranks import with_rank
from .shared import exists, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_prepared: dict[tuple, str] = {}


def state_of(spark: SparkSession, *paths: str) -> tuple:
    """Names, lengths and times of the files of some tables: another state means that a table was written anew."""
    out = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        out += sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where))
    return tuple(out)


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared catalogue of a folder: made once for an application, written to the shared folder and read from there, as
    a service prepares its features before it answers queries. It is made again if the written table is gone, or if the files
    of the tables that it is made of have changed."""
    key = (spark.sparkContext.applicationId, sf_dir, state_of(spark, *[f"{sf_dir}/{t}.parquet" for t in ("embeddings", "part")]))
    path = _prepared.get(key)
    if path is None or not exists(spark, f"{path}/_SUCCESS"):
        path = _prepared[key] = written(catalogue(spark, sf_dir), "songs")
    return spark.read.schema(SONGS_SCHEMA).parquet(path)


SONGS_SCHEMA = "song_idx long, track_id string, title string, artist string, mood string, bpm double, popularity double, size int, label int, audio_vec array<double>, lyrics_vec array<double>, valence double, arousal double"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue made of ``embeddings`` and ``part``: audio vectors with names, tempo, popularity, and a place in mood
    space by the ranks of price and size. The lyrics vector is the first half of the audio vector, of unit length."""
    e, p = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "part")
    base = e.join(p.hint("merge"), e["vec_id"] == p["p_partkey"]).select(  # small files hold many rows: neither side is sent whole
        F.col("vec_id").alias("song_idx"),
        F.col("p_partkey").cast("string").alias("track_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("mood"),
        (60 + 140 * (F.col("p_size") - 1) / 49).alias("bpm"),
        F.col("p_retailprice").alias("popularity"),
        F.col("p_size").alias("size"),
        "label",
        F.transform("embedding", lambda x: x.cast("double")).alias("audio_vec"),
        V.unit(F.slice("embedding", 1, 32)).alias("lyrics_vec"),
    )
    ranked = with_rank(with_rank(base, "popularity", "valence"), "size", "arousal")
    return ranked.select(*[c.split()[0] for c in SONGS_SCHEMA.split(", ")])


def csv(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """A CSV or TSV with a header and a stated schema; malformed numbers become null."""
    return spark.read.schema(schema).option("header", True).option("sep", separator).option("mode", "PERMISSIVE").csv(path)


def polarity_lexicon(df: DataFrame) -> DataFrame:
    """(term, valence, n_words) of (term, positive, negative): .75 or .25, ties left out."""
    v = F.when(F.col("positive") > F.col("negative"), 0.75).when(F.col("positive") < F.col("negative"), 0.25)
    return df.select(F.lower("term").alias("term"), v.alias("valence")).where("valence is not null").withColumn("n_words", F.size(F.split("term", " ")))


def valence_lexicon(df: DataFrame, least: float = 0.12) -> DataFrame:
    """(term, valence, arousal, n_words) of one- and two-word terms that are not near neutral."""
    out = df.withColumn("n_words", F.size(F.split("term", " ")))
    return out.where((F.abs(F.col("valence") - 0.5) >= least) & (F.col("n_words") <= 2))


def tags_to_vector(tags: str, vocabulary: list[str]):
    """A column of JSON {tag: share} as a vector over the vocabulary, of unit length; zeros for null or broken JSON."""
    m = F.from_json(F.col(tags), "map<string,double>")
    raw = F.transform(F.array(*map(F.lit, vocabulary)), lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0.0)))
    return V.unit(raw)


def flat_tracks(nested: DataFrame) -> DataFrame:
    """Flat rows of nested track records: first artist, joined names, last picture, seconds of the clock and the year."""
    names = F.transform("artists", lambda a: a["name"])
    return nested.select(
        F.col("videoId").alias("track_id"),
        F.col("title").alias("track_name"),
        F.get(names, 0).alias("primary_artist"),
        F.array_join(names, ", ").alias("artists"),
        F.array_join(F.transform("artists", lambda a: a["id"]), ", ").alias("artist_ids"),
        F.col("album.name").alias("album_name"),
        F.try_element_at(F.transform("thumbnails", lambda t: t["url"]), F.lit(-1)).alias("art_url"),
        (F.coalesce(F.col("duration_seconds").cast("long"), T.seconds(F.col("duration"))) * 1000).alias("track_duration_ms"),
        T.year(F.col("year")).alias("year"),
    )


def nested_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows of a JSON file of nested track records: one object with a list ``tracks``, a list of records, or one record a line."""
    record = "struct<videoId:string,title:string,artists:array<struct<name:string,id:string>>,album:struct<name:string>,thumbnails:array<struct<url:string>>,duration_seconds:long,duration:string,year:string>"
    whole = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("value"))
    one = F.from_json("value", f"tracks array<{record}>")["tracks"]
    many = F.from_json("value", f"array<{record}>")
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, record))
    found = F.when(F.col("value").startswith("["), many).when(one.isNotNull(), one).otherwise(lines)
    return flat_tracks(whole.select(F.explode(found).alias("t")).select("t.*").where("videoId IS NOT NULL"))


def artist_profiles(spark: SparkSession, profiles: str, artists: str) -> DataFrame:
    """(key, image_url, genres, followers) of a JSON file of profiles by name, or, where it is missing or has none, (artist_id,
    thumbnail_url) of a CSV file of artists with a byte-order mark or without, those that have both."""
    fields = "image_url:string,genres:array<string>,followers:long"
    columns = ["key", "image_url", "genres", "followers"]
    if exists(spark, profiles):
        whole = spark.read.option("wholetext", True).text(profiles).select(F.from_json("value", f"map<string,struct<{fields}>>").alias("m"))
        found = whole.select(F.explode("m").alias("key", "p")).select("key", "p.*")
        if not found.isEmpty():
            return found.select(*columns)
    if not exists(spark, artists):
        return spark.createDataFrame([], "key string, image_url string, genres array<string>, followers long")
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(artists)
    rows = rows.withColumnsRenamed({c: c.lstrip("\ufeff").strip() for c in rows.columns})
    key, url = F.trim("artist_id"), F.trim("thumbnail_url")
    return rows.where((key != "") & (url != "")).select(key.alias("key"), url.alias("image_url"), F.lit(None).cast("array<string>").alias("genres"), F.lit(None).cast("long").alias("followers"))


def sought(df: DataFrame, tiers: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """Adds ``value``, the first non-blank one of several named sources (key, value) in their order, and found_in: the source's name, or
    'not found'. Rows without a key look nowhere. A source that has several values of a key gives its smallest."""
    for i, (_, tier) in enumerate(tiers):
        given = F.nullif(F.trim(value), F.lit(""))
        df = df.join(tier.groupBy(key).agg(F.min(given).alias(f"_{i}")), key, "left")
    name = F.lit("not found")
    for i, (n, _) in reversed([*enumerate(tiers)]):
        name = F.when(F.col(f"_{i}").isNotNull(), n).otherwise(name)
    return df.withColumns({value: F.coalesce(*[F.col(f"_{i}") for i in range(len(tiers))]), "found_in": name}).drop(*[f"_{i}" for i in range(len(tiers))])


def first_tier(df: DataFrame, tiers: list[DataFrame], key: str, value: str) -> DataFrame:
    """Adds ``value`` from the first of several sources (key, value) that has a non-blank one."""
    for i, tier in enumerate(tiers):
        df = df.join(tier.select(key, F.nullif(F.trim(value), F.lit("")).alias(f"_{i}")), key, "left")
    return df.withColumn(value, F.coalesce(*[F.col(f"_{i}") for i in range(len(tiers))])).drop(*[f"_{i}" for i in range(len(tiers))])
