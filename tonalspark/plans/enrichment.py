"""Side tables onto a catalogue, and sources as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrichment as N
from ..sources import catalogue as S
from ..sources.tracks import tracks
from .registry import query, songs, table


@query("side_columns", "WITH {tracks}, side AS (SELECT CAST(vec_id * 2 AS VARCHAR) AS track_id, vec_id / 10.0::DOUBLE AS tempo, 'l' || label AS plain_lyrics, label % 2 = 0 AS has_lyrics FROM embeddings) SELECT t.track_id, s.tempo, s.plain_lyrics, coalesce(s.has_lyrics, false) AS has_lyrics FROM tracks t LEFT JOIN side s USING (track_id)")
def side_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of another store replace those of the same name; lyrics flags are false where it has nothing."""
    e = table(spark, d, "embeddings")
    side = e.select((F.col("vec_id") * 2).cast("string").alias("track_id"), (F.col("vec_id") / 10).alias("tempo"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("plain_lyrics"), (F.col("label") % 2 == 0).alias("has_lyrics"))
    rows = N.with_side(tracks(spark, d), side, "track_id", ["tempo"])
    return N.with_lyrics(rows, side.drop("tempo"), "track_id", ["has_lyrics"]).select("track_id", "tempo", "plain_lyrics", "has_lyrics")


@query("default_moods", "WITH {tracks}, m AS (SELECT CAST(vec_id * 3 AS VARCHAR) AS track_id, CASE WHEN label > 0 THEN label / 10.0::DOUBLE END AS valence, vec_id / 600.0::DOUBLE AS arousal FROM embeddings) SELECT t.track_id, coalesce(m.valence, 0.5::DOUBLE) AS valence, coalesce(m.arousal, 0.5::DOUBLE) AS arousal FROM tracks t LEFT JOIN m USING (track_id)")
def default_moods(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select((F.col("vec_id") * 3).cast("string").alias("track_id"), F.when(F.col("label") > 0, F.col("label") / 10).alias("valence"), (F.col("vec_id") / 600).alias("arousal"))
    return N.with_defaults(tracks(spark, d), e, "track_id", {"valence": 0.5, "arousal": 0.5}).select("track_id", "valence", "arousal")


@query("artist_profiles", "WITH {tracks}, p AS (SELECT upper(p_brand) AS name, p_partkey AS at, 'http://faces/' || p_partkey AS image FROM part WHERE p_size > 3 QUALIFY row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) = 1) SELECT track_id, image FROM tracks LEFT JOIN p ON lower(trim(primary_artist)) = lower(name)")
def artist_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The first profile of each artist's name."""
    p = table(spark, d, "part").where("p_size > 3").select(F.upper("p_brand").alias("name"), F.col("p_partkey").alias("at"), F.concat(F.lit("http://faces/"), F.col("p_partkey").cast("string")).alias("image"))
    return N.with_profile(tracks(spark, d), F.col("primary_artist"), p, "name", "at", ["image"]).select("track_id", "image")


@query("bpm_lookup", "WITH {tracks}, b AS (SELECT CAST(vec_id AS VARCHAR) AS track_id, (label * 20)::DOUBLE AS bpm FROM embeddings) SELECT track_id, nullif(bpm, 0) AS bpm FROM tracks LEFT JOIN b USING (track_id)")
def bpm_lookup(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("track_id"), (F.col("label") * 20).cast("double").alias("bpm"))
    return N.with_bpm(tracks(spark, d), b, "track_id").select("track_id", "bpm")


@query("aligned_vectors", "WITH v AS (SELECT p_partkey, embedding::DOUBLE[] AS v FROM part LEFT JOIN embeddings ON vec_id * 2 = p_partkey), u AS (SELECT p_partkey, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM v), m AS (SELECT dim, avg(x) AS m FROM u GROUP BY dim), c AS (SELECT p_partkey, dim, x - m AS x FROM u JOIN m USING (dim)), n AS (SELECT p_partkey, sqrt(sum(x * x)) AS n, max_by(x, -dim) AS first, max_by(x, dim) AS last FROM c GROUP BY p_partkey) SELECT p_partkey, round(coalesce(first / n, 0), 6) AS first, round(coalesce(last / n, 0), 6) AS last FROM part LEFT JOIN n USING (p_partkey)")
def aligned_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Another model's vectors in the catalogue's order, centred; zeros where it has none."""
    v = table(spark, d, "embeddings").select((F.col("vec_id") * 2).alias("p_partkey"), "embedding")
    out = N.aligned_vectors(table(spark, d, "part").select("p_partkey"), v, "p_partkey", "embedding", "v")
    return out.select("p_partkey", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


_TAGS = """SELECT p_partkey, CASE WHEN p_partkey % 10 < {0} THEN '{{"SMALL": ' || p_size || ', "' || p_type || '": 2.5, "other": 1}}' WHEN p_partkey % 10 = 9 THEN 'broken' END AS tags FROM part"""


def _tags(few: int):
    n, text = F.col("p_partkey") % 10, F.concat(F.lit('{"SMALL": '), F.col("p_size").cast("string"), F.lit(', "'), F.col("p_type"), F.lit('": 2.5, "other": 1}'))
    return F.when(n < few, text).when(n == 9, "broken")


@query("tag_vectors", f"WITH t AS ({_TAGS.format(7)}), m AS (SELECT p_partkey, tags, CASE WHEN tags LIKE '{{%' THEN CASE WHEN tags LIKE '%\"SMALL\": 2.5%' THEN NULL ELSE json_extract(tags, '$.SMALL')::DOUBLE END END AS s, CASE WHEN tags LIKE '{{%' THEN json_extract(tags, '$.ECONOMY')::DOUBLE END AS e FROM t WHERE tags IS NULL OR tags NOT LIKE '%SMALL%SMALL%'), v AS (SELECT p_partkey, coalesce(s, 0) AS s, coalesce(e, 0) AS e FROM m) SELECT p_partkey, round(s / coalesce(nullif(sqrt(s * s + e * e), 0), 1), 6) AS small, round(e / coalesce(nullif(sqrt(s * s + e * e), 0), 1), 6) AS economy FROM v")
def tag_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Tags as vectors over a vocabulary; broken JSON counts as no tags."""
    rows = table(spark, d, "part").select("p_partkey", "p_type", _tags(7).alias("tags")).where("p_type != 'SMALL' OR tags IS NULL OR tags = 'broken'")
    out = N.tag_vectors(rows, "tags", S.tags_to_vector("tags", ["SMALL", "ECONOMY"]), "v")
    return out.select("p_partkey", F.round(F.get("v", F.lit(0)), 6).alias("small"), F.round(F.get("v", F.lit(1)), 6).alias("economy"))


@query("tag_signal_off", "SELECT p_partkey, NULL::DOUBLE AS small FROM part")
def tag_signal_off(spark: SparkSession, d: str) -> DataFrame:
    """With too few tags in the catalogue the signal is off for all."""
    rows = table(spark, d, "part").select("p_partkey", _tags(3).alias("tags"))
    return N.tag_vectors(rows, "tags", S.tags_to_vector("tags", ["SMALL"]), "v").select("p_partkey", F.get("v", F.lit(0)).alias("small"))


@query("known_covers", "WITH {songs}, e AS (SELECT CAST(o_custkey AS VARCHAR) AS src, CAST(o_orderkey % 700 AS VARCHAR) AS dst FROM orders) SELECT DISTINCT a.song_idx AS a, b.song_idx AS b FROM e JOIN songs a ON a.track_id = src JOIN songs b ON b.track_id = dst")
def known_covers(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("src"), (F.col("o_orderkey") % 700).cast("string").alias("dst"))
    return N.known_edges(edges, songs(spark, d), "src", "dst")


@query("artist_rows", "WITH a AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'c' || (c_custkey % 400) END AS id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name || CASE WHEN c_custkey % 2 = 0 THEN ' - Topic' ELSE '' END END AS name, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_acctbal AS INTEGER) END AS subs, 'u' || c_custkey AS url FROM customer), f AS (SELECT id, trim(regexp_replace(name, '\\s+-\\s+Topic\\s*$', '')) AS name, coalesce(subs, 0)::BIGINT AS subs, url FROM a WHERE name IS NOT NULL AND id <> '' AND NOT regexp_matches(name, '9 ?- Topic$|99')) SELECT id AS artist_id, name, subs AS subscribers, url AS image_url FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY subs DESC, name DESC, url DESC) = 1")
def artist_rows(spark: SparkSession, d: str) -> DataFrame:
    """Artist records as rows: without ids, names or with refused names they go."""
    k = F.col("c_custkey")
    nested = table(spark, d, "customer").select(
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("c"), (k % 400).cast("string"))).alias("id"),
        F.when(k % 11 != 0, F.concat("c_name", F.when(k % 2 == 0, " - Topic").otherwise(""))).alias("name"),
        F.when(k % 3 > 0, F.bround("c_acctbal", 0).cast("int")).alias("subscribers"),
        F.array(F.struct(F.lit("small").alias("url")), F.struct(F.concat(F.lit("u"), k.cast("string")).alias("url"))).alias("thumbnails"),
    )
    nested = nested.where("name IS NULL OR NOT name RLIKE '9 ?- Topic$'")
    return N.artist_rows(nested, "99")


@query("annotation_union", "SELECT CAST(p_partkey AS VARCHAR) AS song_id, (p_size % 9 + 1 - 1) / 8.0::DOUBLE AS valence, (p_partkey % 9 + 1 - 1) / 8.0::DOUBLE AS arousal FROM part UNION ALL SELECT 's' || s_suppkey, (s_nationkey % 9) / 8.0::DOUBLE, (s_suppkey % 9) / 8.0::DOUBLE FROM supplier")
def annotation_union(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias(" song_id"), (F.col("p_size") % 9 + 1).alias(" valence "), (F.col("p_partkey") % 9 + 1).alias("arousal "))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("song_id"), (F.col("s_nationkey") % 9 + 1).alias("valence"), (F.col("s_suppkey") % 9 + 1).alias("arousal"))
    return N.annotations([p, s])


@query(
    "media_matches",
    """WITH h AS (SELECT l_orderkey % 500 AS track_id, l_shipdate, l_linenumber, l_partkey AS media_id, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber % 5 = 0 THEN 'live at home' ELSE 'song' END AS title, CASE WHEN l_suppkey % 4 > 0 THEN l_quantity END AS found_s FROM lineitem),
    s AS (SELECT *, CASE WHEN found_s IS NULL THEN 500 WHEN abs(30 - found_s) <= 15 THEN 1000 - abs(30 - found_s) END::DOUBLE AS score FROM h WHERE NOT regexp_matches(title, 'live')) SELECT track_id, media_id, score FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY score DESC, pos, media_id) = 1""",
)
def media_matches(spark: SparkSession, d: str) -> DataFrame:
    """The recording found for each track whose length fits best."""
    l = table(spark, d, "lineitem")
    hits = l.select((F.col("l_orderkey") % 500).alias("track_id"), F.col("l_partkey").alias("media_id"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.col("l_partkey").alias("m")).alias("at"), F.when(F.col("l_linenumber") % 5 == 0, "live at home").otherwise("song").alias("title"), F.lit(30.0).alias("wanted_s"), F.when(F.col("l_suppkey") % 4 > 0, F.col("l_quantity")).alias("found_s"))
    return N.media_matches(hits, "live")


@query("media_flags", "WITH {tracks} SELECT track_id, ord % 2 = 0 AS has_media FROM tracks")
def media_flags(spark: SparkSession, d: str) -> DataFrame:
    """Which tracks have a file, by a listing, since the manifest is empty."""
    rows = tracks(spark, d).select("track_id", "ord")
    listing = rows.where("ord % 2 = 0").select(F.concat(F.lit("file:/media/x.y/"), "track_id", F.lit(".mp3")).alias("path"))
    return N.media_flags(rows, rows.where("false").select("track_id"), listing, "track_id").select("track_id", "has_media")


@query("known_vector_upsert", "WITH old AS (SELECT vec_id, label FROM embeddings), new AS (SELECT vec_id * 2 AS vec_id, label + 100 AS label FROM embeddings WHERE vec_id * 2 IN (SELECT p_partkey FROM part WHERE p_partkey % 3 > 0)) SELECT coalesce(n.vec_id, o.vec_id) AS vec_id, coalesce(n.label, o.label) AS label FROM old o FULL JOIN new n USING (vec_id)")
def known_vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "embeddings").select("vec_id", "label")
    new = old.select((F.col("vec_id") * 2).alias("vec_id"), (F.col("label") + 100).alias("label"))
    return N.upsert_known(old, new, table(spark, d, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("vec_id")), "vec_id")


@query("credit_pairs", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_brand || ', guest' END AS artists, CASE WHEN p_partkey % 3 = 0 THEN 'a' WHEN p_partkey % 3 = 1 THEN 'a,c' ELSE 'a,' END AS artist_ids FROM part")
def credit_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Names and ids of credits in step, each name once."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_brand"), F.lit(", "), F.upper("p_brand"), F.when(F.col("p_partkey") % 3 != 0, ", guest").otherwise("")).alias("names"), F.when(F.col("p_partkey") % 3 == 0, "a,b").when(F.col("p_partkey") % 3 == 1, "a, b, c").otherwise("a,b").alias("ids"))
    return N.ordered_credits(p, "names", "ids", "p_partkey")


@query("matrix_check", "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, NULL::DOUBLE AS off FROM embeddings")
def matrix_check(spark: SparkSession, d: str) -> DataFrame:
    """A matrix of as many rows as the catalogue is used, one of fewer isn't."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    on = N.checked_vectors(e.select("vec_id"), e, "vec_id", "embedding", "v")
    off = N.checked_vectors(on, e.where("vec_id > 3"), "vec_id", "embedding", "w")
    return off.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.get("w", F.lit(0)).alias("off"))


@query("canonical_credits", "WITH f AS (SELECT p_partkey, 0 AS pos, CASE p_partkey % 5 WHEN 0 THEN 'Sơn' WHEN 1 THEN 'Son' WHEN 2 THEN 'SON' WHEN 3 THEN 'Hà' ELSE p_brand END AS name FROM part UNION ALL SELECT p_partkey, 1, CASE WHEN p_partkey % 2 = 0 THEN 'HÀ' ELSE 'beta' END FROM part) SELECT p_partkey, string_agg(CASE WHEN name IN ('Son', 'SON') THEN 'Sơn' ELSE name END, ', ' ORDER BY pos) AS credits FROM f GROUP BY p_partkey")
def canonical_credits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    first = F.when(k % 5 == 0, "Sơn").when(k % 5 == 1, "Son").when(k % 5 == 2, "SON").when(k % 5 == 3, "Hà").otherwise(F.col("p_brand"))
    rows = table(spark, d, "part").select("p_partkey", F.concat(first, F.lit(", "), F.when(k % 2 == 0, "HÀ").otherwise("beta")).alias("names"))
    return N.canonical_credits(rows, "p_partkey", "names")
