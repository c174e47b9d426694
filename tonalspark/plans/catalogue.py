"""Cleaning, integrity, browsing and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import emotion as E
from ..functions import predicates as P
from ..functions import text as T
from ..operators import catalogue as K
from ..operators import entities, ranks, search, vector_join
from .registry import query, songs, table


@query("browse_page", "WITH {songs} SELECT song_idx, title, artist, round(arousal, 6) AS arousal FROM songs WHERE contains(lower(mood), 'steel') OR regexp_matches(artist, '(?i)brand.*1') ORDER BY round(arousal, 9) DESC, song_idx LIMIT 20 OFFSET 20")
def browse_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 20 songs of a mood or an artist pattern, the liveliest first."""
    s = songs(spark, d).where(F.lower("mood").contains("steel") | F.col("artist").rlike("(?i)brand.*1"))
    return s.orderBy(F.round("arousal", 9).desc(), "song_idx").offset(20).limit(20).select("song_idx", "title", "artist", F.round("arousal", 6).alias("arousal"))


@query("artists_topn", "SELECT p_brand AS artist, count(*) AS n, min_by(p_name, p_partkey) AS sample FROM part GROUP BY p_brand ORDER BY n DESC, artist LIMIT 10")
def artists_topn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("artist")).agg(F.count(F.lit(1)).alias("n"), F.min_by("p_name", "p_partkey").alias("sample")).orderBy(F.col("n").desc(), "artist").limit(10)


@query("moods_having", "SELECT p_type AS mood, count(*) AS n, count(*) FILTER (p_size > 25) AS large FROM part GROUP BY p_type HAVING count(*) > 10")
def moods_having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_type").alias("mood")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 25).alias("large")).where("n > 10")


@query("profile_stats", "SELECT p_brand AS artist, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS sd, min(p_retailprice) AS low, max(p_retailprice) AS high, count(DISTINCT p_type) AS moods FROM part GROUP BY p_brand")
def profile_stats(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_retailprice")
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("artist")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean"), F.round(F.stddev_samp(p), 6).alias("sd"), F.min(p).alias("low"), F.max(p).alias("high"), F.count_distinct("p_type").alias("moods"))


@query("percentile_bounds", "SELECT round(quantile_cont(p_retailprice, 0.05), 6) AS low, round(quantile_cont(p_retailprice, 0.95), 6) AS high FROM part")
def percentile_bounds(spark: SparkSession, d: str) -> DataFrame:
    out = ranks.percentiles(table(spark, d, "part"), "p_retailprice", {"low": 0.05, "high": 0.95})
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("featured_pool", "WITH {songs} SELECT song_idx, round(0.5 * arousal + 0.3 * (bpm - 60) / 140 + 0.2 * valence, 6) AS score FROM songs ORDER BY round(0.5 * arousal + 0.3 * (bpm - 60) / 140 + 0.2 * valence, 6) DESC, song_idx LIMIT 30")
def featured_pool(spark: SparkSession, d: str) -> DataFrame:
    score = F.round(0.5 * F.col("arousal") + 0.3 * (F.col("bpm") - 60) / 140 + 0.2 * F.col("valence"), 6)
    return songs(spark, d).select("song_idx", score.alias("score")).orderBy(F.col("score").desc(), "song_idx").limit(30)


@query("newest_pool", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey DESC LIMIT 20")
def newest_pool(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").orderBy(F.col("p_partkey").desc()).limit(20).select("p_partkey", "p_name")


@query("dedup_keep_best", "SELECT md5(text) AS digest, min(doc_id) AS doc_id, max(n_chars) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1 GROUP BY md5(text)")
def dedup_keep_best(spark: SparkSession, d: str) -> DataFrame:
    """One document for each text. The digest stands for the text in the shuffle."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.md5(F.encode("text", "UTF-8")).alias("digest"))
    best = rows.groupBy("digest").agg(F.min(F.struct((-F.col("n_chars")).alias("k"), "doc_id")).alias("b"))
    return best.select("digest", "b.doc_id", (-F.col("b.k")).alias("n_chars"))


@query("dedup_normalized", "SELECT p_partkey, p_name, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1")
def dedup_normalized(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    return K.keep_first(p, [T.match_text(F.col("p_name")), T.match_text(F.col("p_brand"))], [F.col("p_retailprice").desc(), F.col("p_partkey").asc()]).drop("p_retailprice")


@query("canonical_value_per_key", "SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderpriority AS value, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY o_custkey, o_orderpriority) WHERE r = 1")
def canonical_value_per_key(spark: SparkSession, d: str) -> DataFrame:
    return K.canonical_values(table(spark, d, "orders"), F.col("o_custkey").cast("string"), "o_orderpriority")


_REASONS = [("long", "n_chars > 20000"), ("short", "n_chars < 150"), ("address", "regexp_matches(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')"), ("shouting", "text = upper(text)"), ("low_quality", "quality = 0"), ("toxic", "toxic = 1")]


def _reasons() -> list:
    text = F.col("text")
    return [("long", F.col("n_chars") > 20000), ("short", F.col("n_chars") < 150), ("address", text.rlike(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")), ("shouting", text == F.upper(text)), ("low_quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1)]


_CASE = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _REASONS) + " ELSE 'kept' END"


@query("quality_chain_counts", f"SELECT {_CASE} AS reason, count(*) AS rows FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def quality_chain_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return K.counts_by_reason(rows, _reasons())


@query("quality_reason", f"SELECT doc_id, {_CASE} AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def quality_reason(spark: SparkSession, d: str) -> DataFrame:
    """The first reason that applies. Conditions on the text are evaluated before the join, which carries no text."""
    rows = table(spark, d, "documents").select("doc_id", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in _reasons()[:4]])
    reason = F.lit("kept")
    for name, c in reversed([*[(n, F.col(n)) for n, _ in _reasons()[:4]], *_reasons()[4:]]):
        reason = F.when(c, name).otherwise(reason)
    return rows.join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", reason.alias("reason"))


@query("script_ratio_filter", "SELECT doc_id, length(regexp_replace(text, '[^À-ɏ]', '', 'g')) AS accented FROM documents WHERE length(regexp_replace(text, '[^À-ɏ]', '', 'g')) >= 3")
def script_ratio_filter(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.regexp_replace("text", "[^À-ɏ]", ""))
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("accented")).where("accented >= 3")


@query("profanity_filter", r"WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^\p{L}\p{N}]+') AS w FROM documents), n AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('thest', 'onst'))) AS hard, len(list_filter(w, lambda x: x IN ('es', 'thing'))) AS mild FROM w) SELECT doc_id, hard >= 3 OR mild >= 10 OR 4 * hard + mild >= 15 AS profane FROM n")
def profanity_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents with many hits of a hard and a mild list (made-up words of the test prose)."""
    hit = P.profane(F.col("text"), P.words_pattern(["thest", "onst"]), P.words_pattern(["es", "thing"]))
    return table(spark, d, "documents").select("doc_id", hit.alias("profane"))


@query("phase_contract_checks", "SELECT unnest(['least_rows', 'missing_columns', 'null_keys', 'repeated_keys']) AS check, unnest([greatest(10 - count(*), 0), 0, count(*) FILTER (o_orderkey IS NULL), count(o_orderkey) - count(DISTINCT o_orderkey)]) AS failures FROM orders")
def phase_contract_checks(spark: SparkSession, d: str) -> DataFrame:
    return K.contract(table(spark, d, "orders"), "o_orderkey", ["o_orderkey", "o_custkey"])


@query("orphan_check", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def orphan_check(spark: SparkSession, d: str) -> DataFrame:
    return K.orphans(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("latest_wins_upsert", "WITH new AS (SELECT o_custkey AS c_custkey, 'moved ' || o_custkey AS c_name, NULL::DOUBLE AS c_acctbal FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey) SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM customer o FULL JOIN new n USING (c_custkey)")
def latest_wins_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return K.upsert(old, new.select("c_custkey", F.concat(F.lit("moved "), F.col("c_custkey").cast("string")).alias("c_name"), F.lit(None).cast("double").alias("c_acctbal")), "c_custkey")


@query("coalesce_enrichment", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, total) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def coalesce_enrichment(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("c_acctbal"))
    more = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("c_acctbal"))
    return K.enrich(c, more, "c_custkey", ["c_acctbal"])


@query("bridge_explode", "WITH t AS (SELECT doc_id, source || ',' || lang || ', ' || source AS names FROM documents), e AS (SELECT doc_id, unnest(string_split(names, ',')) AS artist, generate_subscripts(string_split(names, ','), 1) - 1 AS position FROM t) SELECT doc_id, trim(artist) AS artist, CAST(min(position) AS INTEGER) AS position FROM e WHERE trim(artist) <> '' GROUP BY doc_id, trim(artist)")
def bridge_explode(spark: SparkSession, d: str) -> DataFrame:
    return K.exploded_credits(table(spark, d, "documents").select("doc_id", F.concat("source", F.lit(","), "lang", F.lit(", "), "source").alias("names")), "doc_id", "names")


_PAIRS = "pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM (SELECT doc_id, md5(text) AS h FROM documents) a JOIN (SELECT doc_id, md5(text) AS h FROM documents) b ON a.h = b.h AND a.doc_id < b.doc_id)"


def _same_text(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the first of its text: a star, not all pairs."""
    h = table(spark, d, "documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("h"))
    first = h.groupBy("h").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return h.join(first, "h").where("doc_id > a").select("a", F.col("doc_id").alias("b"))


@query("entity_components", "SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY md5(text)) AS label FROM documents QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1")
def entity_components(spark: SparkSession, d: str) -> DataFrame:
    return entities.components(_same_text(spark, d))


@query("entity_winner", "SELECT doc_id, min(doc_id) OVER w AS entity, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) = 1 AS winner FROM documents WINDOW w AS (PARTITION BY md5(text))")
def entity_winner(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    out = entities.winners(docs, entities.components(_same_text(spark, d)), "doc_id", [F.col("source").asc(), F.col("doc_id").asc()])
    return out.select("doc_id", "entity", "winner")


@query("merge_credits", "WITH f AS (SELECT lang AS entity, source, min(doc_id) AS first FROM documents GROUP BY lang, source) SELECT entity, string_agg(source, ', ' ORDER BY first) AS credits FROM f GROUP BY entity")
def merge_credits(spark: SparkSession, d: str) -> DataFrame:
    return entities.merged_credits(table(spark, d, "documents").select("doc_id", F.col("lang").alias("entity"), "source"), "entity", "source", "doc_id")


def _recordings(spark: SparkSession, d: str) -> DataFrame:
    """Tracks with credits, lyrics, lengths and lyrics ids that make some of them one recording, in chains too."""
    k, c = F.col("p_partkey"), F.col
    rows = table(spark, d, "part").join(table(spark, d, "documents").select(F.col("doc_id").alias("p_partkey"), "text"), "p_partkey", "left")
    name = F.concat("p_name", F.when(k % 5 == 0, F.concat(F.lit(" (feat. "), "p_brand", F.lit(")"))).when(k % 5 == 1, " ft. someone").otherwise(""))
    return rows.select(
        k.alias("id"), name.alias("track_name"), F.concat("p_brand", F.when(k % 3 == 0, ", Brand#3").otherwise("")).alias("artists"), F.when(k % 4 == 0, F.concat(F.lit("i"), (k % 9).cast("string"))).alias("artist_ids"),
        c("p_brand").alias("primary_artist"), F.lit(None).cast("string").alias("primary_artist_id"), (150_000 + c("p_size") * 1000).cast("long").alias("track_duration_ms"),
        F.when(k % 2 == 0, c("text")).alias("plain_lyrics"), F.when(k % 2 == 1, c("text")).alias("synced_lyrics"), F.when(k % 6 == 0, (k % 60).cast("string")).otherwise("nan").alias("lyrics_id"),
    )


@query("duplicate_entities")
def duplicate_entities(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of tracks that are one recording, by titles, credits, lengths, lyrics and audio."""
    near = vector_join.near_pairs(songs(spark, d).select("song_idx", "audio_vec"), 0.985 - 2e-6).where("cosine >= 0.985")
    return entities.duplicate_pairs(_recordings(spark, d), near)


@query(
    "lyrics_id_entities",
    r"""WITH r AS (SELECT p_partkey AS id, trim(regexp_replace(strip_accents(lower(p_name)), '[^a-z0-9]+', ' ', 'g')) AS title, CAST(p_partkey % 60 AS VARCHAR) AS t FROM part WHERE p_partkey % 6 = 0 AND p_name <> ''),
    p AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.title = b.title AND a.t = b.t AND a.id < b.id) SELECT b AS node, min(a) AS label FROM p GROUP BY b UNION SELECT a, a FROM p WHERE a NOT IN (SELECT b FROM p)""",
)
def lyrics_id_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entities that one title and one lyrics id make, by the same decision and its components."""
    rows = _recordings(spark, d).where("lyrics_id != 'nan'").withColumns({c: F.lit(None).cast("string") for c in ("plain_lyrics", "synced_lyrics")})
    return entities.components(entities.titled_pairs(rows))


@query("path_components", "WITH RECURSIVE e AS (SELECT doc_id AS a, doc_id + CASE WHEN doc_id % 50 = 48 THEN 100 ELSE 2 END AS b FROM documents WHERE doc_id % 7 <> 3), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, reach) AS (SELECT a, a FROM n UNION SELECT r.node, n.b FROM r JOIN n ON r.reach = n.a) SELECT node, min(reach) AS label FROM r GROUP BY node")
def path_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of long paths, whose labels have to travel."""
    i = F.col("doc_id")
    return entities.components(table(spark, d, "documents").where("doc_id % 7 != 3").select(i.alias("a"), (i + F.when(i % 50 == 48, 100).otherwise(2)).alias("b")))


@query("fuzzy_token_match", "WITH t AS (SELECT p_partkey AS id, p_brand AS artist, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_type || ' ' || p_partkey // 10), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM part), l AS (SELECT id, artist, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_type || ' ' || p_partkey // 10), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM (SELECT p_partkey AS id, p_brand AS artist, * FROM part WHERE p_partkey % 100 = 0)), m AS (SELECT l.id AS left_id, t.id AS right_id, round(0.7 * len(list_intersect(l.w, t.w)) / len(list_distinct(list_concat(l.w, t.w))) + CASE WHEN l.artist = t.artist THEN 0.3 ELSE 0 END, 9)::DOUBLE AS score FROM l, t WHERE len(list_intersect(l.w, t.w)) > 0) SELECT left_id, right_id, score FROM m WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) = 1")
def fuzzy_token_match(spark: SparkSession, d: str) -> DataFrame:
    """For every hundredth part the best match of its name among all parts."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("artist"), F.concat_ws(" ", "p_type", F.expr("p_partkey div 10")).alias("title"))
    return search.best_token_match(p.where("id % 100 = 0"), p)


@query("playlist_cooccurrence", "WITH i AS (SELECT DISTINCT o_custkey AS playlist, l_partkey AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT a.item AS seed, b.item AS related, count(*) AS n FROM i a JOIN i b ON a.playlist = b.playlist AND a.item <> b.item WHERE a.item % 100 = 0 GROUP BY a.item, b.item")
def playlist_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """What customers of every hundredth part also bought: the seeds' rows meet a customer's, not all meet all."""
    o, l = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    items = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("playlist"), F.col("l_partkey").alias("item")).distinct()
    seeds = items.where("item % 100 = 0").withColumnRenamed("item", "seed")
    return items.join(seeds, "playlist").where("item != seed").groupBy("seed", F.col("item").alias("related")).agg(F.count(F.lit(1)).alias("n"))


@query("lexicon_emotion")
def lexicon_emotion(spark: SparkSession, d: str) -> DataFrame:
    lexicon = E.Lexicon({"happy": ("the", "les", "die"), "sad": ("of", "de", "und"), "nostalgia": ("is", "es")}, ("and", "very"), ("not", "pas", "nicht", "that"), ("but", "mais", "for"), frozenset({"happy"}), frozenset({"sad"}))
    scores = E.lexicon_scores(F.col("text"), lexicon)
    rows = table(spark, d, "conversations").select("conv_id", "turn", scores.alias("s"))
    return rows.select("conv_id", "turn", *[F.round(F.coalesce(F.try_element_at("s", F.lit(k)), F.lit(0.0)), 6).alias(k) for k in ("happy", "sad", "nostalgia")], F.round(E.scores_to_va(F.col("s"))["valence"], 6).alias("valence"))


@query("grounded_valence")
def grounded_valence(spark: SparkSession, d: str) -> DataFrame:
    v = E.grounded_valence(F.col("text"), {"the": 0.7, "of the": 0.9, "and": 0.3, "is": 0.6, "de la": 0.2, "les": 0.8}, ("not", "that", "pas"))
    return table(spark, d, "documents").select("doc_id", F.round(v, 6).alias("valence"))


@query("variants_limited", "SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size > 10 ORDER BY p_partkey) AS n FROM part) WHERE NOT p_size > 10 OR n <= 3")
def variants_limited(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return K.limit_variants(p, F.col("p_brand"), F.col("p_size") > 10, [F.col("p_partkey").asc()]).select("p_partkey")


@query("blocked_artists", "SELECT p_partkey FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part GROUP BY p_brand HAVING max(p_retailprice) < (SELECT avg(p_retailprice) FROM part) * 1.5 AND NOT bool_or(p_size = 50))")
def blocked_artists(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice", (F.col("p_size") == 50).alias("hot"))
    mean = p.agg((F.avg("p_retailprice") * 1.5).alias("least"))
    return K.blocked_artists(p.join(F.broadcast(mean)), "p_brand", "p_retailprice", "hot", F.col("least")).select("p_partkey")
