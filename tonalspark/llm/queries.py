"""The queries of this subpackage, by name; each takes (spark, sf_dir) and returns its full result."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, importance, jaccard_join, language_id, line_dedup, mixing, neighbours, sharding, token_counts, url_filter, vector_codes, warc
from .common import scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    """The file of a public vocabulary; TOKENIZER_DIR overrides where the installed package keeps it."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"), labels, RULES)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"), min_chars=40, min_docs=5, carry=[])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.survey(_read(spark, sf_dir, "documents"), fraction=0.5, temper=0.5)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_read(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"), k=3, percent=90)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_survey(_read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(_read(spark, sf_dir, "documents"), scratch(spark, "shards"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"), min_bytes=0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(_read(spark, sf_dir, "embeddings"), every=20, k=20)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.importance(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), most=1, buckets=10_000, least_words=20, percent=10, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.survey(_read(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, unit=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and k[2].isdigit()}


_LINES = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_SHARDS = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"


_CODES = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v, len(embedding) // 4 AS w FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * w + 1 : p * w + w] AS x FROM kept, range(4) AS t(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, x AS c FROM parts QUALIFY j < 256
){rounds}, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', CAST(best % 256 AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM near4 GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, j)) FROM book4) AS codebooks_sha256
FROM coded
"""

#: Nearest entries by squared distance, ties to the lower index; all numbers are whole and doubles hold them.
_NEAR = """, near{n} AS MATERIALIZED (
  SELECT vec_id, label, a.p, any_value(x) AS x, min(CAST(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS BIGINT) * 256 + j) AS best
  FROM parts a JOIN book{n} b ON a.p = b.p GROUP BY vec_id, label, a.p
)"""

_BOOK = """, book{m} AS MATERIALIZED (
  SELECT p, j, coalesce(n.c, o.c) AS c FROM book{n} o LEFT JOIN (
    SELECT p, j, list(floor(s / k) ORDER BY i) AS c FROM (
      SELECT p, best % 256 AS j, i, sum(x[i]) AS s, count(*) AS k FROM near{n}, range(1, 1 + (SELECT max(len(c)) FROM book0)) AS t(i) GROUP BY ALL
    ) GROUP BY p, j
  ) n USING (p, j)
)"""


def oracle_sql() -> dict[str, str]:
    """Of what SQL can express; the tests hold the other queries against brute force."""
    rounds = "".join(_NEAR.format(n=n) + _BOOK.format(n=n, m=n + 1) for n in range(4)) + _NEAR.format(n=4)
    return {"op2_line_dedup": _LINES, "op8_sharding": _SHARDS, "op13_vector_codes": _CODES.replace("{rounds}", rounds)}
