"""Raw tracks before cleaning, made of ``part`` and ``documents`` by expressions that Spark and other SQL engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One row for each part: names with every kind of flaw that cleaning looks for, counts, years, lyrics and audio features.
TRACKS = """
SELECT p_partkey AS ord, CAST(p_partkey AS STRING) AS track_id,
  CASE p_partkey % 20 WHEN 0 THEN p_name || ' (Live)' WHEN 1 THEN p_brand || ' | ' || p_name WHEN 2 THEN CASE WHEN p_brand LIKE '%2%' THEN 'Dem ' ELSE 'Đêm ' END || p_name WHEN 3 THEN p_name || ' (feat. Brand#3)'
    WHEN 4 THEN 'Christmas ' || p_name WHEN 5 THEN p_name || ' Remix' WHEN 6 THEN 'Nursery ' || p_name WHEN 7 THEN 'Ночь ' || p_name WHEN 8 THEN CASE WHEN p_brand LIKE '%2%' THEN 'Mua ' ELSE 'Mưa ' END || p_name
    WHEN 9 THEN 'Schön ' || p_name WHEN 10 THEN 'Damn ' || p_name WHEN 11 THEN p_name || ' OST' WHEN 12 THEN CASE WHEN p_brand LIKE '%2%' THEN 'mit ' ELSE 'là một ' END || p_name WHEN 13 THEN 'Bolero ' || p_name
    WHEN 14 THEN 'Springtime ' || p_name WHEN 16 THEN 'la mot ' || p_name || ' cua' WHEN 17 THEN CASE WHEN p_partkey % 40 = 17 THEN 'hỏi ' ELSE 'Tỉnh nghĩ hỏi ' END || p_name WHEN 19 THEN 'la ' || p_name WHEN 18 THEN CASE WHEN p_brand LIKE '%2%' THEN 'be ' ELSE 'bê ' END || p_name || ' la' WHEN 15 THEN CASE WHEN p_brand LIKE '%2%' THEN 'Duro ' ELSE 'Đuro ' END || p_name || ' moja' ELSE p_name || ' ' || CAST(p_partkey % 7 AS STRING) END AS track_name,
  CASE WHEN p_partkey % 17 = 0 THEN 'Hits Channel' WHEN p_partkey % 23 = 0 THEN 'Sơn ' || p_brand WHEN p_partkey % 41 = 0 THEN '2019-01-02' ELSE p_brand END AS primary_artist,
  CASE WHEN p_partkey % 17 = 0 THEN 'Hits Channel' WHEN p_partkey % 23 = 0 THEN 'Sơn ' || p_brand WHEN p_partkey % 41 = 0 THEN '2019-01-02' ELSE p_brand END
    || CASE WHEN p_partkey % 3 = 0 THEN ', Brand#' || CAST(p_partkey % 25 AS STRING) ELSE '' END AS artists,
  CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE 'a' || p_brand END AS primary_artist_id,
  CASE p_partkey % 9 WHEN 0 THEN 'Tour 2019' WHEN 1 THEN 'Winter Songs' WHEN 2 THEN 'Original Soundtrack' WHEN 3 THEN NULL WHEN 4 THEN 'Old Ballads' WHEN 5 THEN 'For Kids' WHEN 6 THEN 'Talk Show' ELSE p_type END AS album_name,
  CAST(p_partkey % 50 AS STRING) AS album_id,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(100000 + p_size * 6000 AS BIGINT) END AS track_duration_ms,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST((p_partkey * 7) % 60 AS INT) END AS track_popularity,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_partkey * 7919) % 300000 END AS view_count,
  CASE WHEN p_partkey % 6 < 2 THEN NULL ELSE CAST(2006 + p_partkey % 19 AS INT) END AS year,
  CASE WHEN p_partkey % 6 = 0 THEN CAST(2004 + p_partkey % 21 AS STRING) || '-03-04' WHEN p_partkey % 6 = 2 THEN 'nan' END AS release_date,
  CASE WHEN p_partkey % 31 = 0 THEN 'chart' END AS hot_source,
  CASE WHEN p_partkey % 14 = 0 THEN '' ELSE text END AS plain_lyrics, CASE WHEN p_partkey % 14 = 0 THEN text END AS synced_lyrics, lang AS lyrics_lang,
  CAST((p_partkey * 37) % 100 AS DOUBLE) / 100 AS lyrics_probability, CAST((p_partkey * 13) % 100 AS DOUBLE) / 400 AS local_probability,
  p_partkey % 13 = 0 AS instrumental,
  CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST((p_partkey * 3) % 101 AS DOUBLE) / 100 END AS valence,
  CASE WHEN p_partkey % 15 = 0 THEN NULL ELSE CAST((p_partkey * 11) % 101 AS DOUBLE) / 100 END AS energy,
  CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE CAST((p_partkey * 17) % 101 AS DOUBLE) / 100 END AS danceability,
  CASE WHEN p_partkey % 12 = 0 THEN NULL ELSE CAST(60 + p_size * 3 AS DOUBLE) END AS tempo, CAST(p_partkey % 12 AS INT) AS key, CAST(p_partkey % 2 AS INT) AS mode, -CAST(p_size AS DOUBLE) / 2 AS loudness,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST((p_partkey * 29) % 101 AS DOUBLE) / 100 END AS instrumental_probability,
  CAST((p_partkey * 31) % 101 AS DOUBLE) / 100 AS voice_probability, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey % 40 AS DOUBLE) / 1000 END AS singing_mean,
  CAST((p_partkey * 43) % 30 AS DOUBLE) / 100 AS speech_mean, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST((p_partkey * 47) % 101 AS DOUBLE) / 100 END AS music_mean,
  CAST((p_partkey * 53) % 50 AS DOUBLE) / 100 AS speech_share, CAST((p_partkey * 59) % 101 AS DOUBLE) / 100 AS low_music, CAST(120 + p_partkey % 300 AS DOUBLE) AS actual_s
FROM {part} LEFT JOIN {documents} ON doc_id = p_partkey
"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(TRACKS, part=read("part"), documents=read("documents"))
