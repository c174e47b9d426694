"""Queries by name, each with the SQL that gives the same rows (None where SQL can't)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalogue import songs, table
from ..sources.tracks import TRACKS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The catalogue of ``sources.catalogue.songs`` in SQL.
SONGS = """base AS (
  SELECT e.vec_id AS song_idx, CAST(p.p_partkey AS VARCHAR) AS track_id, p.p_name AS title, p.p_brand AS artist, p.p_type AS mood,
         60 + 140 * (p.p_size - 1) / 49.0 AS bpm, p.p_retailprice AS popularity, p.p_size AS size, e.label, e.embedding::DOUBLE[] AS audio_vec, (e.embedding[1:32])::DOUBLE[] AS lyrics_vec
  FROM embeddings e JOIN part p ON e.vec_id = p.p_partkey
), songs AS (
  SELECT *, (rank() OVER (ORDER BY popularity) - 1 + (count(*) OVER (PARTITION BY popularity) - 1) / 2.0) / (count(*) OVER () - 1) AS valence,
         (rank() OVER (ORDER BY size) - 1 + (count(*) OVER (PARTITION BY size) - 1) / 2.0) / (count(*) OVER () - 1) AS arousal
  FROM base
)"""


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{songs}", SONGS).replace("{tracks}", "tracks AS (" + TRACKS.format(part="part", documents="documents") + ")")
        return f

    return add


__all__ = ["ORACLES", "QUERIES", "SONGS", "query", "songs", "table"]
