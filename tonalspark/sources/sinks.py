"""Writers: tables swapped in whole, releases with a contract, and reports."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder; false where the file system says no, whether by its answer or by an error."""
    a, fs = _fs(spark, source)
    b, _ = _fs(spark, target)
    try:
        return not fs.exists(b) and bool(fs.rename(a, b))
    except Py4JJavaError:
        return False


def _removed(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def _swapped(spark: SparkSession, staged: str, path: str) -> None:
    """Puts a written folder in the place of ``path``. Whatever fails, one of the two is in place afterwards, or the error says
    where the old one is; it is deleted only when the new one is there."""
    target, fs = _fs(spark, path)
    old = f"{path}.old-{uuid.uuid4().hex}"
    there = fs.exists(target)
    if there and not _moved(spark, path, old):
        _removed(spark, staged)
        raise RuntimeError(f"{path} can't be moved; it stays as it was")
    if not _moved(spark, staged, path):
        if there and not _moved(spark, old, path):
            raise RuntimeError(f"{staged} can't be moved to {path}, and neither can the old table, which is at {old}")
        _removed(spark, staged)
        raise RuntimeError(f"{staged} can't be moved to {path}, which stays as it was")
    if there:
        _removed(spark, old)


def replace(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes beside ``path`` and swaps the folders, so a table may be made from itself and is never seen half-written; between
    the two renames readers see no table for a moment. If a rename fails the old table stays."""
    staged = f"{path}.new-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(staged)
    _swapped(df.sparkSession, staged, path)


def release(parts: dict[str, DataFrame], catalogue: DataFrame, key: str, path: str) -> DataFrame:
    """Publishes the parts of a release as one folder if each has the catalogue's keys, all of them and each once; else raises,
    and the release that was there stays, all of it.

    Returns (part, rows, checksum): the checksum is the sum of row hashes and doesn't depend on their order. What is checked
    is what has been written, before it is swapped in.
    """
    spark, staged = catalogue.sparkSession, f"{path}.new-{uuid.uuid4().hex}"
    keys = catalogue.select(key).distinct()
    n, rows = keys.count(), []
    for name, df in parts.items():
        df.write.parquet(f"{staged}/{name}")
    for name in parts:
        df = spark.read.parquet(f"{staged}/{name}")
        row = df.join(keys, key, "left_semi").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys")).first()
        whole = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")).cast("string").alias("checksum")).first()
        if (row["rows"], row["keys"], whole["rows"]) != (n, n, n):
            _removed(spark, staged)
            raise ValueError(f"{name} has {whole['rows']} rows, {row['keys']} of {n} keys of the catalogue")
        rows.append((name, whole["rows"], whole["checksum"]))
    _swapped(spark, staged, path)
    return spark.createDataFrame(rows, "part string, rows long, checksum string")


def report(df: DataFrame, path: str) -> None:
    """One JSON line a row, for tables of a few rows."""
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str) -> DataFrame:
    """(value): the lines of a table of a few rows as Markdown, to be written as text."""
    spark, columns = df.sparkSession, df.columns
    head = spark.createDataFrame([(0, f"# {title}"), (1, ""), (2, "| " + " | ".join(columns) + " |"), (3, "|" + "---|" * len(columns))], "at int, value string")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    return head.unionByName(df.select(F.lit(4).alias("at"), cells.alias("value"))).orderBy("at", "value").select("value")


def filtered(df: DataFrame, counts: DataFrame, path: str) -> None:
    """A cleaned table as CSV with a header, and the counts of what was dropped as Markdown, in one folder swapped in whole."""
    staged = f"{path}.new-{uuid.uuid4().hex}"
    df.write.option("header", True).option("escape", '"').csv(f"{staged}/rows")
    markdown(counts, "Dropped").coalesce(1).write.text(f"{staged}/report")
    _swapped(df.sparkSession, staged, path)


def vectors(df: DataFrame, key: str, vector: str, path: str) -> None:
    """Vectors with their keys, and beside them how many there are and of what width."""
    staged = f"{path}.new-{uuid.uuid4().hex}"
    df.select(key, vector).write.parquet(f"{staged}/matrix")
    report(df.agg(F.count(F.lit(1)).alias("rows"), F.min(F.size(vector)).alias("least_width"), F.max(F.size(vector)).alias("width")), f"{staged}/metadata")
    _swapped(df.sparkSession, staged, path)


def cache_key(prefix: str, params: str):
    """Prefix and 16 hexadecimal digits of the digest of a struct's JSON: equal parameters have equal keys."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.to_json(params)), 1, 16))


def fresh(cache: DataFrame, keys: DataFrame, now, ttl: str = "ttl_s", at: str = "made_at") -> DataFrame:
    """Of (key, value, made_at, ttl_s) the last value of each wanted key that hasn't expired at ``now``."""
    alive = cache.where(F.unix_timestamp(now) - F.unix_timestamp(at) < F.col(ttl))
    return keys.select("key").distinct().join(alive.groupBy("key").agg(F.max_by("value", at).alias("value")), "key")
