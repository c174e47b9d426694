"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only where that is unset in local mode (tests) a temporary folder is made and
    kept in the session; on a cluster that is an error, as executors wouldn't share it. Checkpoints go there too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[[^,\]]*(,\d+)?\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> str:
    """The path of a new table with the rows."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read again: cuts the lineage and survives lost executors."""
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(written(df, name))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in a stated number of tasks, for much work on rows of few bytes, which Spark would put into few tasks by their size."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it, for reading inside tasks."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
