"""Shards of a growing corpus with size-tiered compaction and versioned manifests.

Arrivals are appended as runs of small immutable Parquet shards. Runs whose shards are about equally large form a tier; a
tier with enough shards is merged into one run of target-sized files. Spark's file scan packs shards into small read
partitions, and as many of those as make up the target are coalesced into a file: nothing is shuffled, and no task reads
much more than the target. A version is a manifest file, one line for each run, which only one of two writers can create; readers see the
runs of one version. The driver handles one line for each run, never one for each shard.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Versions before the last ones in which a vacuum looks for runs that went out of use.
RECENT = 64


@dataclass(frozen=True)
class Run:
    """Shards that were written together: the folder's name, how many they are, their bytes and their rows."""

    name: str
    shards: int
    bytes: int
    rows: int

    def tier(self, target_bytes: int, fanout: int) -> int:
        """Tier t holds runs whose shards have target / fanout**(t+1) to target / fanout**t bytes on average; runs of larger
        ones are settled and have tier 0."""
        return max(0, math.floor(math.log(target_bytes * self.shards / max(self.bytes, 1), fanout)))


class ShardStore:
    """A store below ``root``: ``data/<run>/`` has shards, ``versions/v<number>`` the manifest of that version. The file
    system has to create links (local) or rename without overwriting atomically."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list:
        top = self.path(f"{self.root}/{folder}")
        return list(self.fs.listStatus(top)) if self.fs.exists(top) else []

    def versions(self) -> list[int]:
        """The committed versions, ascending."""
        return sorted(int(n[1:]) for x in self._names("versions") if (n := x.getPath().getName()).startswith("v"))

    def version(self) -> int:
        """The last committed version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def runs(self, version: int | None = None) -> list[Run]:
        """The runs of a version."""
        version = self.version() if version is None else version
        if not version:
            return []
        source = self.fs.open(self.path(f"{self.root}/versions/v{version:09d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
        return [Run(**json.loads(line)) for line in text.splitlines()]

    def manifest(self, version: int | None = None) -> DataFrame:
        """(run, file, bytes) of the shards of a version."""
        runs = self.runs(version)
        if not runs:
            return self.spark.createDataFrame([], "run string, file string, bytes long")
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self._data(*runs))
        return files.select(F.element_at(F.split("path", "/"), -2).alias("run"), F.col("path").alias("file"), F.col("length").alias("bytes"))

    def commit(self, runs: list[Run], after: int) -> int:
        """Makes ``runs`` the version that follows ``after``; an error if another writer was first."""
        if not self._claim(after + 1, "".join(json.dumps(asdict(r)) + "\n" for r in runs)):
            raise RuntimeError(f"version {after + 1} is there already")
        return after + 1

    def _claim(self, version: int, text: str) -> bool:
        """Creates the manifest of a version with its content in one step, or finds that it is there."""
        new, place = (self.path(f"{self.root}/versions/{x}") for x in (f".{uuid.uuid4().hex}", f"v{version:09d}"))
        out = self.fs.create(new, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":  # renaming a local file would overwrite
                os.link(new.toUri().getPath(), place.toUri().getPath())
            else:
                fs = self.spark._jvm.org.apache.hadoop.fs
                once = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
                once[0] = fs.Options.Rename.NONE
                fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, place, once)
        except FileExistsError:
            return False
        except Py4JJavaError:
            if self.fs.exists(place):
                return False
            raise
        finally:
            self.fs.delete(new, False)
        return True

    def _delete(self, *names: str) -> None:
        for folder in self._data(*names):
            self.fs.delete(self.path(folder), True)

    def _data(self, *runs: Run | str) -> list[str]:
        return [f"{self.root}/data/{r.name if isinstance(r, Run) else r}" for r in runs]

    def _written(self, name: str) -> Run:
        """What a written folder holds; rows are counted from the files' footers."""
        size = self.fs.getContentSummary(self.path(*self._data(name)))
        rows = self.spark.read.parquet(*self._data(name)).count()
        return Run(name, size.getFileCount() - self.fs.exists(self.path(f"{self._data(name)[0]}/_SUCCESS")), size.getLength(), rows)

    def append(self, df: DataFrame, max_rows: int = 2000, tries: int = 8) -> int:
        """Writes arrivals as a run of shards of at most ``max_rows`` rows, each task its own, and commits it. No shuffle.

        Rows are stored as they are: nulls, empty texts, repeats and any columns, whatever their names. An empty table
        adds no run. Where another writer commits first, the commit is tried again behind it.
        """
        name = uuid.uuid4().hex
        df.write.option("compression", "zstd").option("maxRecordsPerFile", max_rows).parquet(*self._data(name))
        new = [run] if (run := self._written(name)).rows else []
        for left in reversed(range(tries)):
            before = self.version()
            try:
                return self.commit(self.runs(before) + new, before)
            except RuntimeError:
                if not left:
                    raise
        raise ValueError("tries must be positive")

    def compact(self, target_bytes: int = 64 << 20, fanout: int = 4) -> int:
        """Merges tiers of ``fanout`` shards or more, smallest shards first, until none is left; returns the last version.

        Each merge is a version of its own. Runs that neither the last version nor the one before it has are deleted
        right after the commit, so what is merged exists twice at most. What others append in between stays. An error if
        others have merged the same runs, or if rows were lost; the merged copy is then deleted, and nothing has changed.
        """
        stuck: set[frozenset[Run]] = set()  # what a merge made no fewer of
        while True:
            before = self.version()
            runs = self.runs(before)
            tiers: dict[int, list[Run]] = {}
            for run in runs:
                tiers.setdefault(run.tier(target_bytes, fanout), []).append(run)
            full = [t for t, members in tiers.items() if t and sum(r.shards for r in members) >= fanout and frozenset(members) not in stuck]
            if not full:
                return before
            merged, name, rest = tiers[max(full)], uuid.uuid4().hex, uuid.uuid4().hex
            try:
                self._packed(merged, target_bytes).write.option("compression", "zstd").parquet(*self._data(name))
                new = self._apart(name, rest, target_bytes // fanout)
                if sum(r.rows for r in new) != sum(r.rows for r in merged):
                    raise RuntimeError(f"{sum(r.rows for r in merged)} rows became {sum(r.rows for r in new)}")
                if sum(r.shards for r in new) >= sum(r.shards for r in merged):
                    stuck.add(frozenset(merged))
                    self._delete(name, rest)
                    continue
                self._replace(merged, new)
            except Exception:
                self._delete(name, rest)
                raise
            self.vacuum(keep=2)

    def _replace(self, old: list[Run], new: list[Run], tries: int = 8) -> int:
        """Commits ``new`` in place of ``old``, behind whatever others have committed meanwhile."""
        for left in reversed(range(tries)):
            before = self.version()
            runs = self.runs(before)
            if not set(old) <= set(runs):
                raise RuntimeError("others have merged these runs")
            try:
                return self.commit([r for r in runs if r not in old] + new, before)
            except RuntimeError:
                if not left:
                    raise
        raise ValueError("tries must be positive")

    def _packed(self, runs: list[Run], target_bytes: int) -> DataFrame:
        """The rows of runs in as many partitions as targets fill: each is some eight reads of an eighth of the target (more
        and smaller ones, where the cluster's settings say so), coalesced without a shuffle."""
        reading = self.spark.newSession()
        reading.conf.set("spark.sql.files.maxPartitionBytes", str(max(1, target_bytes // 8)))
        rows = reading.read.option("mergeSchema", str(len(runs) > 1).lower()).parquet(*self._data(*runs))
        return rows.coalesce(-(-sum(r.bytes for r in runs) // target_bytes))

    def _apart(self, name: str, rest: str, least: int) -> list[Run]:
        """The merged run; those of its shards under ``least`` bytes (what was left when the others were full) become a run of
        their own, so that a run's shards stay alike."""
        run = self._written(name)
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self._data(name))
        small = [r["path"] for r in files.where(F.col("length") < least).select("path").collect()]
        if not small or len(small) == run.shards:
            return [run]
        self.fs.mkdirs(self.path(*self._data(rest)))
        for path in small:
            file = self.path(path).getName()
            if not self.fs.rename(self.path(f"{self._data(name)[0]}/{file}"), self.path(f"{self._data(rest)[0]}/{file}")):
                raise RuntimeError(f"{path} can't be moved")
        return [self._written(name), self._written(rest)]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with the file of each, as shard (which replaces a column of this name)."""
        runs = self.runs(version)
        if not runs:
            raise ValueError("no shards")
        rows = self.spark.read.option("mergeSchema", str(len(runs) > 1).lower()).parquet(*self._data(*runs))
        return rows.withColumn("shard", rows.metadataColumn("_metadata")["file_path"])

    def vacuum(self, keep: int = 1, orphan_seconds: float = 7 * 86400) -> None:
        """Deletes the runs that only versions before the last ``keep`` have; those versions can't be read any more.

        What just went out of use is in the versions right before those, so RECENT manifests are read, however old the store is. A
        run that no version has may be another writer's, who will commit it: such ones go ``orphan_seconds`` after their last change,
        as do runs that only older versions have, and manifests. Manifests stay that long so that no writer is given their number again.
        """
        versions, late = self.versions(), (time.time() - orphan_seconds) * 1000
        live = {r.name for v in versions[-keep:] for r in self.runs(v)}
        dead = {r.name for v in versions[-keep - RECENT : -keep] for r in self.runs(v)} - live
        for x in self._names("data"):
            name = x.getPath().getName()
            if name in dead or name not in live and x.getModificationTime() < late:
                self.fs.delete(x.getPath(), True)
        kept = {f"v{v:09d}" for v in versions[-keep - RECENT :]}
        for x in self._names("versions"):
            if x.getPath().getName() not in kept and x.getModificationTime() < late:
                self.fs.delete(x.getPath(), False)


def sharded(docs: DataFrame, root: str, max_rows: int = 2000, target_bytes: int = 64 << 20, fanout: int = 4) -> DataFrame:
    """Appends ``docs`` to the store below ``root``, compacts and vacuums it, and returns its rows with their shard.

    Rows and columns are those of ``docs``, nulls, empty texts and repeated rows included; a column shard is replaced,
    no other name clashes. An empty table comes back empty. If the store has rows already, they come back as well.
    """
    store = ShardStore(docs.sparkSession, root)
    docs = docs.drop("shard")
    store.append(docs, max_rows)
    store.compact(target_bytes, fanout)
    store.vacuum()
    if not store.runs():
        return docs.where("false").withColumn("shard", F.lit(None).cast("string"))
    return store.read()
