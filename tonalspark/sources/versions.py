"""Tables whose versions are manifests that only one writer can create, and a log of batches that have been worked through."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .shared import dealt, scratch, stored

#: Rows of a batch that one task writes, about.
ROWS = 50_000


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def claimed(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file with its text in one step; false if it is there already. Of racing writers one gets true.

    The text is written beside it and takes the name only if nobody has it: a hard link in local folders, a rename that doesn't
    overwrite elsewhere.
    """
    target, fs = _path(spark, path)
    new, _ = _path(spark, f"{target.getParent().toString()}/.{uuid.uuid4().hex}")
    out = fs.create(new, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(new.toUri().getPath(), target.toUri().getPath())
            return True
        hadoop = spark._jvm.org.apache.hadoop.fs
        keep = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        keep[0] = hadoop.Options.Rename.NONE
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, target, keep)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(new, False)


def _names(spark: SparkSession, folder: str) -> list[str]:
    where, fs = _path(spark, folder)
    if not fs.exists(where):
        return []
    return sorted(x for x in (s.getPath().getName() for s in fs.listStatus(where)) if not x.startswith("."))


def _text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    source = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def _drop(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


class Conflict(RuntimeError):
    """Another writer has committed first."""


@dataclass
class VersionedTable:
    """Rows with keys, in buckets by the hash of the keys. A version says which folders hold each bucket; readers keep what they have
    opened, writers make new folders and commit the next version, and there is never a moment without a table.

    root: ``data/<folder>/bucket=b`` and ``versions/v<n>``; buckets: chosen when the first version is made.
    """

    spark: SparkSession
    root: str
    keys: list[str]
    buckets: int = 32

    def version(self) -> int:
        names = _names(self.spark, f"{self.root}/versions")
        return int(names[-1][1:]) if names else 0

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"buckets": self.buckets, "schema": None, "folders": {}}
        return json.loads(_text(self.spark, f"{self.root}/versions/v{version:09d}"))

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.root}/data/{f}/bucket={b}" for b, fs in manifest["folders"].items() if buckets is None or int(b) in buckets for f in fs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(manifest["buckets"])).cast("int")

    def _written(self, rows: DataFrame, manifest: dict) -> tuple[str, list[int]]:
        folder = uuid.uuid4().hex
        rows.withColumn("bucket", self._bucket(manifest)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        return folder, [int(n.partition("=")[2]) for n in _names(self.spark, f"{self.root}/data/{folder}") if n.startswith("bucket=")]

    def _commit(self, manifest: dict, after: int) -> int:
        fs, where = _path(self.spark, f"{self.root}/versions")[::-1]
        fs.mkdirs(where)
        if not claimed(self.spark, f"{self.root}/versions/v{after + 1:09d}", json.dumps(manifest)):
            raise Conflict(f"version {after + 1} is there already")
        return after + 1

    def _tried(self, step: Callable[[int, dict], tuple[str | None, dict] | None], tries: int) -> int:
        """Runs a step on the newest version until its commit comes first; what was written for a lost commit is deleted."""
        for left in reversed(range(tries)):
            before = self.version()
            manifest = self.manifest(before)
            made = step(before, manifest)
            if made is None:
                return before
            folder, new = made
            try:
                return self._commit(new, before)
            except Conflict:
                if folder:
                    _drop(self.spark, f"{self.root}/data/{folder}")
                if not left:
                    raise
        raise ValueError("tries must be positive")

    def replace(self, rows: DataFrame, tries: int = 8) -> int:
        """All rows anew; the table may be made from itself."""

        def step(before: int, manifest: dict) -> tuple[str, dict]:
            folder, filled = self._written(rows, manifest)
            return folder, {**manifest, "schema": rows.schema.jsonValue(), "folders": {str(b): [folder] for b in filled}}

        return self._tried(step, tries)

    def upsert(self, new: DataFrame, order: Column | None = None, keep: bool = True, tries: int = 8) -> int:
        """Rows of ``new`` replace those of equal keys, others are added; of several rows of a key the last in ``order`` (by default the
        greatest) counts. Columns that ``new`` hasn't got stay; with ``keep`` so do values for which it has null.

        Only buckets that have new keys are read and written again. Rows with a null key are left out.
        """
        fresh = self._fresh(new, order)

        def step(before: int, manifest: dict) -> tuple[str, dict] | None:
            touched = self._touched(fresh, manifest)
            if not touched:
                return None
            schema = StructType.fromJson(manifest["schema"]) if manifest["schema"] else fresh.schema
            old = self._rows({**manifest, "schema": schema.jsonValue()}, touched)
            rest = [c for c in schema.names if c not in self.keys]
            there = [c for c in rest if c in fresh.columns]
            side = fresh.select(*self.keys, F.lit(True).alias("__new"), *[F.col(c).cast(schema[c].dataType).alias(f"__{c}") for c in there])
            met = old.join(side, self.keys, "full_outer")
            value = lambda c: F.coalesce(f"__{c}", c) if keep else F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c))
            merged = met.select(*[(value(c).alias(c) if c in there else F.col(c)) for c in schema.names])
            folder, filled = self._written(merged, manifest)
            return folder, {**manifest, "schema": schema.jsonValue(), "folders": {**manifest["folders"], **{str(b): [folder] for b in filled}}}

        return self._tried(step, tries)

    def insert_new(self, new: DataFrame, tries: int = 8) -> int:
        """Adds the rows whose keys the table hasn't got; others are ignored, as are repeats. What is there isn't written again."""
        fresh = self._fresh(new, None)

        def step(before: int, manifest: dict) -> tuple[str, dict] | None:
            touched = self._touched(fresh, manifest)
            rows = fresh
            if manifest["schema"]:
                schema = StructType.fromJson(manifest["schema"])
                old = self._rows(manifest, touched).select(*self.keys)
                rows = fresh.join(old, self.keys, "left_anti").select(*[F.col(f.name).cast(f.dataType) if f.name in fresh.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
            folder, filled = self._written(rows, manifest)
            if not filled:
                _drop(self.spark, f"{self.root}/data/{folder}")
                return None
            folders = {**manifest["folders"], **{str(b): [*manifest["folders"].get(str(b), []), folder] for b in filled}}
            return folder, {**manifest, "schema": rows.schema.jsonValue() if not manifest["schema"] else manifest["schema"], "folders": folders}

        return self._tried(step, tries)

    def _fresh(self, new: DataFrame, order: Column | None) -> DataFrame:
        given = F.struct(*([order] if order is not None else []), *new.columns)
        known = new.dropna(subset=self.keys)
        one = known.groupBy(*[F.col(k).alias(f"__{k}") for k in self.keys]).agg(F.max_by(F.struct(*new.columns), given).alias("r"))
        return stored(one.select("r.*"), "fresh")

    def _touched(self, fresh: DataFrame, manifest: dict) -> list[int]:
        return [r[0] for r in fresh.select(self._bucket(manifest)).distinct().collect()]  # as many as there are buckets

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last ``keep`` versions, and the folders that only those used. Not while others write: a folder
        whose commit is still to come isn't in any version."""
        names = _names(self.spark, f"{self.root}/versions")
        kept = {f for n in names[-keep:] for fs in self.manifest(int(n[1:]))["folders"].values() for f in fs}
        for n in names[:-keep]:
            _drop(self.spark, f"{self.root}/versions/{n}")
        for f in _names(self.spark, f"{self.root}/data"):
            if f not in kept:
                _drop(self.spark, f"{self.root}/data/{f}")


@dataclass
class WorkLog:
    """Which rows have been worked through: results of batches, each a folder, and entries that are numbered without gaps.

    An entry is made when its folder is whole, by whoever gets its number; so a run that is killed leaves at most a folder without
    an entry, which nobody reads, and two runs at once never commit a key twice.
    """

    spark: SparkSession
    root: str
    key: str

    def entries(self) -> list[dict]:
        """name, folder and rows of each commit; as many rows as batches."""
        return [json.loads(_text(self.spark, f"{self.root}/log/{n}")) for n in _names(self.spark, f"{self.root}/log")]

    def results(self, entries: list[dict] | None = None) -> DataFrame | None:
        """The rows of all committed batches, each key once; None before the first."""
        folders = [f"{self.root}/results/{e['folder']}" for e in (self.entries() if entries is None else entries) if e["rows"]]
        return self.spark.read.parquet(*folders) if folders else None

    def pending(self, items: DataFrame) -> DataFrame:
        done = self.results()
        return items if done is None else items.join(done.select(self.key), self.key, "left_anti")

    def commit(self, name: str, results: DataFrame, tries: int = 8) -> bool:
        """Writes a batch's results and enters them; false if a batch of that name is there already (a repeated micro-batch). Keys that
        others have committed meanwhile are taken out; of several rows of a key one stays; null keys are left out."""
        made = None
        for left in reversed(range(tries)):
            entries = self.entries()
            if any(e["name"] == name for e in entries):
                return False
            if made is None:
                made = stored(results.dropna(subset=[self.key]).dropDuplicates([self.key]), "results")
            done, folder = self.results(entries), uuid.uuid4().hex
            rows = made if done is None else made.join(done.select(self.key), self.key, "left_anti")
            rows.write.parquet(f"{self.root}/results/{folder}")
            n = self.spark.read.parquet(f"{self.root}/results/{folder}").count()
            fs, where = _path(self.spark, f"{self.root}/log")[::-1]
            fs.mkdirs(where)
            if claimed(self.spark, f"{self.root}/log/{len(entries):09d}", json.dumps({"name": name, "folder": folder, "rows": n})):
                return True
            _drop(self.spark, f"{self.root}/results/{folder}")
            if not left:
                raise Conflict(f"others keep committing to {self.root}")
        raise ValueError("tries must be positive")

    def run(self, items: DataFrame, work: Callable[[DataFrame], DataFrame], every: int, limit: int | None = None) -> dict[str, int]:
        """Works through the items that have no result yet, in batches of about ``every`` rows by a hash of the key, and commits each;
        returns how many were pending, are done and failed (have no row in what ``work`` returned, and are pending the next time).

        A batch is one distributed job; what was committed before a failure stays, and the next run goes on from there. ``limit``: so
        many batches at most.
        """
        todo = self.pending(items.dropna(subset=[self.key]))
        todo = stored(todo, "pending")
        n = todo.count()
        batches = max(1, -(-n // every))
        path, before = scratch(self.spark, "batches"), sum(e["rows"] for e in self.entries())
        if n:
            h = F.xxhash64(self.key)
            part = F.pmod(F.shiftright(h, 32), F.lit(-(-n // batches // ROWS) or 1))  # a batch is as many tasks as its rows need
            dealt(todo.withColumn("__batch", F.pmod(h, F.lit(batches))).withColumn("__part", part), "__batch", "__part").drop("__part").write.partitionBy("__batch").parquet(path)
        there = sorted((x for x in _names(self.spark, path) if x.startswith("__batch")), key=lambda x: int(x.partition("=")[2]))
        for x in there[:limit]:
            part = self.spark.read.schema(todo.schema).parquet(f"{path}/{x}")
            self.commit(f"{uuid.uuid4().hex}-{x}", work(part))
        done = sum(e["rows"] for e in self.entries()) - before
        asked = n if limit is None else sum(self.spark.read.schema(todo.schema).parquet(f"{path}/{x}").count() for x in there[:limit])
        return {"pending": n, "done": done, "failed": asked - done}

    def stream(self, items: DataFrame, work: Callable[[DataFrame], DataFrame], checkpoint: str, **trigger) -> StreamingQuery:
        """The same over a streaming DataFrame: each micro-batch is committed under its number, so one that is run again after a
        failure changes nothing; keys that have a result aren't worked through again."""

        def each(batch: DataFrame, number: int) -> None:
            if not any(e["name"] == f"micro-batch-{number}" for e in self.entries()):
                self.commit(f"micro-batch-{number}", work(self.pending(batch)))

        return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
