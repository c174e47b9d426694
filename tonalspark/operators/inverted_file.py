"""A nearest-neighbour index that is written once and asked often: lists of vectors around centres, in the shared folder."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.shared import open_fs, scratch, stored
from .ranks import top_per_query
from .vector_join import matrix

#: Rows (a hash of the id chooses them) that centres are found from, at most; and rounds of clustering them.
FIT, ROUNDS = 32_768, 12
#: Rows of a list that a task holds at once; a longer list is dealt to several shards.
SHARD = 16_384
#: Tasks that the visitors of a shard are dealt to.
DEALT = 16


@dataclass
class InvertedFile:
    """path: the lists, as ``list=l/shard=s``; centres: unit vectors; shards of each list; angles: the widest of each list."""

    path: str
    centres: np.ndarray
    shards: np.ndarray
    angles: np.ndarray


def _centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means of a few rows, begun from rows that lie evenly among them; a centre without rows stays."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)]
    for _ in range(ROUNDS):
        of = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centres)
    return centres


def build(rows: DataFrame, item: str = "song_idx", vector: str = "audio_vec", lists: int | None = None, path: str | None = None, seed: int = 7) -> InvertedFile:
    """Puts every row (vectors of one length that aren't null or zero) into the list of its nearest centre.

    The centres come from FIT rows at most; ``lists`` of them, or as many as the square root of the rows, but no more than an eighth of
    FIT. The index stays at ``path`` (or a new one in the shared folder); ``opened`` finds it again.
    """
    spark = rows.sparkSession
    flat = stored(rows.select(F.col(item).cast("long").alias("id"), V.unit(F.col(vector)).alias("v")).where("v IS NOT NULL AND exists(v, x -> x != 0)"), "vectors")
    n = flat.count()
    sample = matrix(flat.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(FIT).select("v").toArrow().column("v"))
    lists = min(lists or math.isqrt(n), max(FIT // 8, 1), len(sample))
    centres = _centres(sample, lists) if lists else np.empty((0, 1))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = matrix(batch.column("v")) @ centres.T
                of = near.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(of), pa.array(near[np.arange(len(of)), of])], names=["id", "v", "list", "near"])

    placed = stored(flat.mapInArrow(dealt, "id long, v array<double>, list long, near double"), "placed")
    sums = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).collect()  # a row a list
    shards, angles = np.zeros(lists, int), np.zeros(lists)
    for r in sums:
        shards[r["list"]], angles[r["list"]] = -(-r["n"] // SHARD), math.acos(max(-1.0, min(1.0, r["near"])))
    path = path or scratch(spark, "inverted-file")
    many = F.broadcast(spark.createDataFrame([(i, int(s)) for i, s in enumerate(shards)], "list long, many long"))  # a row a list
    part = F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("many"))
    placed.join(many, "list").select("list", part.alias("shard"), "id", "v").repartition("list", "shard").write.partitionBy("list", "shard").parquet(f"{path}/lists")
    about = json.dumps({"centres": centres.tolist(), "shards": shards.tolist(), "angles": angles.tolist()})
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.parquet(f"{path}/about")
    return InvertedFile(path, centres, shards, angles)


def opened(spark: SparkSession, path: str) -> InvertedFile:
    """An index that was built before, maybe by another application."""
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    centres = np.array(about["centres"], float)
    return InvertedFile(path, centres, np.array(about["shards"], int), np.array(about["angles"], float))


def _visits(index: InvertedFile, queries: DataFrame, choose) -> DataFrame:
    """(query_id, v, least, list, shard): the shards of the lists that ``choose`` (cosines to the centres, least) names."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                row, of = choose(matrix(batch.column("v")) @ index.centres.T, batch.column("least").to_numpy())
                times = index.shards[of]
                part = np.concatenate([np.arange(0), *[np.arange(t) for t in times]])
                row, of = np.repeat(row, times), np.repeat(of, times)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row, pa.int64())) for c in ("query_id", "v", "least")], pa.array(of, pa.int64()), pa.array(part, pa.int64())], names=["query_id", "v", "least", "list", "shard"])

    return queries.select("query_id", "v", "least").mapInArrow(over, "query_id long, v array<double>, least double, list long, shard long")


def _searched(index: InvertedFile, visits: DataFrame, k: int) -> DataFrame:
    """(query_id, song_idx, score) of the k best rows of each visited shard but the query's own, from ``least`` on."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = open_fs(index.path)
        at, ids, held = None, None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                keys = np.column_stack([batch.column("list").to_numpy(), batch.column("shard").to_numpy()])
                asked, own, least, out = matrix(batch.column("v")), batch.column("query_id").to_numpy(), batch.column("least").to_numpy(), []
                for key in np.unique(keys, axis=0):
                    if at != tuple(key):
                        t = pads.dataset(f"{where}/lists/list={key[0]}/shard={key[1]}", filesystem=fs, format="parquet").to_table(columns=["id", "v"])
                        at, ids, held = tuple(key), t.column("id").to_numpy(), matrix(t.column("v"))
                    here = np.flatnonzero((keys == key).all(1))
                    scores = np.rint(asked[here] @ held.T * 1e6) / 1e6
                    for q, row in zip(here, scores):
                        fits = np.flatnonzero((row >= least[q]) & (ids != own[q]))
                        fits = fits[np.lexsort((ids[fits], -row[fits]))[:k]]
                        out.append((np.full(len(fits), own[q]), ids[fits], row[fits]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "song_idx", "score"])

    tasks = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a visit is a few bytes and much work: Spark mustn't put them together
    together = visits.repartition(tasks, "list", "shard", F.pmod(F.xxhash64("query_id"), F.lit(DEALT))).sortWithinPartitions("list", "shard")
    return together.mapInArrow(over, "query_id long, song_idx long, score double")


def search(index: InvertedFile, queries: DataFrame, k: int, probes: int | None = None, vector: str = "audio_vec") -> DataFrame:
    """(query_id, rank, song_idx, score) of the k rows of highest cosine, to six places, for each query (query_id, vector); ties go to the smaller
    song_idx, and a row of the query's own id isn't found.

    With ``probes`` each query visits the lists of so many nearest centres: fast, and some neighbours may be missed. Without, the result
    is exact: a first round visits the nearest list, a second one all lists that can hold a row as good as the k-th best by
    then; no row of a list is nearer to a query than the angle to its centre less the list's widest angle.
    """
    asked = stored(queries.select(F.col("query_id").cast("long").alias("query_id"), V.unit(F.col(vector)).alias("v")).where("v IS NOT NULL AND exists(v, x -> x != 0)"), "queries")
    if not len(index.centres):
        return asked.sparkSession.createDataFrame([], "query_id long, rank int, song_idx long, score double")
    nowhere = asked.withColumn("least", F.lit(-2.0))

    def nearest(n: int):
        def choose(cos: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            of = np.argsort(-cos, axis=1, kind="stable")[:, :n]
            return np.repeat(np.arange(len(cos)), of.shape[1]), of.ravel()

        return choose

    first = _searched(index, _visits(index, nowhere, nearest(probes or 1)), k)
    if probes is None:
        first = stored(first, "nearest")
        best = top_per_query(first, F.col("score"), k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(-2.0).alias("least"))
        known = asked.join(best, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))

        def others(cos: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            gap = np.maximum(np.arccos(np.clip(cos, -1, 1)) - index.angles - 1e-6, 0)
            may = np.cos(gap) >= least[:, None] - 2e-6
            may[np.arange(len(cos)), np.argsort(-cos, axis=1, kind="stable")[:, 0]] = False
            return np.nonzero(may)

        first = first.unionByName(_searched(index, _visits(index, known, others), k))
    return top_per_query(first, F.col("score"), k).select("query_id", "rank", "song_idx", "score")
