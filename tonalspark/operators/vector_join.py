"""All pairs of near vectors, exactly: blocks around pivots, and prefixes of rotated vectors with the norms that remain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.shared import open_fs, scratch, stored, written

#: Rows of a block and blocks of a tile's side: what a task holds at once.
BLOCK, GROUP = 4096, 8
#: Rows (a hash of the id chooses them) from which the rotation is found and the pivots are taken; any rotation and any pivots
#: give the same pairs.
FIT = 4096
#: Blocks are told apart by their distances from so many pivots.
MARKS = 32
#: The vectors are compared in so many steps, each of an equal share of the rotated components.
STEPS = 4
#: What rounding may add to a product of unit vectors; cosines are taken to six places.
SLACK = 1e-6


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers of one length as rows; missing ones are zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there, flat = column.is_valid().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if there.all():
        return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    out = np.zeros((len(column), len(flat) // max(there.sum(), 1)))
    out[there] = flat.reshape(there.sum(), -1)
    return out


def _far(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((rows**2).sum(1)[:, None] - 2 * rows @ pivots.T + (pivots**2).sum(1), 0))


def _edges(width: int) -> list[int]:
    return sorted({round(width * s / STEPS) for s in range(1, STEPS + 1)})


def _tails(rows: np.ndarray) -> np.ndarray:
    """The norm that each row has left behind each step's last component."""
    behind = np.cumsum((rows**2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.column_stack([behind[:, e] if e < rows.shape[1] else np.zeros(len(rows)) for e in _edges(rows.shape[1])]))


def products(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of rotated rows the pairs (i, j) whose product is over ``least`` (to six places), the products, and how many pairs had
    to be multiplied to the end. A pair is given up when what it has so far and the norms that remain can't reach the bound."""
    edges, tail_a, tail_b = _edges(a.shape[1]), _tails(a), _tails(b)
    start = edges[0]
    so_far = a[:, :start] @ b[:, :start].T
    i, j = np.nonzero(so_far + tail_a[:, :1] * tail_b[:, 0] >= least - SLACK)
    sums = so_far[i, j]
    for step, (start, end) in enumerate(zip(edges, edges[1:]), 1):
        if step == len(edges) - 1:
            break
        sums = sums + np.einsum("ij,ij->i", a[i, start:end], b[j, start:end])
        keep = sums + tail_a[i, step] * tail_b[j, step] >= least - SLACK
        i, j, sums = i[keep], j[keep], sums[keep]
    cos = np.rint(np.einsum("ij,ij->i", a[i], b[j]) * 1e6) / 1e6
    keep = cos > least
    return i[keep], j[keep], cos[keep], len(cos)


def met(rows: DataFrame, least: float, item: str = "song_idx", vector: str = "audio_vec", seed: int = 5) -> DataFrame:
    """(a, b, cosine, scored, visited): what ``near_pairs`` finds, and for each tile a row without a pair that counts the pairs
    that were multiplied to the end and those of blocks that had to meet."""
    spark, schema = rows.sparkSession, "a long, b long, cosine double, scored long, visited long"
    flat = stored(rows.select(F.col(item).cast("long").alias("id"), V.unit(F.col(vector)).alias("v")).where("v IS NOT NULL"), "vectors")
    sample = matrix(flat.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(FIT).select("v").toArrow().column("v"))
    if not len(sample):
        return spark.createDataFrame([], schema)
    turn = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]  # the components that hold most come first
    pivots = (sample @ turn)[: min(1024, max(64, flat.count() // BLOCK))]
    marks = pivots[:MARKS]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v")) @ turn
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(v), pa.list_(pa.float64())), pa.array(_far(v, pivots).argmin(1))], names=["id", "v", "block"])

    turned = stored(flat.mapInArrow(placed, "id long, v array<double>, block long"), "turned")
    sizes = turned.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = turned.join(F.broadcast(sizes), "block").select("block", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("parts")).alias("part"), "id", "v")
    path = scratch(spark, "blocks")
    dealt.repartition("block", "part").write.partitionBy("block", "part").parquet(path)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            far, keys = _far(matrix(batch.column("v")), marks), np.column_stack([batch.column("block").to_numpy(), batch.column("part").to_numpy()])
            for key in np.unique(keys, axis=0):
                here = far[(keys == key).all(1)]
                low, high = found.get(tuple(key), (np.inf, -np.inf))
                found[tuple(key)] = np.minimum(low, here.min(0)), np.maximum(high, here.max(0))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found]), pa.array([k[1] for k in found]), pa.array([list(v[0]) for v in found.values()]), pa.array([list(v[1]) for v in found.values()])], names=["block", "part", "low", "high"])

    sums = [f(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(len(marks))]
    lists = [F.array(*[f"{c}{i}" for i in range(len(marks))]).alias(c) for c in ("low", "high")]
    stored_blocks = spark.read.parquet(path).select(F.col("block").cast("long"), F.col("part").cast("long"), "v")
    table = written(stored_blocks.mapInArrow(ranges, "block long, part long, low array<double>, high array<double>").groupBy("block", "part").agg(*sums).select("block", "part", *lists), "ranges")
    groups = -(-spark.read.parquet(table).count() // GROUP)
    width = float(np.sqrt(max(2 - 2 * least, 0))) + 1e-6
    tiles = spark.range(groups).select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id"), F.lit(groups - 1))).alias("j"))
    n = groups * (groups + 1) // 2
    parts = min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 16))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = open_fs(path)
        fs2, where2 = open_fs(table)
        known = pads.dataset(where2, filesystem=fs2, format="parquet").to_table().sort_by([("block", "ascending"), ("part", "ascending")])
        keys = list(zip(known.column("block").to_pylist(), known.column("part").to_pylist()))
        low, high = matrix(known.column("low")), matrix(known.column("high"))
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def block(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in held:
                t = pads.dataset(f"{where}/block={keys[k][0]}/part={keys[k][1]}", filesystem=fs, format="parquet").to_table(columns=["id", "v"])
                held[k] = t.column("id").to_numpy(), matrix(t.column("v"))
            return held[k]

        for batch in batches:
            for i, j in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist()):
                side = lambda g: range(g * GROUP, min(len(keys), g * GROUP + GROUP))
                held = {k: x for k, x in held.items() if k in side(i) or k in side(j)}
                scored = visited = 0
                for x in side(i):
                    apart = np.maximum(low - high[x], low[x] - high).max(1)  # by the triangle inequality, for each pivot
                    for y in side(j):
                        if y < x or apart[y] > width:
                            continue
                        (left, a), (right, b) = block(x), block(y)
                        visited += len(left) * len(right) if x != y else len(left) * (len(left) - 1) // 2
                        here = 0
                        for start in range(0, len(left), 512):  # bounds the matrix
                            p, q, cos, tried = products(a[start : start + 512], b, least)
                            here += tried
                            p, q = left[p + start], right[q]
                            first = p < q if x == y else np.ones(len(p), bool)
                            if first.any():
                                lo, hi = np.minimum(p, q)[first], np.maximum(p, q)[first]
                                none = np.zeros(len(lo), np.int64)
                                yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.array(cos[first]), pa.array(none), pa.array(none)], names=["a", "b", "cosine", "scored", "visited"])
                        scored += here if x != y else (here - len(left)) // 2  # within a block each pair came twice, and each row met itself
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.float64()), pa.array([scored], pa.int64()), pa.array([visited], pa.int64())], names=["a", "b", "cosine", "scored", "visited"])

    return tiles.repartition(parts, "i", "j").sortWithinPartitions("i", "j").mapInArrow(over, schema)


def near_pairs(rows: DataFrame, least: float, item: str = "song_idx", vector: str = "audio_vec", seed: int = 5) -> DataFrame:
    """(a, b, cosine) of all pairs a < b of rows (a whole number that is theirs alone, vectors of one length) with a cosine over
    ``least``, to six places. Null and zero vectors have no partner.

    Rows are turned to the axes that hold most of the vectors, put into blocks around pivots and written to the shared folder; no
    vector is shuffled again. Tiles of blocks are dealt to the tasks, which leave out blocks that are too far apart by their distances
    from the pivots (the triangle inequality) and compare the others step by step: a pair goes on only while what it has and the
    norms that remain may reach the bound. So vectors without any groups are multiplied in a quarter of their components, few to the end.
    """
    return met(rows, least, item, vector, seed).where("a IS NOT NULL").select("a", "b", "cosine")


def neighbour_pairs(rows: DataFrame, neighbours: int = 6, least: float = 0.995, item: str = "song_idx", vector: str = "audio_vec") -> DataFrame:
    """(a, b, cosine), a < b, of pairs with a cosine of ``least`` of which one is among the other's ``neighbours`` nearest (ties: the
    smaller id); each pair once."""
    near = stored(near_pairs(rows, least - 2e-6, item, vector).where(F.col("cosine") >= least), "near")
    both = near.select("a", "b", "cosine", F.col("a").alias("of"), F.col("b").alias("to")).unionByName(near.select("a", "b", "cosine", F.col("b").alias("of"), F.col("a").alias("to")))
    order = Window.partitionBy("of").orderBy(F.col("cosine").desc(), "to")
    return both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= neighbours).select("a", "b", "cosine").distinct()
