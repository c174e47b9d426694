"""Nearest neighbours by inner product: stable projections in a kd-tree, verified until a chi-square test stops the search.

Vectors get one more component that brings all to one length, so the largest inner product is the smallest distance. A few Gaussian
projections of them are indexed; for a vector at distance d the squared projected distance over d squared follows a chi-square law. A
query meets leaves of the tree by their projected distance, verifies the rows there that are near enough in projection by exact inner
products, and stops when a vector as near as its k-th best would by this law have shown up with the stated probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import top_per_query
from .common import open_fs, scratch, stored

#: Rows from which the cells are cut, at most, and how many of them a cell needs.
FIT, FIT_PER_CELL = 32_768, 32
#: Rows of a shard (what a task holds of the index at once) and of a leaf of its tree.
SHARD, LEAF = 16_384, 512
#: Tasks that a cell's visitors are dealt to, at least as often as there are that many.
DEALT = 32
#: What scores that two ways of summing give may differ by, as a share of the lengths' product.
ERROR = 1e-9


def chi_square_quantile(share: float, degrees: int) -> float:
    """The value that a chi-square number of so many degrees stays below with this probability."""

    def below(x: float) -> float:  # the regularised incomplete gamma function by its series
        a, half = degrees / 2, x / 2
        term = total = 1 / a
        for n in range(1, 2000):
            term *= half / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return total * math.exp(-half + a * math.log(half) - math.lgamma(a))

    low, high = 0.0, 10.0 * degrees + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed component by component, so equal vectors have equal scores wherever they stand."""
    out = np.zeros(len(rows))
    for i in range(rows.shape[1]):
        out += rows[:, i] * query[i]
    return out


@dataclass
class Projection:
    """What tasks need to project: the longest vector's length and the directions, one more row than vectors have components."""

    longest: float
    directions: np.ndarray

    @property
    def width(self) -> int:
        return len(self.directions) - 1

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(1), 0))
        return vectors @ self.directions[:-1] + rest[:, None] * self.directions[-1]

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.directions[:-1]

    def reach(self, vectors: np.ndarray, least: np.ndarray, quantile: float) -> np.ndarray:
        """The squared projected distance beyond which the search stops, for each query and its k-th best score so far."""
        lengths = (vectors**2).sum(1)
        gap = np.maximum(self.longest**2 + lengths - 2 * least, 0) + ERROR * (self.longest**2 + lengths)
        return quantile * gap


@dataclass
class Cells:
    """The upper part of the kd-tree: ``axis`` and ``cut`` of each inner node, level by level; its leaves are the cells."""

    axis: np.ndarray
    cut: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, levels: int) -> Cells:
        axis, cut, groups = [], [], [sample]
        for _ in range(levels):
            below = []
            for g in groups:
                a = int(np.argmax(g.std(0))) if len(g) else 0
                c = float(np.median(g[:, a])) if len(g) else 0.0
                axis.append(a)
                cut.append(c)
                below += [g[g[:, a] < c], g[g[:, a] >= c]]
            groups = below
        return cls(np.array(axis, int), np.array(cut))

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), int)
        while len(node) and node[0] < len(self.axis):  # all rows go down level by level
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - len(self.axis)


class Shard:
    """A kd-tree over the rows of a shard: leaves of neighbouring rows with their boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projection: Projection):
        points = projection.rows(vectors)
        groups, leaves = [np.argsort(ids, kind="stable")], []
        while groups:
            g = groups.pop()
            if len(g) <= LEAF:
                leaves.append(g)
                continue
            a, half = int(np.argmax(np.ptp(points[g], axis=0))), len(g) // 2
            g = g[np.argpartition(points[g, a], half)]
            groups += [g[:half], g[half:]]
        self.ids, self.vectors, self.points = ([x[g] for g in leaves] for x in (ids, vectors, points))
        self.low, self.high = np.array([points[g].min(0) for g in leaves]), np.array([points[g].max(0) for g in leaves])
        self.longest = projection.longest

    def search(self, own: int, query: np.ndarray, point: np.ndarray, least: float, k: int, reach) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and exact scores of the k best rows but ``own``, as far as they reach ``least``, and how many rows were verified.

        Leaves come by their projected distance; the test is made before each, with the k-th best score so far, and for each of its rows
        by its own projected distance: only rows that it lets pass are verified.
        """
        far = gaps(point, self.low, self.high)
        margin = ERROR * self.longest * math.sqrt(query @ query)
        ids, scores, vectors, tried = np.empty(0, np.int64), np.empty(0), np.empty((0, len(query))), 0
        for leaf in np.argsort(far, kind="stable"):
            within = reach(least)
            if far[leaf] > within:
                break
            near = np.flatnonzero(((self.points[leaf] - point) ** 2).sum(1) * (1 - ERROR) <= within)
            got = self.vectors[leaf][near] @ query
            tried += len(near)
            fits = near[(got >= least - margin) & (self.ids[leaf][near] != own)]
            if not len(fits):
                continue
            got = got[np.searchsorted(near, fits)]
            ids, scores = np.concatenate((ids, self.ids[leaf][fits])), np.concatenate((scores, got))
            vectors = np.concatenate((vectors, self.vectors[leaf][fits]))
            if len(scores) >= k:
                least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
                best = scores >= least - margin
                ids, scores, vectors = ids[best], scores[best], vectors[best]
        scores = exact_scores(vectors, query)
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best], tried


def gaps(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The squared distance of a point to each box, less what rounding may add."""
    return (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(-1) * (1 - ERROR)


@dataclass
class Index:
    """A persisted index: path holds the rows as ``cell=c/shard=s``; low and high are the cells' boxes, shards their counts."""

    path: str
    projection: Projection
    cells: Cells
    shards: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build(vectors: DataFrame, k: int = 20, dimensions: int = 12, seed: int = 1, shard: int = SHARD) -> Index:
    """Indexes every usable row of ``vectors`` (vec_id, embedding) in the shared folder.

    Of rows of one vector only the k + 1 smallest vec_ids are kept: no other can be among a query's k nearest, so copies don't
    fill leaves. The cells are cut from the projections of at most FIT rows (a hash of the id chooses); every row is then put
    into its cell, and cells that came out larger than a shard are dealt to several. Boxes and counts of the cells, at most
    FIT / FIT_PER_CELL, are all that comes to the driver.
    """
    rows = vectors.where("vec_id IS NOT NULL").where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    rows = stored(rows.distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    n, width, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding")), F.max(norm)).first()
    projection = Projection(longest or 1.0, np.random.default_rng(seed).standard_normal(((width or 1) + 1, dimensions)))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in projection.rows(_matrix(batch.column(0), projection.width))], pa.binary())], names=["point"])

    levels = max(0, min(math.ceil(math.log2(max(n, 1) / shard)), int(math.log2(FIT // FIT_PER_CELL))))
    sample = np.empty((0, dimensions))
    if levels:
        some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT).select("embedding")
        sample = np.frombuffer(b"".join(some.mapInArrow(projected, "point binary").toArrow().column("point").to_pylist())).reshape(-1, dimensions)
    cells = Cells.fit(sample, levels)

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, count = np.full((1 << levels, dimensions), np.inf), np.full((1 << levels, dimensions), -np.inf), np.zeros(1 << levels, int)
        for batch in batches:
            if batch.num_rows:
                points = projection.rows(_matrix(batch.column(0), projection.width))
                of = cells.of(points)
                np.minimum.at(low, of, points)
                np.maximum.at(high, of, points)
                count += np.bincount(of, minlength=1 << levels)
        at = np.flatnonzero(count)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), pa.array(low[at].tolist()), pa.array(high[at].tolist())], names=["cell", "n", "low", "high"])

    sums = [F.min(F.get("low", F.lit(i))).alias(f"low{i}") for i in range(dimensions)] + [F.max(F.get("high", F.lit(i))).alias(f"high{i}") for i in range(dimensions)]
    found = rows.select("embedding").mapInArrow(boxed, "cell long, n long, low array<double>, high array<double>").groupBy("cell").agg(F.sum("n").alias("n"), *sums).collect()
    counts, low, high = np.zeros(1 << levels, int), np.full((1 << levels, dimensions), np.inf), np.full((1 << levels, dimensions), -np.inf)
    for r in found:
        counts[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r[2 : 2 + dimensions], r[2 + dimensions :]
    shards = -(-counts // shard)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of = cells.of(projection.rows(_matrix(batch.column("embedding"), projection.width)))
                part = batch.column("hash").to_numpy() % np.maximum(shards[of], 1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(of), pa.array(part)], names=["vec_id", "embedding", "cell", "shard"])

    placed = rows.withColumn("hash", F.xxhash64(F.lit(seed), "vec_id")).mapInArrow(dealt, "vec_id long, embedding array<double>, cell long, shard long")
    path = scratch(vectors.sparkSession, "neighbours")
    placed.repartition("cell", "shard").write.partitionBy("cell", "shard").parquet(path)
    return Index(path, projection, cells, shards, low, high)


def _visits(index: Index, queries: DataFrame, quantile: float) -> DataFrame:
    """(query_id, embedding, least, cell, shard): of queries without least their home cell's shards, of others the cells, but for
    home, whose boxes are within reach of their k-th best score."""
    home_only = "least" not in queries.columns
    if home_only:
        queries = queries.withColumn("least", F.lit(float("-inf")))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                vectors = _matrix(batch.column("embedding"), index.projection.width)
                points = index.projection.queries(vectors)
                home = index.cells.of(points)
                if home_only:
                    row, cell = np.arange(len(home)), home
                else:
                    reach = index.projection.reach(vectors, batch.column("least").to_numpy(), quantile)
                    far = np.array([gaps(p, index.low, index.high) for p in points])
                    row, cell = np.nonzero((far <= reach[:, None]) & (np.arange(len(index.shards)) != home[:, None]))
                times = index.shards[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                if len(row):
                    part = np.concatenate([np.arange(t) for t in times])
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row)) for c in ("query_id", "embedding", "least")], pa.array(cell), pa.array(part)], names=["query_id", "embedding", "least", "cell", "shard"])

    return queries.select("query_id", "embedding", "least").mapInArrow(over, "query_id long, embedding array<double>, least double, cell long, shard long")


def _searched(index: Index, visits: DataFrame, k: int, quantile: float) -> DataFrame:
    """(query_id, vec_id, score, tried) of what each visit finds; tried, the rows verified, stands in a visit's first row. Visits of a
    shard come together, dealt to several tasks, each of which loads it once."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = open_fs(index.path)
        loaded, shard = None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                vectors = _matrix(batch.column("embedding"), index.projection.width)
                points, out = index.projection.queries(vectors), []
                for i, (query, least, *at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("query_id", "least", "cell", "shard")))):
                    if at != loaded:
                        table = pads.dataset(f"{where}/cell={at[0]}/shard={at[1]}", filesystem=fs, format="parquet").to_table(columns=["vec_id", "embedding"]).combine_chunks()
                        loaded, shard = at, Shard(table.column("vec_id").to_numpy(), _matrix(table.column("embedding").combine_chunks(), index.projection.width), index.projection)
                    reach = lambda s, v=vectors[i : i + 1]: index.projection.reach(v, np.array([s]), quantile)[0]
                    ids, scores, tried = shard.search(query, vectors[i], points[i], least, k, reach)
                    if len(ids):
                        out.append((np.full(len(ids), query), ids, scores, np.array([tried] + [0] * (len(ids) - 1))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score", "tried"])

    tasks = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a visit is a few bytes and much work: Spark mustn't put them together
    together = visits.repartition(tasks, "cell", "shard", F.pmod(F.xxhash64("query_id"), F.lit(DEALT))).sortWithinPartitions("cell", "shard")
    return together.mapInArrow(over, "query_id long, vec_id long, score double, tried long")


def search(index: Index, queries: DataFrame, k: int = 20, certainty: float = 0.95) -> DataFrame:
    """(query_id, rank int, vec_id, score, verified) of the k nearest found for each row of ``queries`` (query_id, embedding, usable rows).

    First each query searches its home cell; its k-th best score there then bounds which other cells can hold nearer ones, by the
    test, and these are searched in a second round with that bound. ``certainty`` is the probability with which each true neighbour
    lies within the projected distance where the search stops; 1 minus it is the share of neighbours that may be lost. verified: rows
    that were compared exactly for a query, as far as visits found something.
    """
    quantile = chi_square_quantile(certainty, index.projection.directions.shape[1])
    first = stored(_searched(index, _visits(index, queries, quantile), k, quantile), "home")
    best = top_per_query(first, F.col("score"), k, item="vec_id")
    least = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(float("-inf")).alias("least"))
    asked = queries.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    second = stored(_searched(index, _visits(index, asked, quantile), k, quantile), "others")
    found = first.unionByName(second)
    tried = found.groupBy("query_id").agg(F.sum("tried").alias("verified"))
    return top_per_query(found.drop("tried"), F.col("score"), k, item="vec_id").join(tried, "query_id").select("query_id", "rank", "vec_id", "score", "verified")


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, dimensions: int = 12, certainty: float = 0.95, seed: int = 1, shard: int = SHARD) -> DataFrame:
    """The k nearest rows, by inner product in double precision, of each row of ``vectors`` whose vec_id divides by ``every``.

    Returns query_id, rank from 1 (ties to the smaller vec_id), vec_id, score and verified; all candidates where there are fewer than
    k. A row with a null id, or whose vector is null, zero or has null or non-finite components, takes no part. Shorter vectors count as if filled with zeros.
    Repeated rows count once; rows of one id with different vectors are candidates of their own, but never of a query of that id, and as
    queries only the smallest vector (as arrays are ordered) asks. Other columns are ignored; an empty table gives none.
    """
    index = build(vectors, k, dimensions, seed, shard)
    asked = vectors.where(F.col("vec_id") % every == 0).where(usable(F.col("embedding")))
    asked = asked.groupBy(F.col("vec_id").cast("long").alias("query_id")).agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
    return search(index, stored(asked, "queries"), k, certainty)
