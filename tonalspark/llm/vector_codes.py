"""Compresses vectors to a code of a byte a part: Lloyd's rounds with Elkan's bounds, in whole numbers.

Components become whole numbers, vectors equal parts; each part position has a codebook. The state of a round is a table in the
shared folder: beside a row's parts and code it holds, for each part, an upper bound of the distance to its entry and a
lower bound for every entry. When entries move the bounds are shifted by how far they went, and only entries that the bounds
don't exclude strictly are measured, in whole numbers; so the codes are those of measuring all, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .common import remove, stored

#: Components of larger magnitude (as whole numbers) make distances that a long can't hold.
LARGEST = 1 << 27
#: Rows that a task works on at once: bounds its memory.
ROWS = 512
#: Bounds are rounded by this share towards the safe side, far more than doubles err.
SLACK = 1e-12

_STATE = "vec_id {id}, label {label}, parts binary, code binary, upper binary, lower binary, scale binary, tried int"


def whole(vector: Column, unit: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(unit)) * x.cast("double")))


def usable(vector: Column, unit: int) -> Column:
    """No null vector, none without components, none with null, non-finite or too large ones."""
    ok = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) <= LARGEST / unit), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & ok, F.lit(False))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries: in doubles where they hold every number on the way, else in longs."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


class Bounds:
    """Bounds of one part of some rows: code, upper (row) and lower (row, entry); tried counts the distances measured."""

    def __init__(self, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, tried: np.ndarray):
        self.code, self.upper, self.lower, self.tried = code, upper, lower, tried

    @classmethod
    def measured(cls, x: np.ndarray, entries: np.ndarray) -> Bounds:
        d = distances(x, entries)
        code = d.argmin(1)  # the first of equal ones
        root = np.sqrt(d)
        return cls(code, root[np.arange(len(x)), code] * (1 + SLACK), root * (1 - SLACK), np.full(len(x), len(entries)))

    def moved(self, x: np.ndarray, entries: np.ndarray, step: np.ndarray, half: np.ndarray) -> Bounds:
        """After the entries went ``step`` far; ``half``: half of the distances between the entries where they are now."""
        upper = (self.upper + step[self.code]) * (1 + SLACK)
        lower = np.maximum(self.lower - step, 0) * (1 - SLACK)
        tried, code = np.zeros(len(x), int), self.code.copy()
        open_ = np.flatnonzero(self._open(code, upper, lower, half).any(1))
        if not len(open_):
            return Bounds(code, upper, lower, tried)
        own = ((x[open_] - entries[code[open_]]) ** 2).sum(1)  # the upper bound made exact, then the rest again
        upper[open_] = np.sqrt(own) * (1 + SLACK)
        tried[open_] += 1
        at, entry = np.nonzero(self._open(code[open_], upper[open_], lower[open_], half))
        found = np.full((len(open_), len(entries)), np.iinfo(np.int64).max)
        found[np.arange(len(open_)), code[open_]] = own
        found[at, entry] = ((x[open_[at]] - entries[entry]) ** 2).sum(1)
        np.add.at(tried, open_[at], 1)
        lower[open_[at], entry] = np.sqrt(found[at, entry]) * (1 - SLACK)
        lower[open_, code[open_]] = np.sqrt(own) * (1 - SLACK)
        code[open_] = found.argmin(1)
        upper[open_] = np.sqrt(found[np.arange(len(open_)), code[open_]]) * (1 + SLACK)
        return Bounds(code, upper, lower, tried)

    @staticmethod
    def _open(code: np.ndarray, upper: np.ndarray, lower: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Entries that may be as near as the present one: excluded are those strictly beyond it by one of the two bounds."""
        may = (lower <= upper[:, None]) & (half[code] <= upper[:, None])
        may[np.arange(len(code)), code] = False
        return may


def _halves(entries: np.ndarray) -> np.ndarray:
    """(part, entry, entry): half of the distances between a codebook's entries."""
    return np.array([np.sqrt(distances(c, c)) / 2 * (1 - SLACK) for c in entries])


def _matrix(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _assigned(state: DataFrame, entries: np.ndarray, before: np.ndarray | None, schema: str) -> DataFrame:
    """The next state: by measuring all if ``before`` is None, else from the bounds of a state whose entries these were."""
    parts, _, width = entries.shape
    halves = _halves(entries) if before is not None else None
    steps = None if before is None else np.sqrt(((entries - before) ** 2).sum(2)) * (1 + SLACK)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(start, ROWS)
                x = _matrix(batch.column("parts"), np.int32, parts, width).astype(np.int64)
                if steps is None:
                    found = [Bounds.measured(x[:, p], entries[p]) for p in range(parts)]
                else:
                    code, upper = _matrix(batch.column("code"), np.uint8, parts).astype(int), _matrix(batch.column("upper"), np.float64, parts)
                    scale = _matrix(batch.column("scale"), np.float64, parts)
                    lower = _matrix(batch.column("lower"), np.uint8, parts, entries.shape[1]) * scale[:, :, None]
                    found = [Bounds(code[:, p], upper[:, p], lower[:, p], None).moved(x[:, p], entries[p], steps[p], halves[p]) for p in range(parts)]
                lower = np.stack([b.lower for b in found], 1)
                scale = np.maximum(lower.max(2) / 255, 1e-300)
                short = np.floor(lower / scale[:, :, None] * (1 - SLACK)).clip(0, 255).astype(np.uint8)  # a byte a bound, rounded down
                code, upper = np.stack([b.code for b in found], 1).astype(np.uint8), np.stack([b.upper for b in found], 1)
                tried = pa.array(sum(b.tried for b in found).astype(np.int32))
                columns = [batch.column("vec_id"), batch.column("label"), batch.column("parts"), _bytes(code), _bytes(upper), _bytes(short.reshape(len(x), -1)), _bytes(scale * (1 - SLACK)), tried]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "parts", "code", "upper", "lower", "scale", "tried"])

    return state.mapInArrow(over, schema)


def _updated(state: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Each entry as the componentwise floor of its parts' mean; summed in the tasks, then by Spark: as many sums come to the
    driver as codebooks have components."""
    parts, n, width = entries.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, n, width + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), np.int32, parts, width)
                code = _matrix(batch.column(1), np.uint8, parts)
                for p in range(parts):
                    np.add.at(sums[p], code[:, p], np.pad(x[:, p].astype(np.int64), ((0, 0), (0, 1)), constant_values=1))
        at = np.flatnonzero(sums)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.reshape(-1)[at])], names=["place", "s"])

    found = state.select("parts", "code").mapInArrow(partial, "place long, s long").groupBy("place").agg(F.sum("s").alias("s")).toArrow()
    sums = np.zeros(entries.size // width * (width + 1), np.int64)
    sums[found.column("place").to_numpy()] = found.column("s").to_numpy()
    sums = sums.reshape(parts, n, width + 1)
    count = sums[:, :, width:]
    return np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), entries)


def _coded(state: DataFrame, entries: np.ndarray, schema: str) -> DataFrame:
    """vec_id, label, code in hexadecimal digits and the exact error of every row of a state."""
    parts, _, width = entries.shape

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, code = _matrix(batch.column("parts"), np.int32, parts, width).astype(np.int64), _matrix(batch.column("code"), np.uint8, parts)
                error = sum(((x[:, p] - entries[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "parts", "code").mapInArrow(over, schema)


class Codes:
    """rows: a table of vec_id, label, code, error; entries: (part, entry, component); tried: distances measured in each round."""

    def __init__(self, rows: DataFrame, entries: np.ndarray, tried: list[int]):
        self.rows, self.entries, self.tried = rows, entries, tried

    @property
    def sha256(self) -> str:
        """Of all entries' components in decimal digits by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, unit: int = 1024) -> Codes:
    """Codes of all usable rows of ``vectors`` (vec_id, embedding and, if there is one, label).

    Each component x becomes floor(unit x). A codebook starts as its part of the ``entries`` smallest vec_ids (null last, then by
    vector). Rounds assign every part to the nearest entry, ties to the lower index, and replace each entry by the floor of its parts'
    mean; an entry without parts stays. Rows whose vector is null, empty or has null, non-finite or too large components (whole
    numbers above LARGEST) are left out. Shorter vectors are filled with zeros to the longest one's length, as are all where it
    doesn't divide by ``parts``. Repeated rows count as often as they occur; other columns are ignored. An empty table gives none.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte for each part: 1 to 256 entries")
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    kept = vectors.select("vec_id", label.alias("label"), "embedding").where(usable(F.col("embedding"), unit))
    kept = kept.select("vec_id", "label", whole(F.col("embedding"), unit).alias("v"))
    length = kept.agg(F.max(F.size("v"))).first()[0] or parts
    width = -(-length // parts)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                filled = [np.pad(np.array(v, np.int32), (0, parts * width - len(v))) for v in batch.column("v").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _bytes(np.array(filled))], names=["vec_id", "label", "parts"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = _STATE.format(id=kinds["vec_id"], label=kinds["label"])
    spark = vectors.sparkSession
    path = written(kept.mapInArrow(packed, f"vec_id {kinds['vec_id']}, label {kinds['label']}, parts binary"), "parts")
    rows = spark.read.parquet(path)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "parts").select("parts").limit(entries).toArrow().column("parts").combine_chunks()
    book = _matrix(first, np.int32, parts, width).astype(np.int64).transpose(1, 0, 2).copy()
    out = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not len(first):
        return Codes(spark.createDataFrame([], out), book, [])
    state, before, tried = rows, None, []
    for turn in range(rounds + 1):
        last, path = path, written(_assigned(state, book, before, schema), f"codes-{turn}")
        remove(spark, last)  # the new state has all that the old one had
        state = spark.read.parquet(path)
        tried.append(state.agg(F.sum("tried")).first()[0])
        if turn < rounds:
            before, book = book, _updated(state, book)
    return Codes(stored(_coded(state, book, out), "coded"), book, tried)


def survey(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, unit: int = 1024) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row; label_error: the errors of its label's rows,
    null a label of its own. Errors are summed by label before the shuffle and joined back, so Spark can split a hot label."""
    made = compress(vectors, parts, entries, rounds, unit)
    sums = made.rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    met = made.rows.join(sums, made.rows["label"].eqNullSafe(sums["of"]), "left")
    return met.select("vec_id", "code", "error", "label_error", F.lit(made.sha256).alias("codebooks_sha256"))
