"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a piece wherever its low bits are all ones; each piece gives one
character of the signature. The block size, a power of two, sets how many of the bits are looked at. It begins with
the length of the text and is halved while too few pieces come out and doubled while there are too many.

A repetitive text has few distinct windows, so at any block size all of them or none may end a piece. Hence a piece
has half a block at the least, and two blocks at the most: where nothing triggers up to there, the window with the
greatest hash ends it, the last of equal ones. Both depend on what the piece holds, so pieces fall into step again
behind an edit, and each character stands for a bounded part of the text however it repeats itself.

A fingerprint is ``block:signature:signature at twice the block``; two fingerprints are compared by the edit distance
of those signatures that stand for one block size.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mixed

WINDOW = 7
#: A signature has about PIECES / 2 to PIECES characters, and MOST at the most.
PIECES, MOST = 48, 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)

_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 1 << 16), _BASE, np.uint64)
        more[0] = 1
        _powers = np.cumprod(more, dtype=np.uint64)
    return _powers[:n]


def block_size(n_bytes: int) -> int:
    """Where the search for a block size begins."""
    block = 1
    while block * PIECES < n_bytes:
        block *= 2
    return block


def _rolling(data: np.ndarray) -> np.ndarray:
    """The hash of each window of bytes; nothing, if the text is shorter."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.uint32)
    wide, rolling = data.astype(np.uint32), np.zeros(n - WINDOW + 1, np.uint32)
    for k in range(WINDOW):
        rolling *= np.uint32(0x01000193)
        rolling += wide[k : n - WINDOW + 1 + k]
    rolling ^= rolling >> np.uint32(15)
    rolling *= np.uint32(0x85EBCA6B)
    rolling >>= np.uint32(8)
    return rolling


def _starts(rolling: np.ndarray, n: int, block: int) -> np.ndarray:
    """Where the pieces of a text of ``n`` bytes start: one at least, and n / (2 block) to 2 n / block + 1 of them."""
    mask = np.uint32(block - 1)
    triggers = (np.flatnonzero((rolling & mask) == mask) + WINDOW).tolist()
    triggers.append(n + 2 * block + WINDOW)
    least, most = max(block // 2, 1), 2 * block
    starts, start, i = [0], 0, 0
    while True:
        low, high = max(start + least, WINDOW), max(start + most, WINDOW)
        i = bisect_left(triggers, low, i)
        end = triggers[i]
        if end > high:
            if high >= n:
                break
            end = high - int(rolling[low - WINDOW : high - WINDOW + 1][::-1].argmax())
        if end >= n:
            break
        starts.append(end)
        start = end
    return np.array(starts)


def _signature(values: np.ndarray, starts: np.ndarray) -> str:
    """values: of each byte times the power of its place in the text; starts: of the pieces."""
    n = len(values)
    sums = np.add.reduceat(values, starts)
    # a piece's sum times the power that its start lacks doesn't depend on where the piece stands
    lacks = _powers_to(n)[n - 1 - starts]
    return ALPHABET[(mixed(sums * lacks * _places(n)) >> np.uint64(58)).astype(np.intp)].tobytes().decode()


def _places(n: int) -> np.uint64:
    """Takes the length of the text out of the above: the inverse of the base to the power n - 1."""
    return np.uint64(pow(pow(int(_BASE), -1, 1 << 64), n - 1, 1 << 64))


def fingerprint(text: bytes) -> str:
    """Of a whole text; an empty text has block size 1 and empty signatures."""
    n = len(text)
    if not n:
        return "1::"
    data = np.frombuffer(text, np.uint8)
    rolling, made = _rolling(data), {}

    def starts(block: int) -> np.ndarray:
        if block not in made:
            made[block] = _starts(rolling, n, block)
        return made[block]

    block = block_size(n)
    while block > 1 and len(starts(block)) < PIECES // 2:
        block //= 2
    while len(starts(block)) > MOST:
        block *= 2
    values = _BYTE[data] * _powers_to(n)
    return f"{block}:{_signature(values, starts(block))}:{_signature(values, starts(2 * block))}"


def _distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of pairs of signatures of at most 64 characters, bit-parallel over all pairs at once."""
    n = len(a)
    la, lb = np.fromiter(map(len, a), np.int64, n), np.fromiter(map(len, b), np.int64, n)
    A = np.frombuffer("".join(x.ljust(MOST, "\0") for x in a).encode("latin-1"), np.uint8).reshape(n, MOST)
    B = np.frombuffer("".join(x.ljust(MOST, "\1") for x in b).encode("latin-1"), np.uint8).reshape(n, MOST)
    one = np.uint64(1)
    plus, minus = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score, last = la.copy(), one << np.maximum(la - 1, 0).astype(np.uint64)
    for j in range(int(lb.max(initial=0))):
        same = np.packbits(A == B[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
        across = (((same & plus) + plus) ^ plus) | same | minus
        up, down = minus | ~(across | plus), plus & across
        live = j < lb
        score += np.where(live & ((up & last) != 0), 1, 0) - np.where(live & ((down & last) != 0), 1, 0)
        up, down = (up << one) | one, down << one
        vertical = same | minus
        plus, minus = down | ~(vertical | up), up & vertical
    return np.where(la == 0, lb, score)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Of pairs of fingerprints, 0 to 1: one less the edit distance over the longer signature, at the block sizes that
    both have (the better, if two); 0 where they have none in common or one text is empty; 1 for equal ones."""
    out = np.array([float(x == y) for x, y in zip(left, right)])
    at, xs, ys = [], [], []
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            continue
        bx, x1, x2 = x.split(":")
        by, y1, y2 = y.split(":")
        bx, by = int(bx), int(by)
        if not x1 or not y1:
            continue
        for size, p, q in ((bx, x1, y1), (2 * bx, x2, y2)) if bx == by else ((bx, x1, y2),) if bx == 2 * by else ((by, x2, y1),) if by == 2 * bx else ():
            if p and q and (size == min(bx, by) * (1 if bx == by else 2) or min(len(p), len(q)) >= 8):
                at.append(i)
                xs.append(p)
                ys.append(q)
    if at:
        longer = np.maximum(np.fromiter(map(len, xs), np.int64), np.fromiter(map(len, ys), np.int64))
        np.maximum.at(out, np.array(at), np.minimum(1 - _distances(xs, ys) / longer, 1.0))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every whole text; a null text counts as empty. No shuffle."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py().encode()) for x in batch.column(1)], pa.string())], names=[id_col, "fingerprint"])

    return arrow_map(rows, of, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fingerprint string")


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Documents dealt into ranges of doc_id: (part int, tail boolean, doc_id, text), with the first document of each
    range also at the end of the one before (tail), so that every document meets its successor. Ascending doc_id, then
    text, within a part; null ids come first. After the last document comes the first.

    The bounds are approximate quantiles of the ids: one number for each partition passes through the driver.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted({*(rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] or [])}) if n > 1 else []
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        """The number of bounds that an id has reached; null ids are in the first range."""
        none = ids.isna()
        return pd.Series(np.where(none, 0, np.searchsorted(bounds, ids.where(~none, 0).astype(np.int64), side="right"))).astype("int32")

    rows = rows.select((part("doc_id") if len(bounds) else F.lit(0)).alias("part"), "doc_id", "text")
    firsts = sorted((r.part, r.id) for r in rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").alias("id"))).alias("m")).select("part", "m.id").collect())
    before = {p: firsts[i - 1][0] for i, (p, _) in enumerate(firsts)}
    tails = None
    if firsts:
        heads = spark.createDataFrame([(p, i, before[p]) for p, i in firsts], "p int, i long, to int")
        tails = (
            rows.join(F.broadcast(heads), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("i")))
            .groupBy("to", "doc_id")
            .agg(F.min("text").alias("text"))
            .select(F.col("to").alias("part"), F.lit(True).alias("tail"), "doc_id", "text")
        )
    out = rows.select("part", F.lit(False).alias("tail"), "doc_id", "text")
    out = out.unionByName(tails) if tails is not None else out
    # by range, so that a partition has a range of ids, and not the several that one hash may fall to
    return out.repartitionByRange(n, "part").sortWithinPartitions("part", "tail", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points (rounded down) replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def edit_survey(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """For every document its fingerprint, that of its edited text, and how alike the fingerprints of the document, of
    the edited text and of the next document are.

    Order: ascending doc_id, equal ids by text, null ids first; after the last document comes the first, and a single
    document is its own successor. Null texts count as empty. Repeated rows each get a row. Other columns are ignored.
    One shuffle of the texts by ranges of doc_id; tasks hold a batch and the last row before it.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, doc_id, text, fingerprint) of the row that waits for its successor
        for batch in batches:
            parts, tails, ids, texts = (batch.column(i) for i in range(4))
            for start in range(0, batch.num_rows, 1000):
                rows: list = []
                for i in range(start, min(start + 1000, batch.num_rows)):
                    part, text = parts[i].as_py(), texts[i].as_py()
                    raw = text.encode()
                    print_ = fingerprint(raw)
                    if held is not None and held[0] == part:
                        rows.append((*held[1:], text, print_))
                    held = None if tails[i].as_py() else (part, ids[i].as_py(), text, print_)
                if rows:
                    new = [edited(r[1], r[3]) for r in rows]
                    raw = [x.encode() for x in new]
                    prints, own = [fingerprint(x) for x in raw], [r[2] for r in rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
                            pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array(own, pa.string()), pa.array(prints, pa.string()),
                            pa.array(likeness(own, prints)), pa.array(likeness(own, [r[4] for r in rows])),
                        ],
                        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                    )

    return with_next(docs, partitions).mapInArrow(over, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
