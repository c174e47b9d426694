"""Resamples documents by how much their hashed n-grams look like a target's.

The bucket of an n-gram is a CRC-32 of its text. The CRC of each word is computed once; CRCs of n-grams follow from those
of their words by the combination algebra: appending m bytes to a text multiplies its CRC by a GF(2) matrix that depends on
m alone, and adds the CRC of what is appended. So no string of an n-gram is ever made.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, stored, utf8

#: Bytes of words: digits, a-z after lower-casing, all bytes of characters beyond ASCII.
WORD, BREAK = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Bytes of a text that are taken apart at once, to the end of a word: bounds the memory that its words take.
PIECE = 1 << 20

_POLYNOMIAL = 0xEDB88320  # CRC-32, reflected


def _shift_tables(powers: int) -> np.ndarray:
    """(power, byte, value): what each byte of a CRC becomes when 2^power zero bytes are appended; a matrix over GF(2), whose
    columns are given for single bits and added (xor) for whole bytes. Each matrix is the square of the one before."""
    column = np.zeros(32, np.uint32)
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = c >> 1 ^ (_POLYNOMIAL if c & 1 else 0)
        column[bit] = c
    out = np.zeros((powers, 4, 256), np.uint32)
    values = np.arange(256, dtype=np.uint32)
    for power in range(powers):
        for byte in range(4):
            for bit in range(8):
                out[power, byte] ^= np.where(values >> np.uint32(bit) & np.uint32(1), column[8 * byte + bit], np.uint32(0)).astype(np.uint32)
        column = _applied(out[power], column)
    return out


def _applied(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


_SHIFTS = _shift_tables(31)


def combined(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRCs of joined texts from those of their halves and the right halves' lengths in bytes."""
    out = left.copy()
    for power in range(int(lengths.max(initial=0)).bit_length()):
        has = np.flatnonzero(lengths >> power & 1)
        out[has] = _applied(_SHIFTS[power], out[has])
    return out ^ right


def ngram_crcs(crcs: np.ndarray, lengths: np.ndarray, most: int) -> list[np.ndarray]:
    """For n from 1 to ``most`` the CRC of each run of n words joined by one space, by its first word."""
    out = [crcs]
    space = np.full(len(crcs), zlib.crc32(b" "), np.uint32)
    behind = combined(space, crcs, lengths)  # of a space and a word
    for n in range(2, most + 1):
        if len(crcs) < n:
            break
        out.append(combined(out[-1][: len(crcs) - n + 1], behind[n - 1 :], lengths[n - 1 :] + 1))
    return out


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = BREAK.search(text, at + PIECE)
        yield text[at : (at := end.start() if end else len(text))]


def features(text: bytes | None, most: int, buckets: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Words, n-grams, and the distinct buckets of these with their counts."""
    words, total, found = 0, 0, {}
    held, held_lengths = np.empty(0, np.uint32), np.empty(0, np.int64)
    for piece in _pieces((text or b"").lower()):
        here = WORD.findall(piece)
        words += len(here)
        crcs = np.concatenate((held, np.fromiter(map(zlib.crc32, here), np.uint32, len(here))))
        lengths = np.concatenate((held_lengths, np.fromiter(map(len, here), np.int64, len(here))))
        for n, grams in enumerate(ngram_crcs(crcs, lengths, most), 1):
            new = grams[max(0, len(held) - n + 1) :]  # those before lie in what was held from the last piece, whole
            total += len(new)
            for bucket, count in zip(*(a.tolist() for a in np.unique(new % np.uint32(buckets), return_counts=True))):
                found[bucket] = found.get(bucket, 0) + count
        held, held_lengths = (crcs[-(most - 1) :], lengths[-(most - 1) :]) if most > 1 else (held, held_lengths)
    at = sorted(found)
    return words, total, np.array(at, np.uint32), np.array([found[b] for b in at], np.uint32)


def counted(docs: DataFrame, most: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, buckets, counts) of each row: from its whole text, as packed numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [features(text, most, buckets) for text in utf8(batch.column(1))]
        columns = [batch.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), *[pa.array([m[i].tobytes() for m in made], pa.binary()) for i in (2, 3)]]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "buckets", "counts"])

    return arrow_map(docs.select("doc_id", "text"), of, f"doc_id {kind}, n_words long, n_features long, buckets binary, counts binary", rows=256)


def totals(made: DataFrame, buckets: int) -> np.ndarray:
    """The features in each bucket, of all rows of ``counted``: summed in the tasks, then by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for b, n in zip(utf8(batch.column(0)), utf8(batch.column(1))):
                sums[np.frombuffer(b, np.uint32)] += np.frombuffer(n, np.uint32)
        at = np.flatnonzero(sums)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    found = made.select("buckets", "counts").mapInArrow(partial, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(made: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains over a row's features, 0 without any."""
    kind = made.schema["doc_id"].dataType.simpleString()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_features").to_pylist()
            sums = [int(gain[np.frombuffer(b, np.uint32)] @ np.frombuffer(c, np.uint32).astype(np.int64)) for b, c in zip(utf8(batch.column("buckets")), utf8(batch.column("counts")))]
            weight = pa.array([s // k if k else 0 for s, k in zip(sums, n)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), weight], names=["doc_id", "n_words", "n_features", "weight"])

    return made.mapInArrow(over, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor of 1000 times a Gumbel number that follows from the id and the seed; a null id counts as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(key, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance(docs: DataFrame, target: DataFrame, most: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text), for the texts of ``target``.

    Of the N rows with ``least_words`` words or more, the floor(percent N / 100) of highest score are drawn and get their rank from
    1, ties by smaller doc_id (null last), fewer features and smaller weight; other rows' rank is null. Null and empty texts have no
    words and weight 0. Repeated rows count and are drawn as often as they occur. Other columns are ignored.

    Texts are read once; what a row has in its buckets is written, and read again when the gains are known. Scores are whole
    numbers within a range that the formula bounds (some 150,000 values), so the table of their counts goes to the driver; ranks are
    dealt within a score, over distinct rows.
    """
    made = stored(counted(docs, most, buckets), "features")
    gain = gains(totals(made, buckets), totals(counted(target.select(F.lit(0).alias("doc_id"), "text"), most, buckets), buckets))
    score = F.col("weight") + noise(F.col("doc_id"), seed)
    rows = stored(weighed(made, gain).withColumn("score", score), "scores")
    fits = F.col("n_words") >= least_words
    sums = rows.where(fits).groupBy("score").count().toArrow()
    order = np.argsort(-sums.column("score").to_numpy())
    scores, counts = sums.column("score").to_numpy()[order], sums.column("count").to_numpy()[order]
    drawn = int(counts.sum()) * percent // 100
    before = np.concatenate(([0], np.cumsum(counts)))[: len(counts)]
    top = int((before < drawn).sum())
    if not top:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    spark = docs.sparkSession
    offsets = spark.createDataFrame(list(zip(scores[:top].tolist(), before[:top].tolist())), "score long, before long")
    near = fits & (F.col("score") >= int(scores[top - 1]))
    kinds = rows.where(near).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    within = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    ahead = F.coalesce(F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = kinds.withColumn("ahead", ahead).join(F.broadcast(offsets), "score")
    ranked = placed.withColumn("rank", F.explode(F.sequence(F.col("before") + F.col("ahead") + 1, F.col("before") + F.col("ahead") + F.col("copies"))))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*rows.columns, "rank")
    return ranked.unionByName(rows.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with their columns, whose doc_id is drawn; see ``importance``. Rows of one doc_id share their fate;
    those without one stay out."""
    drawn = importance(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, docs["doc_id"] == drawn["__drawn"], "left_semi")
