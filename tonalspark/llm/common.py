"""What the operators of this subpackage share: folders, hashing and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import open_fs, scratch, written

__all__ = ["ASCII_SPACE", "BitMap", "arrow_map", "mixed", "open_fs", "remove", "scratch", "shingles", "signed", "stored", "utf8", "word_hashes", "words_of"]

#: The white space of every contract here: what ``bytes.split()`` and ``bytes.strip()`` use.
ASCII_SPACE = b" \t\n\x0b\x0c\r"

_U64 = np.uint64


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = written(df, name)
    spark._jvm.System.gc()  # what the write has shuffled goes when the driver's collector finds that nothing refers to it
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 2048) -> DataFrame:
    """``f`` over every ``rows`` rows at most; the columns it returns are those of ``schema``, in its order."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = f(batch.slice(start, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(over, schema)


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a string column as UTF-8, without decoding them."""
    cast = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return (x.as_py() for x in cast)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = h
        return h


_words = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    out = np.fromiter(map(_words.__getitem__, words), _U64, len(words))
    if len(_words) >= WordHashes.LIMIT:
        _words.clear()
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser) over an array."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def words_of(text: bytes | None) -> list[bytes]:
    """Words: runs of anything but ASCII white space, A-Z lower-cased."""
    return text.lower().split() if text else []


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """The hash of each k-word shingle, in order; with fewer words, of the whole sequence; without words, nothing."""
    if not words:
        return np.empty(0, _U64)
    h = word_hashes(words)
    width = min(k, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, _U64)
    for i in range(width):
        out = mixed(out * _U64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


#: Bits of a map at most (16 MB).
MOST_BITS = 1 << 27


class BitMap:
    """Of 64-bit numbers, of bounded size: what it doesn't have is in none of them; the fuller it is, the more others it has.

    Each slice of the bits is made in a task of its own; the driver puts them together and sends them with the tasks.
    """

    SLICE = 1 << 17

    def __init__(self, df: DataFrame, column: str, n: int):
        self.size = max(self.SLICE, min(MOST_BITS, 1 << (16 * max(n, 1) - 1).bit_length()))
        slices = -(-self.size // self.SLICE)

        def build(group: pd.DataFrame) -> pd.DataFrame:
            bits = np.zeros(BitMap.SLICE, np.uint8)
            bits[group["bit"].to_numpy() % BitMap.SLICE] = 1
            return pd.DataFrame({"slice": [int(group["bit"].iloc[0]) // BitMap.SLICE], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

        size = self.size
        found = df.select(F.pmod(F.col(column), F.lit(size)).alias("bit")).distinct().withColumn("slice", F.floor(F.col("bit") / BitMap.SLICE).cast("int"))
        whole = np.zeros((slices, self.SLICE // 8), np.uint8)
        for row in found.groupBy("slice").applyInPandas(build, "slice int, bits binary").toLocalIterator():
            whole[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
        self.sent = df.sparkSession.sparkContext.broadcast(whole.reshape(-1))

    def has(self, x: np.ndarray) -> np.ndarray:
        return _bits(self.sent.value, self.size, x)

    def might(self, column: Column) -> Column:
        """Might one of the numbers be that of the row? Only the column goes to Python."""
        sent, size = self.sent, self.size

        @F.pandas_udf("boolean")
        def has(x: pd.Series) -> pd.Series:
            return pd.Series(_bits(sent.value, size, x.to_numpy()))

        return has(column)


def _bits(bits: np.ndarray, size: int, x: np.ndarray) -> np.ndarray:
    at = x.view(np.int64) % size
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
