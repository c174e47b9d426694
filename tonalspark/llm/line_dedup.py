"""Removes lines that many documents share, without joining lines.

The documents that hold each distinct line are counted by 128-bit hashes. All distinct lines are split into shards by hash;
each shard gets a minimal perfect hash (levels of collision-free bits) that numbers its lines, and compact arrays in that
order: fingerprints of 16 bits and counts that stop at 255, with the keepers of those that enough documents hold; some 3.5
bytes a line. Documents are read once more and send their lines to the shards, where they probe the arrays: a line's number is
computed, its fingerprint tells whether it is the line that has the number, and its count decides. A bit map of bounded size keeps
most lines that few documents hold from being sent. What is to be dropped goes back to the documents as hashes.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ASCII_SPACE, BitMap, arrow_map, mixed, open_fs, scratch, signed, stored, utf8

#: Lines of a shard.
SHARD_LINES = 250_000
_NO_ID = -(1 << 63)
_LOW = (1 << 64) - 1
_U = np.uint64


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: n keys get the numbers 0 to n - 1.

    Level by level, keys that meet no other key in a bit array of twice their number set their bit; the rest go on.
    A key's number is the rank of its bit. About 3.7 bits a key with the ranks.
    """

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels, base, rest = [], 0, keys
        while len(rest):
            if len(levels) > 200:
                raise ValueError("keys repeat")
            m = max(64, math.ceil(gamma * len(rest) / 64) * 64)
            at = cls._place(rest, len(levels), m)
            alone = np.bincount(at, minlength=m)[at] == 1
            bits = np.zeros(m, np.uint8)
            bits[at[alone]] = 1
            words = np.packbits(bits, bitorder="little").view(_U)
            ranks = base + np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))[:-1]
            levels.append((m, words, ranks))
            base += int(alone.sum())
            rest = rest[~alone]
        return cls(levels)

    @staticmethod
    def _place(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mixed(keys + _U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % _U(m)).astype(np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """A key of the set gets its own number; any other key one of the numbers, or -1."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (m, words, ranks) in enumerate(self.levels):
            at = self._place(keys[todo], level, m)
            word, bit = words[at >> 6], (at & 63).astype(_U)
            hit = (word >> bit) & _U(1) == 1
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1)))
            out[todo[hit]] = (ranks[at >> 6] + below)[hit]
            todo = todo[~hit]
        return out


class Shard:
    """The arrays of one shard's lines, in the order of its perfect hash; ``held`` are the numbers of lines with a keeper."""

    def __init__(self, salt: int, hashing: PerfectHash, prints: np.ndarray, counts: np.ndarray, held: np.ndarray, keepers: np.ndarray):
        self.salt, self.hashing, self.prints, self.counts, self.held, self.keepers = salt, hashing, prints, counts, held, keepers

    @staticmethod
    def _keys(h1: np.ndarray, h2: np.ndarray, salt: int) -> np.ndarray:
        return mixed(h1 ^ mixed(h2 + _U(salt)))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray, min_docs: int) -> Shard:
        salt = 0
        while len(np.unique(keys := cls._keys(h1, h2, salt))) < len(keys):
            salt += 1
        hashing = PerfectHash.build(keys)
        order = np.argsort(hashing.numbers(keys))
        counts = counts[order]
        held = np.flatnonzero(counts >= min_docs)
        kind = np.uint8 if min_docs <= 255 else np.uint32
        return cls(salt, hashing, (h2[order] >> _U(48)).astype(np.uint16), np.minimum(counts, np.iinfo(kind).max).astype(kind), held.astype(np.uint32), keepers[order][held])

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, keeper) of each line; count 0 where the fingerprint says that the shard doesn't have it. A keeper means
        something only where the count is that of a shared line."""
        if not len(self.prints):
            return np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        at = self.hashing.numbers(self._keys(h1, h2, self.salt))
        own = (at >= 0) & (self.prints[at] == (h2 >> _U(48)).astype(np.uint16))
        keeper = np.zeros(len(h1), np.int64)
        if len(self.held):
            keeper = self.keepers[np.minimum(np.searchsorted(self.held, at), len(self.held) - 1)]
        return np.where(own, self.counts[at], 0).astype(np.int64), keeper

    def dump(self) -> bytes:
        out, extra = io.BytesIO(), {}
        for i, (m, words, ranks) in enumerate(self.hashing.levels):
            extra |= {f"m{i}": np.array([m]), f"w{i}": words, f"r{i}": ranks}
        np.savez(out, salt=np.array([self.salt]), prints=self.prints, counts=self.counts, held=self.held, keepers=self.keepers, **extra)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        z = np.load(io.BytesIO(data))
        levels = [(int(z[f"m{i}"][0]), z[f"w{i}"], z[f"r{i}"]) for i in range(sum(k[0] == "m" for k in z.files))]
        return cls(int(z["salt"][0]), PerfectHash(levels), z["prints"], z["counts"], z["held"], z["keepers"])


def _shard(path: str, number: int) -> Shard:
    fs, where = open_fs(f"{path}/shard={number}")
    return Shard.load(pads.dataset(where, filesystem=fs, format="parquet").to_table(columns=["data"]).column("data")[0].as_py())


def line_hashes(text: bytes | None, min_chars: int) -> tuple[list[int], list[int]]:
    """The numbers and 128-bit hashes of those lines of a text whose key is long enough.

    Lines are split at \\n; a null or empty text has one empty line. A key is the line without ASCII white space at
    its ends and with A-Z lower-cased.
    """
    at, hashes = [], []
    for i, line in enumerate((text or b"").split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(ASCII_SPACE).lower()
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                at.append(i)
                hashes.append(xxhash.xxh3_128_intdigest(key))
    return at, hashes


def _halves(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter((h & _LOW for h in hashes), _U, len(hashes)), np.fromiter((h >> 64 for h in hashes), _U, len(hashes))


def line_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, n, keeper) of all distinct lines whose key is long enough: the documents (distinct doc_ids, null being one) that
    hold it, and the largest of them. A line and document are one row however often they meet; a line that a third of the
    documents hold is summed before it is shuffled."""

    def held(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, hashes, owners = batch.column(0), [], []
        for i, text in enumerate(utf8(batch.column(1))):
            own = set(line_hashes(text, min_chars)[1])
            hashes += own
            owners += [_NO_ID if (x := ids[i].as_py()) is None else x] * len(own)
        if not hashes:
            return None
        h1, h2 = _halves(hashes)
        return pa.RecordBatch.from_arrays([pa.array(signed(h1)), pa.array(signed(h2)), pa.array(owners, pa.int64())], names=["h1", "h2", "doc"])

    return arrow_map(docs.select("doc_id", "text"), held, "h1 long, h2 long, doc long").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper"))


def build_index(lines: DataFrame, min_docs: int, shard_lines: int = SHARD_LINES) -> tuple[str, int, BitMap]:
    """Writes the shards of ``line_counts`` to the shared folder; returns the path, their number, and a bit map of the lines that
    ``min_docs`` documents hold."""
    kept = stored(lines, "lines")
    n = -(-kept.count() // shard_lines)
    path = scratch(lines.sparkSession, "line-index")
    if n:

        def build(group: pd.DataFrame) -> pd.DataFrame:
            h1, h2 = (group[c].to_numpy().view(_U) for c in ("h1", "h2"))
            shard = Shard.build(h1, h2, group["n"].to_numpy(), group["keeper"].to_numpy(), min_docs)
            return pd.DataFrame({"shard": group["shard"].iloc[:1], "data": [shard.dump()]})

        numbered = kept.withColumn("shard", F.pmod("h1", F.lit(n)).cast("int"))  # even: h1 is a hash, each line is one row
        numbered.groupBy("shard").applyInPandas(build, "shard int, data binary").write.partitionBy("shard").parquet(path)
    shared = kept.where(F.col("n") >= min_docs)
    return path, n, BitMap(shared, "h2", shared.count())


def dropped_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc, gone): for each document (by id, null being one) that loses lines the 128-bit hashes of their keys, 16 bytes each.

    A document's lines that may be shared, by the bit map, go to the shards of the index (24 bytes each) and are dealt evenly in the
    order of the shards, so a line that a third of all documents hold is spread over tasks, and a task loads each of its shards once.
    """
    path, n, shared = build_index(line_counts(docs, min_chars), min_docs)
    spark = docs.sparkSession
    if not n:
        return spark.createDataFrame([], "doc long, gone binary")

    def asking(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, out = batch.column(0), []
        for i, text in enumerate(utf8(batch.column(1))):
            own = set(line_hashes(text, min_chars)[1])
            if own:
                h1, h2 = _halves(list(own))
                may = shared.has(h2)
                if may.any():
                    out.append((h1[may], h2[may], np.full(int(may.sum()), _NO_ID if (x := ids[i].as_py()) is None else x, np.int64)))
        if not out:
            return None
        h1, h2, doc = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(signed(h1) % n), pa.array(signed(h1)), pa.array(signed(h2)), pa.array(doc)], names=["shard", "h1", "h2", "doc"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for batch in batches:
            of = batch.column(0).to_numpy()
            h1, h2 = (batch.column(i).to_numpy().view(_U) for i in (1, 2))
            doc, gone = batch.column(3).to_numpy(), np.zeros(len(of), bool)
            for k in np.unique(of):
                if k != number:
                    number, shard = k, _shard(path, int(k))
                own = np.flatnonzero(of == k)
                counts, keepers = shard.probe(h1[own], h2[own])
                gone[own[(counts >= min_docs) & (keepers != doc[own])]] = True
            if gone.any():
                yield pa.RecordBatch.from_arrays([batch.column(3).filter(pa.array(gone)), batch.column(1).filter(pa.array(gone)), batch.column(2).filter(pa.array(gone))], names=["doc", "h1", "h2"])

    asked = stored(arrow_map(docs.select("doc_id", "text"), asking, "shard long, h1 long, h2 long, doc long"), "probes")
    dealt = asked.repartitionByRange("shard", "doc", "h1").sortWithinPartitions("shard")
    found = dealt.mapInArrow(probe, "doc long, h1 long, h2 long").distinct()

    def packed(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series([np.column_stack((np.asarray(a, np.int64), np.asarray(b, np.int64))).tobytes() for a, b in zip(h1, h2)])

    pairs = found.groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))  # as many as the document has lines
    return stored(pairs.select("doc", F.pandas_udf(packed, "binary")(F.col("gone.h1"), F.col("gone.h2")).alias("gone")), "dropped")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, carry: list[str] | None = None) -> DataFrame:
    """Drops the lines whose key has at least ``min_chars`` code points and is held by at least ``min_docs`` documents,
    except in the document of the largest doc_id that holds it (there all of them stay).

    Returns the columns of ``docs`` (or those in ``carry``), text being the kept lines joined by \\n, and n_lines long
    (before dropping) and n_dropped long. A null or empty text has one empty line and comes back empty. Rows of one doc_id are
    one document: they count once, and each gets its row; rows with a null doc_id are one document of the smallest id. An
    empty table gives an empty result. Columns n_lines and n_dropped of the input are replaced.

    Three scans of the texts. Shuffled are 24 bytes for each line of a document, 32 for each distinct line, 32 for each line that may be
    shared, and the texts of documents that may lose lines, by a bit map of their ids; other documents pass as they are.
    """
    gone = dropped_lines(docs, min_chars, min_docs)
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped") and (carry is None or c in carry)]
    rows = docs.select("doc_id", "text", *rest)
    names, width, hurt = rows.columns, len(rows.columns), BitMap(gone, "doc", gone.count())
    schema = StructType(list(rows.schema.fields)).add("n_lines", "long").add("n_dropped", "long")

    def loses(batch: pa.RecordBatch) -> np.ndarray:
        return hurt.has(batch.column(0).cast(pa.int64()).fill_null(_NO_ID).to_numpy())

    def made(batch: pa.RecordBatch, texts: list[bytes], lines: list[int], dropped: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), *batch.columns[2:width], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(~loses(batch)))
        texts = [text or b"" for text in utf8(batch.column(1))]
        return made(batch, texts, [text.count(b"\n") + 1 for text in texts], [0] * len(texts))

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lines, dropped = [], [], []
        for text, hashes in zip(utf8(batch.column(1)), batch.column(width).to_pylist()):
            text, out = text or b"", set()
            parts = text.split(b"\n")
            if hashes:
                known = set(map(bytes, np.frombuffer(hashes, np.uint8).reshape(-1, 16)))
                at, own = line_hashes(text, min_chars)
                out = {j for j, h in zip(at, own) if (h & _LOW).to_bytes(8, "little") + (h >> 64).to_bytes(8, "little") in known}
            texts.append(b"\n".join(x for j, x in enumerate(parts) if j not in out) if out else text)
            lines.append(len(parts))
            dropped.append(len(out))
        return made(batch, texts, lines, dropped)

    name = f"doc_{uuid.uuid4().hex}"  # unlike any column of the documents
    lost = gone.select(F.col("doc").alias(name), F.col("gone").alias(f"lost_{name}"))
    some = arrow_map(rows, lambda batch: batch.filter(pa.array(loses(batch))), rows.schema, rows=512)
    met = some.join(lost.hint("merge"), F.coalesce(some["doc_id"].cast("long"), F.lit(_NO_ID)) == F.col(name), "left").select(*names, f"lost_{name}")
    return arrow_map(rows, whole, schema, rows=512).unionByName(arrow_map(met, kept, schema, rows=512))
