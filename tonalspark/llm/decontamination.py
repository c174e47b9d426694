"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on hashes of shared runs of words (seeds); a bit map of the benchmark's seeds, of
bounded size, keeps all others out of the shuffle. For each pair with enough of the item under seeds, the longest common runs
that don't overlap are marked again and again, found by Karp-Rabin hashes of runs of shrinking length, until only runs shorter
than the shortest allowed are left. The share of the item's words that is marked tells how much of it the document holds, in
whatever order its passages come.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BitMap, arrow_map, mixed, shingles, signed, stored, utf8, word_hashes

#: Items that a document's words are held for in one run of a task.
RUN = 256
#: Texts that hold a seed from which on it counts as common.
COMMON = 1000
#: Words of a long item that count as holding it, whatever share of it they are.
PASSAGE = 30
_U = np.uint64


def plain_words(text: bytes | None) -> list[bytes]:
    """Words without ASCII punctuation at their ends, A-Z lower-cased; what is punctuation alone goes."""
    return [w for x in (text or b"").lower().split() if (w := x.strip(b".,;:!?\"'()[]{}<>|*#&-_~`"))]


_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """The Karp-Rabin hash of each run of ``length`` word hashes, from running sums (arithmetic modulo 2**64): a run's sum
    times the power that takes out its place."""
    n = len(h)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(h * _powers(_BASE, n), dtype=_U)))
    return mixed((sums[length:] - sums[:-length]) * _powers(pow(_BASE, -1, 1 << 64), n)[: n - length + 1])


def tiling(doc: np.ndarray, item: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (place in doc, place in item, length) of tiles of at least
    ``shortest`` words, longest first; no word of either is in two tiles. Of tiles of one length the first in the item,
    then in the document, is marked first."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles, length = [], min(len(doc), len(item))
    # a run of a given length exists only if one of half the length does: seeds of the shortest bound the longest
    while length >= shortest:
        open_doc, open_item = _windows(free_doc, length), _windows(free_item, length)
        hd, hi = _runs(doc, length), _runs(item, length)
        hits = np.flatnonzero(open_item & np.isin(hi, hd[open_doc])) if open_doc.any() else np.empty(0, np.intp)
        marked = False
        for j in hits:
            if not free_item[j : j + length].all():
                continue
            for i in np.flatnonzero((hd == hi[j]) & open_doc):
                if free_doc[i : i + length].all() and (doc[i : i + length] == item[j : j + length]).all():
                    free_doc[i : i + length] = free_item[j : j + length] = False
                    tiles.append((int(i), int(j), length))
                    marked = True
                    break
        if length == shortest:
            break
        length = length - 1 if marked else _next_length(doc, item, free_doc, free_item, shortest, length - 1)
    return tiles


def _windows(free: np.ndarray, length: int) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(free)))
    return sums[length:] - sums[:-length] == length


def _next_length(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, low: int, high: int) -> int:
    """The longest run of free words that both have, by halving, but at least ``low``: having one is monotone in length."""
    while low < high:
        middle = (low + high + 1) // 2
        a, b = _windows(free_doc, middle), _windows(free_item, middle)
        if a.any() and b.any() and np.isin(_runs(item, middle)[b], _runs(doc, middle)[a]).any():
            low = middle
        else:
            high = middle - 1
    return low


def held(doc: np.ndarray, item: np.ndarray, own: np.ndarray, grams: np.ndarray, width: int, least: float, passage: int) -> float | None:
    """The share of the item that the document's tiles cover, or null if that is under ``least`` and no ``passage`` words are in
    tiles of twice the seeds' words or more. own, grams: the seeds of the document and of the item."""
    under = np.zeros(len(item) + 1, np.int64)
    places = np.flatnonzero(np.isin(grams, own))
    np.add.at(under, places, 1)
    np.add.at(under, places + width, -1)
    if (np.cumsum(under)[:-1] > 0).sum() < min(least * len(item), passage):  # more than the seeds cover can't be marked
        return None
    tiles = tiling(_near(own, np.sort(grams), width, doc), item, width)
    cover = sum(t[2] for t in tiles) / len(item)
    return cover if cover >= least or sum(t[2] for t in tiles if t[2] >= 2 * width) >= passage else None


def _near(own: np.ndarray, grams: np.ndarray, width: int, doc: np.ndarray) -> np.ndarray:
    """The document's words with those that no seed covers made unlike any other: they are in no tile."""
    at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
    hit = np.flatnonzero(grams[at] == own)
    under = np.zeros(len(doc) + 1, np.int64)
    np.add.at(under, hit, 1)
    np.add.at(under, np.minimum(hit + width, len(doc)), -1)
    covered = np.cumsum(under)[:-1] > 0
    # keep one word between covered stretches; the rest of a long document needn't be hashed again and again
    keep = covered | np.concatenate(([False], covered[:-1]))
    return np.where(covered, doc, _U(0))[keep]


def _key() -> Column:
    """What a document holds depends on its text alone: equal texts are judged once, by this digest."""
    return F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))


def _seeds(benchmark: DataFrame, shortest: int) -> DataFrame:
    """(seed, item, width, words) of each place of each item: hashes of runs of ``shortest`` words, or of all of a shorter item."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            if words := plain_words(text):
                g = shingles(words, shortest)
                rows.append((signed(g), np.full(len(g), item), np.full(len(g), min(shortest, len(words))), np.full(len(g), len(words))))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["seed", "item", "width", "words"]) if rows else None

    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return arrow_map(rows, of, "seed long, item long, width long, words long")


def _candidates(hits: DataFrame, seeds: DataFrame, coverage: float, passage: int) -> DataFrame:
    """(key, item, width, words) of the pairs of which enough places of the item are under seeds of the text.

    The places times the seeds' width bound what tiles can cover, so a text has to hold at least m = ceil(need / width) places of the
    item, and so one of any but m - 1 of them. Texts and items don't meet on an item's commonest places, m - 1 of them at most, whose
    seeds more than COMMON texts hold: a phrase that very many texts and items share brings none of them together. Such places count as
    held, so no pair is lost.
    """
    need = F.least(F.col("words") * coverage, F.lit(float(passage)))
    common = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > COMMON)
    text = ["item", "width", "words"]  # texts of one item_id that differ in length are told apart; others are one
    ranked = Window.partitionBy(*text).orderBy(F.coalesce("texts", F.lit(0)).desc(), "seed")
    places = seeds.join(common, "seed", "left").withColumn("left_out", F.col("texts").isNotNull() & (F.row_number().over(ranked) < F.ceil(need / F.col("width"))))
    places = places.withColumn("more", F.count_if("left_out").over(Window.partitionBy(*text)))
    met = hits.join(places.where("NOT left_out"), "seed").groupBy("key", *text, "more").agg(F.count(F.lit(1)).alias("places"))
    return met.where((F.col("places") + F.col("more")) * F.col("width") >= need).select("key", *text)


def matches(docs: DataFrame, benchmark: DataFrame, shortest: int = 5, coverage: float = 0.6, passage: int = PASSAGE) -> DataFrame:
    """(key, n_items long, item_id, coverage double) of the texts of ``docs`` that hold an item; see ``contaminated``."""
    benchmark = benchmark.select("item_id", "text")
    seeds = stored(_seeds(benchmark, shortest), "seeds")
    widths = sorted(r["width"] for r in seeds.select("width").distinct().collect())  # at most ``shortest`` numbers
    bits = BitMap(seeds, "seed", seeds.count())

    def hits(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, found = [], []
        for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            words = plain_words(text)
            own = [shingles(words, w) for w in widths if len(words) >= w]
            own = np.unique(np.concatenate(own)) if own else np.empty(0, _U)
            own = own[bits.has(own)]
            keys += [key] * len(own)
            found.append(own)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(signed(np.concatenate(found)))], names=["key", "seed"]) if keys else None

    texts = docs.select(_key().alias("key"), "text")
    met = stored(arrow_map(texts, hits, "key string, seed long").distinct(), "hits")
    pairs = stored(_candidates(met, seeds, coverage, passage), "pairs")
    short = pairs.where(F.col("width") < shortest).select("key", "item", F.lit(1.0).alias("cover"))  # the seed is the whole item
    long = pairs.where(F.col("width") == shortest).select("key", "item").distinct()
    runs = stored(long.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs")), "runs")
    asked_for = BitMap(runs.select(F.xxhash64("key").alias("h")), "h", runs.count())
    words = texts.where(asked_for.might(F.xxhash64("key"))).join(runs.hint("merge"), "key").groupBy("key").agg(F.first("text").alias("text"), F.first("runs").alias("runs"))
    left = words.select("key", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(None).cast("long").alias("item"), "text")
    asked = long.join(runs, "key").select("key", F.pmod(F.xxhash64("item"), F.col("runs")).cast("int").alias("run"), "item")
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), "text").where("text IS NOT NULL")
    right = asked.join(items, "item").select("key", "run", "item", "text")
    dealt = left.unionByName(right).repartition("key", "run").sortWithinPartitions("key", "run", F.col("item").asc_nulls_first())

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, doc, own = None, None, None
        for batch in batches:
            out = []
            for key, item, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), utf8(batch.column(3))):
                words = plain_words(text)
                if item is None:
                    of, doc, own = key, word_hashes(words), shingles(words, shortest)
                elif key == of and len(words) >= shortest:
                    cover = held(doc, word_hashes(words), own, shingles(words, shortest), shortest, coverage, passage)
                    if cover is not None:
                        out.append((key, item, cover))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["key", "item", "cover"])

    found = dealt.mapInArrow(tiled, "key string, item long, cover double").unionByName(short)
    best = F.max(F.struct("cover", (-F.col("item")).alias("item")))
    once = found.groupBy("key", "item").agg(F.max("cover").alias("cover"))  # an item_id may have several texts
    return stored(once.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), best.alias("b")).select("key", "n_items", (-F.col("b.item")).alias("item_id"), F.col("b.cover").alias("coverage")), "matches")


def contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = 5, coverage: float = 0.6, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, n_items long, item_id, coverage double) of every row of ``docs``: how many items it holds at least the share
    ``coverage`` of, and which one it holds most of (ties: the smallest item_id); 0, null and 0.0 where it holds none.

    However long an item is, ``passage`` words of it also count as held, in runs of twice ``shortest`` or more: chance and
    stock phrases make short runs, not such ones. The coverage of such an item is what it is, also under ``coverage``.

    Words are compared without case (A-Z) and without punctuation at their ends. An item of fewer than ``shortest`` words
    has to be there as a whole. Null or empty texts hold nothing; items that are null or without words are left out; an
    empty benchmark contaminates nothing; several texts of one item_id are one item. Repeated rows each get a row. Other
    columns are dropped: see ``decontaminate``.

    One scan finds the seeds; only those that the benchmark may have are shuffled, and the texts of documents that hold
    enough of an item. Documents and items don't meet on an item's commonest seeds (see ``_candidates``). Benchmark and documents may
    both be of any size.
    """
    found = matches(docs, benchmark, shortest, coverage, passage)
    return docs.select("doc_id", _key().alias("key")).join(found, "key", "left").select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, shortest: int = 5, coverage: float = 0.6, passage: int = PASSAGE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns; see ``contaminated``. Rows whose digest isn't among
    the bits of those found pass without a shuffle; only the others are joined with what was found."""
    name = f"key_{uuid.uuid4().hex}"  # unlike any column of the documents
    found = matches(docs, benchmark, shortest, coverage, passage).select(F.col("key").alias(name))
    bits = BitMap(found.select(F.xxhash64(name).alias("h")), "h", found.count())
    might = bits.might(F.xxhash64(_key()))
    return docs.where(~might).unionByName(docs.where(might).join(found, _key() == F.col(name), "left_anti"))
