"""Links documents whose sets of word n-grams have a Jaccard similarity of at least ``percent`` / 100.

The overlaps are entries of the product of the document by n-gram incidence matrix with its transpose, computed in
blocks. Linked rows of sizes up to r differ in at most k = floor(2 r (100 - p) / (100 + p)) entries. The n-gram columns
are dealt by hash into more than k blocks, so two linked rows agree in some block entirely; pairs that agree in none
are below the bound and are discarded before anything is multiplied. For the pairs left, a block of rows is multiplied
with the row that they share a block with, and overlap counts below the bound of the two sizes are dropped.

Within those that agree in a block, every row is first multiplied with the first one alone, blocks of them at a time. Only rows that aren't linked
with it are then multiplied with each other and with the rest, in cells of bounded size from which a forest of links comes
out. Before texts are compared, sketches (counts of n-grams by bins) leave out pairs and rows of cells that differ in too many bins to be linked.
So groups of thousands of linked copies cost a product for each member, groups of thousands of almost linked ones no
more than a bounded number of rows for each block of members, and no link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.entities import components
from .common import arrow_map, mixed, shingles, signed, stored, utf8, words_of

_U = np.uint64
#: Rows multiplied with one row in one run of a task, and rows of a block where blocks are multiplied: the larger, the fewer copies of a
#: row go to cells, and the more sets a task holds (two blocks of them).
RUN, CELL = 256, 1024
#: Sets that a task remembers, to send the signatures of equal ones once.
SEEN = 200_000
#: Tasks that the documents of one set are dealt to.
DEALT = 32
#: Rows that are multiplied with one row at once.
TOGETHER = 64


@lru_cache(maxsize=100_000)
def size_class(n: int, percent: int) -> tuple[int, int, int]:
    """(class, the class's largest size, that of the next): sizes that can be linked are in one class or adjacent ones."""
    i, low = 0, 1
    while (high := 100 * low // percent) < n:
        i, low = i + 1, high + 1
    return i, high, 100 * (high + 1) // percent


def signatures(grams: np.ndarray, percent: int) -> np.ndarray:
    """One number for each block of columns that the row may agree in with a linked row; the row's n-grams are distinct.

    Blocks with very few of the row's n-grams say little. There are ``spare`` more blocks than needed, so a row with no
    more than ``spare`` weak blocks leaves those out: it agrees with a linked row in a block that isn't weak.
    """
    n, out = len(grams), []
    i, high, higher = size_class(n, percent)
    weak = max(1, round(percent / (100 - percent) / 3))
    for tag, r in ((i, high), (i + 1, higher)):
        k = 2 * r * (100 - percent) // (100 + percent)
        if not k:
            continue  # equal sets only; those are found by the hash of the whole set
        spare = (k + 1) // 8
        blocks = k + 1 + spare
        of = (grams % _U(blocks)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        sizes = np.bincount(of, minlength=blocks)
        full = np.flatnonzero(sizes)
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        sums = np.zeros(blocks, _U)
        sums[full] = np.add.reduceat(mixed(grams[order] + _U(tag)), starts)
        marks = mixed(sums + mixed(np.arange(blocks, dtype=_U) + _U(tag << 32)))
        good = sizes >= weak
        out.append(marks[good] if blocks - good.sum() <= spare else marks)
    return np.concatenate(out) if out else np.empty(0, _U)


def _marks(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(mark, doc_id, n, whole): of every document the hash of its whole set (whole), and its signatures."""

    seen: set[int] = set()  # of this task; an equal set has the same signatures and is found by its whole mark

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks, sizes = [], []
        for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            grams = np.unique(shingles(words_of(text), k))
            if len(grams):
                own = mixed(np.add.reduce(mixed(grams), keepdims=True) + _U(len(grams)))
                if doc is None:
                    own = mixed(own + _U(1))  # apart from those of documents with an id
                elif int(own[0]) not in seen:
                    if len(seen) < SEEN:
                        seen.add(int(own[0]))
                    own = np.concatenate((own, signatures(grams, percent)))
            else:
                own = mixed(np.array([(doc or 0) & 0xFFFFFFFFFFFFFFFF], _U))
            marks.append(own)
            sizes.append(len(grams))
        lengths = np.fromiter(map(len, marks), np.int64, len(marks))
        rows = np.repeat(np.arange(len(marks)), lengths)
        whole = np.zeros(len(rows), bool)
        whole[np.cumsum(lengths) - lengths] = True
        return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(marks))), batch.column(0).take(pa.array(rows)), pa.array(np.array(sizes, np.int32)[rows]), pa.array(whole)], names=["mark", "doc_id", "n", "whole"])

    return arrow_map(docs.select("doc_id", "text"), of, "mark long, doc_id long, n int, whole boolean")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by mark and doc_id: those whose mark several rows have, and the whole ones; with the first document
    of the mark, its size and whether it is there by its whole set. Holds a batch and one row, however long a run is."""
    held = None  # the first row of the run that the last batch ended with; False: passed on already
    names = ["mark", "doc_id", "n", "whole", "rep", "rep_n", "rep_whole"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.bool_()]

    def out(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        mark = batch.column(0).to_numpy()
        none = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        doc = batch.column(1).fill_null(0).to_numpy()
        n, whole = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1])))
        size = np.diff(np.append(start, len(mark)))
        of = np.repeat(np.arange(len(start)), size)
        first = start[of]
        rep, rep_n, rep_whole, shared = doc[first], n[first], whole[first], size[of] > 1
        if held is not None:
            row, passed = held
            if row[0] == mark[0]:
                here = of == 0
                rep, rep_n, rep_whole = rep.copy(), rep_n.copy(), rep_whole.copy()
                rep[here], rep_n[here], rep_whole[here], shared = row[1], row[2], row[3], shared | here
                if not passed:
                    yield out([[row[0]], [None if row[4] else row[1]], [row[2]], [row[3]], [row[1]], [row[2]], [row[3]]])
            elif not passed and row[3]:
                yield out([[row[0]], [None if row[4] else row[1]], [row[2]], [row[3]], [row[1]], [row[2]], [row[3]]])
        # the last run may go on in the next batch: a single row of it waits
        waits = len(mark) - 1 if not shared[-1] else -1
        keep = shared | whole
        if waits >= 0:
            keep = keep.copy()
            keep[waits] = False
            held = ((mark[waits], doc[waits], n[waits], whole[waits], none[waits]), False)
        else:
            held = ((mark[-1], rep[-1], rep_n[-1], rep_whole[-1], False), True)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(mark[keep]), pa.array(doc[keep], pa.int64(), mask=none[keep]), pa.array(n[keep], pa.int32()), pa.array(whole[keep]), pa.array(rep[keep]), pa.array(rep_n[keep], pa.int32()), pa.array(rep_whole[keep])], names=names)
    if held is not None and not held[1] and held[0][3]:
        row = held[0]
        yield out([[row[0]], [None if row[4] else row[1]], [row[2]], [row[3]], [row[1]], [row[2]], [row[3]]])


def _fits(a: str, b: str, percent: int) -> F.Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def row_product(row: np.ndarray, block: list[np.ndarray]) -> np.ndarray:
    """A row of the incidence matrix (its sorted n-grams) times a block of rows: one look-up of all the block's entries among the row's
    columns, and the overlap counts accumulated by row."""
    grams, of = np.concatenate(block), np.repeat(np.arange(len(block)), [len(g) for g in block])
    at = np.minimum(np.searchsorted(row, grams), len(row) - 1)
    return np.bincount(of[row[at] == grams], minlength=len(block))


def overlaps(pairs: DataFrame, docs: DataFrame, k: int, percent: int = 0) -> DataFrame:
    """Multiplies rows of the incidence matrix: (a, b, common, either) for each pair (a, b) of documents whose overlap reaches the bound
    of the two sizes for ``percent``.

    The texts of a run of b's come sorted behind that of their a and are multiplied with it TOGETHER at a time; a popular a gets
    several runs, so no task holds more rows than these.
    """
    pairs = pairs.select("a", "b").distinct()
    runs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs"))
    texts = docs.select("doc_id", "text")
    left = runs.select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.col("a").alias("b"), F.lit(0).alias("later"))
    right = pairs.join(runs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("run"), "b", F.lit(1).alias("later"))
    rows = left.unionByName(right).join(texts.hint("merge"), F.col("b") == F.col("doc_id")).drop("doc_id")
    dealt = rows.repartition("a", "run").sortWithinPartitions("a", "run", "later", "b")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, row, block, ids = None, np.empty(0, _U), [], []

        def counted() -> list[tuple]:
            if not block or not len(row):
                return []
            sizes, common = np.array([len(g) for g in block]), row_product(row, block)
            either = len(row) + sizes - common
            at = np.flatnonzero((common > 0) & (100 * common >= percent * either) if percent else np.ones(len(block), bool))
            return [(of, ids[i], common[i], either[i]) for i in at]

        for batch in batches:
            a, b, later = (batch.column(i).to_numpy() for i in (0, 2, 3))
            out: list = []
            for i, text in enumerate(utf8(batch.column(4))):
                if not later[i] or len(block) == TOGETHER:
                    out += counted()
                    block, ids = [], []
                grams = np.unique(shingles(words_of(text), k))
                if not later[i]:
                    of, row = a[i], grams
                elif a[i] == of:
                    block.append(grams)
                    ids.append(b[i])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "common", "either"])
        if out := counted():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "common", "either"])

    return dealt.select("a", "run", "b", "later", "text").mapInArrow(multiply, "a long, b long, common long, either long")


def sketch(grams: np.ndarray) -> bytes | None:
    """How many of a set's n-grams fall into each of a power of two of bins, about two to four a bin; nothing if a byte doesn't hold that.

    Where two sets' counts differ so do the sets: the differences' sum is at most the size of the symmetric difference."""
    bins = 1 << min(max((len(grams) // 4).bit_length(), 4), 16)
    counts = np.bincount((grams & _U(bins - 1)).astype(np.int64), minlength=bins)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def folded(counts: np.ndarray, bins: int) -> np.ndarray:
    """Counts in fewer bins."""
    return counts.reshape(-1, bins).sum(0, dtype=np.int32)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, sketch) of documents (doc_id, text)."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        drawn = [sketch(np.unique(shingles(words_of(text), k))) for text in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(drawn, pa.binary())], names=["doc_id", "sketch"])

    return stored(arrow_map(docs.select("doc_id", "text"), of, "doc_id long, sketch binary"), "sketches")


def _near(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of the right rows of counts may belong to a set that is linked with the left one's; False only where it is sure that they don't."""
    return (100 + percent) * np.abs(right - left).sum(1) <= (100 - percent) * (right.sum(1) + left.sum())


def may_link(pairs: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of documents that may be linked by their sketches."""
    side = lambda c: drawn.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"{c}_sketch"))
    met = pairs.select("a", "b").join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if x is None or y is None:
                keep.append(True)
                continue
            bins = min(len(x), len(y))
            x, y = (folded(np.frombuffer(v, np.uint8), bins) for v in (x, y))
            keep.append(bool(_near(x, y[None], percent)[0]))
        return pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return arrow_map(met.select("a", "b", "a_sketch", "b_sketch"), near, "a long, b long").distinct()


def _open_rows(cells: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """The rows (rep, x, y, side, doc_id, label) of cells that may be linked with a row of another label there, by their sketches."""
    columns = ["rep", "x", "y", "side", "doc_id", "label"]
    met = cells.join(drawn.hint("merge"), "doc_id").select(*columns, "sketch")
    dealt = met.repartition("rep", "x", "y").sortWithinPartitions("rep", "x", "y", "side", "doc_id")

    def kept(held: list) -> Iterator[pa.RecordBatch]:
        counts = [np.frombuffer(h[6], np.uint8) for h in held if h[6] is not None]
        if len(held) < 2 or len({h[5] for h in held}) < 2:
            return
        bins = min(map(len, counts), default=1)
        rows = np.array([np.zeros(bins, np.int32) if h[6] is None else folded(np.frombuffer(h[6], np.uint8), bins) for h in held])
        unknown = np.array([h[6] is None for h in held])
        label, side, same = np.array([h[5] for h in held]), np.array([h[3] for h in held]), held[0][1] == held[0][2]
        keep = np.zeros(len(held), bool)
        for i in range(len(held)):
            others = np.flatnonzero((label != label[i]) & ((np.arange(len(held)) > i) if same else (side > side[i])))
            near = others[unknown[others] | unknown[i] | _near(rows[i], rows[others], percent)] if len(others) else others
            if len(near):
                keep[i] = keep[near] = True
        if keep.any():
            out = [h[:6] for h, k in zip(held, keep) if k]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=columns)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if row[:3] != cell:
                    yield from kept(held)
                    cell, held = row[:3], []
                held.append(row)
        yield from kept(held)

    return dealt.mapInArrow(over, "rep long, x int, y int, side int, doc_id long, label long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles long, component_id) of every row of ``docs`` (doc_id long, text).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set is the distinct k-word shingles, or the
    whole sequence of fewer words. Two documents link when 100 * common >= percent * either. component_id is the smallest
    doc_id reachable by links. A null, empty or blank text has no shingles and links with nothing. Repeated rows of a
    doc_id are one document and each get a row; a row with a null doc_id gets a null component_id. Other columns are
    ignored; an empty table gives an empty result.

    One shuffle of about n (100 - p) / (100 + p) * 5 numbers for a document of n shingles; texts are read again only for
    documents that share a block with another.
    """
    share = F.when(F.col("whole"), F.pmod(F.xxhash64("doc_id"), F.lit(DEALT))).otherwise(0)  # a set that very many documents have is dealt
    dealt = _marks(docs, k, percent).repartition("mark", share).sortWithinPartitions("mark", "doc_id")
    runs = dealt.mapInArrow(_runs, "mark long, doc_id long, n int, whole boolean, rep long, rep_n int, rep_whole boolean")
    # few columns, as a pair comes once from each task of the marks: both sizes in one, and a document's own set where it is equal to rep's
    both = F.shiftleft(F.col("rep_n").cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("both")
    met = runs.groupBy("rep", "doc_id", both).agg(F.sum(F.col("whole").cast("int")).alias("copies"), F.max(F.when(F.col("whole"), F.col("mark"))).alias("set"))
    low = F.col("both").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    found = stored(met.select("rep", "doc_id", F.shiftright("both", 32).cast("int").alias("rep_n"), low.alias("n"), "copies", "set", (F.col("copies") > 0).alias("equal")), "found")
    sizes = found.where("copies > 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")

    # copies of a set are known by the set's number, whichever of them stands first for a mark: their texts needn't be compared
    sets = found.where("copies > 0 AND doc_id IS NOT NULL AND n > 0").groupBy("doc_id").agg(F.max("set").alias("own"))
    pairs = found.where("doc_id IS NOT NULL AND n > 0 AND rep != doc_id").select("rep", "rep_n", "doc_id", "n", "equal")
    pairs = pairs.join(sets, "doc_id").join(sets.select(F.col("doc_id").alias("rep"), F.col("own").alias("rep_own")), "rep")
    pairs = stored(pairs.select("rep", "rep_n", "doc_id", "n", (F.col("equal") | (F.col("own") == F.col("rep_own"))).alias("equal")), "met")
    fits = pairs.where(_fits("n", "rep_n", percent)).groupBy(F.col("rep").alias("a"), F.col("doc_id").alias("b")).agg(F.max("equal").alias("equal"))
    fits = stored(fits, "pairs")
    # a document whose set equals its first one's is compared by that one; texts are read again for the others only
    open_pairs = fits.where("NOT equal")
    unequal = pairs.where("NOT equal").select("rep", "doc_id").distinct()
    wanted = unequal.select("doc_id").unionByName(unequal.select(F.col("rep").alias("doc_id"))).distinct()
    docs = stored(docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left_semi"), "candidates")
    drawn = sketches(docs, k)
    tried = overlaps(stored(may_link(open_pairs, drawn, percent), "open"), docs, k, percent)
    # the first documents of a set's shares, DEALT at most, are linked with the first of them
    shares = found.where("copies > 0 AND doc_id IS NOT NULL AND n > 0").groupBy("set", "n").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    one_set = shares.select("a", F.explode("reps").alias("b")).where("a != b")
    links = fits.where("equal").select("a", "b").unionByName(one_set).unionByName(tried.select("a", "b"))
    links = stored(links, "links")
    # where a first document isn't linked with all that share its marks, those may be linked with each other
    members = unequal
    if not members.isEmpty():
        labels = components(links) if not links.isEmpty() else None
        links = stored(links.unionByName(_across(members, labels, docs, drawn, k, percent)), "links")
    if links.isEmpty():
        return sizes.withColumn("component_id", F.col("doc_id"))
    return sizes.join(components(links).withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def _across(members: DataFrame, labels: DataFrame | None, docs: DataFrame, drawn: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links that join what the first documents of the marks left apart.

    Two documents that agree in a block share its mark and so the mark's first document (rep). Under each rep, the rows that
    aren't linked with it (loose) are multiplied with each other and with those that are, in cells of at most CELL by CELL
    rows; only the links that a cell needs to connect its rows come out. Reps without loose rows need nothing. A cell's rows are first held
    against each other by their sketches: only those that may be linked with another one bring their texts.
    """
    rows = members
    if labels is not None:
        rows = rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(labels.select(F.col("node").alias("rep"), F.col("label").alias("rep_label")), "rep", "left")
    else:
        rows = rows.withColumns({"label": F.lit(None).cast("long"), "rep_label": F.lit(None).cast("long")})
    loose = F.coalesce("label", "doc_id") != F.coalesce("rep_label", "rep")
    rows = stored(rows.select("rep", "doc_id", loose.alias("loose"), F.coalesce("label", "doc_id").alias("label")), "members")
    sizes = rows.groupBy("rep").agg(F.count_if("loose").alias("l"), F.count_if(~F.col("loose")).alias("t"), F.count_distinct("label").alias("labels"))
    blocks = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    sizes = sizes.where("l > 0 AND l + t > 1 AND labels > 1").select("rep", blocks("l").alias("lb"), blocks("t").alias("tb"))
    rows = rows.join(sizes, "rep").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(F.col("loose"), F.col("lb")).otherwise(F.col("tb"))).cast("int"))
    # a cell is (x, y): loose block x with loose block y >= x, or with linked block y - lb
    ahead = F.transform(F.sequence(F.col("own"), F.col("lb") + F.col("tb") - 1), lambda y: F.struct(F.col("own").alias("x"), y.alias("y"), F.lit(0).alias("side")))
    behind = F.when(F.col("own") > 0, F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda x: F.struct(x.alias("x"), F.col("own").alias("y"), F.lit(1).alias("side")))).otherwise(F.expr("array()"))
    linked = F.transform(F.sequence(F.lit(0), F.col("lb") - 1), lambda x: F.struct(x.alias("x"), (F.col("lb") + F.col("own")).alias("y"), F.lit(1).alias("side")))
    cells = rows.select("rep", "doc_id", "label", F.explode(F.when(F.col("loose"), F.concat(ahead, behind)).otherwise(linked)).alias("c")).select("rep", "c.x", "c.y", "c.side", "doc_id", "label")
    met = _open_rows(cells, drawn, percent).join(docs.select("doc_id", "text").hint("merge"), "doc_id").select("rep", "x", "y", "side", "doc_id", "label", "text")
    dealt = met.repartition("rep", "x", "y").sortWithinPartitions("rep", "x", "y", "side", "doc_id")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            side, ids, own = (batch.column(i).to_pylist() for i in (3, 4, 5))
            for i, text in enumerate(utf8(batch.column(6))):
                if keys[i] != cell:
                    yield from _links_of(cell, held, percent)
                    cell, held = keys[i], []
                held.append((side[i], ids[i], own[i], np.unique(shingles(words_of(text), k))))
        yield from _links_of(cell, held, percent)

    return dealt.mapInArrow(multiply, "a long, b long").distinct()


#: N-gram columns of the incidence matrix that are multiplied at once.
COLUMNS = 4096


def _links_of(cell: tuple | None, held: list, percent: int) -> Iterator[pa.RecordBatch]:
    """A forest of the links between the rows of a cell that its product shows, labels that are known joined before."""
    if len(held) < 2 or len({h[2] for h in held}) < 2:
        return
    same = cell[1] == cell[2]
    left = held if same else [h for h in held if not h[0]]
    right = held if same else [h for h in held if h[0]]
    if not left or not right:
        return
    common = _product([h[3] for h in left], [h[3] for h in right])
    nl, nr = np.array([len(h[3]) for h in left]), np.array([len(h[3]) for h in right])
    found = np.argwhere((common > 0) & (100 * common >= percent * (nl[:, None] + nr - common)))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in found:
        a, b = root(left[i][2]), root(right[j][2])
        if a != b:
            parent[a] = b
            out.append((min(left[i][1], right[j][1]), max(left[i][1], right[j][1])))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])


def _product(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlaps of all rows of two blocks: the product of their incidence matrices, summed over blocks of columns.

    Columns that only one of the blocks has add nothing and are left out."""
    out = np.zeros((len(left), len(right)), np.int64)
    columns = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    if not len(columns):
        return out
    spots = []
    for block in (left, right):
        grams, rows = np.concatenate(block), np.repeat(np.arange(len(block)), [len(g) for g in block])
        at = np.minimum(np.searchsorted(columns, grams), len(columns) - 1)
        own = columns[at] == grams
        order = np.argsort(at[own], kind="stable")
        spots.append((at[own][order], rows[own][order]))
    for start in range(0, len(columns), COLUMNS):
        width = min(COLUMNS, len(columns) - start)
        dense = []
        for (at, rows), block in zip(spots, (left, right)):
            lo, hi = np.searchsorted(at, (start, start + width))
            x = np.zeros((len(block), width), np.float32)
            x[rows[lo:hi], at[lo:hi] - start] = 1
            dense.append(x)
        out += np.rint(dense[0] @ dense[1].T).astype(np.int64)
    return out
