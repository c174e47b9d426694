"""Searches the weights of a fused score for the best lists that stay diverse enough: all candidates of a step in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.shared import open_fs, stored, written
from .ranks import places_of
from .retrieval import _arrays, _gathered

#: Songs and seeds whose matrices a task holds at once, one for each signal; rows of pools that it weighs at once.
ROWS, SEEDS, POOLED = 4096, 128, 65_536
#: Scores this far apart differ in their ninth place.
APART = 2e-9

Signals = Callable[[dict, dict], list[np.ndarray]]


def simplex(signals: int, steps: int, most: float = 1.0) -> list[tuple[float, ...]]:
    """All weights in multiples of 1 / steps that sum to one, none above ``most``."""

    def rest(n: int, left: int) -> Iterator[tuple[int, ...]]:
        if n == 1:
            yield (left,)
        else:
            for i in range(left + 1):
                yield from ((i, *r) for r in rest(n - 1, left - i))

    return [tuple(i / steps for i in w) for w in rest(signals, steps) if max(w) <= most * steps + 1e-9]


def split_lists(lists: DataFrame, list_id: str = "list_id", share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds held_out: the lists behind the first round(share n), one at least, in an order that a hash gives."""
    ids = lists.select(list_id).distinct().withColumn("_order", F.struct(F.xxhash64(F.lit(seed), list_id).alias("h"), F.col(list_id).cast("string").alias("id")))
    told = places_of(ids, "_order").select(list_id, (F.col("_at") >= F.greatest(F.lit(1), F.round(F.col("_total") * share))).alias("held_out"))
    return lists.join(told, list_id)


def relevant(lists: DataFrame, seeds: DataFrame, list_id: str = "list_id", other: DataFrame | None = None) -> DataFrame:
    """(query_id, song_idx, held_out): for each stated seed the songs that share a list with it, by whether that list is held out. With
    ``other`` (song_idx, artist) only songs of other artists count."""
    asked = lists.join(seeds.select(F.col("query_id").alias("song_idx")), "song_idx", "left_semi").select(F.col("song_idx").alias("query_id"), list_id)
    met = asked.distinct().join(lists, list_id).where("song_idx != query_id").select("query_id", "song_idx", "held_out").distinct()
    if other is None:
        return met
    of = lambda c: other.select(F.col("song_idx").alias(c), F.coalesce("artist", F.lit("")).alias(f"_{c}"))
    return met.join(of("query_id"), "query_id").join(of("song_idx"), "song_idx").where("_query_id != _song_idx").select("query_id", "song_idx", "held_out")


def corners(candidates: list[tuple[float, ...]], most: float) -> list[tuple[float, ...]]:
    """Weights that span all those up to ``most`` whose sum is that of one of the candidates."""
    n, out = len(candidates[0]), set()
    for total in {round(sum(c), 9) for c in candidates}:
        full = min(int(total / most + 1e-9), n)
        out |= set(permutations(([most] * full + [max(total - full * most, 0.0)] + [0.0] * n)[:n]))
    return sorted(out)


def pools(songs: DataFrame, seeds: DataFrame, signals: Signals, spans: list[tuple[float, ...]], k: int) -> DataFrame:
    """(query_id, song_idx, signals): the signals of those songs that can be among a seed's k best under any weights that ``spans`` span.

    A song that k others beat under each of the spans is beaten by them under all weights between these, as scores are linear in the
    weights. So every block of songs meets every block of seeds once, however many weights are tried afterwards. A task keeps k good
    songs a seed and what they reach at least under each span; of all others only those that reach more under one of them pass, and a
    seed's songs of all tasks are held against the k best of them once more.
    """
    path, weights = written(seeds, "seeds"), np.array(spans, float)

    def may(at: np.ndarray, own: np.ndarray, low: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Not beaten by all that reach ``low`` and have numbers up to ``last``: equal scores go to the smaller number."""
        beaten, even = np.ones(at.shape[1:], bool), np.ones(at.shape[1:], bool)
        for x, y in zip(at, low):
            beaten &= x < y - APART
            even &= x <= y + 1e-13
        return ~(beaten | even & (own > last))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = open_fs(path)
        held: dict[bytes, tuple] = {}
        for part in _gathered(batches, ROWS):
            rows = _arrays(part)
            own = rows["song_idx"].astype(np.int64)
            for batch in pads.dataset(where, filesystem=fs, format="parquet").to_batches(batch_size=SEEDS):
                if not batch.num_rows:
                    continue
                asked, out = _arrays(pa.Table.from_batches([batch])), []
                ids, parts = asked["query_id"].astype(np.int64), signals(rows, asked)
                at = np.tensordot(weights, np.stack(parts), 1)
                if ids.tobytes() not in held:  # scores and numbers of k songs for each seed
                    held[ids.tobytes()] = np.full((len(weights), len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
                top, named = held[ids.tobytes()]
                if np.isinf(top[0]).any() and len(own) > k + 1:
                    # a block's own k best by the sum bound the rest of it
                    first = np.argpartition(-np.where(own[:, None] == ids, -np.inf, at.sum(0)), k - 1, axis=0)[:k]
                    low, last = np.take_along_axis(at, first[None], 1).min(1), own[first].max(0)
                else:
                    low, last = top.min(2), named.max(1)
                passed = may(at, own[:, None], low, last) & (own[:, None] != ids)
                which, j = np.nonzero(passed)
                order = np.argsort(j, kind="stable")
                which, j = which[order], j[order]
                for i in np.unique(j):
                    w = which[np.searchsorted(j, i) : np.searchsorted(j, i, "right")]
                    reach, number = np.concatenate([top[:, i], at[:, w, i]], 1), np.concatenate([named[i], own[w]])
                    good = np.lexsort((number, -reach.sum(0)))[:k]
                    top[:, i], named[i] = reach[:, good], number[good]
                    w = w[may(at[:, w, i], own[w], top[:, i].min(1), named[i].max())]
                    out.append((np.full(len(w), ids[i]), own[w], np.stack([m[w, i] for m in parts], 1)))
                if out:
                    ids_, songs_, of = (np.concatenate(x) for x in zip(*out))
                    lists = pa.ListArray.from_arrays(np.arange(0, of.size + 1, of.shape[1], dtype=np.int32), pa.array(of.ravel().astype(float)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids_), pa.array(songs_), lists], names=["query_id", "song_idx", "signals"])

    def left(group: pa.Table) -> pa.Table:
        """What the k best by the sum and those by each span let through of what all tasks have found for a seed."""
        of, own = np.stack(group.column("signals").to_numpy()), group.column("song_idx").to_numpy()
        at, passed = weights @ of.T, np.ones(len(own), bool)
        if len(own) > k:
            for by in (at.sum(0), *at):
                good = np.lexsort((own, -by))[:k]
                passed &= may(at, own, at[:, good].min(1), own[good].max())
        return group.filter(pa.array(passed))

    schema = "query_id long, song_idx long, signals array<double>"
    return songs.mapInArrow(best, schema).groupBy("query_id").applyInArrow(left, schema)


def placed(pool: DataFrame, candidates: list[tuple[float, ...]], k: int) -> DataFrame:
    """``ranked`` of pools: a task passes on k songs for each candidate, seed and block of rows at most."""
    weights = np.array(candidates, float)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches, POOLED):
            rows = _arrays(part)
            asked, own = rows["query_id"].astype(np.int64), rows["song_idx"].astype(np.int64)
            for c, w in enumerate(weights):
                sure = np.rint(sum(x * m for x, m in zip(w, rows["signals"].T)) * 1e9)
                at = np.lexsort((own, -sure, asked))
                starts = np.flatnonzero(np.r_[True, asked[at][1:] != asked[at][:-1]])
                at = at[np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)])) < k]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(at), c, np.int32), asked[at], own[at], sure[at])], names=["candidate", "query_id", "song_idx", "score"])

    found = pool.mapInArrow(best, "candidate int, query_id long, song_idx long, score double")
    order = Window.partitionBy("candidate", "query_id").orderBy(F.col("score").desc(), "song_idx")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("candidate", "query_id", "rank", "song_idx")


def ranked(songs: DataFrame, seeds: DataFrame, signals: Signals, candidates: list[tuple[float, ...]], k: int) -> DataFrame:
    """(candidate, query_id, rank, song_idx): the k songs of highest weighted sum of the signals for each candidate's weights and each
    seed, itself left out; ties, to nine places, go to the smaller song_idx."""
    return placed(pools(songs, seeds, signals, corners(candidates, max(map(max, candidates))), k), candidates, k)


def gains(lists: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(candidate, query_id, ndcg) at k of ranked lists (candidate, query_id, rank, song_idx) for every query of truth."""
    good = truth.select("query_id", "song_idx").distinct()
    sizes = good.groupBy("query_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("most"))
    ideal = F.array(*[F.lit(float(sum(1 / np.log2(i + 2) for i in range(n)))) for n in range(k + 1)])
    met = lists.join(good, ["query_id", "song_idx"], "left_semi").groupBy("candidate", "query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    every = lists.select("candidate", "query_id").distinct().join(sizes, "query_id")
    return every.join(met, ["candidate", "query_id"], "left").select("candidate", "query_id", (F.coalesce("dcg", F.lit(0.0)) / F.get(ideal, F.col("most").cast("int"))).alias("ndcg"))


def diversity(lists: DataFrame, songs: DataFrame, vector: str) -> DataFrame:
    """(candidate, ild): the mean over the lists of the mean cosine distance of two of their songs, 0 for lists of one.

    The cosines of all pairs of unit vectors follow from the length of their sum, so no pairs are made. A zero vector is at
    distance 1 of any other.
    """
    u = songs.select("song_idx", V.unit(F.col(vector)).alias("u"))
    sums = lists.join(u, "song_idx").groupBy("candidate", "query_id").agg(F.collect_list("u").alias("us"))  # k vectors
    total = F.reduce("us", F.transform(F.get("us", F.lit(0)), lambda x: F.lit(0.0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    n, some = F.size("us"), F.size(F.filter("us", lambda x: F.exists(x, lambda y: y != 0)))
    cosines = (V.dot(total, total) - some) / 2
    return sums.select("candidate", F.when(n > 1, 1 - cosines / (n * (n - 1) / 2)).otherwise(0.0).alias("ild")).groupBy("candidate").agg(F.avg("ild").alias("ild"))


def evaluated(songs: DataFrame, seeds: DataFrame, truth: DataFrame, signals: Signals, candidates: list[tuple[float, ...]], k: int, vector: str) -> DataFrame:
    """(candidate, ndcg, held_out_ndcg, ild) of candidate weights: mean gains by the lists that may be learned from and by those held
    out (truth: query_id, song_idx, held_out), and the diversity of the lists that the first ones' queries get."""
    return outcomes(stored(ranked(songs, seeds, signals, candidates, k), "lists"), songs, truth, k, vector)


def outcomes(lists: DataFrame, songs: DataFrame, truth: DataFrame, k: int, vector: str) -> DataFrame:
    """``evaluated`` of ranked lists."""
    known, held = (gains(lists, truth.where(F.col("held_out") == x), k).groupBy("candidate").agg(F.avg("ndcg").alias(n)) for x, n in ((False, "ndcg"), (True, "held_out_ndcg")))
    asked = lists.join(truth.where(~F.col("held_out")).select("query_id").distinct(), "query_id", "left_semi")
    all_ = lists.select("candidate").distinct()
    return all_.join(known, "candidate", "left").join(held, "candidate", "left").join(diversity(asked, songs, vector), "candidate", "left")


@dataclass
class Winner:
    """weights and what they reach; base: the same of the first start; steps: (step size, jobs so far, best gain) of the search."""

    weights: tuple[float, ...]
    ndcg: float
    held_out_ndcg: float | None
    ild: float
    base: dict
    steps: list = field(default_factory=list)


def search(
    songs: DataFrame, seeds: DataFrame, truth: DataFrame, signals: Signals, starts: list[tuple[float, ...]], k: int = 10, vector: str = "lyrics_vec", keep: float = 0.95, most: float = 0.5, step: float = 0.2, least: float = 0.02, frozen: tuple[int, ...] = ()
) -> Winner:
    """The weights of highest mean gain with a sum of one, each from 0 to ``most``, whose lists keep a share ``keep`` of the diversity
    that the first start has.

    The songs that can be in a list under any such weights are found once. A pattern search on the simplex: from the best weights so far, ``step`` is moved from each signal to each other one; all these and
    the starts' own moves are the candidates of one job. Where none gains, the step is halved, until it is under ``least``. Of
    equal gains the more diverse wins, then the smaller weights. ``frozen`` signals stay at 0. The driver sees a row a candidate.
    """
    songs, seeds, truth = (stored(x, n) for x, n in ((songs, "songs"), (seeds, "asked"), (truth, "truth")))

    def fits(w: tuple[float, ...]) -> tuple[float, ...]:
        v = np.array([0.0 if i in frozen else x for i, x in enumerate(w)])
        v = v / v.sum()
        for _ in range(len(v)):  # what is above the bound goes to the others in proportion
            over = v > most
            if not over.any():
                break
            room = ~over & (v > 0)
            v = np.where(over, most, v + (v - np.minimum(v, most)).sum() * np.where(room, v, 0) / max(v[room].sum(), 1e-12))
        return tuple(float(x) for x in np.round(v, 12))

    known: dict[tuple[float, ...], tuple] = {}

    def ask(candidates: list[tuple[float, ...]]) -> None:
        new = [c for c in dict.fromkeys(candidates) if c not in known]
        if new:
            lists = stored(placed(pool, new, k), "lists")
            for r in outcomes(lists, songs, truth, k, vector).collect():  # a row a candidate
                known[new[r["candidate"]]] = (r["ndcg"] or 0.0, r["held_out_ndcg"], r["ild"] or 0.0)

    starts, jobs, steps = [fits(s) for s in starts], 1, []
    pool = stored(pools(songs, seeds, signals, corners(starts, most), k), "pools")  # moves keep the sum and the bound
    ask(starts)
    enough = known[starts[0]][2] * keep
    value = lambda w: (known[w][2] >= enough - 1e-12, round(known[w][0], 9), round(known[w][2], 9), [-x for x in w])
    heads = list(starts)
    while step >= least:
        moves = {h: [] for h in heads}
        for h in heads:
            for i, j in permutations(range(len(h)), 2):
                if h[i] - step >= -1e-9 and h[j] + step <= most + 1e-9 and j not in frozen:
                    moves[h].append(tuple(round(max(x - step, 0.0), 12) if n == i else round(x + step, 12) if n == j else x for n, x in enumerate(h)))
        ask([m for ms in moves.values() for m in ms])
        jobs += 1
        better = [max([h, *ms], key=value) for h, ms in moves.items()]
        if better == heads:
            step /= 2
        heads = list(dict.fromkeys(better))
        steps.append((step, jobs, max(map(value, heads))[1]))
    best, base = max(heads, key=value), known[starts[0]]
    return Winner(best, *known[best], {"weights": starts[0], "ndcg": base[0], "held_out_ndcg": base[1], "ild": base[2]}, steps)


def chosen(results: DataFrame, base: Column, keep: float = 0.95) -> DataFrame:
    """Adds feasible (an ild of at least ``keep`` times the base's) and chosen to evaluated candidates (a row each): the feasible
    one of highest gain, ties to the more diverse, then to the smaller candidate."""
    floor = results.agg(F.max(F.when(base, F.col("ild"))).alias("_base"))
    rows = results.join(F.broadcast(floor)).withColumn("feasible", F.col("ild") >= keep * F.col("_base")).drop("_base")
    best = rows.where("feasible").agg(F.min_by("candidate", F.struct(-F.round("ndcg", 9), -F.round("ild", 9), F.col("candidate"))).alias("_best"))
    return rows.join(F.broadcast(best)).withColumn("chosen", F.coalesce(F.col("candidate") == F.col("_best"), F.lit(False))).drop("_best")
