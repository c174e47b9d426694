"""Scoring a catalogue against queries, and fusing ranked lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.shared import open_fs, stored, written
from .ranks import top_per_query

#: Weights of the eight parts of the song score in their order: timbre, rhythm, tonality, lyrics, mood, instruments, same label, audio.
PRODUCTION = (0.0, 0.0, 0.0, 0.08, 0.16, 0.0, 0.0, 0.76)
FLOOR, SIGMA_V, SIGMA_A = 0.3, 0.22, 0.14
#: Rows of the catalogue that a task scores at once, and queries that they meet at once: bounds of the memory (8 MB a matrix, some ten of
#: which live at once), not of the result.
ROWS, QUERIES = 16_384, 64


def _arrays(table: pa.Table) -> dict[str, np.ndarray]:
    """Columns as numpy arrays: lists of numbers as a matrix, whose missing rows are zeros."""
    out = {}
    for name in table.column_names:
        column = table.column(name).combine_chunks()
        kind = column.type
        if (pa.types.is_list(kind) or pa.types.is_large_list(kind)) and pa.types.is_floating(kind.value_type):
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            there = ~column.is_null().to_numpy(zero_copy_only=False)
            matrix = np.zeros((len(column), len(flat) // max(there.sum(), 1)))
            matrix[there] = flat.reshape(there.sum(), matrix.shape[1])
            out[name] = matrix
        else:
            out[name] = np.array(column.to_pylist(), object) if pa.types.is_string(kind) or pa.types.is_list(kind) else column.to_numpy(zero_copy_only=False)
    return out


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = np.linalg.norm(a, axis=1, keepdims=True), np.linalg.norm(b, axis=1)
    return (a / np.where(na == 0, 1, na)) @ (b / np.where(nb == 0, 1, nb)[:, None]).T


def best_matches(songs: DataFrame, queries: DataFrame, score: Callable[[dict, dict], np.ndarray], n: int, floor: float, without: DataFrame | None = None) -> DataFrame:
    """(query_id, song_idx, score) of the n songs of highest score, and more, for each row of ``queries``; see ``top_per_query``.

    ``score`` gets arrays of the columns of some songs and of some queries and gives their matrix; scores are taken to six
    places, ties go to the smaller song_idx. without: (query_id, song_idx) that aren't wanted, a list a query.

    The queries, a stated set, are written to the shared folder once. Each task reads them in blocks for every ROWS songs and
    passes on n songs a query and block at most: no row of the catalogue is shuffled, none is sent to the driver.
    """
    if without is not None:
        gone = without.groupBy("query_id").agg(F.collect_set("song_idx").alias("without"))
        queries = queries.join(gone, "query_id", "left").withColumn("without", F.coalesce("without", F.array().cast("array<long>")))
    path = written(queries, "queries")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = open_fs(path)
        for part in _gathered(batches, ROWS):
            rows = _arrays(part)
            own = rows["song_idx"].astype(np.int64)
            for batch in pads.dataset(where, filesystem=fs, format="parquet").to_batches(batch_size=QUERIES):
                if not batch.num_rows:
                    continue
                asked = _arrays(pa.Table.from_batches([batch]))
                raw = score(rows, asked)
                sure, out = np.rint(raw * 1e6), []
                for j, q in enumerate(asked["query_id"]):
                    fits = raw[:, j] >= floor
                    if "without" in asked:
                        fits &= ~np.isin(own, np.array(asked["without"][j], np.int64))
                    at = np.flatnonzero(fits)
                    if len(at) > n:
                        least = np.partition(sure[at, j], len(at) - n)[len(at) - n]
                        at = at[sure[at, j] >= least]
                        at = at[np.lexsort((own[at], -sure[at, j]))[:n]]
                    if len(at):
                        out.append((np.full(len(at), int(q)), own[at], sure[at, j] / 1e6))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "song_idx", "score"])

    return songs.mapInArrow(best, "query_id long, song_idx long, score double")


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def song_scores(rows: dict, seeds: dict, w: tuple) -> np.ndarray:
    """The fused score of each row for each seed, -1 for itself; parts of weight zero aren't computed."""
    out = np.zeros((len(rows["song_idx"]), len(seeds["song_idx"])))
    if w[0]:
        out += w[0] * _cosines(rows["timbre"], seeds["timbre"])
    if w[1]:
        out += w[1] * (1 - sum(np.abs(rows["rhythm"][:, i, None] - seeds["rhythm"][:, i]) for i in range(rows["rhythm"].shape[1])) / rows["rhythm"].shape[1])
    if w[2]:
        out += w[2] * _cosines(rows["tonality"], seeds["tonality"])
    if w[3]:
        out += w[3] * (_cosines(rows["lyrics_vec"], seeds["lyrics_vec"]) + 1) / 2
    if w[4]:
        dv = (rows["valence"].astype(float)[:, None] - seeds["valence"].astype(float)) / SIGMA_V
        da = (rows["arousal"].astype(float)[:, None] - seeds["arousal"].astype(float)) / SIGMA_A
        out += w[4] * np.exp(-0.5 * (dv**2 + da**2))
    if w[5]:
        out += w[5] * (_cosines(rows["instruments"], seeds["instruments"]) + 1) / 2
    if w[6]:
        named = np.array([bool(x) for x in seeds["mood"]])
        out += w[6] * ((rows["mood"][:, None] == seeds["mood"]) & named)
    if w[7]:
        out += w[7] * (rows["audio_vec"] @ seeds["audio_vec"].T + 1) / 2
    out[rows["song_idx"][:, None] == seeds["song_idx"]] = -1
    return out


_PARTS = ("timbre", "rhythm", "tonality", "lyrics_vec", None, "instruments", "mood", "audio_vec")


def _needed(weights: tuple) -> list[str]:
    return ["song_idx", *[c for c, w in zip(_PARTS, weights) if c and w], *(["valence", "arousal"] if weights[4] else [])]


def similar_songs(songs: DataFrame, seeds: DataFrame, k: int = 10, weights: tuple = PRODUCTION, floor: float = FLOOR, excluded: DataFrame | None = None, candidates: DataFrame | None = None, played: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, song_idx, score): for each seed the k songs of highest fused score, itself excluded.

    seeds: rows of ``songs``; query_id is their song_idx. excluded: (query_id, song_idx) that must not be returned, such as
    covers of the seed; played: (song_idx) that no query may return; candidates: (query_id, song_idx) that alone may be,
    and that alone are scored then.
    """
    songs = excluding(songs, played)
    if candidates is not None:
        if excluded is not None:
            candidates = candidates.join(excluded.select("query_id", "song_idx"), ["query_id", "song_idx"], "left_anti")
        out = scored_pairs(candidates, songs, seeds, weights).where(F.col("raw") >= floor)
    else:
        asked = seeds.select(F.col("song_idx").alias("query_id"), *_needed(weights))
        out = best_matches(songs.select(*_needed(weights)), asked, partial(song_scores, w=weights), k, floor, excluded)
    return top_per_query(out, F.col("score"), k).select("query_id", "rank", "song_idx", "score")


def excluding(songs: DataFrame, played: DataFrame | None) -> DataFrame:
    return songs if played is None else songs.join(played.select("song_idx"), "song_idx", "left_anti")


def scored_pairs(pairs: DataFrame, songs: DataFrame, seeds: DataFrame, weights: tuple = PRODUCTION) -> DataFrame:
    """(query_id, song_idx, raw, score) of given pairs (query_id, song_idx) of different songs: both rows are joined to a pair."""
    need = _needed(weights)
    asked = seeds.select(F.col("song_idx").alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in need if c != "song_idx"])
    met = pairs.select("query_id", "song_idx").distinct().where("query_id != song_idx").join(songs.select(*need), "song_idx").join(asked, "query_id")
    share = lambda c: V.half_up(F.coalesce(V.cosine(F.col(c), F.col(f"q_{c}")), F.lit(0.0)))
    gap = lambda c, s: F.pow((F.col(c) - F.col(f"q_{c}")) / s, F.lit(2))
    parts = {
        0: lambda: F.coalesce(V.cosine(F.col("timbre"), F.col("q_timbre")), F.lit(0.0)),
        1: lambda: 1 - F.aggregate(F.zip_with("rhythm", "q_rhythm", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("rhythm"),
        2: lambda: F.coalesce(V.cosine(F.col("tonality"), F.col("q_tonality")), F.lit(0.0)),
        3: lambda: share("lyrics_vec"),
        4: lambda: F.exp(-0.5 * (gap("valence", SIGMA_V) + gap("arousal", SIGMA_A))),
        5: lambda: share("instruments"),
        6: lambda: F.coalesce((F.col("mood") == F.col("q_mood")) & (F.col("mood") != ""), F.lit(False)).cast("double"),
        7: lambda: V.half_up(V.dot(F.col("audio_vec"), F.col("q_audio_vec"))),
    }
    raw = sum((w * parts[i]() for i, w in enumerate(weights) if w), F.lit(0.0))
    return met.withColumn("raw", raw).select("query_id", "song_idx", "raw", V.stable(F.col("raw")).alias("score"))


def _vector_scores(rows: dict, seeds: dict) -> np.ndarray:
    out = _cosines(rows["v"], seeds["v"])
    out[rows["song_idx"][:, None] == seeds["query_id"]] = -2
    return out


def nearest(songs: DataFrame, seeds: DataFrame, n: int, vector: str = "audio_vec") -> DataFrame:
    """(query_id, rank, song_idx, score): the n songs of highest cosine with each seed, itself excluded."""
    out = best_matches(songs.select("song_idx", F.col(vector).alias("v")), seeds.select(F.col("song_idx").alias("query_id"), F.col(vector).alias("v")), _vector_scores, n, -1.0 - 1e-9)
    return top_per_query(out, F.col("score"), n).select("query_id", "rank", "song_idx", "score")


def fast_rank(scored: DataFrame, k: int, floor: float = FLOOR, pool: int = 4) -> DataFrame:
    """The pool of a query that a re-ranker gets: the first ``pool`` times k rows over the floor, by score."""
    return top_per_query(scored.where(F.col("score") >= floor), F.col("score"), pool * k)


def rbf(dv: Column, da: Column, sigma_v: float | Column = 0.20, sigma_a: float | Column = 0.14) -> Column:
    return F.exp(-0.5 * (F.pow(dv / sigma_v, F.lit(2)) + F.pow(da / sigma_a, F.lit(2))))


def _mood_scores(rows: dict, targets: dict) -> np.ndarray:
    dv = (rows["valence"].astype(float)[:, None] - targets["t_valence"].astype(float)) / (0.20 * targets["wide"].astype(float))
    da = (rows["arousal"].astype(float)[:, None] - targets["t_arousal"].astype(float)) / (0.14 * targets["wide"].astype(float))
    return np.exp(-0.5 * (dv**2 + da**2))


def scaled_mood_scores(rows: dict, targets: dict) -> np.ndarray:
    """The kernel with the valence's width times f, a column of the targets."""
    dv = (rows["valence"].astype(float)[:, None] - targets["t_valence"].astype(float)) / (0.20 * targets["f"].astype(float))
    da = (rows["arousal"].astype(float)[:, None] - targets["t_arousal"].astype(float)) / 0.14
    return np.exp(-0.5 * (dv**2 + da**2))


def by_targets(songs: DataFrame, targets: DataFrame, k: int = 10, adaptive: bool = False, played: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, song_idx, score): for each target (query_id, t_valence, t_arousal) the k nearest songs in mood space,
    without those in ``played`` (song_idx).

    adaptive: the kernel widens where few songs are within .05 of the target (1.8 times under 50, 1.3 times under 200).
    """
    asked = targets.select("query_id", F.col("t_valence").cast("double").alias("t_valence"), F.col("t_arousal").cast("double").alias("t_arousal"), F.lit(1.0).alias("wide"))
    songs = excluding(songs, played).select("song_idx", "valence", "arousal")
    if adaptive:
        asked = stored(asked, "targets")
        close = (F.abs(F.col("valence") - F.col("t_valence")) <= 0.05) & (F.abs(F.col("arousal") - F.col("t_arousal")) <= 0.05)
        near = around(songs, asked, 0.0500001).where(close).groupBy("query_id").agg(F.count(F.lit(1)).alias("near"))
        wide = F.when(F.coalesce("near", F.lit(0)) < 50, 1.8).when(F.col("near") < 200, 1.3).otherwise(1.0)
        asked = asked.join(near, "query_id", "left").withColumn("wide", wide).drop("near")
    return top_per_query(best_matches(songs, asked, _mood_scores, k, -1.0), F.col("score"), k).select("query_id", "rank", "song_idx", "score")


def _journey_scores(rows: dict, steps: dict, penalty: float, sigma: tuple[float, float], smooth: float, tempo: float) -> np.ndarray:
    v = rows["audio_vec"] / np.maximum(np.linalg.norm(rows["audio_vec"], axis=1, keepdims=True), 1e-12)
    at, bpm = np.stack([rows["valence"].astype(float), rows["arousal"].astype(float)], 1), rows["bpm"].astype(float)
    out = np.empty((len(at), len(steps["query_id"])))
    for j in range(out.shape[1]):
        score = np.exp(-0.5 * (((at - (steps["t_valence"][j], steps["t_arousal"][j])) / sigma) ** 2).sum(1))
        chosen = list(steps["artists"][j])
        repeats = {a: min(chosen.count(a), 3) for a in chosen}
        if repeats:
            score *= np.array([1 - penalty * repeats.get(a, 0) for a in rows["artist"]]).clip(0)
        last = steps["last_vec"][j]
        if np.any(last):
            follows = 0.5 * np.clip(v @ (last / max(np.linalg.norm(last), 1e-12)), -1, 1)
            if not np.isnan(steps["last_bpm"][j]):
                follows = follows + 0.5 * np.nan_to_num(np.exp(-np.abs(bpm - steps["last_bpm"][j]) / tempo))
            score = np.where(score > 0, score + smooth * follows, score)
        score[np.isin(rows["song_idx"].astype(np.int64), np.array(steps["used"][j], np.int64))] = -1.0
        out[:, j] = score
    return out


def journeys(songs: DataFrame, ends: DataFrame, k: int = 10, penalty: float = 0.15, sigma: tuple[float, float] = (0.20, 0.14), smooth: float = 0.30, tempo: float = 20.0, played: DataFrame | None = None) -> DataFrame:
    """(query_id, place, song_idx, score): paths of songs from (from_v, from_a) to (to_v, to_a) in mood space, a row of ``ends``
    each: at each of k waypoints, slow at both ends, the best unused song of the whole catalogue.

    A song's score is its nearness to the waypoint, less for repeated artists, plus ``smooth`` times how well it follows the
    last one (half the cosine of the audio, half the nearness of the tempo). A waypoint without a song of positive score is
    skipped; ties go to the smaller song_idx. One pass over the songs for each waypoint; what a path has chosen so far is a
    written row.
    """
    ease = 1 / (1 + np.exp(-np.linspace(-3.0, 3.0, k)))
    ease = (ease - ease[0]) / (ease[-1] - ease[0]) if k > 1 else np.zeros(1)
    songs = excluding(songs, played).select("song_idx", "valence", "arousal", "bpm", "artist", "audio_vec")
    start = {"last_vec": F.lit(None).cast("array<double>"), "last_bpm": F.lit(None).cast("double"), "used": F.array().cast("array<long>"), "artists": F.array().cast("array<string>"), "scores": F.array().cast("array<double>")}
    state = stored(ends.select("query_id", "from_v", "from_a", "to_v", "to_a").withColumns(start), "journeys")
    score = partial(_journey_scores, penalty=penalty, sigma=sigma, smooth=smooth, tempo=tempo)
    for t in map(float, ease):
        at = state.select("query_id", (F.col("from_v") + t * (F.col("to_v") - F.col("from_v"))).alias("t_valence"), (F.col("from_a") + t * (F.col("to_a") - F.col("from_a"))).alias("t_arousal"), "last_vec", "last_bpm", "used", "artists")
        best = top_per_query(best_matches(songs, at, score, 1, 1e-12), F.col("score"), 1).select("query_id", "song_idx", "score")
        best = best.join(songs.select("song_idx", "bpm", "artist", "audio_vec"), "song_idx")
        new = state.join(best, "query_id", "left")
        found = lambda more, other: F.when(F.col("song_idx").isNotNull(), more).otherwise(F.col(other)).alias(other)
        state = stored(new.select("query_id", "from_v", "from_a", "to_v", "to_a", found(F.col("audio_vec"), "last_vec"), found(F.col("bpm"), "last_bpm"), found(F.array_append("used", F.col("song_idx")), "used"), found(F.array_append("artists", F.col("artist")), "artists"), found(F.array_append("scores", F.col("score")), "scores")), "journeys")
    return state.select("query_id", F.posexplode(F.arrays_zip("used", "scores")).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("place"), F.col("x.used").alias("song_idx"), F.col("x.scores").alias("score"))


def ranks_of(songs: DataFrame, queries: DataFrame, candidates: DataFrame, score: Callable[[dict, dict], np.ndarray]) -> DataFrame:
    """(query_id, song_idx, rank): the place, from 1, that each candidate (query_id, song_idx, score) has among all songs for its query.

    Nothing is sorted: a task counts, for each block of songs and each query, how many are before each of its candidates (by score to
    six places, then by song_idx), and the counts are added. Candidates are a stated list a query.
    """
    lists = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "song_idx"))).alias("c"))
    asked = queries.join(lists.select("query_id", F.col("c.s").alias("c_score"), F.col("c.song_idx").alias("c_song")), "query_id")
    path = written(asked, "candidates")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = open_fs(path)
        for part in _gathered(batches, ROWS):
            rows = _arrays(part)
            own = rows["song_idx"].astype(np.int64)
            for batch in pads.dataset(where, filesystem=fs, format="parquet").to_batches(batch_size=QUERIES):
                if not batch.num_rows:
                    continue
                made, out = _arrays(pa.Table.from_batches([batch.drop_columns(["c_score", "c_song"])])), []
                sure = np.rint(score(rows, made) * 1e6)
                for j, (q, s, c) in enumerate(zip(made["query_id"], batch.column("c_score").to_pylist(), batch.column("c_song").to_pylist())):
                    order = np.lexsort((own, -sure[:, j]))
                    falling, ids, wanted = -sure[order, j], own[order], np.rint(np.array(s, float) * 1e6)
                    low, high = np.searchsorted(falling, wanted, "left"), np.searchsorted(falling, wanted, "right")
                    ahead = [x + np.searchsorted(ids[x:y], i) for x, y, i in zip(low, high, c)]  # of equal scores the smaller ids
                    out.append((np.full(len(c), int(q)), np.array(c, np.int64), np.array(ahead, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", "song_idx", "ahead"])

    found = songs.mapInArrow(counted, "query_id long, song_idx long, ahead long")
    return found.groupBy("query_id", "song_idx").agg((F.sum("ahead") + 1).alias("rank"))


def fused_colors(songs: DataFrame, targets: DataFrame, n: int, k: int = 60) -> DataFrame:
    """(request, place, song_idx, score, color): the n songs of highest sum of 1 / (k + rank) over a request's colours (request, query_id, t_valence,
    t_arousal; each query_id in one request), as a share of the best, and the colour for which the song scores most (ties: the
    smaller query_id).

    Exact without ranking all songs for each colour: of m colours a song that is behind the first m (k + n) - k - 1 of each can't be among the
    n, so those are the candidates; their places for the other colours are counted.
    """
    targets = stored(targets, "targets")
    asked = targets.select("query_id", F.col("t_valence").cast("double").alias("t_valence"), F.col("t_arousal").cast("double").alias("t_arousal"), F.lit(1.0).alias("wide"))
    most = targets.groupBy("request").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 1  # colours of a request: one or two
    lists = stored(by_targets(songs, targets, most * (k + n) - k), "lists")
    colors = targets.select("request", "query_id")
    wanted = lists.join(colors, "query_id").select("request", "song_idx").distinct().join(colors, "request").select("query_id", "song_idx")
    s = songs.select("song_idx", "valence", "arousal")
    met = wanted.join(s, "song_idx").join(targets.drop("request"), "query_id")
    scored = stored(met.select("query_id", "song_idx", F.round(rbf(F.col("valence") - F.col("t_valence"), F.col("arousal") - F.col("t_arousal")), 6).alias("score")), "scored")
    placed = ranks_of(s, asked, scored, _mood_scores).join(scored, ["query_id", "song_idx"]).join(colors, "query_id")
    sums = placed.groupBy("request", "song_idx").agg(F.sum(1 / (k + F.col("rank"))).alias("sum"), F.min(F.struct((-F.col("score")).alias("s"), "query_id"))["query_id"].alias("color"))
    order = Window.partitionBy("request").orderBy(F.round("sum", 12).desc(), "song_idx")
    top = sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    best = top.where("place = 1").select("request", F.col("sum").alias("best"))
    return top.join(best, "request").select("request", "place", "song_idx", (F.col("sum") / F.col("best")).alias("score"), "color")


def fuse(lists: DataFrame, n: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list, rank from 1, song_idx, weight): (query_id, rank, song_idx, score)."""
    sums = lists.groupBy("query_id", "song_idx").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"))
    return top_per_query(sums.withColumn("score", F.round("score", 9)), F.col("score"), n).select("query_id", "rank", "song_idx", "score")


def cap_per_artist(ranked: DataFrame, cap: int, k: int) -> DataFrame:
    """Of (query_id, rank, song_idx, artist) the first k with at most ``cap`` of an artist; if there are too few, those
    over the cap fill up in their order."""
    mine = Window.partitionBy("query_id", "artist").orderBy("rank")
    over = ranked.withColumn("over", (F.row_number().over(mine) > cap) & F.col("artist").isNotNull())
    order = Window.partitionBy("query_id").orderBy("over", "rank")
    return over.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "place", "song_idx", "artist")


def around(songs: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """Songs and targets (query_id, t_valence, t_arousal) whose cells of mood space are the same or adjacent."""
    cell = lambda v, a: F.array(F.floor(v / radius), F.floor(a / radius))
    wide = F.flatten(F.array(*[F.array(*[F.array(F.floor(F.col("t_valence") / radius) + i, F.floor(F.col("t_arousal") / radius) + j) for j in (-1, 0, 1)]) for i in (-1, 0, 1)]))
    left = targets.select("query_id", "t_valence", "t_arousal", F.explode(wide).alias("cell"))
    return songs.select("song_idx", "valence", "arousal", cell(F.col("valence"), F.col("arousal")).alias("cell")).join(left, "cell").drop("cell")


def within_radius(songs: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """(query_id, song_idx, distance) of songs within ``radius`` of a target in mood space, by cells of that width."""
    d = F.sqrt(F.pow(F.col("valence") - F.col("t_valence"), F.lit(2)) + F.pow(F.col("arousal") - F.col("t_arousal"), F.lit(2)))
    return around(songs, targets, radius).withColumn("distance", d).where(F.col("distance") <= radius).select("query_id", "song_idx", "distance")
