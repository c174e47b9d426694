"""Greedy re-ranking of bounded pools, one group for each query.

A pool has at most a few hundred rows whatever the catalogue's size: it is cut by a top-k before it is grouped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "query_id long, place int, song_idx long, score double"


def by_query(pool: DataFrame, choose: Callable[[pd.DataFrame], list[tuple[int, float]]]) -> DataFrame:
    """``choose`` gets a query's pool by falling score (ties by song) and returns (row, score) in the order chosen."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "song_idx"], ascending=[False, True]).reset_index(drop=True)
        picks = choose(group)
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "place": range(1, len(picks) + 1), "song_idx": [int(group["song_idx"][i]) for i, _ in picks], "score": [float(s) for _, s in picks]})

    return pool.groupBy("query_id").applyInPandas(run, SCHEMA)


def _vectors(group: pd.DataFrame, column: str) -> np.ndarray:
    v = np.stack([np.asarray(x, float) for x in group[column]])
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def mmr(k: int = 10, balance: float = 0.7, vector: str = "lyrics_vec") -> Callable:
    """Maximal marginal relevance: relevance less the highest cosine with what is chosen."""

    def choose(group: pd.DataFrame) -> list:
        rel, v = group["score"].to_numpy(float), _vectors(group, vector)
        left, worst, out = np.ones(len(rel), bool), np.full(len(rel), -np.inf), []
        while left.any() and len(out) < k:
            value = rel if not out else balance * rel - (1 - balance) * worst
            i = int(np.argmax(np.where(left, value, -np.inf)))
            out.append((i, rel[i]))
            left[i] = False
            worst = np.maximum(worst, v @ v[i])
        return out

    return choose


def va_mmr(k: int = 10, balance: float = 0.5) -> Callable:
    """The same with the distance in mood space as what sets songs apart."""

    def choose(group: pd.DataFrame) -> list:
        rel, at = group["score"].to_numpy(float), group[["valence", "arousal"]].to_numpy(float)
        left, near, out = np.ones(len(rel), bool), np.full(len(rel), np.inf), []
        while left.any() and len(out) < k:
            value = rel if not out else balance * rel + (1 - balance) * near
            i = int(np.argmax(np.where(left, value, -np.inf)))
            out.append((i, rel[i]))
            left[i] = False
            near = np.minimum(near, np.linalg.norm(at - at[i], axis=1))
        return out

    return choose


def dpp(k: int = 10, vector: str = "lyrics_vec") -> Callable:
    """Greedy maximum of a determinantal point process with kernel sqrt(rel) cos sqrt(rel), by Cholesky updates."""

    def choose(group: pd.DataFrame) -> list:
        rel, v = np.maximum(group["score"].to_numpy(float), 1e-6), _vectors(group, vector)
        kernel = v @ v.T
        np.fill_diagonal(kernel, 1.0)
        kernel *= np.sqrt(np.outer(rel, rel))
        gain, rows, left, out = kernel.diagonal().copy(), [], np.ones(len(rel), bool), []
        while left.any() and len(out) < k:
            i = int(np.argmax(np.where(left, gain, -np.inf)))
            out.append((i, group["score"][i]))
            left[i] = False
            row = (kernel[i] - sum(r * r[i] for r in rows)) / np.sqrt(max(gain[i], 1e-10))
            rows.append(row)
            gain = np.maximum(gain - row**2, 0.0)
        return out

    return choose


def artist_penalty(k: int = 10, penalty: float = 0.15, floor: float = 0.3, new_mood: float = 1.03) -> Callable:
    """In order of score: repeats of an artist are scaled down (dropped under the floor), a new mood is scaled up."""

    def choose(group: pd.DataFrame) -> list:
        artists, moods, out = {}, set(), []
        for i, (score, artist, mood) in enumerate(zip(group["score"], group["artist"], group["mood"])):
            if len(out) == k:
                break
            if artist and (seen := artists.get(artist, 0)):
                score *= (1 - penalty) ** seen
                if score < floor:
                    continue
            if mood and mood not in moods:
                score *= new_mood
                moods.add(mood)
            if artist:
                artists[artist] = artists.get(artist, 0) + 1
            out.append((i, score))
        return out

    return choose


def coherent(k: int = 10, share: float = 0.55, penalty: float = 0.15, vector: str = "audio_vec") -> Callable:
    """A tight cluster: relevance (scaled to 0..1 in the pool) and the cosine with the centre of what is chosen."""

    def choose(group: pd.DataFrame) -> list:
        score, v, artist = group["score"].to_numpy(float), _vectors(group, vector), group["artist"].to_numpy()
        rel = (score - score.min()) / (score.max() - score.min() + 1e-9)
        left, picks, seen = np.ones(len(rel), bool), [], {}
        while left.any() and len(picks) < k:
            if picks:
                centre = v[picks].mean(0)
                value = share * rel + (1 - share) * (v @ (centre / (np.linalg.norm(centre) + 1e-9)))
            else:
                value = rel.copy()
            value = value * np.array([max(0.0, 1 - penalty * min(seen.get(a, 0), 3)) for a in artist])
            i = int(np.argmax(np.where(left, np.rint(value * 1e6), -np.inf)))
            picks.append(i)
            left[i] = False
            seen[artist[i]] = seen.get(artist[i], 0) + 1
        return [(i, score[i]) for i in picks]

    return choose
