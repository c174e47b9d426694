"""Transitions against plain loops over each pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tonalspark.operators import crossfade as X

# The wheel's hour of each key in major and minor.
MAJOR, MINOR = [8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1], [5, 12, 7, 2, 9, 4, 11, 6, 1, 8, 3, 10]


def fits(a, b):
    (n, m), (p, q) = (((MAJOR if x["mode"] == 1 else MINOR)[x["key"]], x["mode"]) for x in (a, b))
    if n == p:
        return 1.0 if m == q else 0.8
    return 0.7 if m == q and abs(n - p) in (1, 11) else 0.4


def plain(a, b, beats):
    def num(v, default=None):
        return default if v is None or not math.isfinite(v) else v

    ta, tb, ea, eb, length = num(a["tempo"], 120), num(b["tempo"], 120), num(a["energy"], 0.5), num(b["energy"], 0.5), num(a["duration_s"], 180)
    dt, de = abs(ta - tb) / max(ta, 1), abs(ea - eb)
    mood = 0.5 if a["quadrant"] is None or b["quadrant"] is None else [1.0, 0.5, 0.0, 0.5][(a["quadrant"] - b["quadrant"]) % 4]
    key = 0.4 if None in (a["key"], b["key"], a["mode"], b["mode"]) else fits(a, b)
    if dt > 0.12 or de > 0.45:
        wanted = 4
    elif mood >= 1 and dt < 0.06 and key >= 0.8:
        wanted = 11
    elif mood >= 0.5 and dt < 0.07 and key >= 0.7 or ea > 0.7 and eb > 0.7:
        wanted = 9
    else:
        wanted = 5 if mood == 0 else 7
    out = num(a["vocal_end_s"], num(a["fade_out_cue_s"], max(0, length - wanted - 5)))
    grid = sorted(beats.get(a["song_idx"], []))
    later = [g for g in grid if g >= out]
    snap = later[0] if later else grid[-1] if grid else out
    leaves = max(out, min(snap, max(0, length - 0.2)))
    voice, grid = num(b["vocal_start_s"]), sorted(beats.get(b["song_idx"], []))
    if voice is not None:
        t = max(0, voice - max(2.5, min(6, 2 * 240 / max(60, min(200, tb)))))
        t = min(grid, key=lambda g: (abs(g - t), g)) if grid else t
        enters = min(max(0, t), max(0, voice - 0.4))
    else:
        cue = num(b["fade_in_cue_s"])
        enters = cue if cue is not None and cue <= 2 else 0
    late = length - leaves < 3.4
    overlap = max(3, min(wanted, 12)) if late else max(3, min(wanted, length - leaves, 12))
    rise = overlap if voice is None else max(0.5, min(overlap, voice - enters - 0.4))
    gains = [0.8, 0.8]
    if num(a["lufs"]) is not None and num(b["lufs"]) is not None:
        gains = [min(1, max(0, 0.8 * min(10 ** (12 / 20), 10 ** ((-14 - x["lufs"]) / 20)))) for x in (a, b)]
    rate = max(0.94, min(1.06, ta / tb)) if dt <= 0.06 and ta > 0 and tb > 0 else 1.0
    return (overlap, leaves, enters, rise, *gains, "linear" if mood >= 1 and dt < 0.03 and key == 1 else "equal-power", late, rate, overlap >= 6 and key >= 0.7)


def test_transitions(spark):
    rng = random.Random(6)
    some = lambda f, p=0.85: f() if rng.random() < p else None
    songs = []
    for i in range(300):
        length = rng.choice([None, 30.0, 180.0, 240.5])
        songs.append({
            "song_idx": i, "tempo": some(lambda: rng.choice([100.0, 103.0, 120.0, 126.0, float("nan"), 0.0])), "energy": some(lambda: rng.choice([0.2, 0.5, 0.75, 0.9])), "duration_s": length, "quadrant": some(lambda: rng.randrange(1, 5)),
            "key": some(lambda: rng.randrange(12)), "mode": some(lambda: rng.randrange(2)), "lufs": some(lambda: rng.choice([-30.0, -14.0, -8.5])), "vocal_start_s": some(lambda: rng.choice([0.0, 1.0, 9.3, 25.0]), 0.6),
            "vocal_end_s": some(lambda: rng.choice([20.0, 100.7, 178.9, 239.0]), 0.6), "fade_in_cue_s": some(lambda: rng.choice([0.5, 1.9, 8.0]), 0.5), "fade_out_cue_s": some(lambda: rng.choice([25.0, 160.0]), 0.5),
        })
    beats = {i: [round(0.3 + 1.9 * k, 6) for k in range(rng.choice([0, 3, 90]))] for i in range(300) if i % 4}
    schema = "song_idx long, tempo double, energy double, duration_s double, quadrant int, key int, mode int, lufs double, vocal_start_s double, vocal_end_s double, fade_in_cue_s double, fade_out_cue_s double, list int, at int"
    df = spark.createDataFrame([tuple(s.values()) + (i % 3, i) for i, s in enumerate(songs)], schema).repartition(4)
    grid = spark.createDataFrame([(i, b) for i, bs in beats.items() for b in bs], "song_idx long, beat double")
    got = X.planned(X.neighbours(df, "list", ["at"]), grid, ["list"], volume=0.8).collect()
    assert len(got) == 297 and {(r.a_song_idx, r.b_song_idx) for r in got} == {(i, i + 3) for i in range(297)}
    for r in got:
        want = plain(songs[r.a_song_idx], songs[r.b_song_idx], beats)
        for x, y in zip(r[3:], want):
            assert x == pytest.approx(y, abs=1e-9) if isinstance(y, float) else x == y, (r, want)


def test_as_of(spark):
    cues = spark.createDataFrame([(1, 5.0), (1, 0.5), (1, 99.0), (1, 3.0), (2, 1.0), (None, 1.0), (1, None)], "k int, t double")
    grid = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, 3.0), (1, 7.0), (3, 1.0), (1, None)], "k int, b double")
    got = {(r.k, r.t): (r.before, r.after) for r in X.as_of(cues, grid, "k", "t", "b").collect() if r.t is not None}
    assert got == {(1, 5.0): (3.0, 7.0), (1, 0.5): (None, 1.0), (1, 99.0): (7.0, None), (1, 3.0): (3.0, 3.0), (2, 1.0): (None, None), (None, 1.0): (None, None)}
    row = spark.range(1).select(X.snapped(F.lit(5.0), F.lit(3.0), F.lit(7.0), "nearest"), X.snapped(F.lit(5.0), F.lit(None).cast("double"), F.lit(7.0), "before"), X.snapped(F.lit(5.0), F.lit(3.0), F.lit(None).cast("double"), "after")).first()
    assert tuple(row) == (3.0, 5.0, 3.0)
