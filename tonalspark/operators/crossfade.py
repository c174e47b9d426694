"""How one song goes over into the next: overlap, levels, and cue times that are met with the beats as of their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds, decibels and bars of a transition.
TARGET_LUFS, MOST_BOOST_DB = -14.0, 12.0
CLEAR_OF_VOICE, SHORTEST, LONGEST, SHORTEST_RISE = 0.4, 3.0, 12.0, 0.5
LEAD_BARS, LEAST_LEAD, MOST_LEAD, INTRO_SILENCE = 2, 2.5, 6.0, 2.0

#: Columns of a song that a plan looks at; each may be null.
SONG = ["song_idx", "tempo", "energy", "duration_s", "quadrant", "key", "mode", "lufs", "vocal_start_s", "vocal_end_s", "fade_in_cue_s", "fade_out_cue_s"]


def as_of(cues: DataFrame, grid: DataFrame, key: str, time: str, beat: str) -> DataFrame:
    """Adds before and after to cues: the last time of the key's grid that isn't later, and the first that isn't earlier.

    Cues and grid are merged in order of time, so a key's rows are sorted once and each cue looks at its two neighbours alone;
    null where there is none. Equal times are both.
    """
    both = cues.withColumns({"__t": F.col(time), "__beat": F.lit(None).cast("double"), "__cue": F.lit(1)}).unionByName(grid.select(F.col(key), F.col(beat).alias("__t"), F.col(beat).cast("double").alias("__beat"), F.lit(0).alias("__cue")).where("__t IS NOT NULL"), allowMissingColumns=True)
    up, down = Window.partitionBy(key).orderBy("__t", "__cue"), Window.partitionBy(key).orderBy(F.col("__t").desc(), "__cue")
    last = lambda w: F.last("__beat", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumns({"before": last(up), "after": last(down)}).where("__cue = 1").drop("__t", "__beat", "__cue")


def snapped(time: Column, before: Column, after: Column, side: str) -> Column:
    """A time on the grid: the nearest (of two the earlier), the last that isn't later, or the first that isn't earlier, if there is none
    the grid's last; the time itself on an empty grid."""
    if side == "before":
        return F.coalesce(before, time)
    if side == "after":
        return F.coalesce(after, before, time)
    return F.coalesce(F.when(after.isNull() | (time - before <= after - time), before), after, time)


def known(c: Column) -> Column:
    """The number, or null if it isn't one."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def harmony(key_a: Column, mode_a: Column, key_b: Column, mode_b: Column) -> Column:
    """How well two keys (0 to 11, mode 1 major) go together: 1 the same, .8 relatives, .7 a fifth apart in one mode, else .4."""
    hour = lambda key, mode: F.pmod(key * 7 + F.when(mode == 1, 7).otherwise(4), F.lit(12))
    turn, same = F.pmod(hour(key_a, mode_a) - hour(key_b, mode_b), F.lit(12)), mode_a == mode_b
    return F.when(turn == 0, F.when(same, 1.0).otherwise(0.8)).when(same & turn.isin(1, 11), 0.7).otherwise(0.4)


def mood_fit(a: Column, b: Column) -> Column:
    """1 for one quadrant (1 to 4), .5 for adjacent ones or where one isn't known, 0 for opposite ones."""
    apart = F.pmod(a - b, F.lit(4))
    return F.when(a.isNull() | b.isNull(), 0.5).when(apart == 0, 1.0).when(apart == 2, 0.0).otherwise(0.5)


def neighbours(songs: DataFrame, list_id: str, order: list[str]) -> DataFrame:
    """(list_id, a_..., b_...) of each song of a list and the one that follows it."""
    one = F.struct(*SONG)
    following = F.lead(one).over(Window.partitionBy(list_id).orderBy(*order))
    rows = songs.select(list_id, one.alias("a"), following.alias("b")).where("b IS NOT NULL")
    return rows.select(list_id, *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in SONG])


def planned(pairs: DataFrame, beats: DataFrame, keep: list[str], volume: float = 1.0) -> DataFrame:
    """The transition of each pair of ``neighbours``: ``keep``, a_song_idx, b_song_idx, overlap_s, fade_out_at_s, fade_in_at_s, fade_in_s, gain_a,
    gain_b, curve, hold, rate, bass_swap.

    The closer two songs are in tempo, energy, mood and key, the longer they overlap. The first fades from the first downbeat behind
    its last voice (beats: song_idx, beat); if what is left then is too short, it plays to its end and the second comes in over it. The
    second enters a few bars before its first voice, on a downbeat, and is loud before the voice. Levels meet at one loudness.
    """
    c, number = F.col, lambda name: known(F.col(name).cast("double"))
    tempo_a, tempo_b = F.coalesce(number("a_tempo"), F.lit(120.0)), F.coalesce(number("b_tempo"), F.lit(120.0))
    energy_a, energy_b = F.coalesce(number("a_energy"), F.lit(0.5)), F.coalesce(number("b_energy"), F.lit(0.5))
    length = F.coalesce(number("a_duration_s"), F.lit(180.0))
    tempo_gap, energy_gap = F.abs(tempo_a - tempo_b) / F.greatest(tempo_a, F.lit(1.0)), F.abs(energy_a - energy_b)
    mood = mood_fit(c("a_quadrant"), c("b_quadrant"))
    tuned = F.coalesce(harmony(F.round("a_key"), c("a_mode"), F.round("b_key"), c("b_mode")), F.lit(0.4))
    both_known = c("a_key").isNotNull() & c("b_key").isNotNull() & c("a_mode").isNotNull() & c("b_mode").isNotNull()
    wanted = (
        F.when((c("_tempo") > 0.12) | (c("_energy") > 0.45), 4.0)
        .when((c("_mood") >= 1) & (c("_tempo") < 0.06) & (c("_key") >= 0.8), 11.0)
        .when(((c("_mood") >= 0.5) & (c("_tempo") < 0.07) & (c("_key") >= 0.7)) | ((energy_a > 0.7) & (energy_b > 0.7)), 9.0)
        .when(c("_mood") == 0, 5.0)
        .otherwise(7.0)
    )
    rows = pairs.withColumns({"_tempo": tempo_gap, "_energy": energy_gap, "_mood": mood, "_key": F.when(both_known, tuned).otherwise(0.4), "_length": length, "_id": F.struct(*keep, "a_song_idx", "b_song_idx")}).withColumn("_wanted", wanted)
    voice = number("b_vocal_start_s")
    bar = 240 / F.greatest(F.lit(60.0), F.least(F.lit(200.0), tempo_b))
    lead = F.greatest(F.lit(LEAST_LEAD), F.least(F.lit(MOST_LEAD), LEAD_BARS * bar))
    rows = rows.withColumns({
        "_out": F.coalesce(number("a_vocal_end_s"), number("a_fade_out_cue_s"), F.greatest(F.lit(0.0), c("_length") - c("_wanted") - 5)),
        "_in": F.greatest(F.lit(0.0), voice - lead), "_voice": voice,
    })
    cues = rows.select("_id", F.explode(F.array(F.struct(c("a_song_idx").alias("song_idx"), F.lit("out").alias("cue"), c("_out").alias("t")), F.struct(c("b_song_idx").alias("song_idx"), F.lit("in").alias("cue"), c("_in").alias("t")))).alias("c")).select("_id", "c.*").where("t IS NOT NULL")
    met = as_of(cues, beats, "song_idx", "t", "beat")
    at = met.groupBy("_id").agg(*[F.max(F.when(F.col("cue") == cue, snapped(c("t"), c("before"), c("after"), side))).alias(f"_snap_{cue}") for cue, side in (("out", "after"), ("in", "nearest"))])
    rows = rows.join(at, "_id", "left")
    leaves = F.greatest(c("_out"), F.least(c("_snap_out"), F.greatest(F.lit(0.0), c("_length") - 0.2)))
    silence = number("b_fade_in_cue_s")
    enters = F.when(c("_voice").isNotNull(), F.least(F.greatest(F.lit(0.0), c("_snap_in")), F.greatest(F.lit(0.0), c("_voice") - CLEAR_OF_VOICE))).otherwise(F.coalesce(F.when(silence <= INTRO_SILENCE, silence), F.lit(0.0)))
    rows = rows.withColumns({"_leaves": leaves, "_enters": enters}).withColumn("_tail", c("_length") - c("_leaves"))
    late = c("_tail") < SHORTEST + CLEAR_OF_VOICE
    overlap = F.greatest(F.lit(SHORTEST), F.least(c("_wanted"), F.when(late, F.lit(LONGEST)).otherwise(c("_tail")), F.lit(LONGEST)))
    level = lambda p: F.least(F.lit(1.0), F.greatest(F.lit(0.0), volume * F.least(F.pow(F.lit(10.0), F.lit(MOST_BOOST_DB / 20)), F.pow(F.lit(10.0), (TARGET_LUFS - number(f"{p}_lufs")) / 20))))
    measured = number("a_lufs").isNotNull() & number("b_lufs").isNotNull()
    rows = rows.withColumn("_overlap", overlap)
    rise = F.when(c("_voice").isNotNull(), F.greatest(F.lit(SHORTEST_RISE), F.least(c("_overlap"), c("_voice") - c("_enters") - CLEAR_OF_VOICE))).otherwise(c("_overlap"))
    near = (c("_tempo") <= 0.06) & (tempo_a > 0) & (tempo_b > 0)
    return rows.select(
        *keep, "a_song_idx", "b_song_idx", c("_overlap").alias("overlap_s"), c("_leaves").alias("fade_out_at_s"), c("_enters").alias("fade_in_at_s"), rise.alias("fade_in_s"),
        *[F.when(measured, level(p)).otherwise(F.lit(volume)).alias(f"gain_{p}") for p in "ab"],
        F.when((c("_mood") >= 1) & (c("_tempo") < 0.03) & (c("_key") == 1), "linear").otherwise("equal-power").alias("curve"), late.alias("hold"),
        F.when(near, F.greatest(F.lit(0.94), F.least(F.lit(1.06), tempo_a / tempo_b))).otherwise(1.0).alias("rate"), ((c("_overlap") >= 6) & (c("_key") >= 0.7)).alias("bass_swap"),
    )
