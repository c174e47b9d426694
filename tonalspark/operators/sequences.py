"""Deltas, beats, regions and transitions along ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deltas(df: DataFrame, key: str, order: list[str], value: str, out: str = "delta") -> DataFrame:
    """Adds the difference from the row before in the same key; null for the first."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def bpm_of(beats: Column) -> Column:
    """Tempo of downbeat times: 240 over the median gap of .1 to 8 seconds, doubled or halved into 60 to 200; null without."""
    gaps = F.filter(F.zip_with(F.slice(beats, 2, F.greatest(F.size(beats) - 1, F.lit(0))), beats, lambda b, a: b - a), lambda g: g.between(0.1, 8.0))
    sort, n = F.array_sort(gaps), F.size(gaps)
    middle = (F.get(sort, ((n - 1) / 2).cast("int")) + F.get(sort, (n / 2).cast("int"))) / 2
    raw = 240 / middle
    low = F.greatest(F.ceil(F.log2(60 / raw)), F.lit(0))
    up = raw * F.pow(F.lit(2.0), low)
    return F.when(n > 0, up / F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(up / 200)), F.lit(0))))


def active_regions(df: DataFrame, key: str, time: str, value: str, threshold: float, least: float, ties: list[str] | None = None) -> DataFrame:
    """(key, start, end, rows) of the runs of rows over a threshold that last at least so many seconds; rows of one time
    stand in the order of ``ties``."""
    order = Window.partitionBy(key).orderBy(time, *(ties or []))
    on = df.withColumn("_on", F.col(value) > threshold).withColumn("_turn", (~F.col("_on").eqNullSafe(F.lag("_on").over(order))).cast("int"))
    runs = on.withColumn("_run", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = runs.where("_on").groupBy(key, "_run").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("rows"))
    return out.where(F.col("end") - F.col("start") >= least).drop("_run")


def transitions(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, next, overlap, gain_db) of adjacent songs (bpm, arousal, valence, loudness): the closer in tempo and
    mood, the longer they overlap, from 3 to 12 seconds; the gain brings the next to this one's loudness, within 6 dB."""
    at = Window.partitionBy(key).orderBy(order)
    rows = df.select(key, order, "song_idx", "bpm", "valence", "arousal", "loudness", F.lead(F.struct("song_idx", "bpm", "valence", "arousal", "loudness")).over(at).alias("n")).where("n is not null")
    tempo = F.abs(F.col("bpm") - F.col("n.bpm")) / F.greatest("bpm", "n.bpm")
    mood = F.abs(F.col("valence") - F.col("n.valence")) + F.abs(F.col("arousal") - F.col("n.arousal"))
    overlap = F.when((tempo <= 0.03) & (mood <= 0.25), 12.0).when((tempo <= 0.06) & (mood <= 0.5), 8.0).when((tempo <= 0.12) | (mood <= 0.25), 5.0).otherwise(3.0)
    gain = F.least(F.greatest(F.col("loudness") - F.col("n.loudness"), F.lit(-6.0)), F.lit(6.0))
    return rows.select(key, order, "song_idx", F.col("n.song_idx").alias("next"), overlap.alias("overlap"), gain.alias("gain_db"))


def snap(time: Column, grid: Column, side: str = "nearest") -> Column:
    """The grid time that is nearest, or the last before, or the first after; the time itself on an empty grid."""
    before, after = F.array_max(F.filter(grid, lambda g: g <= time)), F.array_min(F.filter(grid, lambda g: g >= time))
    if side == "before":
        return F.coalesce(before, time)
    if side == "after":
        return F.coalesce(after, time)
    return F.coalesce(F.when(after.isNull() | (time - before <= after - time), before).otherwise(after), after, before, time)
