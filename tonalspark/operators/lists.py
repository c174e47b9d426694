"""What recommended lists are like in themselves: how far their songs lie apart, how they go over into each other, how near they
are to what was asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import vectors as V

_ROOT_TWO = 2**0.5


def _plane(v: Column, a: Column, w: Column, b: Column) -> Column:
    return F.sqrt(F.pow(v - w, F.lit(2)) + F.pow(a - b, F.lit(2)))


def spreads(recs: DataFrame, songs: DataFrame) -> DataFrame:
    """(query_id, n, ild_audio, ild_lyrics, ild_va, ild_color, mood_coherence, tempo_coherence, color_coherence) of lists (query_id, rank,
    song_idx).

    The ild are means over all pairs of a list: of cosine distances, of distances in mood space, of CIEDE2000 differences of colours
    that can be read; 0 under two songs. Coherences are one less the mean distance as a share of the longest, the variation of the tempo,
    the mean difference as a share of 100; 1 under two songs. Lists are short: their pairs are made within a list.
    """
    rows = recs.select("query_id", "rank", "song_idx").join(songs.select("song_idx", "audio_vec", "lyrics_vec", "valence", "arousal", "bpm", C.cielab(F.col("color_hex")).alias("lab")), "song_idx")
    columns = ["rank", "audio_vec", "lyrics_vec", "valence", "arousal", "lab"]
    pairs = rows.alias("x").join(rows.select("query_id", *[F.col(c).alias(f"r_{c}") for c in columns]), "query_id").where("rank < r_rank")
    far = lambda v: 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(V.cosine(F.col(v), F.col(f"r_{v}")), F.lit(0.0))))
    means = pairs.groupBy("query_id").agg(
        F.avg(far("audio_vec")).alias("ild_audio"), F.avg(far("lyrics_vec")).alias("ild_lyrics"), F.avg(_plane(F.col("valence"), F.col("arousal"), F.col("r_valence"), F.col("r_arousal"))).alias("ild_va"),
        F.avg(F.when(F.col("lab").isNotNull() & F.col("r_lab").isNotNull(), C.ciede2000(F.col("lab"), F.col("r_lab")))).alias("ild_color"),
    )
    tempo = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("bpm").alias("m"), F.stddev_pop("bpm").alias("s"))
    out = tempo.join(means, "query_id", "left")
    ild = {c: F.coalesce(c, F.lit(0.0)) for c in ("ild_audio", "ild_lyrics", "ild_va", "ild_color")}
    even = F.when((F.col("n") < 2) | (F.col("m") <= 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("s") / F.col("m")))
    return out.select(
        "query_id", "n", *[x.alias(c) for c, x in ild.items()], F.greatest(F.lit(0.0), 1 - ild["ild_va"] / _ROOT_TWO).alias("mood_coherence"), even.alias("tempo_coherence"), F.greatest(F.lit(0.0), 1 - ild["ild_color"] / 100).alias("color_coherence"),
    )


def jumps(recs: DataFrame, songs: DataFrame) -> DataFrame:
    """(query_id, bpm_jump, audio_jump): the mean change of tempo, where both are known, and of the audio (one less the cosine) from a
    song to the next of its list; null under two songs."""
    rows = recs.select("query_id", "rank", "song_idx").join(songs.select("song_idx", "bpm", V.unit(F.col("audio_vec")).alias("v")), "song_idx")
    before = lambda c: F.lag(c).over(Window.partitionBy("query_id").orderBy("rank"))
    steps = rows.select("query_id", F.abs(F.nanvl("bpm", F.lit(None)) - before("bpm")).alias("b"), (1 - V.dot(F.col("v"), before("v"))).alias("t"))
    return steps.groupBy("query_id").agg(F.avg("b").alias("bpm_jump"), F.avg("t").alias("audio_jump"))


def targeting(recs: DataFrame, songs: DataFrame, targets: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """(query_id, euclidean, mahalanobis): how far a list's songs lie from its target (query_id, t_valence, t_arousal) in mood space on
    average, plainly and by the inverse covariance of all songs; 1 for an empty list."""
    s = songs.agg(F.var_samp("valence").alias("vv"), F.var_samp("arousal").alias("aa"), F.covar_samp("valence", "arousal").alias("va")).select((F.col("vv") + ridge).alias("vv"), (F.col("aa") + ridge).alias("aa"), "va")
    met = targets.join(recs.select("query_id", "song_idx"), "query_id", "left").join(songs.select("song_idx", "valence", "arousal"), "song_idx", "left").join(F.broadcast(s))
    dv, da = F.col("valence") - F.col("t_valence"), F.col("arousal") - F.col("t_arousal")
    det = F.col("vv") * F.col("aa") - F.col("va") * F.col("va")
    square = (dv * dv * F.col("aa") - 2 * dv * da * F.col("va") + da * da * F.col("vv")) / det
    sums = met.groupBy("query_id").agg(F.avg(F.sqrt(dv * dv + da * da)).alias("e"), F.avg(F.sqrt(F.greatest(square, F.lit(0.0)))).alias("m"))
    return sums.select("query_id", F.coalesce("e", F.lit(1.0)).alias("euclidean"), F.coalesce("m", F.lit(1.0)).alias("mahalanobis"))


def journey_fit(paths: DataFrame, songs: DataFrame, ends: DataFrame, bins: int = 10) -> DataFrame:
    """(query_id, n, ks, mean, sd, covered): how evenly the songs of a path (query_id, song_idx) lie between its ends (query_id, from_v,
    from_a, to_v, to_a) in mood space: the gap between the distribution of their projections, cut to 0..1, and the uniform one, their
    mean and deviation, and the share of equal bins in use. Under two songs 1, 0, 0 and 0; for equal ends 1, .5, 0 and 0."""
    c = F.col
    met = ends.join(paths.select("query_id", "song_idx"), "query_id", "left").join(songs.select("song_idx", "valence", "arousal"), "song_idx", "left")
    dv, da = c("to_v") - c("from_v"), c("to_a") - c("from_a")
    length = dv * dv + da * da
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((c("valence") - c("from_v")) * dv + (c("arousal") - c("from_a")) * da) / F.nullif(length, F.lit(0.0))))
    rows = met.withColumns({"t": F.when(length >= 1e-9, t), "still": length < 1e-9})
    whole = Window.partitionBy("query_id")
    placed = rows.withColumns({"i": F.row_number().over(whole.orderBy(c("t").asc_nulls_last())), "n": F.count("song_idx").over(whole)})
    gap = F.greatest(c("i") / c("n") - c("t"), c("t") - (c("i") - 1) / c("n"))
    sums = placed.groupBy("query_id").agg(F.max("n").alias("n"), F.max("still").alias("still"), F.max(gap).alias("ks"), F.avg("t").alias("mean"), F.stddev_pop("t").alias("sd"), (F.count_distinct(F.least(F.floor(c("t") * bins), F.lit(bins - 1))) / bins).alias("covered"))
    pick = lambda name, few, still: F.when(c("n") < 2, few).when(c("still"), still).otherwise(c(name)).alias(name)
    return sums.select("query_id", "n", pick("ks", 1.0, 1.0), pick("mean", 0.0, 0.5), pick("sd", 0.0, 0.0), pick("covered", 0.0, 0.0))


def edges_of_sound(frames: DataFrame, key: str, time: str, level: str, least: float = 1.0, share: float = 0.08, floor: float = 0.005) -> DataFrame:
    """(key, start, end) of the first and last run of frames over a level that lasts ``least`` seconds or more; the level is ``share`` of the
    key's peak, ``floor`` at least. Keys without such a run are left out."""
    peak = frames.groupBy(key).agg(F.max(level).alias("_peak"))
    on = frames.join(peak, key).withColumn("_on", F.col(level) >= F.greatest(F.lit(floor), share * F.col("_peak")))
    order = Window.partitionBy(key).orderBy(time)
    turns = on.withColumn("_turn", (~F.col("_on").eqNullSafe(F.lag("_on").over(order))).cast("int"))
    runs = turns.withColumn("_run", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_on")
    long = runs.groupBy(key, "_run").agg(F.min(time).alias("a"), F.max(time).alias("b")).where(F.col("b") - F.col("a") >= least)
    return long.groupBy(key).agg(F.min("a").alias("start"), F.max("b").alias("end"))


def cues(frames: DataFrame, boundaries: DataFrame, beats: DataFrame, key: str, silence: float = 0.02) -> DataFrame:
    """(key, fade_out, fade_in, downbeats) from frames (key, time, level), structural boundaries (key, at) and beats (key, beat).

    The fade-out is a second before the last frame that isn't silent (20 seconds before the end, if that comes before 30 s), within the
    song; the fade-in at the first loud frame or the second boundary, whichever is later, but at 15 s at most; downbeats are each
    fourth beat, null where there are fewer than two. Times to two places, beats to three.
    """
    loud = F.col("level") >= silence
    sums = frames.groupBy(key).agg(F.max("time").alias("length"), F.max(F.when(loud, F.col("time"))).alias("last"), F.min(F.when(loud, F.col("time"))).alias("first"))
    second = boundaries.groupBy(key).agg(F.get(F.array_sort(F.collect_list("at")), F.lit(1)).alias("second"))  # a song's few parts
    grid = beats.groupBy(key).agg(F.transform(F.filter(F.array_sort(F.collect_list("beat")), lambda x, i: i % 4 == 0), lambda x: F.round(x, 3)).alias("downbeats"))
    met = sums.join(second, key, "left").join(grid, key, "left")
    out = F.coalesce(F.when(F.col("last") - 1 >= 30, F.col("last") - 1), F.greatest(F.lit(0.0), F.col("length") - 20))
    into = F.least(F.lit(15.0), F.greatest(F.coalesce("first", F.lit(0.0)), F.coalesce("second", F.lit(0.0))))
    return met.select(key, F.round(F.greatest(F.lit(0.0), F.least("length", out)), 2).alias("fade_out"), F.round(F.greatest(F.lit(0.0), into), 2).alias("fade_in"), F.when(F.size("downbeats") >= 2, F.col("downbeats")).alias("downbeats"))
