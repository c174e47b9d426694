"""What results look like: columns in a fixed order, documents with defaults, reasons, and values that JSON can hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import dot

FLOATS = ("double", "float")


def first_present(columns: list[str], wanted: list[str]) -> str | None:
    """The first of the wanted columns that a table has."""
    return next((c for c in wanted if c in columns), None)


def allow_listed(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns that the table has, in the order of the list."""
    return df.select(*[c for c in allowed if c in df.columns])


def finite(c: Column) -> Column:
    """Null for NaN and infinities, which JSON hasn't."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def sanitised(df: DataFrame) -> DataFrame:
    """All floating columns finite, arrays of such included (elements that aren't become null)."""
    kinds = {c: t for c, t in df.dtypes}
    plain = {c: finite(F.col(c)) for c, t in kinds.items() if t in FLOATS}
    lists = {c: F.transform(c, finite) for c, t in kinds.items() if t in [f"array<{k}>" for k in FLOATS]}
    return df.withColumns(plain | lists)


def art_url(has_file: Column, track_id: Column, thumbnail: Column) -> Column:
    """The path of a local picture, else the thumbnail, else null."""
    return F.when(has_file, F.concat(F.lit("/art/"), track_id)).otherwise(F.nullif(F.trim(thumbnail), F.lit("")))


def seconds_of(first_ms: Column, second_ms: Column, file_s: Column) -> Column:
    """The first of two lengths in milliseconds that isn't zero, else the file's, in seconds."""
    ms = F.coalesce(F.nullif(first_ms, F.lit(0)), F.nullif(second_ms, F.lit(0)))
    return F.coalesce(ms / 1000, file_s)


def artist_name(*columns: Column) -> Column:
    return F.coalesce(*columns, F.lit("Unknown"))


def song_document(df: DataFrame, has_audio: Column) -> Column:
    """A struct with every field that a client expects; what the table lacks or has null is a default or null."""
    c = lambda name, other=None: F.coalesce(F.col(name), other) if name in df.columns and other is not None else F.col(name) if name in df.columns else other if other is not None else F.lit(None).cast("string")
    number = lambda name, other=None: finite(c(name, F.lit(other) if other is not None else None).cast("double"))
    return F.struct(
        F.col("song_idx").alias("song_index"), F.col("track_id"), c("track_name", F.lit("Unknown")).alias("track_name"),
        artist_name(*[F.col(x) for x in ("primary_artist", "artists", "artist_name") if x in df.columns]).alias("artist"),
        F.trim(F.get(F.split(c("artist_ids", F.lit("")), ","), F.lit(0))).alias("artist_id"), c("album_name", F.lit("")).alias("album_name"),
        number("valence", 0.5).alias("valence"), number("energy", 0.5).alias("energy"), number("danceability", 0.5).alias("danceability"), number("tempo", 120.0).alias("tempo"),
        number("loudness").alias("loudness"), c("mood_quadrant", F.lit("")).alias("mood_quadrant"), has_audio.alias("has_audio"), F.when(has_audio, F.concat(F.lit("/audio/"), F.col("track_id"))).alias("audio_url"),
    )


def resolve_ids(wanted: DataFrame, songs: DataFrame) -> DataFrame:
    """(wanted, song_idx): digits are a place in the catalogue, anything else a track's key; null where there is none."""
    asked = wanted.select("wanted").distinct().withColumn("_place", F.when(F.col("wanted").rlike(r"^\d{1,18}$"), F.col("wanted").cast("long")))
    by_place = asked.where("_place IS NOT NULL").join(songs.select(F.col("song_idx").alias("_place"), F.col("song_idx")), "_place", "left")
    by_key = asked.where("_place IS NULL").join(songs.select(F.col("track_id").alias("wanted"), "song_idx"), "wanted", "left")
    return by_place.select("wanted", "song_idx").unionByName(by_key.select("wanted", "song_idx"))


def clipped(df: DataFrame, shares: list[str]) -> DataFrame:
    """Shares cut to 0..1, key to 0..11, and mode rounded (halves to even) and cut to 0..1."""
    cut = lambda c, low, high: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))
    made = {c: cut(F.col(c), 0.0, 1.0) for c in shares if c in df.columns}
    made |= {"key": cut(F.col("key"), 0, 11)} if "key" in df.columns else {}
    return df.withColumns(made | ({"mode": cut(F.bround(F.col("mode").cast("double"), 0), 0.0, 1.0)} if "mode" in df.columns else {}))


#: The quadrant that each label lies in.
QUADRANTS = {"happy": "Q1", "excited": "Q1", "tense": "Q2", "angry": "Q2", "sad": "Q3", "melancholic": "Q3", "calm": "Q4", "peaceful": "Q4"}
#: Fixed values: (valence, arousal) of each label where no better estimate is there.
CENTRES = {"happy": (0.90, 0.75), "excited": (0.70, 0.90), "peaceful": (0.78, 0.20), "calm": (0.72, 0.15), "melancholic": (0.30, 0.35), "sad": (0.15, 0.30), "tense": (0.35, 0.85), "angry": (0.15, 0.90)}


def quadrant_of(label: Column, before: Column) -> Column:
    """The quadrant of a label, else what was known before, else Q3."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for k, v in QUADRANTS.items() for x in (k, v)]), F.lower(label))
    return F.coalesce(found, before, F.lit("Q3"))


def threshold_label(valence: Column, energy: Column) -> Column:
    """One of eight labels, by quadrant and within it by thresholds; null counts as the middle."""
    v, e = F.coalesce(valence, F.lit(0.5)), F.coalesce(energy, F.lit(0.5))
    q1 = F.when((v > 0.7) & (e > 0.7), "excited").otherwise("happy")
    q2 = F.when((v < 0.30) & (e > 0.68), "angry").otherwise("tense")
    q3 = F.when(v < 0.3, "sad").otherwise("melancholic")
    q4 = F.when(e < 0.3, "peaceful").otherwise("calm")
    return F.when((v >= 0.5) & (e >= 0.5), q1).when((v < 0.5) & (e >= 0.5), q2).when(v < 0.5, q3).otherwise(q4)


def label_or_estimate(label: Column, valence: Column, arousal: Column, energy: Column) -> Column:
    """A known label, else the one of valence and of arousal (or energy, or the middle)."""
    return F.coalesce(label, threshold_label(valence, F.coalesce(arousal, energy)))


def estimated_valence(mode: Column, tempo: Column, energy: Column, loudness: Column) -> Column:
    """Valence from mode, tempo, energy and loudness, for songs without a better one, to four places."""
    share = lambda c, low, width: F.least(F.greatest((c - low) / width, F.lit(0.0)), F.lit(1.0))
    m = F.when(F.coalesce(mode, F.lit(1)) == 1, 0.15).otherwise(-0.15)
    t = (share(F.coalesce(tempo, F.lit(120.0)), 60, 120) - 0.5) * 0.2
    e = (F.coalesce(energy, F.lit(0.5)) - 0.5) * 0.15
    n = (share(F.coalesce(loudness, F.lit(-8.0)), -20, 20) - 0.5) * 0.1
    return F.round(F.least(F.greatest(0.5 + m + t + e + n, F.lit(0.0)), F.lit(1.0)), 4)


def fused(audio: Column, words: Column, share: float = 0.6) -> Column:
    """Audio and lyrics at .6 and .4; audio alone where there are no lyrics."""
    return F.when(words.isNotNull(), share * audio + (1 - share) * words).otherwise(audio)


def with_mood(df: DataFrame, label: str = "label8") -> DataFrame:
    """Adds song_valence and song_arousal: half the label's centre and half the valence, and .6 of energy and .4 of arousal,
    each scaled to 0..1 over the table (.5 for null). The bounds are one aggregate, joined to the rows."""
    known = {c: F.coalesce(F.col(c), F.lit(0.5)) for c in ("valence", "energy", "arousal")}
    bounds = df.agg(*[f(x).alias(f"_{n}_{c}") for c, x in known.items() for n, f in (("low", F.min), ("high", F.max))])
    scale = lambda c: F.least(F.greatest((known[c] - F.col(f"_low_{c}")) / (F.col(f"_high_{c}") - F.col(f"_low_{c}") + 1e-9), F.lit(0.0)), F.lit(1.0))
    centre = F.coalesce(F.try_element_at(F.create_map(*[x for k, (v, _) in CENTRES.items() for x in (F.lit(k), F.lit(v))]), F.lower(F.coalesce(F.col(label), F.lit("happy")))), F.lit(0.5))
    met = df.join(F.broadcast(bounds))
    return met.withColumns({"song_valence": 0.5 * centre + 0.5 * scale("valence"), "song_arousal": 0.6 * scale("energy") + 0.4 * scale("arousal")}).drop(*bounds.columns)


def color_why(valence: Column, arousal: Column, target_v: Column, target_a: Column, match: Column, label: Column, hex_: Column) -> Column:
    """Why a song suits a colour: both places, how near they are, and the song's mood."""
    mood = F.lower(F.coalesce(label, F.lit("")))
    reason = F.when(mood != "", F.concat(F.lit("the song is "), mood, F.lit(", as the colour's mood is"))).otherwise("song and colour are of one mood")
    return F.struct(
        reason.alias("reason"), F.lit("mood").alias("top_signal"), F.round(match, 3).alias("mood_match"), F.array(F.round(valence, 3), F.round(arousal, 3)).alias("song_va"),
        F.array(F.round(target_v, 3), F.round(target_a, 3)).alias("color_va"), mood.alias("song_emotion"), hex_.alias("color_hex"),
    )


def song_why(score: Column, label: Column, seed_label: Column, tempo: Column, seed_tempo: Column, valence: Column, arousal: Column, seed_v: Column, seed_a: Column) -> Column:
    """Why a song is like another: the fused score, whether the moods are one, how far the tempos and moods are apart."""
    mood, seed = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(seed_label, F.lit("")))
    same = (mood != "") & (mood == seed)
    near = F.exp(-0.5 * (F.pow((valence - seed_v) / 0.22, F.lit(2)) + F.pow((arousal - seed_a) / 0.14, F.lit(2))))
    return F.struct(
        F.when(same, F.concat(F.lit("it sounds alike and is "), mood, F.lit(" as well"))).otherwise("it sounds alike").alias("reason"), F.lit("audio").alias("top_signal"),
        F.round(score, 3).alias("similarity"), same.alias("same_mood"), mood.alias("song_emotion"), F.round(F.abs(tempo - seed_tempo), 1).alias("tempo_delta"), F.round(near, 3).alias("mood_match"),
    )


def nearest_end(valence: Column, arousal: Column, from_v: Column, from_a: Column, to_v: Column, to_a: Column) -> Column:
    """Which end of a journey a song is nearer to: 0 the first (also if both are as near), 1 the second."""
    far = lambda v, a: F.pow(valence - v, F.lit(2)) + F.pow(arousal - a, F.lit(2))
    return F.when(far(to_v, to_a) < far(from_v, from_a), 1).otherwise(0)


def musical_text(tempo: Column, tempo_class: Column, energy_class: Column, dance: Column, mode: Column) -> Column:
    """A short text of what is known for sure: tempo, energy, dance and mode; null parts are left out."""
    danced = F.when(dance < 0.34, "low").when(dance < 0.66, "medium").when(dance.isNotNull(), "high")
    named = lambda c: F.nullif(F.trim(c), F.lit(""))
    beats = F.concat(F.lit("tempo "), named(tempo_class), F.coalesce(F.concat(F.lit(" (~"), F.bround(tempo, 0).cast("int").cast("string"), F.lit(" BPM)")), F.lit("")))
    parts = F.concat_ws(", ", beats, F.concat(F.lit("energy "), named(energy_class)), F.concat(F.lit("dance "), danced), F.when(mode == 1, "major").when(mode.isNotNull(), "minor"))
    return F.when(parts == "", "unknown").otherwise(parts)


def sentiment(positive: Column, negative: Column, neutral: Column) -> Column:
    """struct of positive, negative, neutral and compound shares to four places, and the category; no words are neutral, null
    without any lyrics."""
    total = positive + negative + neutral
    share = lambda c, other: F.round(F.when(total > 0, c / total).otherwise(other), 4)
    compound = F.round(F.when(total > 0, (positive - negative) / total).otherwise(0.0), 4)
    category = F.when(compound >= 0.05, "Positive").when(compound <= -0.05, "Negative").when(compound.isNotNull(), "Neutral")
    made = F.struct(share(positive, 0.0).alias("positive"), share(negative, 0.0).alias("negative"), share(neutral, 1.0).alias("neutral"), compound.alias("compound"), category.alias("category"))
    return F.when(total.isNotNull(), made)


def decibels(db: Column) -> Column:
    """The factor of a level in dB."""
    return F.pow(F.lit(10.0), db / 20)


def loudness_gain(own: Column, other: Column, most: float = 6.0) -> Column:
    """The dB that bring one song to another's loudness, within bounds; 0 where one isn't known or no loudness (-70 to 0 LUFS)."""
    known = own.between(-70, 0) & other.between(-70, 0)
    return F.when(known, F.least(F.greatest(own - other, F.lit(-most)), F.lit(most))).otherwise(0.0)


def beats_of(text: Column) -> Column:
    """The finite numbers of a JSON list of beat times, ascending as they stand; an empty list for null or broken text."""
    parsed = F.from_json(text, "array<double>")
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.array().cast("array<double>"))


def time_signature(gaps: Column, bpm: Column) -> Column:
    """3 where bars of three beats are clearly steadier than bars of four, at 70 to 130 BPM; else 4."""

    def unsteady(n: int) -> Column:
        bars = F.floor(F.size(gaps) / n).cast("int")
        sums = F.transform(F.sequence(F.lit(0), bars - 1), lambda i: F.aggregate(F.slice(gaps, i * n + 1, F.lit(n)), F.lit(0.0), lambda s, x: s + x))
        mean = F.aggregate(sums, F.lit(0.0), lambda s, x: s + x) / bars
        var = F.aggregate(sums, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / bars
        return F.when(bars > 2, F.sqrt(var)).otherwise(float("inf"))

    enough = F.coalesce(F.size(gaps) >= 4, F.lit(False)) & bpm.between(70, 130)
    return F.when(enough & (unsteady(3) < 0.7 * unsteady(4)), 3).otherwise(4)


def cue_points(levels: Column, step: float, duration: Column, boundary: Column, silent: float = 0.02) -> Column:
    """struct(fade_in, fade_out): the first loud frame or the first boundary, at most 15 s; the last loud frame less a second,
    or 20 s before the end where that is under 30 s."""
    at = lambda i: (i - 1) * step
    places = F.filter(F.transform(levels, lambda x, i: F.when(x >= silent, i + 1)), lambda i: i.isNotNull())
    first, last = F.coalesce(at(F.get(places, F.lit(0))), F.lit(0.0)), F.element_at(F.when(F.size(places) > 0, places), -1)
    out = F.when((last > 1) & (at(last) - 1.0 >= 30), at(last) - 1.0).otherwise(F.greatest(F.lit(0.0), duration - 20.0))
    fade_in = F.greatest(F.lit(0.0), F.least(F.lit(15.0), F.greatest(first, F.coalesce(boundary, F.lit(0.0)))))
    return F.struct(F.round(fade_in, 2).alias("fade_in"), F.round(F.greatest(F.lit(0.0), F.least(duration, out)), 2).alias("fade_out"))


def downbeats(beats: Column, dance: Column, least: float = 0.7) -> Column:
    """Every fourth beat to three places, for songs to dance to; null with fewer than two."""
    every = F.filter(F.transform(beats, lambda b, i: F.when(i % 4 == 0, F.round(b, 3))), lambda b: b.isNotNull())
    return F.when((F.coalesce(dance, F.lit(0.0)) >= least) & (F.size(every) >= 2), every)


def frame_shares(speech: Column, singing: Column, music: Column) -> Column:
    """Of the levels of frames: the three means, the share of frames where speech leads, and the share with little music."""
    n = F.size(speech)
    mean = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / n, 5)
    leads = F.zip_with(speech, music, lambda s, m: ((s >= 0.10) & (s > m)).cast("double"))
    return F.struct(mean(speech).alias("speech_mean"), mean(singing).alias("singing_mean"), mean(music).alias("music_mean"), mean(leads).alias("speech_share"), mean(F.transform(music, lambda m: (m < 0.10).cast("double"))).alias("low_music"))


def rms_envelope(signal: Column, window: int, hop: int) -> Column:
    """The root mean square of windows of a signal, one each ``hop`` samples; of the whole, if it is shorter than a window."""
    power = lambda part: F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x) / F.size(part))
    starts = F.sequence(F.lit(0), F.floor((F.size(signal) - window) / hop).cast("int"))
    return F.when(F.size(signal) < window, F.array(power(signal))).otherwise(F.transform(starts, lambda i: power(F.slice(signal, i * hop + 1, F.lit(window)))))


def merged_features(model: dict[str, Column], measured: dict[str, Column], estimate: Column, source: Column) -> dict[str, Column]:
    """What a model says, else what was measured; valence is estimated where neither has it, and flagged; and the source."""
    some = F.coalesce(*[c.cast("string") for c in model.values()]).isNotNull()
    out = {k: F.coalesce(model.get(k, F.lit(None).cast("double")), measured.get(k, F.lit(None).cast("double"))) for k in {**measured, **model}}
    valence = out["valence"]
    return out | {"valence": F.coalesce(valence, estimate), "valence_estimated": valence.isNull(), "feature_source": F.when(some, F.concat(source, F.lit("+model"))).otherwise(source)}


def client_of(forwarded: Column, host: Column) -> Column:
    """The first address of a forwarding header, else the host, else unknown."""
    return F.coalesce(F.nullif(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit("")), host, F.lit("unknown"))


def limit_of(path: Column, limits: dict[str, int], default: int) -> Column:
    """The limit of the first prefix that a path starts with."""
    out = F.lit(default)
    for prefix, n in reversed([*limits.items()]):
        out = F.when(F.startswith(path, F.lit(prefix)), n).otherwise(out)
    return out


def prompt_contrast(vector: Column, positive: Column, negative: Column) -> Column:
    """How much nearer a vector is to one prompt than to its opposite."""
    return dot(vector, positive) - dot(vector, negative)


#: The names of the quadrants and the colour of a song that has none.
QUADRANT_NAMES = ("Q1: Happy/Excited", "Q2: Angry/Tense", "Q3: Sad/Melancholic", "Q4: Calm/Peaceful")
NO_COLOR = "#6366f1"


def defaulted(df: DataFrame, media: DataFrame) -> DataFrame:
    """Songs as they are loaded, with a default for what must not be missing: (track_id, album_id, primary_artist_id, popularity, explicit,
    arousal, color_hex, mood_quadrant, instrumental, has_lyrics, image, has_art, has_audio, audio_file).

    Arousal is the energy where it is missing, else .5. A quadrant that is missing or unknown follows from valence and arousal; a
    valence of 0 counts as .5 there, and a missing one gives the fourth. An image is the medium one, else the thumbnail. media: the
    track_ids that have a file.
    """
    c = lambda name, kind="string": F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
    blank = lambda x: F.when(F.trim(x) != "", x)
    arousal = F.coalesce(c("arousal", "double"), c("energy", "double"), F.lit(0.5))
    valence = F.when(c("valence", "double") == 0, 0.5).otherwise(c("valence", "double"))
    high, up = valence >= 0.5, arousal >= 0.5
    derived = F.when(high & up, QUADRANT_NAMES[0]).when((valence < 0.5) & up, QUADRANT_NAMES[1]).when((valence < 0.5) & ~up, QUADRANT_NAMES[2]).otherwise(QUADRANT_NAMES[3])
    image = F.coalesce(blank(c("image_url_medium")), blank(c("thumbnail_url")))
    flag = lambda name: F.coalesce(c(name, "boolean"), F.lit(False))
    files = media.select(F.col("track_id").cast("string").alias("__id")).distinct().withColumn("__file", F.lit(True))
    met = df.join(files, df["track_id"].cast("string") == F.col("__id"), "left")
    has = F.coalesce("__file", F.lit(False))
    return met.select(
        "track_id", blank(c("album_id")).alias("album_id"), blank(c("primary_artist_id")).alias("primary_artist_id"), F.coalesce(c("track_popularity", "int"), F.lit(0)).alias("popularity"), flag("track_explicit").alias("explicit"),
        arousal.alias("arousal"), F.coalesce(blank(c("color_hex")), F.lit(NO_COLOR)).alias("color_hex"), F.when(c("mood_quadrant") != "Unknown", c("mood_quadrant")).otherwise(derived).alias("mood_quadrant"),
        flag("instrumental").alias("instrumental"), flag("has_lyrics").alias("has_lyrics"), image.alias("image"), F.coalesce(image.startswith("http"), F.lit(False)).alias("has_art"),
        has.alias("has_audio"), F.when(has, F.concat(F.col("track_id").cast("string"), F.lit(".mp3"))).alias("audio_file"),
    )
