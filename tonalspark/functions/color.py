"""Colours: sRGB, HSL, Oklab, valence and arousal, emotions and differences."""

from __future__ import annotations

import colorsys
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

#: The twelve named colours of the survey norms.
COLORS = {
    "red": "#BE0032", "orange": "#F38400", "yellow": "#F3C300", "pink": "#FFB7C5", "green": "#008856", "turquoise": "#3AB09E",
    "blue": "#0067A5", "purple": "#9C4F96", "brown": "#80461B", "white": "#F2F3F4", "grey": "#848482", "black": "#222222",
}

EMOTIONS = ("happy", "excited", "peaceful", "calm", "melancholic", "sad", "tense", "angry")

#: How strongly each anchor colour is associated with each of EMOTIONS (survey shares).
ANCHOR_EMOTIONS = {
    "#FF0000": [0.1242, 0.2850, 0.0211, 0.0299, 0.1368, 0.0070, 0.1029, 0.2931],
    "#FF8000": [0.3333, 0.2358, 0.0416, 0.1009, 0.1076, 0.0078, 0.1008, 0.0721],
    "#FFFF00": [0.3130, 0.2162, 0.0401, 0.1052, 0.1239, 0.0108, 0.1193, 0.0714],
    "#008000": [0.2104, 0.2318, 0.0627, 0.2069, 0.0992, 0.0109, 0.1435, 0.0346],
    "#40E0D0": [0.2628, 0.2786, 0.0631, 0.2087, 0.0854, 0.0250, 0.0539, 0.0225],
    "#0000FF": [0.1377, 0.2504, 0.0738, 0.1777, 0.1684, 0.0883, 0.0754, 0.0283],
    "#800080": [0.1421, 0.2580, 0.0648, 0.0753, 0.2118, 0.0547, 0.1300, 0.0633],
    "#FFC0CB": [0.3012, 0.3452, 0.0763, 0.1110, 0.0844, 0.0077, 0.0532, 0.0211],
    "#8B4513": [0.0281, 0.0648, 0.0405, 0.0541, 0.3203, 0.0449, 0.3697, 0.0777],
    "#FFFFFF": [0.1197, 0.2691, 0.1154, 0.2264, 0.1273, 0.0376, 0.0755, 0.0291],
    "#808080": [0.0133, 0.0422, 0.0321, 0.0326, 0.4702, 0.1324, 0.2087, 0.0684],
    "#000000": [0.0127, 0.0547, 0.0191, 0.0146, 0.3123, 0.1096, 0.2705, 0.2064],
}

#: The weights of (L, a/.4, b/.4, C/.4, cos h, sin h) for valence, and the sRGB to Oklab matrices.
VALENCE_WEIGHTS = (0.686, -0.7459, 0.0369, 0.4956, 0.1458, -0.0404)
RGB_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
XYZ_LMS = ((0.8189, 0.3619, -0.1288), (0.0329, 0.9293, 0.0361), (0.0482, 0.2643, 0.6338))
LMS_LAB = ((0.2104, 0.7936, -0.0040), (1.9779, -2.4285, 0.4505), (0.0259, 0.7827, -0.8086))

#: Fixed values: (valence, arousal, hue, saturation, lightness) of the anchors from mood back to colour.
MOOD_ANCHORS = (
    (0.95, 0.90, 55, 95, 70), (0.85, 0.70, 50, 85, 65), (0.75, 0.55, 110, 70, 70), (0.70, 0.15, 180, 40, 75), (0.60, 0.20, 150, 45, 60), (0.45, 0.35, 40, 50, 45),
    (0.30, 0.30, 240, 45, 35), (0.20, 0.20, 225, 35, 25), (0.25, 0.80, 75, 85, 50), (0.15, 0.90, 5, 95, 40), (0.65, 0.85, 0, 90, 50),
)


def rgb(hex_: Column) -> Column:
    """Shares of red, green and blue as an array; null for what isn't #RRGGBB."""
    good = F.when(hex_.rlike("^#[0-9A-Fa-f]{6}$"), hex_)
    return F.when(good.isNotNull(), F.array(*[F.conv(F.substring(good, i, 2), 16, 10).cast("double") / 255 for i in (2, 4, 6)]))


def hsl(hex_: Column) -> Column:
    """struct(h, s, l): hue in degrees, saturation and lightness as shares."""

    def of(x: Column) -> Column:
        r, g, b, high, spread = x["r"], x["g"], x["b"], x["high"], x["high"] - x["low"]
        light = (high + x["low"]) / 2
        sat = F.when(spread == 0, 0.0).otherwise(spread / (1 - F.abs(2 * light - 1)))
        hue = F.when(spread == 0, 0.0).when(high == r, F.pmod((g - b) / spread, F.lit(6.0))).when(high == g, (b - r) / spread + 2).otherwise((r - g) / spread + 4)
        return F.struct((hue * 60).alias("h"), sat.alias("s"), light.alias("l"))

    return let(rgb(hex_), lambda c: let(F.struct(c[0].alias("r"), c[1].alias("g"), c[2].alias("b"), F.array_max(c).alias("high"), F.array_min(c).alias("low")), of))


def _times(matrix: tuple, v: Column) -> Column:
    """A matrix of three rows times an array of three."""
    return F.array(*[row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in matrix])


def oklab(hex_: Column) -> Column:
    """L, a and b as an array."""
    power = lambda v, e: F.transform(v, lambda c: F.pow(c, F.lit(e)))
    lms = let(power(rgb(hex_), 2.2), lambda c: let(_times(RGB_XYZ, c), lambda xyz: power(_times(XYZ_LMS, xyz), 1 / 3)))
    return let(lms, lambda c: _times(LMS_LAB, c))


def _clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def valence_arousal(hex_: Column) -> Column:
    """struct(valence, arousal) of a colour: arousal from redness, saturation and lightness, valence from Oklab.

    Colours of a saturation under .12 have no hue: valence then follows lightness. Null for what isn't a colour.
    """

    def place_of(c: Column) -> Column:
        h, s, l, o = c["hsl"]["h"], c["hsl"]["s"], c["hsl"]["l"], c["lab"]
        redness = F.when(s < 0.12, 0.5).otherwise((1 + F.cos(F.radians(h))) / 2)
        chroma, angle = F.sqrt(o[1] * o[1] + o[2] * o[2]), F.atan2(o[2], o[1])
        tinted = F.lit(0.0)
        for feature, w in zip((o[0], o[1] / 0.4, o[2] / 0.4, chroma / 0.4, F.cos(angle), F.sin(angle)), VALENCE_WEIGHTS):
            tinted = tinted + feature * w
        valence = F.when(s < 0.12, _clip(0.20 + 0.41 * l)).otherwise(_clip(tinted))
        return F.struct(valence.alias("valence"), _clip(0.373 * redness + 0.356 * s + 0.271 * l - 0.10).alias("arousal"))

    return F.when(rgb(hex_).isNotNull(), let(F.struct(hsl(hex_).alias("hsl"), oklab(hex_).alias("lab")), place_of))


def quadrant(valence: Column, arousal: Column) -> Column:
    """Q1 high both, Q2 low valence, Q3 low both, Q4 low arousal; halves count as high."""
    return F.when((valence >= 0.5) & (arousal >= 0.5), "Q1").when(arousal >= 0.5, "Q2").when(valence < 0.5, "Q3").otherwise("Q4")


def _anchor(hex_: str) -> tuple[float, float, float]:
    """(cos h * s, sin h * s, l) of a constant: chroma-scaled hue and lightness, where anchors are compared."""
    h, l, s = colorsys.rgb_to_hls(*[int(hex_[i : i + 2], 16) / 255 for i in (1, 3, 5)])
    return math.cos(2 * math.pi * h) * s, math.sin(2 * math.pi * h) * s, l


def emotion_shares(hex_: Column) -> Column:
    """A map of EMOTIONS to shares: the anchors' by inverse squared distance, summing to one."""
    places = F.array(*[F.array(*map(F.lit, _anchor(k))) for k in ANCHOR_EMOTIONS])
    table = F.array(*[F.array(*[F.lit(p[i]) for p in ANCHOR_EMOTIONS.values()]) for i in range(len(EMOTIONS))])
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)

    def weights(c: Column) -> Column:
        at = F.array(F.cos(F.radians(c["h"])) * c["s"], F.sin(F.radians(c["h"])) * c["s"], c["l"])
        return let(at, lambda v: F.transform(places, lambda a: 1 / (total(F.zip_with(a, v, lambda x, y: (x - y) * (x - y))) + 1e-6)))

    shares = let(let(hsl(hex_), weights), lambda w: F.transform(table, lambda p: total(F.zip_with(p, w, lambda x, y: x * y))))
    return let(shares, lambda v: F.map_from_arrays(F.array(*map(F.lit, EMOTIONS)), F.transform(v, lambda x: x / total(v))))


def mood_to_hsl(valence: Column, arousal: Column) -> Column:
    """struct(hue, sat, light): the three nearest mood anchors, by inverse distance."""
    anchors = F.array(*[F.struct(F.sqrt(F.pow(valence - v, F.lit(2)) + F.pow(arousal - a, F.lit(2))).alias("d"), F.lit(i).alias("i"), F.lit(float(h)).alias("h"), F.lit(float(s)).alias("s"), F.lit(float(l)).alias("l")) for i, (v, a, h, s, l) in enumerate(MOOD_ANCHORS)])
    def mean(near: Column) -> Column:
        total = F.aggregate(near, F.lit(0.0), lambda t, x: t + 1 / (x["d"] + 1e-6))
        of = lambda k: F.aggregate(near, F.lit(0.0), lambda t, x: t + x[k] / (x["d"] + 1e-6)) / total
        return F.struct(F.pmod(of("h"), F.lit(360.0)).alias("hue"), of("s").alias("sat"), of("l").alias("light"))

    return let(F.slice(F.array_sort(anchors), 1, 3), mean)


def modulated(hsl: Column, tempo: Column, mode: Column, energy: Column, bright: Column) -> Column:
    """A mood's colour, struct(hue, sat, light) in degrees and hundredths, moved by what is known of the audio: the faster and the more energetic, the
    more saturated; major is lighter than minor; a bright timbre is warmer and lighter. Unknown features move nothing."""
    cut = lambda x, high: F.least(F.greatest(x, F.lit(0.0)), F.lit(float(high)))
    step = lambda x: F.coalesce(x, F.lit(0.0))
    sat = hsl["sat"] + step((cut((tempo - 60) / 140, 1) - 0.5) * 15) + step((energy - 0.5) * 10)
    light = hsl["light"] + F.when(mode.isNull(), 0.0).when(mode == 1, 10.0).otherwise(-10.0) + step((bright - 0.5) * 8)
    hue = F.pmod(hsl["hue"] + step((bright - 0.5) * -30), F.lit(360.0))
    return F.struct(hue.alias("hue"), cut(sat, 100).alias("sat"), cut(light, 100).alias("light"))


def hex_of(hue: Column, sat: Column, light: Column) -> Column:
    """``#rrggbb`` of a hue in degrees, saturation and lightness in hundredths; channels are cut to whole numbers."""
    s, l = sat / 100, light / 100
    chroma = (1 - F.abs(2 * l - 1)) * s

    def channel(n: int) -> Column:
        k = F.pmod(n + hue / 30, F.lit(12.0))
        value = l - chroma / 2 * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.floor(F.round(value * 255, 9)))), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(8), channel(4))


def bridge(hexes: Column, words: dict[str, str], most: int = 3) -> Column:
    """An array of struct(hex, emotion, word, valence, arousal) of the first ``most`` colours that can be read: the emotion of the largest share
    (ties: the first by name), what it is called, and the place in mood space to two digits."""
    names = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])

    def of(h: Column) -> Column:
        shares = F.map_entries(emotion_shares(h))
        top = F.array_min(F.transform(shares, lambda e: F.struct((-F.round(e["value"], 6)).alias("s"), e["key"].alias("emotion"))))["emotion"]
        place = valence_arousal(h)
        return F.struct(h.alias("hex"), top.alias("emotion"), F.coalesce(F.try_element_at(names, top), top).alias("word"), F.round(place["valence"], 2).alias("valence"), F.round(place["arousal"], 2).alias("arousal"))

    return F.transform(F.filter(F.slice(hexes, 1, most), lambda h: rgb(h).isNotNull()), of)


def cielab(hex_: Column) -> Column:
    """L, a and b under D65 as an array, from sRGB with its piecewise gamma."""
    matrix = ((0.4124564 / 0.95047, 0.3575761 / 0.95047, 0.1804375 / 0.95047), (0.2126729, 0.7151522, 0.0721750), (0.0193339 / 1.08883, 0.1191920 / 1.08883, 0.9503041 / 1.08883))
    linear = F.transform(rgb(hex_), lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))))
    curve = lambda v: F.transform(v, lambda t: F.when(t > 216 / 24389, F.pow(t, F.lit(1 / 3))).otherwise((24389 / 27 * t + 16) / 116))
    return let(let(linear, lambda c: curve(_times(matrix, c))), lambda f: F.array(116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])))


def ciede2000(p: Column, q: Column) -> Column:
    """The CIEDE2000 difference of two CIELAB colours (Sharma, Wu and Dalal 2005). Each step is computed once for a pair and named."""
    far = 25.0**7

    def adjusted(x: Column) -> Column:
        mean = (F.sqrt(x["a1"] * x["a1"] + x["b1"] * x["b1"]) + F.sqrt(x["a2"] * x["a2"] + x["b2"] * x["b2"])) / 2
        grey = let(F.pow(mean, F.lit(7)), lambda c: 1.5 - 0.5 * F.sqrt(c / (c + far)))
        return let(grey, lambda g: F.struct(x["l1"].alias("l1"), x["l2"].alias("l2"), (x["a1"] * g).alias("a1"), (x["a2"] * g).alias("a2"), x["b1"].alias("b1"), x["b2"].alias("b2")))

    def polar(x: Column) -> Column:
        angle = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
        chroma = [F.sqrt(x[f"a{i}"] * x[f"a{i}"] + x[f"b{i}"] * x[f"b{i}"]).alias(f"c{i}") for i in (1, 2)]
        return F.struct(x["l1"].alias("l1"), x["l2"].alias("l2"), *chroma, *[angle(x[f"a{i}"], x[f"b{i}"]).alias(f"h{i}") for i in (1, 2)])

    def means(x: Column) -> Column:
        apart, total, none = x["h2"] - x["h1"], x["h1"] + x["h2"], x["c1"] * x["c2"] == 0
        turn = F.when(none, 0.0).when(F.abs(apart) <= 180, apart).when(apart > 180, apart - 360).otherwise(apart + 360)
        middle = F.when(none, total).when(F.abs(apart) <= 180, total / 2).when(total < 360, (total + 360) / 2).otherwise((total - 360) / 2)
        return F.struct((x["l2"] - x["l1"]).alias("dl"), (x["c2"] - x["c1"]).alias("dc"), (2 * F.sqrt(x["c1"] * x["c2"]) * F.sin(F.radians(turn / 2))).alias("dh"), ((x["l1"] + x["l2"]) / 2).alias("l"), ((x["c1"] + x["c2"]) / 2).alias("c"), middle.alias("h"))

    def scaled(x: Column) -> Column:
        cos = lambda d: F.cos(F.radians(d))
        t = 1 - 0.17 * cos(x["h"] - 30) + 0.24 * cos(2 * x["h"]) + 0.32 * cos(3 * x["h"] + 6) - 0.20 * cos(4 * x["h"] - 63)
        light = let(F.pow(x["l"] - 50, F.lit(2)), lambda s: 1 + 0.015 * s / F.sqrt(20 + s))
        turn = let(F.pow(x["c"], F.lit(7)), lambda c: -2 * F.sqrt(c / (c + far))) * F.sin(F.radians(60 * F.exp(-F.pow((x["h"] - 275) / 25, F.lit(2)))))
        return F.struct((x["dl"] / light).alias("l"), (x["dc"] / (1 + 0.045 * x["c"])).alias("c"), (x["dh"] / (1 + 0.015 * x["c"] * t)).alias("h"), turn.alias("r"))

    both = F.struct(*[v[i].alias(f"{n}{k}") for k, v in ((1, p), (2, q)) for i, n in enumerate("lab")])
    steps = let(both, lambda x: let(adjusted(x), lambda y: let(polar(y), lambda z: let(means(z), scaled))))
    return let(steps, lambda d: F.sqrt(d["l"] * d["l"] + d["c"] * d["c"] + d["h"] * d["h"] + d["r"] * d["c"] * d["h"]))


def client_mood(hex_: Column) -> Column:
    """struct(valence, arousal) of any colour by its lightness and chroma, as a client guesses it; the middle for broken ones."""
    def mood(lab: Column) -> Column:
        light, chroma = lab[0] / 100, F.sqrt(lab[1] * lab[1] + lab[2] * lab[2]) / 130
        cut = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
        return F.struct(cut(0.69 * light + 0.22 * chroma).alias("valence"), cut(-0.31 * light + 0.6 * chroma).alias("arousal"))

    middle = F.struct(F.lit(0.5).alias("valence"), F.lit(0.5).alias("arousal"))
    return F.when(hex_.rlike("^#[0-9A-Fa-f]{6}$"), let(cielab(hex_), mood)).otherwise(middle)


def mood_atmosphere(valence: Column, arousal: Column) -> Column:
    """struct(hue, sat, light) from cool indigo to warm amber."""
    hue = F.pmod((250 + (35 - 250) * valence) / 360, F.lit(1.0))
    return F.struct(hue.alias("hue"), (0.3 + 0.55 * arousal).alias("sat"), (0.32 + 0.34 * valence).alias("light"))
