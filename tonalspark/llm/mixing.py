"""Mixes sources to target weights by iterative proportional fitting.

Topics are clusters of documents by their content words, apart from what their language has in common. Tokens are summed by
cell (source, language, topic). The wanted marginals are first brought within what the values hold and what all dimensions can
meet together; raking, in which no cell gives more than it has, then finds the tokens of each cell that meet them. Each document is
kept with its cell's probability, decided by a hash of its id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_map, stored, utf8, word_hashes

DIMENSIONS = ("source", "lang", "topic")
#: Values of a dimension that have a target of their own, those of most tokens (ties by name); rarer ones are raked as one value, within which
#: tokens keep their proportions. So the cells on the driver are bounded, whatever the corpus. Values with a given target always count.
VALUES = {"source": 1000, "lang": 100, "topic": 64}
REST = "\x00rest"
#: Raking ends when no sum of a value is off its target by this share of all tokens; targets that aren't met after so many
#: rounds count as out of reach. STEPS halvings find how far the way from the shares as they are to the wanted ones can be gone.
ROUNDS, TOLERANCE, STEPS = 200, 1e-9, 7
#: Numbers of a document's vector, classes of languages whose means are taken off, rounds of clustering, and documents from which
#: the first centres are chosen (all documents then move them).
WIDTH, LANGUAGES, CLUSTERING, FIRST = 256, 64, 6, 1000


def words_and_vector(text: bytes | None) -> tuple[int, np.ndarray]:
    """The words of a text between ASCII white space, and square roots of the counts of its words of six bytes or more by hash,
    of length 1000, as whole numbers: sums of them are the same in any order. Zeros without such words."""
    words = (text or b"").lower().split()
    long = [w for w in words if len(w) >= 6]
    counts = np.sqrt(np.bincount((word_hashes(long) % np.uint64(WIDTH)).astype(np.int64), minlength=WIDTH))
    return len(words), np.rint(counts * (1000 / max(np.linalg.norm(counts), 1e-9))).astype(np.int16)


def _language_class() -> Column:
    return F.pmod(F.xxhash64("lang"), F.lit(LANGUAGES)).cast("int")


@dataclass
class Topics:
    """Centres of clusters and the means of the classes of languages, sent with the tasks."""

    centres: np.ndarray
    means: np.ndarray

    def of(self, vectors: np.ndarray, languages: np.ndarray) -> np.ndarray:
        """The nearest centre of each vector less its language's mean; 0 for a vector of zeros."""
        rest = vectors - self.means[languages]
        near = (rest @ self.centres.T - (self.centres**2).sum(1) / 2).argmax(1)
        return np.where(vectors.any(1), near, 0).astype(np.int32)


def vectors(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns in ``carry`` with language int, n_tokens long and vector binary of every whole text."""
    rows = docs.select(*carry, _language_class().alias("language"), "text")
    width = len(rows.columns) - 1

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [words_and_vector(text) for text in utf8(batch.column(width))]
        return pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array([n for n, _ in made], pa.int64()), pa.array([v.tobytes() for _, v in made], pa.binary())], names=[*batch.schema.names[:width], "n_tokens", "vector"])

    return arrow_map(rows, of, StructType(rows.schema.fields[:width]).add("n_tokens", "long").add("vector", "binary"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, WIDTH).astype(np.float64)


def _sums(made: DataFrame, group, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the vectors of each group and their counts: summed in the tasks, then by Spark; kinds x WIDTH numbers come
    to the driver, however many documents there are."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((kinds, WIDTH + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1))
                of = group(v, batch.column(0).to_numpy())
                rows = np.column_stack([v, np.ones(len(v))]).astype(np.int64)
                for k in np.unique(of):
                    sums[k] += rows[of == k].sum(0)
        k, place = np.nonzero(sums)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sums[k, place])], names=["k", "place", "s"])

    out = np.zeros((kinds, WIDTH + 1), np.int64)
    found = made.select("language", "vector").mapInArrow(partial, "k int, place int, s long").groupBy("k", "place").agg(F.sum("s").alias("s")).toArrow()
    out[found.column("k").to_numpy(), found.column("place").to_numpy()] = found.column("s").to_numpy()
    return out[:, :WIDTH], out[:, WIDTH]


def fit_topics(made: DataFrame, topics: int = 8) -> Topics:
    """Clusters of all rows of ``vectors``: the first centres are those of FIRST rows chosen by a hash, then come rounds of
    assigning every row and taking means."""
    made = made.select("language", "vector")
    sums, n = _sums(made, lambda v, language: language, LANGUAGES)
    means = sums / np.maximum(n, 1)[:, None]
    some = made.orderBy(F.xxhash64("vector"), "vector", "language").limit(FIRST).collect()
    rest = np.array([np.frombuffer(r["vector"], np.int16) - means[r["language"]] for r in some if any(r["vector"])])
    if not len(rest):
        return Topics(np.zeros((topics, WIDTH)), means)
    model = Topics(first_centres(rest, topics), means)
    for _ in range(CLUSTERING):
        fixed = model
        sums, n = _sums(made, lambda v, language, m=fixed: m.of(v, language) * LANGUAGES + language, topics * LANGUAGES)
        by_topic = (sums - n[:, None] * np.tile(means, (topics, 1))).reshape(topics, LANGUAGES, WIDTH).sum(1)
        count = n.reshape(topics, LANGUAGES).sum(1)
        model = Topics(np.where(count[:, None] > 0, by_topic / np.maximum(count, 1)[:, None], fixed.centres), means)
    return model


def first_centres(rows: np.ndarray, topics: int, starts: int = 10, seed: int = 3) -> np.ndarray:
    """The tightest of several clusterings of a few rows, each begun from rows that are likely to be far apart."""
    best, least = rows[np.zeros(topics, int)], np.inf
    for start in range(starts):
        rng = np.random.default_rng([seed, start])
        centres = [rows[rng.integers(len(rows))]]
        for _ in range(topics - 1):
            gaps = np.min([((rows - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(rows[rng.choice(len(rows), p=gaps / gaps.sum())] if gaps.sum() else rows[0])
        now = np.array(centres)
        for _ in range(10):
            apart = (rows**2).sum(1)[:, None] - 2 * rows @ now.T + (now**2).sum(1)
            of = apart.argmin(1)
            now = np.array([rows[of == k].mean(0) if (of == k).any() else now[k] for k in range(topics)])
        if (spread := apart.min(1).sum()) < least:
            best, least = now, spread
    return best


def assigned(made: DataFrame, model: Topics) -> DataFrame:
    """The rows of ``vectors`` with topic int instead of language and vector."""
    rest = [c for c in made.columns if c not in ("language", "vector")]
    rows = made.select(*rest, "language", "vector")

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        topic = model.of(_matrix(batch.column(len(rest) + 1)), batch.column(len(rest)).to_numpy())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(topic)], names=[*batch.schema.names[: len(rest)], "topic"])

    return arrow_map(rows, of, StructType(rows.schema.fields[: len(rest)]).add("topic", "integer"))


def profiled(docs: DataFrame, topics: int = 8, model: Topics | None = None) -> DataFrame:
    """Adds topic int and n_tokens long to the columns of ``docs`` (doc_id, text, lang and others), from whole texts.

    Tokens are words between ASCII white space. The topic is the nearest of ``topics`` clusters of all documents by their words
    of six bytes or more, once what is common to a language is taken off, so a topic has documents of all languages. A text
    without such words, also a null one, has topic 0. Columns of these names that the input has are replaced.
    """
    docs = docs.drop("topic", "n_tokens")
    if model is None:
        model = fit_topics(stored(vectors(docs, []), "vectors"), topics)
    rows = docs.withColumn("__language", _language_class())
    width, at = len(docs.columns), docs.columns.index("text")

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [words_and_vector(text) for text in utf8(batch.column(at))]
        topic = model.of(np.array([v for _, v in made], float).reshape(-1, WIDTH), batch.column(width).to_numpy())
        return pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(topic), pa.array([n for n, _ in made], pa.int64())], names=[*batch.schema.names[:width], "topic", "n_tokens"])

    return arrow_map(rows, of, StructType(docs.schema.fields).add("topic", "integer").add("n_tokens", "long"))


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _filled(tokens: np.ndarray, shares: np.ndarray, budget: float) -> np.ndarray:
    """Tokens in proportion to the shares, none above what a value has; what the full ones can't give, the others do. Where those that
    have a share can't give the budget, the rest comes from the others in proportion."""
    out, open_ = np.zeros(len(tokens)), shares > 0
    while open_.any():
        due = (budget - out.sum()) * np.where(open_, shares, 0) / shares[open_].sum()
        full = open_ & (due >= tokens)
        if not full.any():
            return out + due
        out, open_ = np.where(full, tokens, out), open_ & ~full
    left, room = budget - out.sum(), np.where(shares > 0, 0.0, tokens)
    return out + left * room / room.sum() if left > 1e-12 * budget and room.sum() else out


def _scales(of: np.ndarray, base: np.ndarray, most: np.ndarray, aim: np.ndarray) -> np.ndarray:
    """For each value the factor by which the base of its cells, none above ``most``, sums to its aim. Cells that the factor fills are
    taken out and the factor for the others is raised, until no more fill up."""
    sums = np.bincount(of, base, len(aim))
    scale = np.divide(aim, sums, out=np.zeros(len(aim)), where=sums > 0)
    for _ in range(len(of) + 1):
        full = base * scale[of] >= most
        held, free = np.bincount(of[full], most[full], len(aim)), np.bincount(of[~full], base[~full], len(aim))
        new = np.maximum(scale, np.divide(aim - held, free, out=scale.copy(), where=(free > 0) & (aim > held)))
        if (new <= scale * (1 + 1e-14)).all():
            break
        scale = new
    return scale


def rake(codes: list[np.ndarray], tokens: np.ndarray, aims: list[np.ndarray], fraction: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """The raked tokens of each cell, and the largest deviation of a sum from its aim as a share of all tokens.

    codes: the value of each cell in each dimension; aims: the tokens of each value. A cell has the fraction of its tokens times a
    factor for each of its values, but no more than its tokens. The factors are set dimension by dimension until all sums hold; of all
    tables with these sums and bounds it is the one nearest to the cells as they are (by relative entropy), in whatever order the
    dimensions come.
    """
    total, base = max(tokens.sum(), 1e-300), fraction * tokens
    scales, off, w = [np.ones(len(a)) for a in aims], np.inf, base
    for _ in range(rounds):
        for d, aim in enumerate(aims):
            others = base.copy()
            for e, of in enumerate(codes):
                if e != d:
                    others = others * scales[e][of]
            scales[d] = _scales(codes[d], others, tokens, aim)
        w = base.copy()
        for of, scale in zip(codes, scales):
            w = w * scale[of]
        w = np.minimum(w, tokens)
        off = max(np.abs(np.bincount(of, w, len(aim)) - aim).max(initial=0) for of, aim in zip(codes, aims)) / total
        if off <= tolerance:
            break
    return w, off


@dataclass
class Plan:
    """cells: source, lang, topic, tokens and probability; values: dimension, value, tokens and the wanted, target and reached shares;
    way: how far the way to the wanted shares was gone, 1 if they can be met together."""

    cells: pd.DataFrame
    values: pd.DataFrame
    way: float


def planned(cells: pd.DataFrame, fraction: float = 0.5, temper: float = 0.5, targets: dict[str, dict[str, float]] | None = None) -> Plan:
    """How the fraction of all tokens is dealt to the cells (source, lang, topic, tokens) so that the marginals meet their targets.

    Wanted are the given shares, or shares in proportion to each value's tokens to the power ``temper``. A value that hasn't got its share
    gives all it has, and the others of its dimension share the rest. Where the dimensions still can't be met together (a source in one
    language only), the targets lie on the way from the shares as they are, which can always be met, to the wanted ones: as far as
    halving the way STEPS times can tell that they can be met. So what is returned as the target is reached.
    """
    cells = cells.sort_values(list(DIMENSIONS)).reset_index(drop=True)
    tokens = cells["tokens"].to_numpy(float)
    budget, codes, wanted, held, names = fraction * tokens.sum(), [], [], [], []
    for k in DIMENSIONS:
        of, values = pd.factorize(cells[k])
        sums = np.bincount(of, tokens, len(values))
        given = (targets or {}).get(k)
        shares = np.where(sums > 0, [given.get(v, 0.0) for v in values] if given else sums**temper, 0.0)
        codes.append(of)
        held.append(sums)
        wanted.append(shares / max(shares.sum(), 1e-300) if shares.any() else sums / max(sums.sum(), 1e-300))
        names.append(list(values))
    goals = [_filled(n, s, budget) for n, s in zip(held, wanted)]

    def reached(way: float) -> tuple[list[np.ndarray], np.ndarray, float]:
        aims = [(1 - way) * fraction * n + way * g for n, g in zip(held, goals)]
        return aims, *rake(codes, tokens, aims, fraction)

    way, (aims, w, off) = 1.0, reached(1.0)
    if off > TOLERANCE:
        low, high, (aims, w, off) = 0.0, 1.0, reached(0.0)
        for _ in range(STEPS):
            middle = (low + high) / 2
            found = reached(middle)
            if found[2] <= TOLERANCE:
                low, (aims, w, off) = middle, found
            else:
                high = middle
        way = low
    cells["probability"] = np.divide(w, tokens, out=np.zeros(len(tokens)), where=tokens > 0).clip(0, 1)
    got = max(w.sum(), 1e-300)
    rows = [(k, v, float(held[d][i]), float(wanted[d][i]), float(aims[d][i] / max(budget, 1e-300)), float(np.bincount(codes[d], w, len(aims[d]))[i] / got)) for d, k in enumerate(DIMENSIONS) for i, v in enumerate(names[d])]
    return Plan(cells, pd.DataFrame(rows, columns=["dimension", "value", "tokens", "wanted", "target", "reached"]), way)


def chance(seed: int) -> Column:
    """A number from 0 to 1 that follows from doc_id (or from the topic and tokens, where it is null) and the seed."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws("/", "source", "lang", "topic", "n_tokens"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), key)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _own(cells: DataFrame, targets: dict[str, dict[str, float]] | None, values: dict[str, int]) -> dict[str, list[str] | None]:
    """For each dimension the values that count for themselves, None for all of them."""
    out: dict[str, list[str] | None] = {}
    for k in DIMENSIONS:
        top = [r[0] for r in cells.groupBy(k).agg(F.sum("tokens").alias("n")).orderBy(F.col("n").desc(), k).limit(values[k] + 1).collect()]
        out[k] = None if len(top) <= values[k] else sorted({*top[: values[k]], *((targets or {}).get(k) or {})})
    return out


def mixed(docs: DataFrame, profile: DataFrame, fraction: float = 0.5, temper: float = 0.5, targets: dict[str, dict[str, float]] | None = None, seed: int = 1, values: dict[str, int] = VALUES, shares: bool = False) -> DataFrame:
    """Adds probability double and kept boolean to ``docs``, which has the columns of ``profiled``; with ``shares`` also
    source_target, source_reached and so on for lang and topic: the share of the kept tokens that the row's value is to have, and has
    in expectation.

    profile: the same rows, as far as cells are counted from them (doc_id, source, lang, topic, n_tokens). The expected tokens of
    what is kept are ``fraction`` of all; see ``planned`` for the marginals. A null source or language is the value ''. Documents
    without tokens are in no cell's sum and have the probability of their cell. Rows of one doc_id share their fate. An empty table gives
    an empty result; columns of the added names that the input has are replaced.

    Cells are summed by Spark; those of the values that have targets of their own (see VALUES) come to the driver and go back with the
    tasks, so what is sent is bounded by the parameter, not by the corpus.
    """
    cells = stored(profile.groupBy(*[_key(k).alias(k) for k in DIMENSIONS]).agg(F.sum("n_tokens").alias("tokens")), "cells")
    own, spark = _own(cells, targets, values), docs.sparkSession
    coarse = lambda k, c: c if own[k] is None else F.when(c.isin(own[k]), c).otherwise(REST)
    small = cells.groupBy(*[coarse(k, F.col(k)).alias(k) for k in DIMENSIONS]).agg(F.sum("tokens").cast("double").alias("tokens")).toPandas()
    plan = planned(small, fraction, temper, targets)
    added = ["probability", "kept", *[f"{k}_{s}" for k in DIMENSIONS for s in ("target", "reached") if shares]]
    known = spark.createDataFrame(list(plan.cells[[*DIMENSIONS, "probability"]].itertuples(index=False, name=None)), "cell_source string, cell_lang string, cell_topic string, probability double")
    out = docs.drop(*added).withColumns({f"cell_{k}": coarse(k, _key(k)) for k in DIMENSIONS}).join(F.broadcast(known), [f"cell_{k}" for k in DIMENSIONS], "left")
    if shares:
        for k in DIMENSIONS:
            told = plan.values[plan.values["dimension"] == k][["value", "target", "reached"]]
            told = spark.createDataFrame(list(told.itertuples(index=False, name=None)), f"cell_{k} string, {k}_target double, {k}_reached double")
            out = out.join(F.broadcast(told), f"cell_{k}", "left")
    out = out.drop(*[f"cell_{k}" for k in DIMENSIONS]).withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return out.withColumn("kept", chance(seed) < F.col("probability")).select(*[c for c in docs.columns if c not in added], *added)


def _profile(docs: DataFrame) -> tuple[DataFrame, Topics]:
    """(doc_id, source, lang, n_tokens, topic) of every document, and the topics' model; one scan of the texts."""
    made = stored(vectors(docs, ["doc_id", "source", "lang"]), "vectors")
    model = fit_topics(made)
    return stored(assigned(made, model), "profile"), model


def survey(docs: DataFrame, fraction: float = 0.5, temper: float = 0.5, seed: int = 1) -> DataFrame:
    """(doc_id, source, lang, n_tokens, topic, probability, kept, and the target and reached share of each of its values) of every
    document."""
    profile, _ = _profile(docs)
    return mixed(profile, profile, fraction, temper, seed=seed, shares=True)


def sample(docs: DataFrame, fraction: float = 0.5, temper: float = 0.5, seed: int = 1) -> DataFrame:
    """The kept rows of ``docs``, with their columns. Texts are read twice and never shuffled."""
    profile, model = _profile(docs)
    clashes = {c: f"own_{c}" for c in docs.columns if c in ("topic", "n_tokens", "probability", "kept")}
    rows = profiled(docs.withColumnsRenamed(clashes), model=model)
    out = mixed(rows, profile, fraction, temper, seed=seed).where("kept").drop("topic", "n_tokens", "probability", "kept")
    return out.withColumnsRenamed({v: k for k, v in clashes.items()}).select(*docs.columns)
