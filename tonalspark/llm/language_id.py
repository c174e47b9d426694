"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword; for each bit of the codewords a binary classifier over hashed 1- to 3-grams says on
which side a text lies. Decoding weighs each bit's hinge loss by how well that bit was learned, and takes the
codeword of least loss. Where the runner-up is as near, the text is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_map

BUCKETS = 1 << 12
UNKNOWN = "und"
_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower-case form, or a space where it is no letter."""
    global _table
    if _table is None:
        out = np.full(1 << 16, 32, np.uint32)
        for i in range(1 << 16):
            if (c := chr(i)).isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
        _table = out
    return _table


def features(text: str) -> np.ndarray | None:
    """Square roots of the shares of the hashed n-grams of a whole text, of unit length; None without a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    plain = _letters()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        if chr(points[i]).isalpha():
            plain[i] = points[i]
    if not len(plain) or (plain == 32).all():
        return None
    plain = np.concatenate(([np.uint32(32)], plain, [np.uint32(32)])).astype(np.uint32)
    plain = plain[(plain[:-1] != 32).tolist() + [True] if len(plain) < 2 else np.concatenate(([True], (plain[1:] != 32) | (plain[:-1] != 32)))]
    counts = np.zeros(BUCKETS)
    gram = plain * np.uint32(0x9E3779B1)
    for n in (1, 2, 3):
        if len(plain) >= n:
            if n > 1:
                gram = (gram[:-1] * np.uint32(0x85EBCA6B)) ^ (plain[n - 1 :] * np.uint32(0xC2B2AE35))
            counts += np.bincount((gram * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=BUCKETS) / (len(plain) - n + 1)
    root = np.sqrt(counts)
    return (root / np.linalg.norm(root)).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +-1: all ways to split the classes for up to 7 of them, else random columns, the best of some draws."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 7:
        return np.array([(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]).T.astype(float)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    draws = [rng.choice([-1.0, 1.0], (n, bits)) for _ in range(50)]
    return max(draws, key=lambda m: (bits - m @ m.T + 2 * bits * np.eye(n)).min())


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # of each bit

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous, loss) of each row of features; the loss is 0 at a codeword, 1 where the bits say nothing."""
        margins = np.tanh(2 * (x @ self.weights))
        losses = (np.maximum(0, 1 - margins[:, None, :] * self.codes[None]) * self.trust).sum(2) / self.trust.sum()
        likely = np.exp(-6 * (losses - losses.min(1, keepdims=True)))
        share = likely / likely.sum(1, keepdims=True)
        best = losses.argmin(1)
        top = np.sort(losses, axis=1)
        close = top[:, 1] - top[:, 0] < 0.05 if losses.shape[1] > 1 else np.zeros(len(x), bool)
        return best, share[np.arange(len(x)), best], close, top[:, 0]


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_lang: int = 600, ridge: float = 0.3) -> Model | None:
    """Learns from a bounded sample: about ``per_lang`` rows of each label, chosen by a hash of their ids (of their texts where the
    id is null). Features are
    those of whole texts, made in the tasks; the driver gets vectors alone. Rows without label, text or letters teach
    nothing; None if no row is left."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == k, min(1.0, 1.3 * per_lang / n)) for k, n in sorted(sizes.items())])
    place = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")), F.lit(11)), F.lit(1 << 20))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [features(text.as_py()) for text in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b"" if x is None else x.astype(np.float32).tobytes() for x in made], pa.binary())], names=["lang", "place", "x"])

    chosen = rows.select("lang", place.alias("place"), "text").where(F.col("place") < share * (1 << 20))
    seen = arrow_map(chosen, of, "lang string, place long, x binary").toArrow()  # vectors as they are, not an object for each row
    names, places, vectors = seen.column("lang").to_pylist(), seen.column("place").to_pylist(), seen.column("x").combine_chunks()
    first: dict[str, list[int]] = {}
    for i in sorted(range(len(names)), key=lambda i: (places[i], vectors[i].as_py())):
        if len(mine := first.setdefault(names[i], [])) < per_lang:
            mine.append(i)
    langs = sorted(k for k, at in first.items() if any(len(vectors[i].as_py()) for i in at))
    if not langs:
        return None
    at = [(j, i) for j, k in enumerate(langs) for i in first[k] if len(vectors[i].as_py())]
    y, x = np.array([j for j, _ in at]), np.empty((len(at), BUCKETS), np.float32)
    for row, (_, i) in zip(x, at):
        row[:] = np.frombuffer(vectors[i].as_py(), np.float32)
    del seen, vectors
    codes = codewords(len(langs))
    weigh = np.sqrt(len(y) / len(langs) / np.bincount(y, minlength=len(langs)))[y]  # classes count alike
    weights = ridge_weights(x, codes[y], weigh, ridge)
    trust = np.maximum(((_times(x, weights) * codes[y]) > 0).mean(0) - 0.5, 0.01)
    return Model(langs, codes, weights.astype(np.float32), trust)


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w in doubles, some columns of x at a time."""
    out = np.zeros((len(x), w.shape[1]))
    for k in range(0, x.shape[1], 512):
        out += x[:, k : k + 512].astype(np.float64) @ w[k : k + 512]
    return out


def ridge_weights(x: np.ndarray, targets: np.ndarray, weigh: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge regressions of each column of the targets on weighted rows, by the smaller of the two systems that have the same
    solution: as many equations as rows, or as columns, so never more than BUCKETS of them. Sums are of doubles, made of a part
    of x at a time, so no copy of x is held."""
    n, d = x.shape
    if n <= d:
        gram = ridge * np.eye(n)
        for k in range(0, d, 512):
            part = x[:, k : k + 512].astype(np.float64) * weigh[:, None]
            gram += part @ part.T
        dual = np.linalg.solve(gram, targets * weigh[:, None]) * weigh[:, None]
        return np.concatenate([x[:, k : k + 512].astype(np.float64).T @ dual for k in range(0, d, 512)])
    gram, right = ridge * np.eye(d), np.zeros((d, targets.shape[1]))
    for k in range(0, n, 512):
        part = x[k : k + 512].astype(np.float64) * weigh[k : k + 512, None]
        gram += part.T @ part
        right += part.T @ (targets[k : k + 512] * weigh[k : k + 512, None])
    return np.linalg.solve(gram, right)


def identify(docs: DataFrame, model: Model | None, carry: list[str] | None = None) -> DataFrame:
    """Adds (lang_pred string, score double, ambiguous boolean, loss double) to the columns of ``docs`` (or those in ``carry``),
    from whole texts alone. loss says how far the text is from the codeword: 0 at it, 1 where no bit says anything, more beyond.

    A null text, an empty one and one without a letter get ``und``, score 0, not ambiguous, loss 1; so does every text if there
    is no model. Repeated rows each get their row. Columns of these names that the input has are replaced. The model is
    buckets x bits numbers, sent with the tasks: 4096 x 7 for four languages. No shuffle.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous", "loss")
    docs = docs.select(*[c for c in docs.columns if c != "text" and (carry is None or c in carry)], "text")
    with_text = carry is None or "text" in carry
    at = len(docs.columns) - 1

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        lang, score, close, loss = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool), np.ones(n)
        texts = batch.column(at)
        for start in range(0, n, 512):
            rows, vectors = [], []
            for i in range(start, min(start + 512, n)):
                if model and (text := texts[i].as_py()) and (x := features(text)) is not None:
                    rows.append(i)
                    vectors.append(x)
            if rows:
                best, share, near, far = model.decode(np.stack(vectors))
                score[rows], close[rows], loss[rows] = share, near, far
                for i, k in zip(rows, best):
                    lang[i] = model.langs[k]
        return pa.RecordBatch.from_arrays([*batch.columns[: at + with_text], pa.array(lang, pa.string()), pa.array(score), pa.array(close), pa.array(loss)], names=[*batch.schema.names[: at + with_text], "lang_pred", "score", "ambiguous", "loss"])

    schema = StructType(docs.schema.fields[: at + with_text]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean").add("loss", "double")
    return arrow_map(docs, predict, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous and loss of every document; held-out documents teach nothing."""
    model = fit(docs.where(~is_held_out(F.col("doc_id"))))
    kept = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(kept, model, carry=["doc_id", "held_out"])
