"""Small models and sweeps over signals: ridge probes by folds, weights, calibration, predictions by chunks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_chunks(df: DataFrame, key: str, text: str, size: int, predict: Callable[[Column], Column]) -> DataFrame:
    """(key, chunks, mean): a prediction for each piece of ``size`` characters of a text, and their mean."""
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / size).cast("int"))
    chunks = df.select(key, F.explode(F.transform(starts, lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))).alias("_chunk"))
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.avg(predict(F.col("_chunk"))).alias("mean"))


def calibrated(df: DataFrame, column: str, mean: float, sd: float, out: str) -> DataFrame:
    """Adds the column moved to a mean and a deviation, cut to 0..1."""
    s = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    moved = mean + F.coalesce((F.col(column) - F.col("_m")) * sd / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(0.0))
    return df.join(F.broadcast(s)).withColumn(out, F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))).drop("_m", "_s")


def weight_sweep(df: DataFrame, first: str, second: str, wanted: str, weights: list[float]) -> DataFrame:
    """(w, agreement): the correlation with ``wanted`` of a blend with each weight of the second signal; a row without it has
    the first alone. One pass: a sum for each weight."""
    blend = lambda w: ((1 - w) * F.col(first) + F.coalesce(w * F.col(second), F.lit(0.0))) / ((1 - w) + F.when(F.col(second).isNotNull(), w).otherwise(0.0))
    row = df.agg(*[F.corr(blend(w), F.col(wanted)).alias(f"w{i}") for i, w in enumerate(weights)])
    pairs = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.col(f"w{i}").alias("agreement")) for i, w in enumerate(weights)])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def _moments(df: DataFrame, vector: str, target: str, fold: Column) -> dict[int, tuple[np.ndarray, np.ndarray, float, float, int]]:
    """For each fold (X'X, X'y, y'y, sum y, n) with a column of ones, summed where the rows are: a few numbers a fold come back."""

    def sums(batches):
        import pandas as pd

        made: dict = {}
        for rows in batches:
            for k, part in rows.groupby("fold"):
                x = np.column_stack([np.stack([np.asarray(v, float) for v in part["v"]]), np.ones(len(part))])
                y = part["y"].to_numpy(float)
                old = made.get(k)
                new = [x.T @ x, x.T @ y, float(y @ y), float(y.sum()), len(y)]
                made[k] = new if old is None else [a + b for a, b in zip(old, new)]
        for k, (xx, xy, yy, s, n) in made.items():
            yield pd.DataFrame({"fold": [k], "xx": [xx.ravel().tolist()], "xy": [xy.tolist()], "yy": [yy], "s": [s], "n": [n]})

    rows = df.where(F.col(vector).isNotNull() & F.col(target).isNotNull()).select(fold.alias("fold"), F.col(vector).alias("v"), F.col(target).cast("double").alias("y"))
    parts = rows.mapInPandas(sums, "fold int, xx array<double>, xy array<double>, yy double, s double, n long")
    add = lambda c: F.expr(f"aggregate(collect_list({c}), array_repeat(0D, size(first({c}))), (s, x) -> zip_with(s, x, (a, b) -> a + b))")
    whole = parts.groupBy("fold").agg(add("xx").alias("xx"), add("xy").alias("xy"), F.sum("yy").alias("yy"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = {}
    for r in whole.toLocalIterator():
        d = len(r["xy"])
        out[r["fold"]] = (np.array(r["xx"]).reshape(d, d), np.array(r["xy"]), r["yy"], r["s"], r["n"])
    return out


def ridge_by_folds(df: DataFrame, vector: str, target: str, fold: Column, strengths: list[float]) -> DataFrame:
    """(alpha, r2): of ridge regressions of each strength, fitted without a fold and scored on it, over all folds; an intercept
    isn't shrunk. Only sums of products, as wide as the vectors, reach the driver."""
    folds = _moments(df, vector, target, fold)
    rows = []
    for alpha in strengths:
        error = total = 0.0
        for k, (xx, xy, yy, s, n) in folds.items():
            others = [v for j, v in folds.items() if j != k]
            if not others:
                continue
            gram, right = sum(v[0] for v in others), sum(v[1] for v in others)
            shrink = alpha * np.eye(len(right))
            shrink[-1, -1] = 0
            w = np.linalg.solve(gram + shrink, right)
            error += yy - 2 * w @ xy + w @ xx @ w
            total += yy - s * s / n
        rows.append((float(alpha), round(float(1 - error / total), 6) if total else None))
    return df.sparkSession.createDataFrame(rows, "alpha double, r2 double")


Moments = tuple[np.ndarray, np.ndarray, float, float, int]


def _together(parts: list[Moments]) -> Moments:
    return tuple(sum(x) for x in zip(*parts))


def _ridge(moments: Moments, alpha: float) -> np.ndarray:
    shrink = alpha * np.eye(len(moments[1]))
    shrink[-1, -1] = 0
    return np.linalg.solve(moments[0] + shrink, moments[1])


def _r2(w: np.ndarray, moments: Moments) -> float:
    """Of predictions w'x on rows that the moments are of; nan where the target doesn't vary."""
    xx, xy, yy, s, n = moments
    total = yy - s * s / n
    return 1 - (yy - 2 * w @ xy + w @ xx @ w) / total if total > 1e-12 else float("nan")


def nested_ridge(df: DataFrame, vector: str, target: str, outer: Column, inner: Column, strengths: list[float]) -> DataFrame:
    """(fold, alpha, r2, rows) of ridge regressions by nested folds: for each outer fold the strength is chosen by the mean r2 over the
    inner folds of the other rows (ties: the first), the model is fitted to all of these and scored on the outer fold.

    outer and inner are numbers from 0, the inner one under 1,000. One pass over the rows: the sums of products of each (outer, inner)
    cell come to the driver, and all training sets, inner and outer, are sums of cells. Cells without rows and folds whose target
    doesn't vary are left out.
    """
    cells = {(k // 1000, k % 1000): v for k, v in _moments(df, vector, target, (outer * 1000 + inner).cast("int")).items()}
    rows = []
    for o in sorted({o for o, _ in cells}):
        train = {i: _together([v for (a, b), v in cells.items() if a != o and b == i]) for i in sorted({b for a, b in cells if a != o})}
        if not train:
            continue
        best, best_score = strengths[0], -np.inf
        for alpha in strengths:
            scores = [_r2(_ridge(_together([v for j, v in train.items() if j != i]), alpha), train[i]) for i in train if len(train) > 1]
            scores = [x for x in scores if x == x]
            if scores and np.mean(scores) > best_score + 1e-12:
                best, best_score = alpha, np.mean(scores)
        test = _together([v for (a, _), v in cells.items() if a == o])
        r2 = _r2(_ridge(_together(list(train.values())), best), test)
        if r2 == r2:
            rows.append((o, float(best), float(r2), int(test[4])))
    return df.sparkSession.createDataFrame(rows, "fold int, alpha double, r2 double, rows long")


def transferred(train: DataFrame, test: DataFrame, vector: str, target: str, alpha: float = 100.0, out: str = "predicted") -> tuple[DataFrame, float]:
    """The rows of ``test`` with the prediction of a ridge regression fitted to ``train``, another corpus with vectors of the same width,
    and its r2 there (nan without rows). The model is as many numbers as a vector has; rows without a vector get null."""
    fitted, scored = (_moments(x, vector, target, F.lit(0)) for x in (train, test))
    if not fitted:
        return test.withColumn(out, F.lit(None).cast("double")), float("nan")
    w = _ridge(fitted[0], alpha)
    dot = F.aggregate(F.zip_with(vector, F.lit(w[:-1].tolist()), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return test.withColumn(out, dot + float(w[-1])), _r2(w, scored[0]) if scored else float("nan")


def nonnegative(signals: np.ndarray, target: np.ndarray, floors: np.ndarray | None = None, rounds: int = 500) -> np.ndarray:
    """Weights of at least ``floors`` with the least squared error, by projected coordinate steps over sums of products:
    signals is the matrix of products of the signals, target that of the signals with the target."""
    w = np.zeros(len(target)) if floors is None else floors.astype(float).copy()
    low = np.zeros(len(target)) if floors is None else floors
    for _ in range(rounds):
        before = w.copy()
        for i in range(len(w)):
            w[i] = max(low[i], w[i] + (target[i] - signals[i] @ w) / max(signals[i, i], 1e-12))
        if np.abs(w - before).max() < 1e-12:
            break
    return w


def blend_weights(df: DataFrame, signals: list[str], target: str, floors: dict[str, float]) -> DataFrame:
    """(signal, weight) of the non-negative blend of signals nearest to a target, some with a least weight, scaled to a sum of
    one. One pass over the rows gives the sums of products."""
    pairs = [(a, b) for i, a in enumerate(signals) for b in signals[i:]]
    row = df.dropna(subset=[*signals, target]).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"_{a}_{b}") for a, b in pairs], *[F.sum(F.col(a) * F.col(target)).alias(f"_{a}") for a in signals]).first()
    gram = np.array([[row[f"_{a}_{b}"] if f"_{a}_{b}" in row else row[f"_{b}_{a}"] for b in signals] for a in signals], float)
    w = nonnegative(gram, np.array([row[f"_{a}"] for a in signals], float), np.array([floors.get(a, 0.0) for a in signals]))
    return df.sparkSession.createDataFrame([(a, float(x / (w.sum() or 1.0))) for a, x in zip(signals, w)], "signal string, weight double")
