"""Vectors as arrays of doubles."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once for a row, however often ``f`` uses it within lambdas."""
    return F.get(F.transform(F.array(value), f), 0)


def unit(a: Column) -> Column:
    """Of unit length; a zero vector stays."""
    return let(F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0)), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def half_up(cos: Column) -> Column:
    """A cosine as a share from 0 to 1."""
    return (cos + 1) / 2


def stable(score: Column) -> Column:
    """Scores to six places, halves to even, so that equal ones tie on every machine."""
    return F.rint(score * 1e6) / 1e6
