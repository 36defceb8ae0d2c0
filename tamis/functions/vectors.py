"""Vector functions on array columns, computed in double precision in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def to_int8(v: Column) -> Column:
    """127 levels on each side, half to even."""
    return F.transform(_double(v), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x * 127))).cast("tinyint"))


def from_int8(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 127)
