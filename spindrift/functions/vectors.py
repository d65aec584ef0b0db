"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is zero."""
    return F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def half(values: Sequence[float]) -> list[float]:
    """Values after a round trip through 16-bit floats."""
    return np.asarray(values, dtype=np.float16).astype(np.float64).tolist()


def to_half(v: Column) -> Column:
    """``half`` on a column: 11 significant bits, subnormals below 2^-14, ties to even."""
    x = as_double(v)

    def one(a: Column) -> Column:
        exponent = F.greatest(F.floor(F.log2(F.abs(a))), F.lit(-14)).cast("double")
        step = F.pow(F.lit(2.0), exponent - 10)
        return F.when(a == 0, a).otherwise(F.rint(a / step) * step)

    return F.transform(x, one)


def literal(values: Sequence[float], places: int = 6) -> str:
    """A vector as text with so many significant digits, as a bulk load writes it."""
    return "[" + ",".join(f"{v:.{places}g}" for v in values) + "]"
