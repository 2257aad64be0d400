"""Vector columns (ARRAY<FLOAT> or ARRAY<DOUBLE>), computed in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision; the cosine when both are unit length."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v: Column) -> Column:
    """Unit-length copy as ARRAY<FLOAT>; the zero vector stays zero."""
    length = norm(v)
    unit = F.transform(v, lambda x: x.cast("double") / length)
    return F.when(length > 0, unit).otherwise(v.cast("array<double>")).cast("array<float>")


def unit_interval_score(score: Column) -> Column:
    """Cosine mapped to [0, 1]: the same order, the scale many search engines report."""
    return (F.lit(1.0) + score) / F.lit(2.0)


def components(v: Column) -> Column:
    """Generator for (dim, val) rows of a vector."""
    return F.posexplode(v)
