"""Small numeric columns and dense-vector arithmetic on array columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_round_amount(amount: Column) -> Column:
    return (amount % 1 == 0).cast("int")


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null when either norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_error(x: Column, y: Column) -> Column:
    diffs = F.zip_with(x, y, lambda a, b: a.cast("double") - b.cast("double"))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, d: acc + d * d)


def norm_risk(x: Column, xhat: Column) -> Column:
    """Reconstruction distance over 5, clipped."""
    return clip01(F.sqrt(squared_error(x, xhat)) / 5.0)


def mse_risk(x: Column, xhat: Column) -> Column:
    """Ten times the mean squared error, at most 1."""
    return F.least(F.lit(1.0), F.lit(10.0) * squared_error(x, xhat) / F.size(x))


def pair_features(a: Column, b: Column) -> Column:
    """``[a, b, |a - b|]`` as one array."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def anomaly_risk(raw: Column) -> Column:
    return clip01(F.lit(1.0) - (raw + 0.5) / 2.0)
