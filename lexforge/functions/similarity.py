"""Edit distance and vector similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a correction must be more similar than this, in 32-bit arithmetic.
GATE = 0.3


def distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; 0 if either is null or empty."""
    return F.when(F.coalesce(F.length(a), F.lit(0)) * F.coalesce(F.length(b), F.lit(0)) == 0, 0).otherwise(F.levenshtein(a, b))


def normalized_distance(a: Column, b: Column) -> Column:
    """Distance over the longer length, NaN if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(float("nan"))).otherwise(F.try_divide(distance(a, b).cast("double"), longest)).cast("float")


def similarity(a: Column, b: Column) -> Column:
    """1 - normalized distance as FLOAT."""
    return F.lit(1.0).cast("float") - normalized_distance(a, b)


def similar_enough(a: Column, b: Column) -> Column:
    return similarity(a, b) > F.lit(GATE).cast("float")


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _ratio(top: Column, a: Column, b: Column) -> Column:
    low = _norm(a) * _norm(b)
    return F.when(low == 0, F.lit(float("nan"))).otherwise(F.try_divide(top, low))


def _products(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") * y.cast("double")))


def abs_cosine(a: Column, b: Column) -> Column:
    """Cosine of the absolute values, NaN for a zero vector; the similarity of columns."""
    return _ratio(F.aggregate(_products(a, b), F.lit(0.0), lambda s, x: s + x), a, b)


def max_product(a: Column, b: Column) -> Column:
    """Largest absolute product over both norms, NaN for a zero vector; the similarity of rows."""
    return _ratio(F.array_max(_products(a, b)), a, b)
