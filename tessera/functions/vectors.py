"""Vector arithmetic on ARRAY<DOUBLE> columns (higher-order functions).

Rule followed by every function here: a lambda body refers only to its own
lambda variables, never to an outer column.  The optimizer may inline an
earlier projection into the place a column is used; inside a lambda that
expression would be re-evaluated once per element (multiplicatively when
lambdas nest).  Outer values therefore enter as arguments -- through
``arrays_zip`` or ``array_repeat`` -- which are evaluated once per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed numerical guards (same as the reference's formulas)
NORM_EPS = 1e-12
MASS_EPS = 1e-9


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def _rep(s, like) -> Column:
    s = _c(s) if isinstance(s, (str, Column)) else F.lit(s)
    return F.array_repeat(s, F.size(_c(like)))


def scale(a, s) -> Column:
    return F.zip_with(_c(a), _rep(s, a), lambda x, y: x * y)


def divide(a, s) -> Column:
    return F.zip_with(_c(a), _rep(s, a), lambda x, y: x / y)


def finite(a) -> Column:
    """NaN and +-inf -> 0."""
    return F.transform(_c(a), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0)
                       .otherwise(x))


def to_double(a) -> Column:
    return _c(a).cast("array<double>")


def cosine(a, b) -> Column:
    """dot / (|a| * |b| + 1e-12)."""
    return dot(a, b) / (norm(a) * norm(b) + NORM_EPS)


def _zeros_like_first(tokens, value: float = 0.0) -> Column:
    return F.array_repeat(F.lit(value), F.size(F.element_at(_c(tokens), 1)))


def weighted_sum(tokens, weights) -> Column:
    """Per-dimension sum of token vectors weighted by a numeric array."""
    pairs = F.arrays_zip(_c(tokens).alias("t"), _c(weights).cast("array<double>").alias("w"))
    return F.aggregate(pairs, _zeros_like_first(tokens),
                       lambda acc, s: F.zip_with(acc, s["t"], lambda a, x: a + x * s["w"]))


def masked_sum(tokens, mask) -> Column:
    """Per-dimension sum of tokens weighted by mask (0/1)."""
    return weighted_sum(tokens, mask)


def masked_max(tokens, mask) -> Column:
    """Per-dimension max over tokens with mask 1 (-inf when none)."""
    pairs = F.arrays_zip(_c(tokens).alias("t"), _c(mask).alias("m"))
    return F.aggregate(
        pairs, _zeros_like_first(tokens, float("-inf")),
        lambda acc, s: F.when(s["m"] == 1, F.zip_with(acc, s["t"], lambda a, x: F.greatest(a, x)))
        .otherwise(acc))


def dots(vec, mats) -> Column:
    """[vec . b for b in mats] (mats: ARRAY<ARRAY<DOUBLE>>)."""
    return F.zip_with(_c(mats), F.array_repeat(_c(vec), F.size(_c(mats))),
                      lambda b, x: dot(x, b))
