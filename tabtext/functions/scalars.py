"""Scalar and array functions (FUN-1..6, 9..12, TOP-4).

Each returns a ``Column`` built from Spark built-ins so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(scores) -> Column:
    """FUN-1: numerically stable softmax of an ``array<double>``."""
    a = _col(scores)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def logit(p) -> Column:
    """FUN-2: ``ln(p / (1 - p))``; NULL at p = 0 or 1 instead of an ANSI error."""
    p = _col(p)
    return F.when((p > 0) & (p < 1), F.log(p / (F.lit(1.0) - p)))


def logit_array(ps) -> Column:
    return F.transform(_col(ps), lambda p: F.when((p > 0) & (p < 1), F.log(p / (F.lit(1.0) - p))))


def sign(x) -> Column:
    """FUN-3: sign as an integer (collapses codes >= 1 to 1)."""
    return F.signum(_col(x)).cast("int")


def absolute(x) -> Column:
    """FUN-4."""
    return F.abs(_col(x))


def square_root(x) -> Column:
    """FUN-5."""
    return F.sqrt(_col(x))


def reciprocal(x) -> Column:
    """FUN-6: ``1 / x``; NULL at 0."""
    return F.try_divide(F.lit(1.0), _col(x).cast("double"))


def int_range(lo, hi) -> Column:
    """FUN-9: ``[lo, hi]`` as an array of integers (empty when hi < lo)."""
    lo, hi = _col(lo), _col(hi)
    # sequence(lo, lo) filtered empty keeps the element type of lo/hi
    return F.filter(F.sequence(lo, F.greatest(lo, hi)), lambda x: x <= hi)


def squared_error(pred, label) -> Column:
    """FUN-10."""
    d = _col(pred).cast("double") - _col(label).cast("double")
    return d * d


def as_double(x) -> Column:
    """FUN-11."""
    return _col(x).cast("double")


def run_step(run) -> Column:
    """FUN-12: integer suffix of ``name-<n>``."""
    return F.element_at(F.split(_col(run), "-"), -1).cast("int")


def argmax(scores) -> Column:
    """TOP-4: 0-based index of the first maximum of an array."""
    a = _col(scores)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
