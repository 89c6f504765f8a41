"""Column expressions on k-dimensional points. Dimensions are scalar double columns, so predicates reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(dims: Sequence[str]) -> Column:
    """No dimension is null, NaN or infinite."""
    return reduce(and_, [F.col(d).isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf")) for d in dims])


def check_box(dims: Sequence[str], lo: Sequence[float], hi: Sequence[float]) -> None:
    if not len(dims) == len(lo) == len(hi):
        raise ValueError(f"a box over {len(dims)} dimensions has {len(lo)} lower and {len(hi)} upper bounds")
    if any(a > b for a, b in zip(lo, hi, strict=True)):
        raise ValueError("a lower bound exceeds its upper bound")


def in_box(dims: Sequence[str], lo: Sequence, hi: Sequence) -> Column:
    """Closed box; bounds are numbers or columns."""
    return reduce(and_, [F.col(d).between(a, b) for d, a, b in zip(dims, lo, hi, strict=True)])


def boxes_touch(lo1: Sequence[Column], hi1: Sequence[Column], lo2: Sequence[Column], hi2: Sequence[Column]) -> Column:
    """Closed boxes overlap; touching counts."""
    return reduce(and_, [(a <= d) & (b >= c) for a, b, c, d in zip(lo1, hi1, lo2, hi2, strict=True)])


def near_point(dims: Sequence[str], point: Sequence[float], rtol: float = 0.0, atol: float = 0.0) -> Column:
    """Equality per dimension, or with tolerances |x - p| <= atol + rtol * |p|."""
    if not (rtol or atol):
        return reduce(and_, [F.col(d) == F.lit(float(p)) for d, p in zip(dims, point, strict=True)])
    return reduce(and_, [F.abs(F.col(d) - float(p)) <= atol + rtol * abs(float(p)) for d, p in zip(dims, point, strict=True)])


def euclidean(dims: Sequence[str], point: Sequence) -> Column:
    """Distance to a point of numbers or columns; terms are added in order of dims."""
    return F.sqrt(reduce(add, [(F.col(d) - p) * (F.col(d) - p) for d, p in zip(dims, point, strict=True)]))


def array_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def min_max(column: str, lo: Column, hi: Column) -> Column:
    """Scaled to [0, 1]; a constant column becomes 0."""
    return F.when(hi == lo, F.lit(0.0)).otherwise((F.col(column) - lo) / (hi - lo))


def volume(lo: Sequence[Column], hi: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x * y, [b - a for a, b in zip(lo, hi, strict=True)])
