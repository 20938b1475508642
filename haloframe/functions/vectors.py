"""Scalar, vector and array expressions as Columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def lj_coefficient(r2: Column, eps: float, sig: float) -> Column:
    """The factor of a displacement in the Lennard-Jones pair force; distances are at least ``sig``."""
    near = F.lit(1.0) / F.greatest(r2, F.lit(sig * sig))
    sixth = near * near * near
    return -(sixth * (F.lit(48.0 * eps * sig**12) * sixth - F.lit(24.0 * eps * sig**6)) * near)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    return F.transform(a, lambda x: F.try_divide(x, norm(a)))


def almost_equal(a: Column, b: Column, eps: float) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= eps), lambda ok: ok)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, b: Column) -> Column:
    """Element by element."""
    return F.zip_with(a, b, lambda x, y: x * y)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def divided(a: Column, by: Column) -> Column:
    """Null elements where ``by`` is 0."""
    return F.transform(a, lambda x: F.try_divide(x, by))


def absolute(a: Column) -> Column:
    return F.transform(a, lambda x: F.abs(x))


def all_at_most(a: Column, b: Column) -> Column:
    """Whether every element of ``a`` is at most that of ``b``."""
    return F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda ok: ok)


def mean(values: Column) -> Column:
    """0 for none."""
    return F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values)), F.lit(0.0))


def argmin(values: Column, key=lambda x: x) -> Column:
    """The place, counted from 0, of the first element of least ``key``; null for none."""
    keys = F.transform(values, key)
    return F.nullif(F.array_position(keys, F.array_min(keys)), F.lit(0).cast("bigint")) - 1


def narrowed(value: Column) -> Column:
    """A double as a single-precision number, infinities as the largest ones."""
    most = F.lit(3.4028234663852886e38)
    return F.when(value == float("inf"), most).when(value == float("-inf"), -most).otherwise(value).cast("float")


def select_if(condition: Column, a: Column, b: Column) -> Column:
    return F.when(condition, a).otherwise(b)


def zipped(a: Column, b: Column) -> Column:
    """Pairs ``a, b`` as long as the first array; a shorter second one is padded with nulls."""
    return F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, F.size(a))


def in_three(x: Column, y: Column, z: Column | None = None) -> Column:
    """Coordinates as an array of three, a missing one 0."""
    return F.array(x, y, F.coalesce(z, F.lit(0.0)) if z is not None else F.lit(0.0))


def formatted(values: list[Column], separator: str = ",", precision: int = 6) -> Column:
    """A line of numbers with so many digits behind the point."""
    return F.concat_ws(separator, *[F.format_string(f"%.{precision}f", v) for v in values])


def quadratic_roots(a: Column, b: Column, c: Column) -> Column:
    """Both real roots, the one with the positive square root first; empty if there are none.

    With ``a`` = 0 the one root of the line, or none if ``b`` is 0 too.  No root is a difference of
    nearly equal numbers, so a small ``a`` costs no digits.
    """
    delta = b * b - 4 * a * c
    root = F.sqrt(F.greatest(delta, F.lit(0.0)))
    first = F.when(b > 0, 2 * c / (-b - root)).otherwise((-b + root) / (2 * a))
    second = F.when(b < 0, 2 * c / (-b + root)).otherwise((-b - root) / (2 * a))
    none = F.array().cast("array<double>")
    line = F.when(b != 0, F.array(-c / b)).otherwise(none)
    return F.when(a == 0, line).when(delta >= 0, F.array(first, second)).otherwise(none)


@F.arrow_udf(ArrayType(DoubleType()))
def _running(values: pa.Array, init: pa.Array) -> pa.Array:
    """All lists of one length are added up at once; sums of one list never reach another."""
    none = np.asarray(values.is_null())
    sizes = values.value_lengths().fill_null(0).to_numpy()
    flat, starts = values.flatten(), np.cumsum(sizes) - sizes
    known, gone = flat.fill_null(0.0).to_numpy(), np.asarray(flat.is_null())
    first, lost = init.fill_null(0.0).to_numpy(), np.asarray(init.is_null())
    ends = np.concatenate([[0], np.cumsum(np.where(none, 0, sizes + 1))])
    sums, masks = np.empty(ends[-1]), np.empty(ends[-1], bool)
    for size in np.unique(sizes):
        rows = np.flatnonzero((sizes == size) & ~none)
        own, at = starts[rows, None] + np.arange(size), ends[rows, None] + np.arange(size + 1)
        sums[at] = np.cumsum(np.column_stack([first[rows], known[own]]), axis=1)
        masks[at] = np.logical_or.accumulate(np.column_stack([lost[rows], gone[own]]), axis=1)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sums, mask=masks), mask=pa.array(none))


def scan_left(values: Column, init: Column) -> Column:
    """Running sums in one pass, the initial value first; null from the first null on."""
    return _running(values.cast("array<double>"), init.cast("double"))


def slice_to(values: Column, start: int, end: int) -> Column:
    """Elements from ``start`` to ``end``, both counted from 0 and included, cut at the array's end."""
    return F.slice(values, start + 1, F.greatest(F.least(F.lit(end + 1), F.size(values)) - start, F.lit(0)))


def upper_median(values: Column) -> Column:
    """The element in the middle of the sorted values, the upper one of two; 0 for none."""
    return F.coalesce(F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")), F.lit(0.0))
