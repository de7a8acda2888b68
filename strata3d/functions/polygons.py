"""Arrow functions over single polygons or pairs, for what has no closed form.

Callers filter with exact native expressions first, so only rows that truly need a sweep
reach Python; a NULL input row needs none. Polygons go over as one flat array of doubles
(`shapes.packed`), which numpy reads without a Python object per point.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PARTS_TYPE
from .planar import (corridor, dissolved, eroded_parts_outside, eroded_touch, parts_of, rings_of,
                     sweep, valid)
from .shapes import packed


def _each(fn, *cols):
    return pd.Series([None if any(v is None for v in row) else fn(*row)
                      for row in zip(*cols)], dtype=object)


@F.pandas_udf(T.DoubleType())
def _area_outside(child: pd.Series, parent: pd.Series, tol: pd.Series) -> pd.Series:
    return _each(eroded_parts_outside, child, parent, tol).astype("float64")


@F.pandas_udf(PARTS_TYPE)
def _outside(child: pd.Series, parent: pd.Series, tol: pd.Series) -> pd.Series:
    return _each(lambda c, p, t: eroded_parts_outside(c, p, t, collect=True), child, parent, tol)


@F.pandas_udf(PARTS_TYPE)
def _joined(parts: pd.Series) -> pd.Series:
    return _each(lambda p: parts_of(dissolved(p)), parts)


@F.pandas_udf(T.BooleanType())
def _still_touch(a: pd.Series, b: pd.Series, tol: pd.Series) -> pd.Series:
    return _each(eroded_touch, a, b, tol)


@F.pandas_udf(T.BooleanType())
def _is_valid(parts: pd.Series) -> pd.Series:
    return _each(valid, parts)


@F.pandas_udf(PARTS_TYPE)
def _intersection(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(lambda p, q: sweep([rings_of(p), rings_of(q)], [], collect=True), a, b)


@F.pandas_udf(PARTS_TYPE)
def _difference(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(lambda p, q: sweep([rings_of(p)], [rings_of(q)], collect=True), a, b)


@F.pandas_udf(PARTS_TYPE)
def _repair(parts: pd.Series) -> pd.Series:
    return _each(lambda p: sweep([rings_of(p)], [], collect=True), parts)


@F.pandas_udf(PARTS_TYPE)
def _flat_corridor(path: pd.Series, width: pd.Series) -> pd.Series:
    return _each(lambda p, w: corridor(p, w / 2.0), path, width)


def area_outside(child: Column, parent: Column, tol: Column) -> Column:
    """Area of `child`, eroded by `tol` (whole if that empties it), outside `parent`."""
    return _area_outside(packed(child), packed(parent), tol)


def outside(child: Column, parent: Column, tol: Column) -> Column:
    """What `area_outside` measures, as a polygon."""
    return _outside(packed(child), packed(parent), tol)


def joined(parts: Column) -> Column:
    """Parts that touch or overlap made one."""
    return _joined(packed(parts))


def still_touch(a: Column, b: Column, tol: Column) -> Column:
    """Whether both, each eroded by `tol` (whole if emptied), still meet."""
    return _still_touch(packed(a), packed(b), tol)


def is_valid(parts: Column) -> Column:
    return _is_valid(packed(parts))


def intersection(a: Column, b: Column) -> Column:
    return _intersection(packed(a), packed(b))


def difference(a: Column, b: Column) -> Column:
    return _difference(packed(a), packed(b))


def repair(parts: Column) -> Column:
    """Even-odd reading of a broken polygon, as a valid one."""
    return _repair(packed(parts))


def flat_corridor(path: Column, width: Column) -> Column:
    """Flat-ended band of the given width along a line of points."""
    return _flat_corridor(F.flatten(F.transform(path, lambda p: F.array(p["x"], p["y"]))), width)
