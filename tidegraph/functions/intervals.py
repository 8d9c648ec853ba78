"""Interval predicates. A missing lower bound reaches back for ever, a missing upper one forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .times import instant


def _not_after(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a <= b)


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """The closed intervals have an instant in common."""
    return _not_after(a_from, b_to) & _not_after(b_from, a_to)


def contains_interval(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """The closed interval ``b`` lies within the closed interval ``a``."""
    lower = a_from.isNull() | (b_from.isNotNull() & (a_from <= b_from))
    upper = a_to.isNull() | (b_to.isNotNull() & (b_to <= a_to))
    return F.coalesce(lower & upper, F.lit(False))


def contains_instant(a_from: Column, a_to: Column, t) -> Column:
    """from <= t <= to."""
    t = instant(t)
    return (a_from.isNull() | (a_from <= t)) & (a_to.isNull() | (t <= a_to))


def half_open_contains(a_from: Column, a_to: Column, t) -> Column:
    """from <= t < to."""
    t = instant(t)
    return (a_from.isNull() | (a_from <= t)) & (a_to.isNull() | (t < a_to))


def left_open_contains(a_from: Column, a_to: Column, t) -> Column:
    """from < t <= to."""
    t = instant(t)
    return (a_from.isNull() | (a_from < t)) & (a_to.isNull() | (t <= a_to))


def touches(a_from: Column, a_to: Column, start=None, stop=None) -> Column:
    """Closed overlap with a constant interval, as bare comparisons that a file scan can use."""
    keep = F.lit(True)
    if stop is not None:
        keep = keep & (a_from <= instant(stop))
    if start is not None:
        keep = keep & (a_to.isNull() | (a_to >= instant(start)))
    return keep


def within(ts: Column, start=None, stop=None) -> Column:
    """start <= ts <= stop; either bound may be missing."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (ts >= instant(start))
    if stop is not None:
        keep = keep & (ts <= instant(stop))
    return keep


def normalise_interval(df: DataFrame, start: str = "valid_from", stop: str = "valid_to") -> DataFrame:
    """Swap the ends of intervals that run backwards; open ends stay open."""
    backwards = F.col(stop) < F.col(start)
    lower = F.when(backwards, F.col(stop)).otherwise(F.col(start))
    upper = F.when(backwards, F.col(start)).otherwise(F.col(stop))
    return df.withColumns({start: lower, stop: upper})
