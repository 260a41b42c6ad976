"""Integrity rules that a build asserts (survey 1.3): one aggregate each, raising on failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplace.operators.aggregates import duplicates


def assert_unique(df: DataFrame, key: str, name: str = "table") -> None:
    """AGG-13: raises with up to ten repeated keys."""
    twice = [r[0] for r in duplicates(df, key).orderBy(key).limit(10).collect()]
    if twice:
        raise ValueError(f"{name}: {key} repeats, for example {twice}")


def assert_same_count(a: DataFrame, b: DataFrame, name: str = "copy") -> None:
    """SNK-2, AGG-12: a written table holds as many rows as its source."""
    if (x := a.count()) != (y := b.count()):
        raise ValueError(f"{name}: {x} rows against {y}")


def assert_dimension(df: DataFrame, column: str, size: int | None = None) -> int:
    """SRC-21: every vector has one length."""
    low, high = df.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high or (size is not None and low not in (None, size)):
        raise ValueError(f"{column}: lengths from {low} to {high}, wanted {size}")
    return low


def assert_range(name: str, value: float, low: float, high: float, open_low: bool = False) -> None:
    """API-1's argument rules."""
    if value > high or value < low or (open_low and value == low):
        raise ValueError(f"{name} must be from {low} to {high}")
