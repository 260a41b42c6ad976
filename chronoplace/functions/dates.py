"""Dates stay text: years may be negative and values partial (DAT-*, FLT-4, SRT-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplace.schemas import DATES

FIRST_YEAR, LAST_YEAR = -5000, 2025


def clean_date(value: Column) -> Column:
    """DAT-1: without leading plus signs and time of day; empty is null."""
    return F.nullif(F.split(F.regexp_replace(value, "^[+]+", ""), "T")[0], F.lit(""))


def canonical_date(*columns: str) -> Column:
    """DAT-2: the first that isn't empty, in the fixed order of kinds."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns or DATES))


def signed_year(value: Column) -> Column:
    """DAT-3: the year with its sign; null where it can't be read."""
    return F.regexp_extract(F.trim(value), r"^(-?\d+)(?:-|$)", 1).try_cast("int")


def year_window(df: DataFrame, column: str = "year") -> DataFrame:
    """FLT-4: unknown years stay."""
    return df.filter(F.col(column).isNull() | F.col(column).between(FIRST_YEAR, LAST_YEAR))


def timeline(df: DataFrame) -> DataFrame:
    """SRT-4: dated rows by year, then page."""
    return df.filter("year is not null").orderBy("year", "page_id")
