"""Values made fit for a response or a table (PRJ-3, PRJ-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """A finite number, or null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def whole(value: Column) -> Column:
    """An integer, or null; fractions are cut."""
    return finite(value).cast("long")


def shown(value: Column, default: str | None = "") -> Column:
    """Text, or a default for null."""
    return F.coalesce(value.cast("string"), F.lit(default))


def listed(values: Column, default: str | None = "") -> Column:
    """A list as text, comma-joined; nulls in it are left out."""
    return F.coalesce(F.array_join(values.cast("array<string>"), ", "), F.lit(default))


def storable(df: DataFrame) -> DataFrame:
    """Every column as a plain value: lists and structs as JSON, truth values as 0 and 1, NaN and infinities as null."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind.startswith(("array", "struct", "map")):
            column = F.to_json(column)
        elif kind == "boolean":
            column = column.cast("int")
        elif kind in ("double", "float"):
            column = F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)
        out.append(column.alias(name))
    return df.select(out)
