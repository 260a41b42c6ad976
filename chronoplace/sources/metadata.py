"""Structured metadata and the gazetteer as inputs (SRC-15, SRC-16, PRJ-5, AGG-5). No network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplace.functions.dates import clean_date
from chronoplace.operators.aggregates import merge_metadata
from chronoplace.schemas import DATES

#: Least populations a gazetteer may be cut at.
TIERS = (500, 1000, 5000, 15000)
PLAIN = ("wikidata_id", "occupation", "country", "citizenship", "location", "instance_of")


def bindings(rows: DataFrame, column: str = "binding") -> DataFrame:
    """PRJ-5: JSON bindings {name: {"value": ...}} as typed columns, with seq for the order they came in."""
    names = ("title", "lat", "lon", *DATES, *PLAIN)
    parsed = F.from_json(column, "struct<" + ",".join(f"{n}:struct<value:string>" for n in names) + ">")
    value = lambda n: F.col("__b").getField(n).getField("value")
    out = rows.withColumn("__b", parsed)
    return out.select("seq", value("title").alias("title"), *(value(n).try_cast("double").alias(n) for n in ("lat", "lon")), *(clean_date(value(n)).alias(n) for n in DATES), *(value(n).alias(n) for n in PLAIN))


def merged(rows: DataFrame) -> DataFrame:
    """AGG-5: one row for each title."""
    return merge_metadata(rows, "title", "seq", ["lat", "lon", *DATES, *PLAIN[:-1]], ["instance_of"])


def gazetteer(cities: DataFrame, least: int = 15000, most: int | None = None) -> DataFrame:
    """SRC-16: cities from a population tier up, the `most` largest if given."""
    if least not in TIERS:
        raise ValueError(f"least must be one of {TIERS}")
    rows = cities.filter(F.col("population") >= least)
    return rows.orderBy(F.desc("population"), "geoname_id").limit(most) if most else rows
