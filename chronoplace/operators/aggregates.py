"""Aggregates, priority dedupe, set operations and histograms (AGG-*, SET-*, SNK-3, SNK-8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """Keeps the first row of each key in an explicit order (AGG-6, SNK-3, GRF-3, REL-14); ties must be ordered by the caller."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def union_all(*frames: DataFrame) -> DataFrame:
    """SET-1: union of frames with different columns; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """AGG-13: keys that stand in more than one row, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def min_hop(membership: DataFrame) -> DataFrame:
    """AGG-1."""
    return membership.groupBy("page_id").agg(F.min("hop").alias("min_hop"))


def hop_histogram(membership: DataFrame) -> DataFrame:
    """AGG-2: rows and distinct pages of each hop."""
    return membership.groupBy("hop").agg(F.count("*").alias("n_rows"), F.count_distinct("page_id").alias("n_pages"))


def hop_categories(membership: DataFrame) -> DataFrame:
    """SNK-8: the sorted categories of each hop."""
    return membership.select("hop", "category").distinct().groupBy("hop").agg(F.sort_array(F.collect_list("category")).alias("categories"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """AGG-11: rows of each value."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-11: filled values of each column, and their share in per cent, in one aggregate."""
    counts = df.agg(F.count("*").alias("__all"), *(F.count(c).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in columns))
    return counts.select("__all", F.inline(pairs)).select("column_name", "filled", F.round(F.try_divide(F.col("filled") * 100.0, F.col("__all")), 4).alias("percent"))


def merge_metadata(rows: DataFrame, key: str, seq: str, single: list[str], lists: list[str]) -> DataFrame:
    """AGG-5: the first value that isn't null of each column in ingest order, and distinct values of list columns in order."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in single]
    kept = [_in_order(seq, c) for c in lists]
    return rows.groupBy(key).agg(*firsts, *kept)


def _in_order(seq: str, column: str) -> Column:
    pairs = F.sort_array(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(column).alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda x: x["v"])).alias(column)


def largest_population(matches: DataFrame, title: str = "title_key") -> DataFrame:
    """AGG-9: if every candidate of a title is exact_name, only those of the largest population stay (ties stay)."""
    by = Window.partitionBy(title)
    marked = matches.withColumn("__exact", F.min(F.col("match_type") == "exact_name").over(by)).withColumn("__most", F.max("population").over(by))
    return marked.filter(~F.col("__exact") | (F.col("population") == F.col("__most"))).drop("__exact", "__most")


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """SET-3, JOI-16, SNK-4, SNK-7: what is still to be done; key-based resume."""
    return wanted.join(have.select(key), key, "left_anti")
