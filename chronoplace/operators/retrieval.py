"""Entity branch and scope filters (REL-3, FLT-7 to FLT-11, JOI-4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplace.functions.text import category_score, parse_place, quoted
from chronoplace.operators.aggregates import first_by


def location_match(city: str) -> Column:
    """FLT-7."""
    value, city = F.lower(F.coalesce("location", F.lit(""))), city.lower()
    return (value == city) | value.like(f"{city} %") | value.like(f"% {city}") | value.like(f"% {city},%")


def category_match(terms: list[str]) -> Column:
    """FLT-8."""
    # Where a term may stand in a category.
    value = F.lower(F.translate("category", "_()", "   "))
    one = lambda t: (value == t) | value.like(f"{t} %") | value.like(f"% {t}") | value.like(f"% {t} %") | value.like(f"% {t},%")
    return reduce(lambda a, b: a | b, (one(t.lower()) for t in terms))


def entity_candidates(articles: DataFrame, categories: DataFrame, place: str) -> DataFrame:
    """REL-3: page_id and its best category_score, from location metadata and categories. Categories are cut before the join."""
    parts = parse_place(place)
    if not parts:
        return articles.select("page_id", F.lit(0.0).alias("category_score")).limit(0)
    pages = articles.filter("not is_redirect")
    placed = pages.filter(location_match(parts[0])).select("page_id", F.lit(0.0).alias("category_score"))
    named = categories.filter(category_match(parts)).select("page_id", category_score(F.col("category"), parts[0].lower(), [p.lower() for p in parts[1:]]).alias("category_score"))
    return first_by(placed.unionByName(named.join(pages.select("page_id"), "page_id", "left_semi")), "page_id", F.desc("category_score"))


def country_match(country: str | None) -> Column:
    """FLT-9: a label, or one in a list-shaped string; without a country everything matches."""
    if not country or not country.strip():
        return F.lit(True)
    name = country.strip().lower()
    # The shape of a label in a list that is written as text.
    value = F.trim(F.lower(F.coalesce("country", F.lit(""))))
    return (value == name) | value.rlike(rf"(?:^|[\[\],;|])\s*['\"]?{quoted(name)}['\"]?\s*(?:$|[\],;|])")


def country_pages(articles: DataFrame, country: str) -> DataFrame:
    """FLT-10: the strict form that scopes dense retrieval."""
    return articles.filter("not is_redirect").filter(F.lower(F.trim(F.coalesce("country", F.lit("")))) == country.strip().lower()).select("page_id")


def restrict_to_graph(df: DataFrame, graph: DataFrame) -> DataFrame:
    """FLT-11: an empty graph leaves nothing."""
    return df.join(graph.select("page_id"), "page_id", "left_semi")


def match_reason() -> Column:
    """PRJ-2."""
    # The reasons as they are shown.
    return (
        F.when(F.col("exact_title_match"), "City in title")
        .when(F.col("lead_exact_match"), "City in introduction")
        .when(F.col("entity_associated"), "City in location metadata")
        .when(F.col("result_source") == "coordinates", "Mapped nearby")
        .otherwise("City mentioned in article")
    )
