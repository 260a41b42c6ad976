"""Features, rank fusion, scoring, reranking and the final cut (REL-7 to REL-15, NUM-*, TOP-4, TOP-5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplace.functions.geo import proximity
from chronoplace.functions.text import parse_list
from chronoplace.operators.aggregates import first_by, union_all
from chronoplace.shared import materialise

# Weights and thresholds of ranking.
RRF_K = 60
RRF_WEIGHTS = {"bm25_strict": 4.0, "bm25_relaxed": 1.0, "kalm": 1.0, "category": 5.0, "graph": 0.0}
SCORE_WEIGHTS = {"geographic": 0.5, "hop": 2.0, "quality": 1.0, "importance": 1.0, "category": 4.0, "graph": 0.0}
RRF_SCALE = 100.0
IMPORTANCE_WEIGHT, IMPORTANCE_POPULATION = 1.5, 200_000
RERANK_ROWS, RERANK_WEIGHT = 50, 5.0
SOURCES = ("coordinates", "bm25", "dense", "category", "graph")
# Fields that a class of entity should have, and their weights.
PROFILES = {
    "person": {"wikidata_id": 1.0, "instance_of": 1.0, "occupation": 1.0, "birth_date": 0.6, "death_date": 0.6, "country": 0.4},
    "place": {"wikidata_id": 1.0, "instance_of": 1.0, "country": 0.7, "location": 0.7, "lat": 0.5, "lon": 0.5, "inception": 0.4},
    "event": {"wikidata_id": 1.0, "instance_of": 1.0, "country": 0.4, "location": 0.4, "start_time": 0.6, "end_time": 0.6, "point_in_time": 0.6},
    "work": {"wikidata_id": 1.0, "instance_of": 1.0, "country": 0.4, "inception": 0.6},
    "other": {"wikidata_id": 1.0, "instance_of": 1.0, "country": 0.4, "location": 0.4, "inception": 0.4, "point_in_time": 0.4},
}
# Type names of each class, in order of precedence.
CLASSES = {
    "person": ("human", "person", "fictional human", "fictional character"),
    "event": ("battle", "war", "revolution", "historical event", "event", "armed conflict", "conflict", "election", "treaty", "massacre", "siege", "incident", "protest", "rebellion", "uprising"),
    "place": (
        "city", "municipality", "town", "village", "country", "state", "region", "archaeological site", "building", "church", "castle", "fort", "monument", "museum",
        "archaeological museum", "art museum", "history museum", "library", "archive", "hospital", "psychiatric hospital", "factory", "assembly plant", "airport", "airfield",
        "lake", "reservoir", "island", "park", "synagogue", "mosque", "temple", "tekke", "university",
    ),
    "work": ("book", "novel", "film", "painting", "newspaper", "journal", "magazine", "song", "album", "artwork", "document", "periodical", "underground press"),
    "organization": (
        "organization", "nonprofit organization", "association", "political party", "trade union", "community organization", "religious organization", "diaspora organization",
        "episcopate", "diocese", "company", "institution",
    ),
}


def number(value: Column) -> Column:
    """NUM-2: a number, or 0 where there is none."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def entity_class(types: Column, as_text: bool = False) -> Column:
    """REL-15: whole type names, lower-cased; null and empty lists are other. `as_text`: lists written as text (TXT-17)."""
    low = F.transform(parse_list(types) if as_text else types, F.lower)
    out = F.lit("other")
    for name, words in reversed(CLASSES.items()):
        out = F.when(F.arrays_overlap(low, F.array(*map(F.lit, words))), F.lit(name)).otherwise(out)
    return out


def populated(df: DataFrame, column: str) -> Column:
    """A value that says something; lists and numbers count by their text."""
    kind = dict(df.dtypes)[column]
    value = F.to_json(column) if kind.startswith("array") else F.col(column).cast("string")
    return F.coalesce(~F.trim(value).isin("", "[]", "{}", "null", "None"), F.lit(False))


def completeness(df: DataFrame) -> Column:
    """REL-8: weighted share of the fields of the row's class; classes without a profile have 0."""
    out = F.lit(0.0)
    for name, fields in PROFILES.items():
        got = reduce(lambda a, b: a + b, (F.when(populated(df, c), w).otherwise(0.0) for c, w in fields.items()))
        out = F.when(F.col("entity_class") == name, got / sum(fields.values())).otherwise(out)
    return out


def quality() -> Column:
    """REL-9, from first_paragraph_length and full_text_length; an unknown full length counts as the lead's."""
    lead = F.coalesce("first_paragraph_length", F.lit(0))
    full = F.coalesce("full_text_length", lead)
    part = lambda when, value: F.when(F.coalesce(when, F.lit(False)), value).otherwise(0.0)
    recognised = F.coalesce(F.col("entity_class") != "other", F.lit(True))
    return part(F.col("is_list_article"), -5.0) + part((lead < 160) & (full < 800), -2.5) + part(recognised, 0.75) + part(lead >= 240, 1.0) + part(lead < 80, -0.75)


def features(df: DataFrame, population: int | None, weight: float = IMPORTANCE_WEIGHT, least_population: int = IMPORTANCE_POPULATION) -> DataFrame:
    """quality_score and importance_score (REL-9, REL-10); the prior counts for cities of `least_population` or more."""
    use = population is not None and population >= least_population
    return df.withColumns({"quality_score": quality(), "importance_score": F.lit(float(weight)) * completeness(df), "use_importance": F.lit(use)})


def fuse(rankings: Mapping[str, DataFrame], weights: Mapping[str, float] | None = None, k: int = RRF_K, top_n: int | None = None) -> DataFrame:
    """REL-11: page_id, rrf_score and the sources in ranking order. Each ranking: page_id and rank (RNK-1).

    Given weights replace the defaults; names without one count 1. A weight of 0 still gives rows.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    weights = RRF_WEIGHTS if weights is None else weights
    parts = []
    for i, (name, frame) in enumerate(rankings.items()):
        if not {"page_id", "rank"} <= set(frame.columns):
            raise ValueError(f"{name} needs page_id and rank")
        parts.append(frame.select("page_id", (F.lit(float(weights.get(name, 1.0))) / (k + F.col("rank"))).alias("w"), F.struct(F.lit(i).alias("i"), F.lit(name).alias("name")).alias("s")))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    names = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["name"]), ",")
    out = every.groupBy("page_id").agg(F.sum("w").alias("rrf_score"), names.alias("rrf_sources"))
    return out.orderBy(F.desc("rrf_score"), "page_id").limit(top_n) if top_n else out


#: Rows that one task numbers at most; beyond, ranges of the order are numbered side by side.
ALONE = 20_000


def ranked(df: DataFrame, *order: Column | str, n: int | None = None) -> DataFrame:
    """SRT-2, RNK-1: page_id and rank 1 to n in an order that ends in page_id.

    Rows are dealt into ranges of the order; a row's rank is its place in its range and the sizes of the ranges before
    (one row for each range). A list that is known to be short is numbered by one task instead; n is its length, where
    it is known.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    if (df.count() if n is None else n) <= ALONE:
        return df.select("page_id", F.row_number().over(Window.orderBy(*keys, "page_id")).alias("rank"))
    # written, so that both readers below see the same ranges
    dealt = materialise(df.repartitionByRange(*keys, "page_id").withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*keys, "page_id"))
    return dealt.withColumn("place", place).join(F.broadcast(before), "__range").select("page_id", (F.col("before") + F.col("place")).cast("int").alias("rank"))


def score(df: DataFrame, radius: float, weights: Mapping[str, float] | None = None) -> Column:
    """REL-12; given weights are merged over the defaults, missing columns count 0; a weight that isn't known is an error."""
    if unknown := set(weights or {}) - set(SCORE_WEIGHTS):
        raise ValueError(f"unknown score weights: {sorted(unknown)}")
    w = {**SCORE_WEIGHTS, **(weights or {})}
    value = lambda c: number(F.col(c)) if c in df.columns else F.lit(0.0)
    hop = F.coalesce((5 - F.col("hop")) * w["hop"], F.lit(0.0)) if "hop" in df.columns else F.lit(0.0)
    near = proximity(F.col("distance_km"), radius, w["geographic"]) if "distance_km" in df.columns else F.lit(0.0)
    prior = F.when(F.col("use_importance"), w["importance"] * value("importance_score")).otherwise(0.0) if "use_importance" in df.columns else F.lit(0.0)
    return RRF_SCALE * value("rrf_score") + near + hop + w["quality"] * value("quality_score") + prior + w["category"] * value("category_score") + w["graph"] * value("graph_score")


def min_max(value: Column) -> Column:
    """NUM-1, AGG-8: over the whole (small) frame; a constant gives 0."""
    low, high = F.min(value).over(Window.partitionBy()), F.max(value).over(Window.partitionBy())
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)


def rerank(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], place: str, rows: int = RERANK_ROWS) -> DataFrame:
    """REL-13, TOP-4: the best unmapped rows are scored on (place, title and lead) by an injected model."""
    best = df.filter("distance_km is null").orderBy(F.desc("score"), "page_id").limit(rows)
    pairs = best.select("page_id", F.lit(place).alias("query"), F.concat_ws(". ", "title", "first_paragraph").alias("passage"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch.page_id, "ce": scorer(batch).astype(float)})

    rated = pairs.mapInPandas(run, "page_id long, ce double")
    rated = rated.select("page_id", (RERANK_WEIGHT * min_max(F.col("ce"))).alias("gain"))
    return df.join(rated, "page_id", "left").withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0.0))).drop("gain")


def finalize(df: DataFrame, limit: int) -> DataFrame:
    """TOP-5, SRT-3: all mapped rows and the `limit` best others, by score, then page."""
    others = df.filter("distance_km is null").orderBy(F.desc_nulls_last("score"), "page_id").limit(limit)
    return df.filter("distance_km is not null").unionByName(others).orderBy(F.desc_nulls_last("score"), "page_id")


def stats(candidates: DataFrame) -> DataFrame:
    """AGG-16: one row."""
    return candidates.agg(F.count("*").alias("total_found"), F.coalesce(F.sum(F.when(F.col("distance_km").isNotNull(), 1)), F.lit(0)).alias("from_coords"))


def combine(branches: Mapping[str, DataFrame]) -> DataFrame:
    """SET-1, REL-14: branches in the order of SOURCES; the first that has a page names its source."""
    named = [branches[s].withColumn("result_source", F.lit(s)).withColumn("__order", F.lit(i)) for i, s in enumerate(SOURCES) if s in branches]
    return first_by(union_all(*named), "page_id", "__order").drop("__order")
