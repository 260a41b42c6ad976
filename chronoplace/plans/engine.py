"""The engine: search over the tables of a build, and what is served from it (REL-7, GRF-6, FLT-*, API-5)."""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplace.checks import assert_range, assert_unique
from chronoplace.functions.dates import canonical_date, signed_year, year_window
from chronoplace.functions.geo import within_radius
from chronoplace.functions.text import fold_alias
from chronoplace.operators import ranking as R
from chronoplace.operators import retrieval as Q
from chronoplace.operators import vectors as V
from chronoplace.operators.aggregates import min_hop
from chronoplace.operators.graph import cut, graph_scores
from chronoplace.operators.postings import TextIndex, text_candidates

CACHE_RADIUS, CACHE_LIMIT, CACHE_VERSION = 50.0, 150, "1"


@dataclass(frozen=True)
class Settings:
    """What an installation may set; `from_env` reads CHRONOPLACE_<NAME>."""

    linked_enough: int = 50
    dense_rows: int = 200
    bm25_least: float = 1.0
    importance_weight: float = R.IMPORTANCE_WEIGHT
    importance_population: int = R.IMPORTANCE_POPULATION

    @classmethod
    def from_env(cls) -> Settings:
        given = {f.name: os.environ.get(f"CHRONOPLACE_{f.name.upper()}") for f in fields(cls)}
        return cls(**{f.name: type(f.default)(given[f.name]) for f in fields(cls) if given[f.name]})


def article_index(articles: DataFrame, metadata: DataFrame, membership: DataFrame, check: bool = True) -> DataFrame:
    """JOI-2: one row per article with metadata, hop, date, year, class and list flag; unknown years stay (FLT-4)."""
    if check:
        assert_unique(articles, "page_id", "articles")
        assert_unique(metadata, "page_id", "metadata")
    rows = articles.join(metadata.drop("title"), "page_id", "left").join(min_hop(membership).withColumnRenamed("min_hop", "hop"), "page_id", "left")
    rows = rows.withColumn("canonical_date", canonical_date()).withColumn("year", signed_year(F.col("canonical_date")))
    as_text = dict(rows.dtypes)["instance_of"] == "string"
    rows = rows.withColumn("entity_class", R.entity_class(F.col("instance_of"), as_text))
    return year_window(rows.withColumn("is_list_article", F.col("title").rlike("^Lists? of ")))


@dataclass
class Engine:
    """Tables of a build. Optional ones switch their branch off when absent."""

    articles: DataFrame
    categories: DataFrame
    vectors: DataFrame | None = None
    city_graph: DataFrame | None = None
    cities: DataFrame | None = None
    aliases: DataFrame | None = None
    cache: DataFrame | None = None
    text: TextIndex | None = None
    city_vectors: DataFrame | None = None
    model: Callable[[list[str]], list[list[float]]] | None = None
    settings: Settings = field(default_factory=Settings)

    def index(self) -> TextIndex:
        """The written text index; where a build has none, it is written once."""
        if self.text is None:
            self.text = TextIndex.build(self.articles)
        return self.text

    def scope(self, geoname_id: int | None, linked_only: bool) -> tuple[str, DataFrame | None]:
        """GRF-6: the city's graph if asked for or large enough, else the country. What is linked is written."""
        linked = None
        if self.city_graph is not None and geoname_id is not None:
            linked = cut(graph_scores(self.city_graph.filter(F.col("geoname_id") == geoname_id), self.articles))
        if linked_only or (linked is not None and linked.limit(self.settings.linked_enough).count() >= self.settings.linked_enough):
            nothing = self.articles.select("page_id", F.lit(0).alias("graph_distance"), F.lit(0.0).alias("graph_score")).limit(0)
            return "graph", nothing if linked is None else linked
        return "country", linked

    def search(
        self, place: str, lat: float, lon: float, radius: float = 50.0, limit: int = 150, *, country: str | None = None, geoname_id: int | None = None, population: int | None = None,
        linked_only: bool = False, query_vector: list[float] | None = None, bm25_least: float | None = None, rrf_weights: dict | None = None, score_weights: dict | None = None,
        scorer: Callable[[pd.DataFrame], pd.Series] | None = None,
    ) -> tuple[DataFrame, DataFrame]:
        """(results, one row of stats). Five branches side by side, scope, features, fusion, score, optional reranking, final cut."""
        assert_range("radius", radius, 0, 500, open_low=True)
        least = self.settings.bm25_least if bm25_least is None else bm25_least
        pages = self.articles.filter("not is_redirect")
        label, linked = self.scope(geoname_id, linked_only)
        if label == "graph":
            inside = lambda df: Q.restrict_to_graph(df, linked)
        elif country and country.strip():
            inside = lambda df: df.join(pages.filter(Q.country_match(country)).select("page_id"), "page_id", "left_semi")
        else:
            inside = lambda df: df

        def dense() -> DataFrame | None:
            if self.vectors is None or query_vector is None:
                return None
            scoped = Q.country_pages(self.articles, country) if label == "country" and country else pages.select("page_id")
            return cut(inside(V.top(self.vectors, query_vector, self.settings.dense_rows, scoped)))

        # each branch runs once, all at the same time; what it finds is written and read by the steps after it
        with ThreadPoolExecutor(4) as pool:
            jobs = [
                pool.submit(lambda: cut(inside(text_candidates(self.index(), place)))),
                pool.submit(lambda: cut(inside(Q.entity_candidates(self.articles, self.categories, place)))),
                pool.submit(lambda: cut(inside(within_radius(pages, lat, lon, radius).select("page_id", "distance_km")))),
                pool.submit(dense),
            ]
            text, entity, distance, near = (j.result() for j in jobs)
        if near is not None:  # text hits outside the best get their dense score too
            near = near.unionByName(V.scores(self.vectors, query_vector, text.select("page_id")))
        rows = self._candidates(pages, text, entity, distance, near, None if linked is None else inside(linked))
        rows = cut(R.features(rows, population, self.settings.importance_weight, self.settings.importance_population))

        # coordinates outside the radius leave every branch; those inside are mapped and not ranked
        far, has = F.expr("distance_km is null and lat is null"), {}
        has["bm25"] = far & F.col("has_text") & (F.col("bm25_score") >= least)
        has["dense"] = far & F.col("dense_score").isNotNull()
        has["category"] = far & (F.col("category_score") > 0)
        has["graph"] = far & F.col("graph_score").isNotNull()
        branches = {"coordinates": rows.filter("distance_km is not null")} | {name: rows.filter(rule) for name, rule in has.items()}
        lists = {
            "bm25_strict": (has["bm25"] & (F.col("query_match_tier") == 2), F.desc("bm25_score")),
            "bm25_relaxed": (has["bm25"] & (F.col("query_match_tier") == 1), F.desc("bm25_score")),
            "kalm": (has["dense"], F.desc("dense_score")),
            "category": (has["category"], F.desc("category_score"), F.desc("quality_score")),
            "graph": (has["graph"], F.desc("graph_score"), F.asc("graph_distance")),
        }
        # the lengths of all lists in one aggregate
        sizes = rows.agg(*(F.count_if(rule).alias(name) for name, (rule, *_) in lists.items())).first()
        ranks = {name: R.ranked(rows.filter(rule), *order, n=sizes[name]) for name, (rule, *order) in lists.items() if sizes[name]}
        if not ranks:
            ranks = {"bm25_strict": rows.select("page_id", F.lit(1).alias("rank")).limit(0)}
        found = R.combine(branches).join(R.fuse(ranks, rrf_weights), "page_id", "left")
        found = found.withColumn("score", R.score(found, radius, score_weights)).withColumn("match_reason", Q.match_reason())
        if scorer is not None:
            found = R.rerank(found, scorer, place)
        found = cut(found)
        return R.finalize(found, limit), R.stats(found).withColumn("scope", F.lit(label))

    def _candidates(self, pages: DataFrame, text: DataFrame, entity: DataFrame, distance: DataFrame, near: DataFrame | None, linked: DataFrame | None) -> DataFrame:
        """REL-7, JOI-8 to JOI-10: a row for each page that a branch found, with what every branch says of it."""
        # the branches' rows meet in one aggregate, which needs no join for each of them
        empty = {"bm25_score": "double", "query_match_tier": "int", "exact_title_match": "boolean", "lead_exact_match": "boolean", "category_score": "double", "entity_associated": "boolean", "distance_km": "double", "dense_score": "double", "graph_distance": "int", "graph_score": "double"}

        def said(df: DataFrame, **columns: str) -> DataFrame:
            return df.select("page_id", *(F.expr(columns[c]).cast(kind).alias(c) if c in columns else F.lit(None).cast(kind).alias(c) for c, kind in empty.items()))

        parts = [
            said(text, **{c: c for c in ("bm25_score", "query_match_tier", "exact_title_match", "lead_exact_match")}),
            said(entity, category_score="category_score", entity_associated="true"),
            said(distance, distance_km="distance_km"),
        ]
        if near is not None:
            parts.append(said(near, dense_score="dense_score"))
        if linked is not None:
            parts.append(said(linked, graph_distance="graph_distance", graph_score="graph_score"))
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        flags = every.groupBy("page_id").agg(*(F.max(c).alias(c) for c in empty))
        # an entity hit without a text hit has tier 1 and a BM25 score of 1, but is no text match
        flags = flags.withColumn("has_text", F.col("bm25_score").isNotNull())
        flags = flags.withColumns({
            "bm25_score": F.coalesce("bm25_score", F.when(F.col("entity_associated"), 1.0), F.lit(0.0)),
            "query_match_tier": F.coalesce("query_match_tier", F.when(F.col("entity_associated"), 1), F.lit(0)),
            "exact_title_match": F.coalesce("exact_title_match", F.lit(False)),
            "lead_exact_match": F.coalesce("lead_exact_match", F.lit(False)),
            "entity_associated": F.coalesce("entity_associated", F.lit(False)),
            "category_score": F.coalesce("category_score", F.lit(0.0)),
        })
        # lengths first: whole texts needn't reach the join
        return pages.withColumns({"first_paragraph_length": F.length("first_paragraph"), "full_text_length": F.length("full_text")}).drop("full_text").join(flags, "page_id")

    def article(self, page_id: int) -> DataFrame:
        """API-2, FLT-12: no row where there is no such article."""
        return self.articles.filter((F.col("page_id") == page_id) & ~F.col("is_redirect"))

    def coordinates(self) -> DataFrame:
        """API-3, FLT-13."""
        return self.articles.filter("not is_redirect and lat is not null and lon is not null").select("page_id", "lat", "lon")

    def resolve_city(self, query: str) -> DataFrame:
        """API-5, JOI-5, TOP-1: the largest city with this alias."""
        hits = self.aliases.filter(F.col("normalized_alias") == fold_alias(query))
        return self.cities.join(hits.select("geoname_id"), "geoname_id", "left_semi").orderBy(F.desc("population"), "geoname_id").limit(1)

    def query_vector(self, place: str) -> list[float] | None:
        """VEC-3."""
        return V.query_vector(place, self.city_vectors, self.model)

    def cached(self, geoname_id: int, radius: float, limit: int, linked_only: bool = False) -> DataFrame | None:
        """FLT-18: a hit needs the cache's own radius, limit and version."""
        if self.cache is None or linked_only or radius != CACHE_RADIUS or limit != CACHE_LIMIT:
            return None
        return self.cache.filter((F.col("geoname_id") == geoname_id) & (F.col("version") == CACHE_VERSION)).select("payload")
