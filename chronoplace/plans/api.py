"""What a server in front of the engine answers (API-1 to API-8, PRJ-3, PRJ-6, TXT-18, TOP-6). Pages and cards stay tables
until they are written as JSON; a response is bounded by the mapped rows and the limit."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from chronoplace import schemas
from chronoplace.checks import assert_range
from chronoplace.functions import text, values
from chronoplace.operators.aggregates import missing
from chronoplace.operators.graph import cut
from chronoplace.plans.engine import CACHE_LIMIT, CACHE_RADIUS, CACHE_VERSION, Engine


class NotFound(LookupError):
    """There is no such place or page."""


@dataclass(frozen=True)
class Location:
    label: str
    latitude: float
    longitude: float


def cards(found: DataFrame) -> DataFrame:
    """PRJ-3: results as they are shown, best first; see schemas.CARD."""
    kinds = dict(found.dtypes)
    country = values.listed(F.col("country")) if kinds["country"].startswith("array") else values.shown(F.col("country"))
    return found.select(
        F.col("page_id").cast("long").alias("page_id"),
        values.shown(F.col("title")).alias("title"),
        text.clean_text(F.col("first_paragraph")).alias("first_paragraph"),
        values.shown(F.col("entity_class"), "other").alias("entity_class"),
        (values.whole(F.col("year")) if "year" in kinds else F.lit(None).cast("long")).alias("year"),
        F.nullif(country, F.lit("")).alias("country"),
        values.finite(F.col("lat")).alias("latitude"),
        values.finite(F.col("lon")).alias("longitude"),
        values.finite(F.col("distance_km")).alias("distance_km"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        values.shown(F.col("result_source"), "unknown").alias("source"),
        "match_reason",
    )


def first_mapped(shown: DataFrame, most: int = 15) -> DataFrame:
    """TOP-6: the mapped cards that a client lists at first."""
    return shown.filter("distance_km is not null").orderBy(F.desc("score"), "page_id").limit(most)


def response(location: Location, shown: DataFrame, stats: DataFrame) -> DataFrame:
    """TXT-18: one row, payload: the response as JSON, cards best first."""
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("page_id").alias("p"), F.struct(*shown.columns).alias("card"))))
    every = shown.agg(F.transform(in_order, lambda x: x["card"]).alias("connected"))
    counts = stats.select(F.struct(F.col("from_coords").cast("long").alias("mapped"), F.col("total_found").cast("long").alias("connected")).alias("counts"))
    where = F.struct(F.lit(location.label).alias("label"), F.lit(float(location.latitude)).alias("latitude"), F.lit(float(location.longitude)).alias("longitude"))
    body = F.struct(where.alias("query"), F.filter("connected", lambda c: c["distance_km"].isNotNull()).alias("mapped"), "connected", "counts")
    return every.crossJoin(F.broadcast(counts)).select(F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def parsed(payloads: DataFrame) -> DataFrame:
    """TXT-18, the way back: query, mapped, connected, counts of each payload."""
    return payloads.select(F.from_json("payload", schemas.RESPONSE).alias("r")).select("r.*")


@dataclass
class Answer:
    """API-1: one row (query, mapped, connected, counts), whether the cache had it, and seconds by part."""

    body: Row
    from_cache: bool
    seconds: dict[str, float] = field(default_factory=dict)


@dataclass
class Service:
    """`geocoder`: for places that no alias names; there is none by default, as the engine uses no network."""

    engine: Engine
    geocoder: Callable[[str], Location | None] | None = None
    scorer: Callable[[pd.DataFrame], pd.Series] | None = None
    _places: dict[str, Location] = field(default_factory=dict, repr=False)

    def health(self) -> dict[str, str]:
        """API-4."""
        return {"status": "ok"}

    def warm_up(self) -> None:
        """API-13: the text index is opened, or built, before the first request; the model and the scorer are tried once."""
        self.engine.index()
        if self.engine.model is not None:
            self.engine.model(["warm up"])
        if self.scorer is not None:
            self.scorer(pd.DataFrame({"page_id": [0], "query": [""], "passage": [""]}))

    def geocode(self, q: str, city: Row | None) -> Location:
        """API-5: the city that an alias names, else the geocoder's place; remembered (API-6), at most 128 of them."""
        if city is not None:
            return Location(_label(city), city.latitude, city.longitude)
        if q not in self._places:
            found = self.geocoder(q) if self.geocoder else None
            if found is None:
                raise NotFound(f"could not find {q!r}")
            if len(self._places) >= 128:
                self._places.pop(next(iter(self._places)))
            self._places[q] = found
        return self._places[q]

    def search(self, q: str, radius_km: float = 50.0, limit: int = 150, linked_only: bool = False) -> Answer:
        """API-1: rules, cache, place, search, cards."""
        if len(q) < 2:
            raise ValueError("q must have two characters or more")
        assert_range("radius_km", radius_km, 0, 500, open_low=True)
        assert_range("limit", limit, 10, 500)
        began = time.perf_counter()
        city = self.engine.resolve_city(q).first() if self.engine.aliases is not None else None
        if city is not None and (hit := self.engine.cached(city.geoname_id, radius_km, limit, linked_only)) is not None:
            if (row := parsed(hit).first()) is not None:
                return Answer(row, True, {"total": time.perf_counter() - began})
        location = self.geocode(q, city)
        located = time.perf_counter()
        body = parsed(self._answer(location, city, radius_km, limit, linked_only)).first()
        done = time.perf_counter()
        return Answer(body, False, {"geocode": located - began, "search": done - located, "total": done - began})

    def _answer(self, location: Location, city: Row | None, radius: float, limit: int, linked_only: bool = False) -> DataFrame:
        label = location.label
        of_city = {"country": city.country_name, "geoname_id": city.geoname_id, "population": city.population} if city is not None else {}
        found, stats = self.engine.search(label, location.latitude, location.longitude, radius, limit, linked_only=linked_only, query_vector=self.engine.query_vector(label), scorer=self.scorer, **of_city)
        return response(location, cards(found), stats)

    def article(self, page_id: int) -> Row:
        """API-2: title, lead, cleaned text, class, year, country; NotFound for redirects and unknown ids."""
        page = self.engine.article(page_id)
        year = values.whole(F.col("year")) if "year" in page.columns else F.lit(None).cast("long")
        row = page.select(
            "page_id", values.shown(F.col("title")).alias("title"), text.article_lead(F.col("first_paragraph"), F.col("full_text")).alias("first_paragraph"),
            text.clean_text(F.col("full_text")).alias("full_text"), values.shown(F.col("entity_class"), "other").alias("entity_class"), year.alias("year"), F.nullif(values.shown(F.col("country")), F.lit("")).alias("country"),
        ).first()
        if row is None:
            raise NotFound(f"no article {page_id}")
        return row

    def coordinates(self) -> DataFrame:
        """API-3."""
        return self.engine.coordinates()

    def build_cache(self, least_population: int = 15000, at_once: int = 4) -> DataFrame:
        """API-8, SNK-4, FLT-17: payloads (schemas.CACHE) of all cities from a population up that have none yet.

        Cities are the stated set: a gazetteer has some ten thousand. `at_once` are searched side by side; each one's
        payload is written before the next is taken up, so a build that is broken off goes on where it was when what it
        had written is put into the cache (see `upsert`).
        """
        wanted = self.engine.cities.filter(F.col("population") >= least_population)
        if self.engine.cache is not None:
            wanted = missing(wanted, self.engine.cache.filter(F.col("version") == CACHE_VERSION), "geoname_id")

        def one(city: Row) -> DataFrame:
            answer = self._answer(Location(_label(city), city.latitude, city.longitude), city, CACHE_RADIUS, CACHE_LIMIT)
            return cut(answer.select(F.lit(city.geoname_id).cast("long").alias("geoname_id"), F.lit(CACHE_VERSION).alias("version"), "payload"))

        self.engine.index()
        with ThreadPoolExecutor(at_once) as pool:
            rows = list(pool.map(one, wanted.orderBy(F.desc("population"), "geoname_id").toLocalIterator()))
        spark = self.engine.articles.sparkSession
        if not rows:
            return spark.createDataFrame([], schemas.CACHE)
        return spark.read.schema(schemas.CACHE).parquet(*(r._chronoplace_path for r in rows))


def _label(city: Row) -> str:
    """TXT-8 for one city."""
    state = city.country_code == "US" and city.admin1_name
    return f"{city.name}, {city.admin1_name}" if state else ", ".join(x for x in (city.name, city.country_name) if x)


def upsert(have: DataFrame, rows: DataFrame, key: str | list[str], seq: str | None = None) -> DataFrame:
    """SNK-4: rows replace those of the same key; of several new rows of a key the last by `seq` stands."""
    from chronoplace.operators.aggregates import first_by

    keys = [key] if isinstance(key, str) else key
    if seq:
        rows = first_by(rows, keys, F.desc(seq))
    return have.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*have.columns))
