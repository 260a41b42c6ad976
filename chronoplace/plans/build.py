"""The offline build (API-14): steps in order, each from tables that stand to one that is published (SNK-1 to SNK-12).

A step names its inputs; one that is missing is an error that says which step makes it. A
table is written beside its place and moved there when it is whole. Beside each table
stands the state of its inputs when it was built, so that a stale one is noticed (API-7).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplace import schemas
from chronoplace.checks import assert_unique
from chronoplace.functions.text import citation_sentences, city_aliases, title_candidates, title_key
from chronoplace.operators import graph
from chronoplace.operators import vectors as V
from chronoplace.operators.aggregates import largest_population
from chronoplace.operators.postings import TextIndex
from chronoplace.plans.engine import Engine, Settings, article_index
from chronoplace.shared import cleaning, exists, filesystem, remove, version
from chronoplace.sources import metadata, sqldump, xmldump


class Stale(RuntimeError):
    """A table is older than what it was built from."""


def data_root(candidates: Sequence[str], variable: str = "CHRONOPLACE_DATA") -> str:
    """SRC-20: what the environment names, else the first candidate that is there, else the first."""
    return os.environ.get(variable) or next((c for c in candidates if os.path.isdir(c)), candidates[0])


def publish(df: DataFrame, path: str, sort: list[str] | None = None, partition: list[str] | None = None) -> int:
    """SNK-1, SNK-2, SNK-5, SNK-6: written beside its place, counted, then moved there; the number of rows.

    The table that stood there is moved aside first and deleted last: at each moment the old or the new one is whole
    on disk, and `recover` puts the old one back if a build broke off between the two moves. Sorted files carry tight
    statistics, which is what an index is here.
    """
    from pyspark.sql import Observation

    spark = df.sparkSession
    building, aside = f"{path}.building-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    fs, to = filesystem(spark, path)
    at, old = filesystem(spark, building)[1], filesystem(spark, aside)[1]
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n"))
    out = out.sortWithinPartitions(*sort) if sort else out
    try:
        with cleaning(spark):
            (out.write.partitionBy(*partition) if partition else out.write).parquet(building)
        n, written = seen.get["n"], spark.read.parquet(building).count()
        if n != written:
            raise ValueError(f"{path}: {written} rows of {n} were written")
        had = fs.exists(to)
        if had and not fs.rename(to, old):
            raise OSError(f"could not move {path} aside")
        if not fs.rename(at, to):
            if had:
                fs.rename(old, to)
            raise OSError(f"could not publish {path}")
        if had:
            fs.delete(old, True)
        return n
    except BaseException:
        fs.delete(at, True)
        raise


def recover(spark: SparkSession, path: str) -> bool:
    """Puts back a table that a build left aside; True if there was one to put back."""
    fs, to = filesystem(spark, path)
    parent = to.getParent()
    if fs.exists(to) or not fs.exists(parent):
        return False
    left = sorted((s.getPath() for s in fs.listStatus(parent) if s.getPath().getName().startswith(f"{to.getName()}.old-")), key=str)
    return bool(left) and fs.rename(left[-1], to)


@dataclass
class Build:
    """A folder of tables. `dumps` names the inputs of the first steps; see `Step`s below."""

    spark: SparkSession
    root: str
    model: Callable[[list[str]], list[list[float]]] | None = None
    seed: str = "History"
    hops: int = 4
    least_population: int = 15000
    link_hops: int = 1

    def at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def table(self, name: str) -> DataFrame:
        self.require(name)
        return self.spark.read.parquet(self.at(name))

    def require(self, name: str, who: str = "") -> None:
        """Raises if there is no such table, or input; a table that a broken build left aside is put back."""
        if not exists(self.spark, self.at(name)) and not recover(self.spark, self.at(name)):
            made = next((s for s in STEPS if name in s.makes), None)
            raise FileNotFoundError(f"{who}{self.at(name)} is missing" + (f": run step {made.name!r}" if made else ""))

    def dump(self, relation: str) -> DataFrame:
        return sqldump.read(self.spark, self.at(f"dumps/{relation}.sql.gz"), relation)

    def publish(self, name: str, df: DataFrame, sort: list[str] | None = None) -> int:
        n = publish(df, self.at(name), sort)
        return n

    def state(self, names: Sequence[str]) -> str:
        return " ".join(f"{n}={version(self.spark.read.format('binaryFile').option('recursiveFileLookup', 'true').load(self.at(n)))}" for n in names)

    def run(self, *names: str) -> dict[str, int]:
        """Runs the named steps, or all, in their order; rows of each table that was made."""
        out: dict[str, int] = {}
        for step in STEPS:
            if names and step.name not in names:
                continue
            for need in step.needs:
                self.require(need, f"for step {step.name!r} ")
            out |= step.run(self)
            for name in step.makes:
                if exists(self.spark, self.at(name)):
                    remove(self.spark, self.at(f"_states/{name}"))
                    self.spark.createDataFrame([(name, self.state(step.needs))], "table_name string, state string").coalesce(1).write.json(self.at(f"_states/{name}"))
        return out

    def require_current(self, name: str) -> None:
        """API-7: raises if the table is missing, or older than what it was built from. Inputs that are gone are no fault: a
        finished build may stand alone."""
        self.require(name)
        step = next(s for s in STEPS if name in s.makes)
        row = self.spark.read.schema("table_name string, state string").json(self.at(f"_states/{name}")).first()
        if all(exists(self.spark, self.at(n)) for n in step.needs) and row.state != self.state(step.needs):
            raise Stale(f"{self.at(name)} is older than {', '.join(step.needs)}: run step {step.name!r}")

    def engine(self, settings: Settings | None = None, **more: object) -> Engine:
        """The engine over the tables that stand."""
        have = lambda name: self.table(name) if exists(self.spark, self.at(name)) else None
        for name in ("article_index", "text_index"):
            self.require_current(name)
        return Engine(
            articles=self.table("article_index"), categories=self.table("article_categories"), vectors=have("vectors"), city_graph=have("city_links"), cities=have("cities"), aliases=have("aliases"),
            cache=have("city_cache"), text=TextIndex.open(self.spark, self.at("text_index")), model=self.model, settings=settings or Settings.from_env(), **more,
        )


@dataclass(frozen=True)
class Step:
    name: str
    needs: tuple[str, ...]
    makes: tuple[str, ...]
    run: Callable[[Build], dict[str, int]]


def _categories(b: Build) -> dict[str, int]:
    """GRF-1, JOI-11, JOI-12: categories within reach of the seed, and their articles."""
    links, targets, pages = b.dump("categorylinks"), b.dump("linktarget"), b.dump("page")
    hops = graph.cut(graph.category_hops(sqldump.category_edges(links, targets, pages), b.seed, b.hops))
    members = graph.hop_membership(sqldump.category_members(links, targets), hops)
    return {"category_hops": b.publish("category_hops", hops, ["hop", "category"]), "article_categories": b.publish("article_categories", members, ["category", "page_id"])}


def _articles(b: Build) -> dict[str, int]:
    """SRC-10, SRC-11, FLT-2, FLT-3: articles of the categories, from the XML dump."""
    rows = xmldump.articles(xmldump.read_pages(b.spark, b.at("dumps/pages.xml")), b.table("article_categories"))
    assert_unique(rows, "page_id", "articles")
    return {"articles": b.publish("articles", rows, ["page_id"])}


def _metadata(b: Build) -> dict[str, int]:
    """SRC-15, PRJ-5, AGG-5: structured metadata by title, on the articles' ids."""
    lines = b.spark.read.schema("seq long, binding string").json(b.at("dumps/bindings.json"))
    merged = metadata.merged(metadata.bindings(lines))
    ids = b.table("articles").select("page_id", "title")
    return {"metadata": b.publish("metadata", ids.join(merged, "title"), ["page_id"])}


def _index(b: Build) -> dict[str, int]:
    """JOI-2, SNK-6: the flat index, sorted by place, so that a box of coordinates leaves few files."""
    rows = article_index(b.table("articles"), b.table("metadata"), b.table("article_categories").select(*(c.split()[0] for c in schemas.MEMBERSHIP.split(", "))))
    return {"article_index": b.publish("article_index", rows, ["lat", "lon", "page_id"])}


def _text(b: Build) -> dict[str, int]:
    """SNK-12: the inverted index."""
    index = TextIndex.build(b.table("article_index"), b.at("text_index"))
    return {"text_index": index.n_all}


def _vectors(b: Build) -> dict[str, int]:
    """VEC-2, VEC-4, SRC-14, SNK-7: vectors of the checkpoint files, and of articles that none has, from the model."""
    folder = b.at("dumps/embeddings")
    done = V.checked(V.read_checkpoints(b.spark, folder)) if exists(b.spark, folder) else None
    rows = done
    if b.model is not None:
        fresh = V.embed(b.table("articles").filter("not is_redirect"), b.model, done)
        rows = fresh if done is None else done.unionByName(fresh.select("page_id", F.col("embedding").cast("array<float>").alias("embedding")))
    if rows is None:
        return {}
    return {"vectors": b.publish("vectors", rows, ["page_id"])}


def _gazetteer(b: Build) -> dict[str, int]:
    """SRC-16, SNK-11, TXT-9: cities and their aliases."""
    cities = metadata.gazetteer(b.spark.read.schema(schemas.CITIES).json(b.at("dumps/cities.json")), b.least_population)
    assert_unique(cities, "geoname_id", "cities")
    rows = {"cities": b.publish("cities", cities, ["geoname_id"])}
    aliases = city_aliases(b.table("cities"))
    rows["aliases"] = b.publish("aliases", aliases, ["normalized_alias", "geoname_id"])
    if b.table("aliases").join(b.table("cities"), "geoname_id", "left_anti").limit(1).count():
        raise ValueError("an alias names no city")
    return rows


def _citations(b: Build) -> dict[str, int]:
    """SNK-12, TXT-15, TXT-16: citation sentences, and an inverted index of them."""
    n = b.publish("citations", citation_sentences(b.table("articles").filter("not is_redirect")).withColumn("sentence_id", F.xxhash64("page_id", "pos")), ["page_id", "pos"])
    rows = b.table("citations").select("page_id", F.lit(False).alias("is_redirect"), F.lit("").alias("title"), F.lit("").alias("first_paragraph"), F.col("sentence").alias("full_text"))
    whole = rows.groupBy("page_id", "is_redirect", "title", "first_paragraph").agg(F.array_join(F.sort_array(F.collect_list("full_text")), "\n").alias("full_text"))
    TextIndex.build(whole, b.at("citation_index"))
    if b.table("citations").select("page_id").distinct().count() != whole.count():
        raise ValueError("the citation index does not hold every cited page")
    return {"citations": n}


def match_cities(cities: DataFrame, page: DataFrame) -> DataFrame:
    """JOI-13, AGG-9: the articles that bear a city's name. page: page_id, namespace, title, is_redirect."""
    titles = page.filter("namespace = 0").select("page_id", F.col("title").alias("wikipedia_title"), "is_redirect", title_key(F.col("title")).alias("title_key"))
    return largest_population(title_candidates(cities).join(titles, "title_key"))


def _links(b: Build) -> dict[str, int]:
    """GRF-2 to GRF-4, JOI-14: cities' articles and what they link to."""
    page = b.dump("page")
    matches = match_cities(b.table("cities"), page)
    n = b.publish("city_article_matches", matches.select("geoname_id", "page_id", "wikipedia_title", "is_redirect", "match_type", "population"), ["geoname_id"])
    edges = graph.cut(graph.link_edges(b.dump("pagelinks"), b.dump("linktarget"), page))
    rows = graph.city_links(b.table("city_article_matches"), edges, page, b.link_hops, all_cities=True)
    return {"city_article_matches": n, "city_links": b.publish("city_links", rows, ["geoname_id", "graph_distance"])}


def _cache(b: Build) -> dict[str, int]:
    """API-8, SNK-4: payloads of the cities that have none, put into the cache."""
    from chronoplace.plans.api import Service, upsert

    rows = Service(b.engine()).build_cache(b.least_population)
    old = b.table("city_cache") if exists(b.spark, b.at("city_cache")) else rows.limit(0)
    return {"city_cache": b.publish("city_cache", graph.cut(upsert(old, rows, ["geoname_id", "version"])), ["geoname_id"])}


STEPS = (
    Step("categories", ("dumps/categorylinks.sql.gz", "dumps/linktarget.sql.gz", "dumps/page.sql.gz"), ("category_hops", "article_categories"), _categories),
    Step("articles", ("dumps/pages.xml", "article_categories"), ("articles",), _articles),
    Step("metadata", ("dumps/bindings.json", "articles"), ("metadata",), _metadata),
    Step("index", ("articles", "metadata", "article_categories"), ("article_index",), _index),
    Step("text", ("article_index",), ("text_index",), _text),
    Step("vectors", ("articles",), ("vectors",), _vectors),
    Step("gazetteer", ("dumps/cities.json",), ("cities", "aliases"), _gazetteer),
    Step("citations", ("articles",), ("citations", "citation_index"), _citations),
    Step("links", ("cities", "dumps/page.sql.gz", "dumps/linktarget.sql.gz", "dumps/pagelinks.sql.gz"), ("city_article_matches", "city_links"), _links),
    Step("cache", ("article_index", "text_index", "cities", "aliases"), ("city_cache",), _cache),
)


def manifest(tables: dict[str, DataFrame], version: str = "1") -> DataFrame:
    """SNK-9, SNK-10: the tables of a build and their row counts, in one plan."""
    rows = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), F.lit(version).alias("version"), "n_rows") for name, df in sorted(tables.items())]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def catalogue(b: Build) -> DataFrame:
    """SNK-10: what stands in a build's folder."""
    names = [n for s in STEPS for n in s.makes if n not in ("text_index", "citation_index") and exists(b.spark, b.at(n))]
    return manifest({n: b.table(n) for n in names})


def main(args: list[str] | None = None) -> dict[str, int]:
    """API-9: python -m chronoplace.plans.build ROOT [STEP ...], with a flag for each setting of a build."""
    import argparse

    from chronoplace.session import session

    parser = argparse.ArgumentParser(description="Runs steps of the offline build, in their order: " + ", ".join(s.name for s in STEPS))
    parser.add_argument("root")
    parser.add_argument("steps", nargs="*", metavar="step", choices=[[], *(s.name for s in STEPS)])
    parser.add_argument("--seed", default="History")
    parser.add_argument("--hops", type=int, default=4)
    parser.add_argument("--least-population", type=int, default=15000, choices=metadata.TIERS)
    parser.add_argument("--link-hops", type=int, default=1)
    given = parser.parse_args(args)
    b = Build(session(), given.root, seed=given.seed, hops=given.hops, least_population=given.least_population, link_hops=given.link_hops)
    rows = b.run(*given.steps)
    for name, n in rows.items():
        print(f"{name}: {n} rows")
    return rows


if __name__ == "__main__":
    main()
