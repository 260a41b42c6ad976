"""Bounded breadth-first searches over edge lists (GRF-*, JOI-14, AGG-10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplace.operators.aggregates import first_by
from chronoplace.shared import materialise


def cut(df: DataFrame) -> DataFrame:
    """Ends lineage at a table in the folder that all executors share."""
    return materialise(df, "cut")


#: Nodes of a frontier, and nodes seen before, that may be broadcast; pairs of a search and a node that one task brings together, about.
SHORT, SEEN, PAIRS = 50_000, 200_000, 1_000_000


def _step(edges: DataFrame, near: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, node, parent) one step from near(keys, src), which is sent to the edges.

    Edges are dealt by their end, in as many parts as the pairs ask for, so what a node is reached by meets where it is
    made, and no pair is shuffled but those of nodes that are reached more than PAIRS times.
    """
    counts = F.broadcast(near.groupBy("src").agg(F.count("*").alias("n")))
    loads = edges.join(counts, "src").groupBy("dst").agg(F.sum("n").alias("n"))
    pairs, most = (x or 0 for x in loads.agg(F.sum("n"), F.max("n")).first())
    parts = max(1, -(-pairs // PAIRS), min(edges.sparkSession.sparkContext.defaultParallelism, pairs // 20_000))
    used = edges.join(counts.select("src"), "src", "left_semi")

    def reached(some: DataFrame, *by: str) -> DataFrame:
        return some.repartition(parts, *by).join(F.broadcast(near), "src").groupBy(*keys, F.col("dst").alias("node")).agg(F.min("src").alias("parent"))

    if most <= PAIRS:
        return reached(used, "dst")
    hot = F.broadcast(loads.filter(F.col("n") > PAIRS).select("dst"))
    return reached(used.join(hot, "dst", "left_anti"), "dst").unionByName(reached(used.join(hot, "dst", "left_semi"), "src", "dst"))


def bfs(edges: DataFrame, seeds: DataFrame, hops: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """C5: (keys, node, distance, parent) of the nodes reached from seeds(keys, node) in at most `hops` steps.

    edges(src, dst). One join per hop; nodes seen are left out, parents are the
    least possible. Ends early when nothing new is reached. Searches of different
    keys don't meet, so long frontiers are taken in blocks of keys; a search whose
    own frontier is long is shuffled to the edges.
    """
    if hops < 0:
        raise ValueError("hops must not be negative")
    by = [*keys, "node"]
    level = cut(seeds.select(*by).distinct().withColumn("distance", F.lit(0)).withColumn("parent", F.lit(None).cast(seeds.schema["node"].dataType)))
    seen, held = level, 0
    for hop in range(1, hops + 1):
        near = level.select(*keys, F.col("node").alias("src"))
        n, longest = near.groupBy(*keys).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
        if hop > 1 and not n:
            break
        held += n
        blocks = max(1, -(-n // SHORT)) if longest <= SHORT else 1
        fresh = []
        for i in range(blocks):
            mine = (F.pmod(F.xxhash64(*keys), F.lit(blocks)) == i) if blocks > 1 else F.lit(True)
            if longest <= SHORT:
                step = _step(edges, near.filter(mine), keys)
            else:
                step = edges.join(near, "src").groupBy(*keys, F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
            old = seen.select(*by).filter(mine)
            old = F.broadcast(old) if held <= SEEN * blocks else old.hint("merge")
            fresh.append(step.join(old, by, "left_anti").select(*by, F.lit(hop).alias("distance"), "parent"))
        level = cut(reduce(lambda a, b: a.unionByName(b), fresh))
        seen = seen.unionByName(level)
    return seen


def category_hops(edges: DataFrame, seed: str = "History", hops: int = 4) -> DataFrame:
    """GRF-1: (category, hop) from the seed; a seed without children is an error that names similar ones."""
    if edges.filter(F.col("parent") == seed).isEmpty():
        like = [r[0] for r in edges.filter(F.lower("parent").contains(seed.lower())).select("parent").distinct().orderBy("parent").limit(30).collect()]
        raise ValueError(f"no subcategories under {seed!r}; similar: {like}")
    start = edges.sparkSession.createDataFrame([(seed,)], "node string")
    return bfs(edges.select(F.col("parent").alias("src"), F.col("child").alias("dst")), start, hops).select(F.col("node").alias("category"), F.col("distance").alias("hop"))


def hop_membership(members: DataFrame, hops: DataFrame) -> DataFrame:
    """JOI-12: members(page_id, category) with their category's hop."""
    return members.join(hops, "category").select("page_id", "category", "hop")


def link_edges(pagelinks: DataFrame, linktarget: DataFrame, page: DataFrame) -> DataFrame:
    """JOI-14: (src, dst) page links; red links and self links go; of pages with one title the least id stands (AGG-10)."""
    ids = page.filter("namespace = 0").groupBy("title").agg(F.min("page_id").alias("dst"))
    targets = linktarget.filter("namespace = 0").select("target_id", "title").join(ids, "title").select("target_id", "dst")
    return pagelinks.filter("from_namespace = 0").join(targets, "target_id").filter("from_id != dst").select(F.col("from_id").alias("src"), "dst").distinct()


def city_links(matches: DataFrame, edges: DataFrame, page: DataFrame, hops: int = 1, all_cities: bool = False) -> DataFrame:
    """GRF-2 to GRF-4: the link graph of matches(geoname_id, page_id): per city and article title the shortest way."""
    if all_cities and hops > 1:
        raise ValueError("all cities at once are limited to one hop")
    seeds = matches.filter("not is_redirect").select("geoname_id", F.col("page_id").alias("seed_page_id"), F.col("page_id").alias("node"))
    reached = bfs(edges, seeds, hops, ("geoname_id", "seed_page_id"))
    titles = page.filter("namespace = 0").select("page_id", "title")
    name = lambda key, out: titles.select(F.col("page_id").alias(key), F.col("title").alias(out))
    rows = reached.select("geoname_id", "seed_page_id", F.col("node").alias("article_page_id"), F.col("distance").alias("graph_distance"), F.coalesce("parent", "seed_page_id").alias("parent_page_id"))
    rows = rows.join(name("seed_page_id", "seed_title"), "seed_page_id").join(name("article_page_id", "article_title"), "article_page_id").join(name("parent_page_id", "parent_title"), "parent_page_id")
    return first_by(rows, ["geoname_id", "article_title"], "graph_distance", "seed_page_id", "parent_page_id", "article_page_id")


def graph_scores(graph: DataFrame, articles: DataFrame) -> DataFrame:
    """JOI-6, AGG-4, GRF-5, REL-6: page_id, graph_distance and 1 / (1 + distance) of articles whose title the graph holds."""
    keyed = articles.filter("not is_redirect").select("page_id", F.replace("title", F.lit(" "), F.lit("_")).alias("article_title"))
    # one row for each title, else a title that many articles have gives the square of their number
    best = graph.groupBy("article_title").agg(F.min("graph_distance").alias("graph_distance"))
    found = keyed.join(best, "article_title").groupBy("page_id").agg(F.min("graph_distance").alias("graph_distance"))
    return found.withColumn("graph_score", 1 / (1 + F.col("graph_distance")))
