"""Searches in blocks, in many parts and with nodes that are reached very often give what one plain search gives."""

import random

import pytest
from pyspark.sql import functions as F

from chronoplace.operators import graph


def brute(links, seeds, hops):
    out = []
    for key, starts in seeds.items():
        seen, level = set(starts), {n: None for n in starts}
        for distance in range(hops + 1):
            out += [(key, node, distance, parent) for node, parent in level.items()]
            step = {}
            for node in level:
                for to in links.get(node, set()) - seen:
                    step[to] = min(node, step.get(to, node))
            seen |= set(step)
            level = step
    return sorted(out, key=str)


@pytest.mark.parametrize("short,seen,pairs", [(50_000, 200_000, 1_000_000), (40, 10, 20), (40, 10**6, 500), (3, 0, 7)])
def test_bfs_agrees_with_plain_searches(spark, monkeypatch, short, seen, pairs):
    for name, value in {"SHORT": short, "SEEN": seen, "PAIRS": pairs}.items():
        monkeypatch.setattr(graph, name, value, raising=False)
    draw = random.Random(3)
    links = {f"n{i}": {f"n{draw.randrange(60)}" for _ in range(3)} | {"hub"} for i in range(60)} | {"hub": {"n1", "n2", "n3"}}
    seeds = {k: {f"n{draw.randrange(60)}" for _ in range(3)} for k in range(25)}
    edges = spark.createDataFrame([(a, b) for a, to in links.items() for b in to], "src string, dst string")
    starts = spark.createDataFrame([(k, n) for k, own in seeds.items() for n in own], "city long, node string")
    got = graph.bfs(edges, starts, 3, ("city",)).select("city", "node", "distance", "parent").collect()
    assert sorted(map(tuple, got), key=str) == brute(links, seeds, 3)
    alone = graph.bfs(edges, starts.filter("city = 0").select("node"), 3).select("node", "distance", "parent").collect()
    assert sorted(((0, *r) for r in alone), key=str) == brute(links, {0: seeds[0]}, 3)


def test_pairs_are_not_shuffled(spark, monkeypatch):
    written = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(df) or cut(df))
    monkeypatch.setattr(graph, "PAIRS", 100, raising=False)
    edges = spark.range(400).select((F.col("id") % 20).alias("src"), (F.col("id") + 1000).alias("dst"))
    seeds = spark.range(100).select(F.col("id").alias("city"), (F.col("id") % 20).alias("node"))
    assert graph.bfs(edges, seeds, 1, ("city",)).count() == 100 + 100 * 20
    plan = written[-1]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(city" not in plan and "hashpartitioning(dst" in plan and ", 20), REPARTITION_BY_NUM" in plan
