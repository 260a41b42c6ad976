"""Registered queries do the whole job: against their SQL, or brute force in Python."""

import os
import re

import duckdb
import pytest

from chronoplace.plans import queries

SF = "/root/testdata/sf0.001"


def whole(name):
    """Rows of the query's SQL, in order."""
    sql = queries.SQL[name]
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return sorted(db.execute(sql).fetchall())


def rows(spark, name):
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, SF).collect())


@pytest.mark.parametrize("name", ["rrf_fusion", "dense_lookup", "graph_score", "graph_scope_semi", "linked_search", "country_search"])
def test_whole_tables_agree_with_sql(spark, name):
    got, expected = rows(spark, name), whole(name)
    assert any(r[0] % 2 for r in got) and len(got) == len(expected)
    for a, b in zip(got, expected):
        assert [x for x in a if not isinstance(x, float)] == [x for x in b if not isinstance(x, float)]
        assert [x for x in a if isinstance(x, float)] == pytest.approx([x for x in b if isinstance(x, float)], abs=2e-5)
    assert "documents" in queries.SQL[name] and " % 2 = 0" not in queries.SQL[name]


def test_link_bfs_reaches_words_and_pages(spark):
    links = {}
    for page, html in duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall():
        links.setdefault(str(page), set())
        for word in re.findall(r'href="(/[^"]+)"', html or ""):
            links[str(page)].add(word)
            links.setdefault(word, set()).add(str(page))
    expected = []
    for city in (n for n in links if not n.startswith("/") and int(n) % 20 == 0):
        seen, level = {city}, [(city, None)]
        for distance in range(3):
            expected += [(int(city), node, distance, parent) for node, parent in level]
            step = {}
            for node, _ in level:
                for to in links[node] - seen:
                    step[to] = min(node, step.get(to, node))
            seen |= set(step)
            level = list(step.items())
    got = [(r.city, r.node, r.distance, r.parent) for r in queries.link_bfs(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert max(r[2] for r in got) == 2
