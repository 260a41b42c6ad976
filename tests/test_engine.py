"""The engine's operators on small literal tables."""

from pyspark.sql import functions as F

from chronoplace.functions import text
from chronoplace.operators import ranking, retrieval
from chronoplace.sources import sqldump


def test_scope_filters(spark):
    pages = spark.createDataFrame([(1, "France"), (2, "United States"), (3, '["France"]'), (4, None)], "page_id long, country string")
    assert sorted(r.page_id for r in pages.filter(retrieval.country_match(" france")).collect()) == [1, 3]
    assert pages.filter(retrieval.country_match(None)).count() == 4
    links = spark.createDataFrame([(2, 1), (3, 2)], "page_id long, graph_distance int")
    assert sorted(r.page_id for r in retrieval.restrict_to_graph(pages, links).collect()) == [2, 3]
    assert retrieval.restrict_to_graph(pages, links.limit(0)).count() == 0


def test_cleanup_and_lead(spark):
    rows = spark.createDataFrame([("thumb|A caption", "220px|thumb|left|x\n'''Bold''' [[a|b]] &amp; c")], "lead string, body string")
    r = rows.select(text.clean_text(F.col("body")).alias("t"), text.article_lead(F.col("lead"), F.col("body")).alias("l")).first()
    assert r.t == "Bold b & c" and r.l == "Bold b & c"


def test_dump_tuples_with_escaped_quotes(spark):
    lines = spark.createDataFrame([("INSERT INTO `page` VALUES (1,14,'It\\'s',0,0),(2,0,'A''b',1,0)",), ("(3,0,'Plain_one',0,0);",)], "value string")
    got = sorted(tuple(r) for r in sqldump.parse(lines, "page").collect())
    assert got == [(1, 14, "It's", False), (2, 0, "A'b", True), (3, 0, "Plain_one", False)]


def test_fusion_order(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "page_id long, rank int")
    b = spark.createDataFrame([(2, 1)], "page_id long, rank int")
    got = {r.page_id: (round(r.rrf_score, 9), r.rrf_sources) for r in ranking.fuse({"bm25_strict": a, "graph": b}).collect()}
    assert got == {1: (round(4 / 61, 9), "bm25_strict"), 2: (round(4 / 62, 9), "bm25_strict,graph")}
