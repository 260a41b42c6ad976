"""Nearest vectors for query sets of any size."""

from pyspark.sql import functions as F

from chronoplace.operators import vectors


def test_queries_beyond_one_block(spark):
    n = 10_050
    queries = spark.range(n).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), (F.col("id") % 3 - 1).cast("double")).alias("query"))
    pages = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, -1.0]), (3, [0.5, 0.0])], "page_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.page_id for r in vectors.top_batch(pages, queries, 2).collect()}
    best = {0: (2, 3), 1: (3, 1), 2: (1, 3)}
    assert got == {(q, i + 1): best[q % 3][i] for q in range(n) for i in range(2)}
