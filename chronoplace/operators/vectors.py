"""Dense vectors (VEC-*, JOI-15, JOI-18, TOP-2, TOP-3): exact inner products, never an approximation by default."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoplace.checks import assert_dimension, assert_unique
from chronoplace.functions.text import fold_alias
from chronoplace.operators.aggregates import missing
from chronoplace.shared import filesystem


def dot(a: Column, b: Column) -> Column:
    """VEC-1, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def scores(vectors: DataFrame, query: list[float], scope: DataFrame | None = None) -> DataFrame:
    """JOI-15: page_id and dense_score; the scope cuts ids before vectors are touched, ids without a vector drop out."""
    rows = vectors if scope is None else vectors.join(scope.select("page_id"), "page_id", "left_semi")
    return rows.select("page_id", dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))).alias("dense_score"))


def top(vectors: DataFrame, query: list[float], k: int = 200, scope: DataFrame | None = None) -> DataFrame:
    """TOP-2, TOP-3: the k best, ties by page_id; a heap per task, no full sort."""
    return scores(vectors, query, scope).orderBy(F.desc("dense_score"), "page_id").limit(k)


#: Queries that are sent to the executors at once, about: blocks are cut by hash.
BLOCK = 5_000


def top_batch(vectors: DataFrame, queries: DataFrame, k: int = 200) -> DataFrame:
    """JOI-18: the k best for each of queries(query_id, query), a stated query set that is sent in blocks of about BLOCK.

    A block is multiplied with each batch of vectors; only the k best of a batch leave it, so what is shuffled are at
    most k rows for each query and batch, not the product.
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(lambda a, b: a.unionByName(b), [_top_block(vectors, queries.filter(block == i), k) for i in range(blocks)])


def _top_block(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query")).filter("query is not null").collect()
    ids, wanted = np.array([r.query_id for r in rows], np.int64), np.array([r.query for r in rows], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(ids):
                continue
            pages, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for at in range(0, len(pages), 2048):
                part, own = lists.slice(at, 2048), pages[at : at + 2048]
                if (np.asarray(part.value_lengths()) != wanted.shape[1]).any():
                    raise ValueError("vectors and queries differ in length")
                matrix = part.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                for q in range(0, len(ids), 512):
                    # equal vectors get equal scores wherever they stand in the block
                    found = np.round(wanted[q : q + 512] @ matrix.T, 12)
                    best = np.lexsort((np.broadcast_to(own, found.shape), -found))[:, :k]
                    n = best.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[q : q + 512], n)), pa.array(own[best].ravel()), pa.array(np.take_along_axis(found, best, 1).ravel())], ["query_id", "page_id", "dense_score"]
                    )

    pairs = vectors.filter("embedding is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    pairs = pairs.mapInArrow(run, "query_id long, page_id long, dense_score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dense_score"), "page_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def embed(articles: DataFrame, model: Callable[[list[str]], list[list[float]]], done: DataFrame | None = None, least: int = 50) -> DataFrame:
    """VEC-2, FLT-5, SNK-7: vectors of eligible leads that aren't done yet, from an injected model."""
    wanted = eligible(articles, least)
    wanted = wanted if done is None else missing(wanted, done, "page_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch.page_id, "embedding": list(model(batch.first_paragraph.tolist()))})

    return wanted.select("page_id", "first_paragraph").mapInPandas(run, "page_id long, embedding array<float>")


def eligible(articles: DataFrame, least: int = 50) -> DataFrame:
    """FLT-5."""
    return articles.filter(F.length("first_paragraph") > least)


def checked(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """SRC-21, VEC-4: a store that may be searched: every id once, every vector of one length."""
    assert_unique(vectors, "page_id", "vectors")
    assert_dimension(vectors, "embedding", size)
    return vectors


def read_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-14: the files embeddings_{start}_{end}.parquet of a folder as one store; any other name is an error."""
    fs, at = filesystem(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    names = [n for n in names if not n.startswith(("_", "."))]
    if odd := [n for n in names if not re.fullmatch(r"embeddings_\d+_\d+\.parquet", n)]:
        raise ValueError(f"not checkpoints: {sorted(odd)}")
    if not names:
        raise FileNotFoundError(f"no checkpoints in {folder}")
    names.sort(key=lambda n: int(n.split("_")[1]))
    return spark.read.schema("page_id long, embedding array<float>").parquet(*(f"{folder.rstrip('/')}/{n}" for n in names))


def query_vector(place: str, cities: DataFrame | None, model: Callable[[list[str]], list[list[float]]] | None) -> list[float] | None:
    """VEC-3: the city's own vector, else the model's for a place without a comma, else none (no dense branch).

    cities: normalized_alias and embedding.
    """
    if cities is not None:
        own = cities.filter((F.col("normalized_alias") == fold_alias(place)) & F.col("embedding").isNotNull()).select("embedding").orderBy("embedding").first()
        if own:
            return list(own.embedding)
    if model is None or "," in place:
        return None
    return [float(x) for x in model([place])[0]]
