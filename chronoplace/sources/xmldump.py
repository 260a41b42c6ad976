"""Articles from an XML dump (SRC-10, SRC-11, FLT-1 to FLT-3, JOI-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplace.functions.text import paragraphs

_SCHEMA = "id long, ns int, title string, redirect struct<_title: string>, revision array<struct<text: struct<_VALUE: string>>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, namespace, title, redirect_target, wikitext; Spark's XML source splits files at row tags."""
    pages = spark.read.format("xml").option("rowTag", "page").schema(_SCHEMA).load(path)
    text = F.try_element_at("revision", F.lit(1)).getField("text").getField("_VALUE")
    return pages.select(F.col("id").alias("page_id"), F.col("ns").alias("namespace"), "title", F.col("redirect._title").alias("redirect_target"), text.alias("wikitext"))


def articles(pages: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The article table: namespace 0, wanted ids only, before any text is cleaned; rows without a lead go, redirects stay."""
    rows = pages.filter("namespace = 0")
    if wanted is not None:
        rows = rows.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    blocks = F.when(F.col("redirect_target").isNull(), paragraphs(F.col("wikitext"))).otherwise(F.array().cast("array<string>"))
    out = rows.select("page_id", "title", blocks.alias("__p"), "redirect_target")
    return out.select(
        "page_id",
        "title",
        F.coalesce(F.try_element_at("__p", F.lit(1)), F.lit("")).alias("first_paragraph"),
        F.array_join("__p", "\n\n").alias("full_text"),
        F.col("redirect_target").isNotNull().alias("is_redirect"),
        "redirect_target",
    ).filter(F.col("is_redirect") | (F.length("first_paragraph") > 0))
