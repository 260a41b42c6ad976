"""Relations from SQL dumps: INSERT statements as text, one tuple per row (SRC-1 to SRC-9).

Both layouts are read: a whole statement on a line, and a header line followed
by lines of tuples. A table is one file, so every tuple of the right shape counts;
tuples are matched with strings that may hold escaped quotes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STRING = r"'((?:[^'\\]|\\.|'')*)'"


@dataclass(frozen=True)
class Relation:
    """A tuple pattern with one group for each column, and the columns' types."""

    pattern: str
    columns: tuple[tuple[str, str], ...]


# Leading fields of the dump tables; what follows them is skipped.
RELATIONS = {
    "page": Relation(rf"\((\d+),(-?\d+),{_STRING},([01])", (("page_id", "long"), ("namespace", "int"), ("title", "title"), ("is_redirect", "boolean"))),
    "linktarget": Relation(rf"\((\d+),(-?\d+),{_STRING}\)", (("target_id", "long"), ("namespace", "int"), ("title", "title"))),
    "categorylinks": Relation(
        rf"\((\d+),{_STRING},'[^']*',{_STRING},'[^']*','(page|subcat|file)',\d+,(\d+)\)", (("from_id", "long"), ("sortkey", "title"), ("prefix", "title"), ("cl_type", "string"), ("target_id", "long"))
    ),
    "pagelinks": Relation(r"\((\d+),(-?\d+),(\d+)\)", (("from_id", "long"), ("from_namespace", "int"), ("target_id", "long"))),
}


def unescape(value: Column) -> Column:
    """SRC-9: backslash quote, doubled quote, double backslash, in this order."""
    for a, b in (("\\'", "'"), ("''", "'"), ("\\\\", "\\")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def parse(lines: DataFrame, relation: Relation | str, value: str = "value") -> DataFrame:
    """SRC-3 to SRC-8: a row for each tuple in the lines; titles keep their underscores."""
    r = RELATIONS[relation] if isinstance(relation, str) else relation
    rows = lines.select(F.explode(F.regexp_extract_all(F.col(value), F.lit(r.pattern), F.lit(0))).alias("__t"))
    pick = lambda i, kind: unescape(F.regexp_extract("__t", r.pattern, i)) if kind == "title" else F.regexp_extract("__t", r.pattern, i)
    typed = lambda i, kind: (pick(i, kind) == "1") if kind == "boolean" else pick(i, kind).cast({"title": "string"}.get(kind, kind))
    return rows.select(*(typed(i + 1, kind).alias(name) for i, (name, kind) in enumerate(r.columns)))


def read(spark: SparkSession, path: str, relation: str, partitions: int | None = None) -> DataFrame:
    """SRC-1, SRC-2: a dump file, compressed or not. A gzip file is one split: `partitions` deals its lines out again."""
    lines = spark.read.option("ignoreCorruptFiles", "true").text(path)
    return parse(lines.repartition(partitions) if partitions else lines, relation)


def category_edges(categorylinks: DataFrame, linktarget: DataFrame, page: DataFrame) -> DataFrame:
    """JOI-11, AGG-14: distinct (parent, child) category edges; rows with an unresolved side go."""
    subcats = categorylinks.filter("cl_type = 'subcat'")
    parents = linktarget.filter("namespace = 14").select("target_id", F.col("title").alias("parent"))
    children = page.filter("namespace = 14").select(F.col("page_id").alias("from_id"), F.col("title").alias("child"))
    return subcats.join(parents, "target_id").join(children, "from_id").select("parent", "child").distinct()


def category_members(categorylinks: DataFrame, linktarget: DataFrame) -> DataFrame:
    """(page_id, category) of article memberships."""
    names = linktarget.filter("namespace = 14").select("target_id", F.col("title").alias("category"))
    return categorylinks.filter("cl_type = 'page'").join(names, "target_id").select(F.col("from_id").alias("page_id"), "category").distinct()
