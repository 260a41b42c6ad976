"""Native span finding: where a pattern's matches stand in a text, in code points.

Spark has functions for the matched strings and for the pieces between them, but
none for positions. `split` and `regexp_extract_all` walk the same leftmost,
non-overlapping matches, so pieces and matches alternate and a running sum of
their lengths gives each match's place. All of it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,kind:string,order:int,value:string>>"


def nothing() -> Column:
    return F.array().cast(SPAN)


def find(text: Column, pattern: str, kind: str, order: int, valid: Callable[[Column], Column], guard: Column | None = None) -> Column:
    """Spans of the leftmost, non-overlapping matches that are `valid`; failing ones are dropped without another try.

    `pattern` must not match the empty string. `guard`, if given, is a cheap
    condition that any text with a match meets; other texts skip the scan.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), nothing().alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.length(x["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.lit(order).alias("order"), x["value"].alias("value"))
        kept = F.concat(acc["spans"], F.array(span)).cast(SPAN)
        return F.struct(end.alias("at"), F.when(valid(x["value"]), kept).otherwise(acc["spans"]).alias("spans"))

    both = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda a, b: F.struct(a.alias("piece"), b.alias("value")))
    spans = F.aggregate(both, start, step, lambda acc: acc["spans"])
    return spans if guard is None else F.when(guard, spans).otherwise(nothing())


def in_order(spans: Column) -> Column:
    """By start, then by kind as listed, then by end."""
    return F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["order"], s["end"], s["kind"], s["value"]))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["order"].alias("order"), s["value"].alias("value")),
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replace(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with each span, in order, replaced by mark(kind). Where spans overlap, the earlier one's mark stands for all that they cover."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        parts = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap, mark(s["kind"])))).otherwise(acc["parts"])
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), parts.alias("parts"))

    def last(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, last))
