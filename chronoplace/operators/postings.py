"""Inverted index and BM25 (REL-1, REL-2, TXT-10 to TXT-12, AGG-15, C4).

The index is written once: a row for each (term, page_id, col) with the term's
positions and, beside them, what scoring needs of the page (its length, whether it
is a redirect), and one row of corpus statistics. Each file holds the pages of one
task, as runs in the order of (term, page_id): nothing is shuffled or spilled, a
query's filter on terms leaves only the Parquet pages that hold them to be read, and
a common term is spread over all files. A row without a term holds each page's
length, for the statistics. A phrase is an intersection of shifted
position lists, so nothing is joined but one row set per word. N and the mean length
count redirects too; results leave them out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplace.functions.text import parse_place
from chronoplace.operators.aggregates import first_by
from chronoplace.shared import batches_of, cleaning, exists, fresh_path

COLUMNS = ("title", "first_paragraph", "full_text")
K1, B = 1.2, 0.75
NAMES = ["term", "page_id", "col", "positions", "n_tokens", "is_redirect"]
POSTINGS = "term string, page_id long, col string, positions array<int>, n_tokens int, is_redirect boolean"


def _bare(first: int, last: int) -> tuple[str, str]:
    """Lower-case letters in a range of code points whose canonical decomposition starts with an ASCII letter, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(first, last)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha() and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, BARE = _bare(0xC0, 0x1F00)
# Bit masks of the combining marks, from U+0300 and from U+0320 on, that belong to a token and are dropped from it.
MARKS = "".join(chr(0x300 + i) for i in range(32) if 0x08029FDF >> i & 1) + "".join(chr(0x320 + i) for i in range(18) if 0x000361F8 >> i & 1)


def tokens(value: Column) -> Column:
    """TXT-11: lower-case words of letters and digits, Latin letters without marks."""
    plain = F.translate(F.lower(F.coalesce(value, F.lit(""))), MARKED + MARKS, BARE)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def query_words(text: str) -> list[str]:
    """The tokenizer for one query string, on the driver."""
    table = str.maketrans(MARKED, BARE, MARKS)
    plain = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in text.strip().lower().translate(table))
    return plain.split()


#: Tokens that one sorted run of a file holds, about, and rows of it that are handed back at once.
RUN, BACK = 2_000_000, 100_000


def postings(articles: DataFrame) -> DataFrame:
    """The rows of an index, not yet written: runs of whole pages, each in the order of (term, page_id, col), and a row without a term for each page."""
    split = articles.select("page_id", "is_redirect", *(tokens(F.col(c)).alias(c) for c in COLUMNS))

    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = pa.Table.from_batches(held).combine_chunks()
        n, lists = len(pages), [pa.concat_arrays(pages.column(c).chunks) for c in COLUMNS]
        sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
        own, flags, length = pages.column("page_id").combine_chunks(), pages.column("is_redirect").combine_chunks(), pa.array(sum(sizes).astype(np.int32))
        none = pa.nulls(n, pa.string())
        yield pa.RecordBatch.from_arrays([none, own, none, pa.nulls(n, pa.list_(pa.int32())), length, flags], NAMES)
        words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        # places of words, pages and columns in the order of the rows; positions stay in order within them
        alphabet = pc.array_sort_indices(words.dictionary)
        place = np.empty(len(alphabet), np.int64)
        place[alphabet.to_numpy(zero_copy_only=False)] = np.arange(len(alphabet))
        by_page = pc.sort_indices(pages.select(["page_id"]), sort_keys=[("page_id", "ascending")])
        page_place = np.empty(n, np.int64)
        page_place[by_page.to_numpy(zero_copy_only=False)] = np.arange(n)
        key = place[words.indices.to_numpy(zero_copy_only=False)] * (3 * n)
        key += np.concatenate([np.repeat(page_place * 3 + i, x) for i, x in enumerate(sizes)])
        at = np.concatenate([np.arange(x.sum()) - np.repeat(np.cumsum(x) - x, x) for x in sizes]).astype(np.int32)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        ends, key = np.append(first, len(at)), key[first]
        page = pc.take(by_page, pa.array(key % (3 * n) // 3))
        terms, names = words.dictionary.take(alphabet), pa.array(COLUMNS)
        for i in range(0, len(key), BACK):
            part, page_part = key[i : i + BACK], page.slice(i, BACK)
            edges = ends[i : i + BACK + 1]
            positions = pa.ListArray.from_arrays(pa.array((edges - edges[0]).astype(np.int32)), pa.array(at[edges[0] : edges[-1]]))
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(part // (3 * n))), own.take(page_part), names.take(pa.array(part % 3)), positions, length.take(page_part), flags.take(page_part)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += sum(len(batch.column(c).flatten()) for c in COLUMNS)
            if n >= RUN:
                yield from rows(held)
                held, n = [], 0
        if held:
            yield from rows(held)

    # all words of a page stand in its own row, so nothing is shuffled to bring them together
    return split.mapInArrow(run, POSTINGS)


def statistics(written: DataFrame) -> DataFrame:
    """One row: pages and their mean length, redirects and pages without words included."""
    return written.filter("term is null").agg(F.count("*").alias("n_all"), F.avg("n_tokens").alias("avg_tokens"))


@dataclass(frozen=True)
class TextIndex:
    """A written index. `postings`: see POSTINGS; n_all and avg_tokens are its one row of statistics."""

    postings: DataFrame
    n_all: int
    avg_tokens: float
    path: str

    @classmethod
    def build(cls, articles: DataFrame, path: str | None = None) -> TextIndex:
        """SNK-12, SNK-6: writes the index; statistics last, so that only a whole index has them."""
        spark = articles.sparkSession
        path = path or fresh_path(spark, "text-index")
        with cleaning(spark), batches_of(spark, "4m"):
            postings(articles).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(f"{path}/postings")
            statistics(spark.read.schema(POSTINGS).parquet(f"{path}/postings")).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TextIndex:
        if not exists(spark, f"{path}/statistics/_SUCCESS"):
            raise FileNotFoundError(f"no text index at {path}: build it with TextIndex.build")
        row = spark.read.schema("n_all long, avg_tokens double").parquet(f"{path}/statistics").first()
        return cls(spark.read.schema(POSTINGS).parquet(f"{path}/postings").filter("term is not null"), row.n_all, row.avg_tokens or 0.0, path)

    def of(self, words: list[str]) -> TextIndex:
        """The index cut down to a query's words; the filter reaches the scan."""
        return TextIndex(self.postings.filter(F.col("term").isin(sorted(set(words)))), self.n_all, self.avg_tokens, self.path)


def phrase_hits(index: TextIndex, words: list[str], column: str | None = None) -> DataFrame:
    """TXT-12: page_id, the number of places where the words stand in a row within one column, n_tokens and is_redirect."""
    rows = index.postings if column is None else index.postings.filter(F.col("col") == column)
    if not words:
        return rows.select("page_id", F.lit(0).cast("long").alias("hits"), "n_tokens", "is_redirect").limit(0)
    found = rows.filter(F.col("term") == words[0]).select("page_id", "col", "n_tokens", "is_redirect", F.col("positions").alias("at"))
    for i, word in enumerate(words[1:], 1):
        shifted = _shifted(rows, word, i)
        found = found.join(shifted, ["page_id", "col"]).withColumn("at", F.array_intersect("at", "next")).drop("next").filter(F.size("at") > 0)
    return found.groupBy("page_id").agg(F.sum(F.size("at")).alias("hits"), F.max("n_tokens").alias("n_tokens"), F.max("is_redirect").alias("is_redirect"))


def _shifted(rows: DataFrame, word: str, by: int) -> DataFrame:
    return rows.filter(F.col("term") == word).select("page_id", "col", F.transform("positions", lambda p: p - by).alias("next"))


def bm25(index: TextIndex, phrases: list[list[str]]) -> DataFrame:
    """REL-1: page_id and bm25_score of the pages, redirects aside, that hold every phrase.

    A phrase's document frequency is a count over its own hits, one row beside them.
    """
    parts = []
    for words in phrases:
        hits = phrase_hits(index, words)
        scored = hits.crossJoin(F.broadcast(hits.agg(F.count("*").alias("n"))))
        idf = F.ln((index.n_all - F.col("n") + 0.5) / (F.col("n") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        weight = idf * F.col("hits") * (K1 + 1) / (F.col("hits") + K1 * (1 - B + B * F.col("n_tokens") / index.avg_tokens)) if index.avg_tokens else F.lit(0.0)
        parts.append(scored.filter("not is_redirect").select("page_id", weight.alias("w")))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.groupBy("page_id").agg(F.sum("w").alias("bm25_score"), F.count("*").alias("k")).filter(F.col("k") == len(phrases)).drop("k")


def text_candidates(index: TextIndex, place: str) -> DataFrame:
    """REL-2: strict phrase (tier 2) before all parts in any order (tier 1), with title and lead flags of the city."""
    parts = [query_words(p) for p in parse_place(place)]
    index = index.of([w for p in parts for w in p])
    if not parts:
        return index.postings.select("page_id", F.lit(0.0).alias("bm25_score"), F.lit(0).alias("query_match_tier"), F.lit(False).alias("exact_title_match"), F.lit(False).alias("lead_exact_match")).limit(0)
    strict = bm25(index, [[w for p in parts for w in p]]).withColumn("query_match_tier", F.lit(2))
    relaxed = bm25(index, parts).withColumn("query_match_tier", F.lit(1))
    out = first_by(strict.unionByName(relaxed), "page_id", F.desc("query_match_tier"))
    for column, flag in (("title", "exact_title_match"), ("first_paragraph", "lead_exact_match")):
        hit = phrase_hits(index, parts[0], column).select("page_id", F.lit(True).alias(flag))
        out = out.join(hit, "page_id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out
