"""Substring deduplication over a log-structured fingerprint index.

A word is removed if a window of 50 words that covers it also starts in a
document with a smaller doc_id. Windows are judged on the input.

1. Fingerprints. Each text's 25-word hashes are winnowed: every window of 50
   words has 26 of them, and the least is its anchor. Equal windows have equal
   anchors, so only anchors that more than one document holds can matter. There
   are about two anchors for every 27 words.
2. The index keeps (anchor, first doc_id, last doc_id) in immutable runs: tables
   bucketed and sorted by anchor. A new batch's run is merge-joined with each run
   of the history where it lies, without an exchange: anchors seen before, or in
   two documents of the batch, become candidates. When FANOUT runs of a level have
   gathered they are merged, bucket by bucket, into one of the next level, so a
   row is rewritten as often as there are levels. A manifest names the runs;
   `FingerprintIndex.open` takes an index up again in another session.
3. Verification. Documents that hold candidates are read again, and each maximal
   stretch of windows with one candidate anchor becomes a row with the 64-bit
   hashes of its windows, made from word hashes of another salt. (anchor, window
   hash) is the 128-bit identity of a window's word sequence. Equal stretches fold
   into one group with the least doc_id, which settles whole copies without pairs;
   only anchors with different stretches are compared window by window, by the
   least doc_id of each window. They are dealt by anchor and a salt, then by window,
   so an anchor that a third of all documents hold is spread over many tasks.
4. Removal spans return to their documents and are merged.

Nothing is gathered on the driver but batch bounds. Tables between the steps are
written to the shared folder, so a lost executor costs a task, not the job; each
is deleted once the next one stands.

Defined results: null or empty texts have no words; a null doc_id neither
removes nor loses words; rows with equal doc_id count as one document (a window
in two of them is not "smaller"); repeated rows give repeated results; input
columns other than doc_id and text are ignored. Bytes that aren't UTF-8 pass
through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplace.llm.textnp import NON_SPACE, SECOND, Words, chunks, covered, runs, strings, sums
from chronoplace.shared import cleaning, drop, fresh_path, materialise, remove

WINDOW = 50
GRAM = 25
#: Runs of one level that are merged into one of the next.
FANOUT = 2
#: Tasks that the stretches of one anchor are dealt to.
SALT = 16
#: Bytes of an Arrow batch of texts: a batch lies in the executor's direct memory, in its stream and in the worker at once.
BATCH = "2m"


def _window_anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, anchor) of every window: the least of the gram hashes that the window holds."""
    at = words.places(window)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    least = runs(words.hash, gram)
    width, have = window - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    rest = width - have
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    return at, least[at]


def _stretches(owner: np.ndarray, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Index of the first window of each maximal stretch of neighbouring windows of one text with one anchor."""
    fresh = np.ones(len(at), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
    return np.flatnonzero(fresh)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def fingerprints(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key and the distinct anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                at, anchor = _window_anchors(w := Words(chunk, NON_SPACE), window, gram)
                owner = w.owner()[at] if len(at) else at
                first = _stretches(owner, at, anchor)
                order = np.lexsort((anchor[first], owner[first]))
                o, a = owner[first][order], anchor[first][order]
                fresh = np.ones(len(o), bool)
                fresh[1:] = (o[1:] != o[:-1]) | (a[1:] != a[:-1])
                counts = np.bincount(o[fresh], minlength=chunk.n)
                ids = [batch.column(i).slice(chunk.first, chunk.n) for i in (0, 1)]
                lists = _lists(counts, pa.array(a[fresh].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*ids, lists], ["doc_id", "text_key", "anchors"])

    return docs.mapInArrow(run, "doc_id long, text_key long, anchors array<long>")


class FingerprintIndex:
    """Immutable runs of (anchor, first, last), bucketed and sorted by anchor; every method leaves older runs as they are."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.path = path or fresh_path(spark, "index")
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        #: (kind, level, path) of what the index consists of: runs, prints of each batch, found anchors.
        self.parts: list[tuple[str, int, str]] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that was built at path, by whatever session."""
        rows = spark.read.schema("version int, buckets int, fanout int, kind string, level int, part string").json(f"{path}/manifest-*").collect()
        last = max(r.version for r in rows)
        rows = [r for r in rows if r.version == last]
        index = cls(spark, path, rows[0].buckets, rows[0].fanout)
        index.parts, index.version = [(r.kind, r.level, r.part) for r in rows], last
        return index

    def _commit(self) -> None:
        """Writes the next manifest: a handful of rows for each level and batch."""
        self.version += 1
        rows = [(self.version, self.buckets, self.fanout, *part) for part in self.parts]
        self.spark.createDataFrame(rows, "version int, buckets int, fanout int, kind string, level int, part string").coalesce(1).write.json(f"{self.path}/manifest-{self.version:06d}")

    def _paths(self, kind: str, level: int | None = None) -> list[str]:
        return [p for k, n, p in self.parts if k == kind and level in (None, n)]

    def run(self, path: str) -> DataFrame:
        """A run as a table that Spark knows to be dealt by anchor."""
        name = "chronoplace_run_" + path.rpartition("-")[2]
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (anchor BIGINT, first BIGINT, last BIGINT) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _write_run(self, rows: DataFrame, level: int) -> str:
        path = fresh_path(self.spark, "run")
        name = "chronoplace_run_" + path.rpartition("-")[2]
        with cleaning(self.spark):
            rows.select("*").write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", path).option("compression", "zstd").saveAsTable(name)
        self.parts.append(("run", level, path))
        return path

    def _table(self, kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*self._paths(kind))

    def met(self, run: DataFrame, older: DataFrame) -> DataFrame:
        """Anchors that a batch's run shares with a run of the history: a merge join of buckets."""
        both = run.hint("merge").join(older.select("anchor", F.col("first").alias("f"), F.col("last").alias("l")), "anchor")
        # a document that two batches share is one document
        return both.filter("first != last or f != l or first != f").select("anchor")

    def add(self, batch: DataFrame) -> None:
        """Takes a batch in: its run, its candidates against the history, compaction."""
        prints = materialise(fingerprints(batch), "prints", batch=BATCH)
        rows = prints.select(F.explode("anchors").alias("anchor"), F.col("doc_id").alias("first"), F.col("doc_id").alias("last"))
        history = [self.run(p) for p in self._paths("run")]
        # combined before it is dealt, into as many parts as there are buckets: a task writes whole buckets
        with cleaning(self.spark, self.buckets):
            run = self.run(self._write_run(rows.groupBy("anchor").agg(F.min("first").alias("first"), F.max("last").alias("last")), 0))
        found = run.filter("first < last").select("anchor")
        for older in history:
            found = found.unionByName(self.met(run, older))
        self.parts += [("prints", 0, prints._chronoplace_path), ("found", 0, materialise(found, "found")._chronoplace_path)]
        level = 0
        while len(self._paths("run", level)) >= self.fanout:
            self.compact(level)
            level += 1
        self._commit()

    def compact(self, level: int) -> None:
        """Merges the runs of a level into one of the next, each bucket with its like."""
        old = self._paths("run", level)
        both = self.run(old[0])
        for path in old[1:]:
            other = self.run(path).select(F.col("anchor").alias("a"), F.col("first").alias("f"), F.col("last").alias("l"))
            both = both.hint("merge").join(other, F.col("anchor") == F.col("a"), "full").select(F.coalesce("anchor", "a").alias("anchor"), F.least("first", "f").alias("first"), F.greatest("last", "l").alias("last"))
        self._write_run(both, level + 1)
        self.parts = [p for p in self.parts if p[2] not in old]
        for path in old:
            self._forget(path)

    def _forget(self, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS chronoplace_run_{path.rpartition('-')[2]}")
        remove(self.spark, path)

    def close(self, delete: bool = False) -> None:
        """Takes the runs out of the session's catalogue; deletes the index if asked to."""
        for kind, _, path in self.parts:
            if kind == "run":
                self.spark.sql(f"DROP TABLE IF EXISTS chronoplace_run_{path.rpartition('-')[2]}")
            if delete:
                remove(self.spark, path)
        if delete:
            remove(self.spark, self.path)

    def candidates(self) -> DataFrame:
        """Anchors that two or more documents hold."""
        return self._table("found", "anchor long").distinct()

    def holders(self) -> DataFrame:
        """doc_id, text_key and the candidate anchors of each document that has any."""
        rows = self._table("prints", "doc_id long, text_key long, anchors array<long>").select("doc_id", "text_key", F.explode("anchors").alias("anchor"))
        return rows.join(self.candidates(), "anchor", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("anchors"))


def _windows(joined: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each stretch of windows with a candidate anchor: anchor, digest, doc_id, text_key, at, n, prints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3)
            for chunk in chunks(batch.column(2)):
                w = Words(chunk, NON_SPACE)
                at, anchor = _window_anchors(w, window, gram)
                if not len(at):
                    continue
                owner = w.owner()[at]
                mine = wanted.slice(chunk.first, chunk.n)
                # candidate anchors as (text, anchor) pairs; membership by search in a sorted composite
                pair_of = np.repeat(np.arange(chunk.n), np.asarray(mine.value_lengths().fill_null(0)))
                values = mine.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                good = np.zeros(len(at), bool)
                edges, firsts = np.searchsorted(owner, np.arange(chunk.n + 1)), np.searchsorted(pair_of, np.arange(chunk.n + 1))
                for i in range(chunk.n):
                    lo, hi = edges[i], edges[i + 1]
                    if lo < hi and firsts[i] < firsts[i + 1]:
                        good[lo:hi] = np.isin(anchor[lo:hi], values[firsts[i] : firsts[i + 1]])
                at, anchor, owner = at[good], anchor[good], owner[good]
                if not len(at):
                    continue
                prints = w.runs(window, SECOND)[at]
                first = _stretches(owner, at, anchor)
                last = np.append(first[1:], len(at))
                digest = sums(prints, first, last - first)
                ids = [batch.column(i).slice(chunk.first, chunk.n).take(pa.array(owner[first])) for i in (0, 1)]
                starts = (at[first] - w.first[owner[first]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[first].view(np.int64)), pa.array(digest.view(np.int64)), *ids, pa.array(starts), _lists(last - first, pa.array(prints.view(np.int64)))],
                    ["anchor", "digest", "doc_id", "text_key", "at", "prints"],
                )

    return joined.mapInArrow(run, "anchor long, digest long, doc_id long, text_key long, at long, prints array<long>")


def _by_print(prints: Column) -> Column:
    """(print, offsets) of each distinct window of a stretch: text that repeats itself gives a row, not one for each place."""
    plain = F.transform(prints, lambda p, i: F.struct(p.alias("print"), F.array(i).alias("offsets")))
    places = lambda p: F.filter(F.transform(prints, lambda x, i: F.when(x == p, i)), lambda i: i.isNotNull())
    few = F.transform(F.array_distinct(prints), lambda p: F.struct(p.alias("print"), places(p).alias("offsets")))
    return F.when(F.size(F.array_distinct(prints)) == F.size(prints), plain).otherwise(few)


def _spans(stretches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, the working table that they read); rows: doc_id, text_key, at, n: windows [at, at + n) of a document that also start in one with a smaller doc_id."""
    key = ["anchor", "digest"]
    folded = materialise(stretches.groupBy(*key).agg(F.min("doc_id").alias("least"), F.any_value("prints").alias("prints")), "folded")
    mixed = folded.groupBy("anchor").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo != hi")
    mixed = mixed.select("anchor", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = folded.withColumn("salt", F.pmod("digest", F.lit(SALT)).cast("int"))
    windows = salted.join(mixed, ["anchor", "salt"], "left_semi").select(*key, "least", F.inline(_by_print(F.col("prints"))))
    shared = windows.groupBy("anchor", "print").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).filter("lo < hi").drop("hi")
    later = windows.join(shared, ["anchor", "print"]).filter("least > lo")
    partly = later.groupBy(*key).agg(F.flatten(F.collect_list("offsets")).alias("offsets"))
    marks = folded.select(*key, "least").join(partly, key, "left")
    rows = stretches.select(*key, "doc_id", "text_key", "at", F.size("prints").alias("n")).join(marks, key)
    whole = rows.filter("doc_id > least").select("doc_id", "text_key", "at", F.col("n").cast("long").alias("n"))
    some = rows.filter("doc_id = least").select("doc_id", "text_key", F.explode(F.transform("offsets", lambda o: o + F.col("at"))).alias("at"), F.lit(1).cast("long").alias("n"))
    return whole.unionByName(some), folded


def _removed(joined: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text from (doc_id, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            for chunk in chunks(batch.column(1)):
                w = Words(chunk, NON_SPACE)
                mine = spans.slice(chunk.first, chunk.n)
                lengths = np.asarray(mine.value_lengths().fill_null(0))
                flat = mine.flatten()
                at, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                of = np.repeat(np.arange(chunk.n), lengths)
                hit = covered(len(w.starts), w.first[of] + at, n + window - 1) if len(at) else np.zeros(len(w.starts), bool)
                kept = ~hit
                texts = []
                for i in range(chunk.n):
                    lo, hi = w.first[i], w.first[i + 1]
                    own = kept[lo:hi]
                    texts.append(b" ".join(chunk.text(i).split()) if own.all() else b" ".join(x for x, k in zip(chunk.text(i).split(), own.tolist(), strict=True) if k))
                so_far = np.concatenate([[0], np.cumsum(hit)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.n), pa.array(w.counts.astype(np.int64)), pa.array((so_far[w.first[1:]] - so_far[w.first[:-1]]).astype(np.int64)), strings(texts)],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    if batches < 2:
        return []
    shares = [i / batches for i in range(1, batches)]
    got = docs.select(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 1000).alias("b")).first()["b"]
    return sorted(set(got or []))


def deduplicate(docs: DataFrame, batches: int = 3, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every row of docs(doc_id, text).

    The rows enter the index in `batches` ranges of doc_id, as they would arrive over time.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    known = docs.filter("doc_id is not null and text is not null")
    index = FingerprintIndex(spark)
    edges = [None, *_bounds(known, batches), None]
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = known
        part = part.filter(F.col("doc_id") > lo) if lo is not None else part
        part = part.filter(F.col("doc_id") <= hi) if hi is not None else part
        index.add(part)
    holders = materialise(index.holders(), "holders")
    index.close(delete=True)
    keys = ["doc_id", "text_key"]
    stretches = materialise(_windows(known.join(holders, keys).select(*keys, "text", "anchors"), window, gram), "stretches", batch=BATCH)
    drop(holders)
    found, folded = _spans(stretches)
    # a set, as rows that are repeated bring the same spans again
    spans = materialise(found.groupBy(*keys).agg(F.collect_set(F.struct("at", "n")).alias("spans")), "spans")
    drop(stretches, folded)
    joined = docs.join(spans, keys, "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<at:bigint,n:bigint>>")).alias("spans"))
    return _removed(joined, window)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


