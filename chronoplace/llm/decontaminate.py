"""Benchmark decontamination with an FM-index per training shard.

A window is 13 consecutive words of a benchmark item (a shorter item is one
window). For each shard of documents an FM-index is built over word codes: the
suffix array gives the Burrows-Wheeler transform, a wavelet matrix over it
answers ranks, and all windows are searched backwards at once. Occurrences are
located by walking to sampled suffix positions; their spans are merged.

What enters the index: words outside the benchmark's vocabulary can't be part of
an occurrence, nor can a word pair that no item has. So a shard's text is cut to
the stretches whose neighbouring word pairs all occur in items and that are as
long as the shortest window. That loses no occurrence, and documents without
benchmark text cost a vocabulary lookup. A shard closes when SHARD_SYMBOLS words
have entered or SHARD_BYTES of text have been read, which bounds memory whatever
the partition holds. Indexes aren't kept: cut to one benchmark's stretches, an
index can't serve another, and an index of whole texts would be larger than they.

The benchmark is a stated query set: it is split into blocks of at most
BLOCK_WORDS words by item, each block is one map over all documents, and no
shuffle takes place. Words are lower-cased (A-Z) runs of ASCII letters, digits
and non-ASCII characters.

Defined results: null or empty texts have no words and are clean; items without
words are ignored; a null item_id is written as the empty string; items with
equal ids count once; repeated documents give repeated results; bytes that
aren't UTF-8 count as word characters and pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplace.llm.textnp import ALNUM, Words, chunks, covered, strings
from chronoplace.shared import materialise

WINDOW = 13
#: A shard closes when so many words have entered its index, or so many bytes of text have been read for it.
SHARD_SYMBOLS, SHARD_BYTES = 1 << 18, 8 << 20
BLOCK_WORDS = 1 << 21
#: Blocks that documents pass through in one go.
AT_ONCE = 4
SAMPLE = 8


class WaveletMatrix:
    """rank(c, i): how often c stands before position i, for arrays of c and i."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.bits = max(1, int(top).bit_length())
        self.zeros, self.split = [], []
        for level in reversed(range(self.bits)):
            bit = (values >> level) & 1 == 1
            ahead = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~bit, out=ahead[1:])
            self.zeros.append(ahead)
            self.split.append(int(ahead[-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for depth, (zeros, split) in enumerate(zip(self.zeros, self.split, strict=True)):
            one = (c >> (self.bits - 1 - depth)) & 1 == 1
            i = np.where(one, split + i - zeros[i], zeros[i])
            start = np.where(one, split + start - zeros[start], zeros[start])
        return i - start


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """By prefix doubling; `ranks` must make every suffix differ in the end (separators are unique)."""
    n, step = len(ranks), 1
    order = np.argsort(ranks, kind="stable")
    while True:
        fresh = np.ones(n, bool)
        fresh[1:] = ranks[order[1:]] != ranks[order[:-1]]
        now = np.empty(n, np.int64)
        now[order] = np.cumsum(fresh) - 1
        if fresh.all():
            return order
        after = np.zeros(n, np.int64)
        after[: n - step] = now[step:] + 1
        ranks = now * (n + 1) + after
        order = np.argsort(ranks, kind="stable")
        step *= 2


class FMIndex:
    """Over runs of codes 1..top; each run is followed by a separator of its own."""

    def __init__(self, codes: np.ndarray, top: int) -> None:
        sep = codes == 0
        n_sep = int(sep.sum())
        order = suffix_array(np.where(sep, np.cumsum(sep) - 1, codes + n_sep))
        before = codes[order - 1]  # the last position is a separator, so position 0 wraps to one
        self.bwt, self.wavelet = before, WaveletMatrix(before, top)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=top + 1))])
        sampled = (order % SAMPLE == 0) | (before == 0)  # runs' starts too: no walk crosses a separator
        self.sampled, self.place = sampled, np.where(sampled, order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the suffixes that start with each pattern (all of one length)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        alive = np.arange(len(patterns))
        for j in reversed(range(patterns.shape[1])):
            c = patterns[alive, j]
            lo[alive], hi[alive] = self.below[c] + self.wavelet.rank(c, lo[alive]), self.below[c] + self.wavelet.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        hi[np.setdiff1d(np.arange(len(patterns)), alive, assume_unique=True)] = 0
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            done = self.sampled[rows[open_]]
            out[open_[done]] = self.place[rows[open_[done]]] + steps
            open_ = open_[~done]
            c = self.bwt[rows[open_]]
            rows[open_] = self.below[c] + self.wavelet.rank(c, rows[open_])
            steps += 1
        return out


class Phrases:
    """A block of benchmark windows as codes: vocabulary, known pairs, patterns by length, items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        words = [(str(i), Words(c, ALNUM, True)) for i, t in items for c in chunks(pa.array([t], pa.string()))]
        words = [(i, w.hash) for i, w in words if len(w.starts)]
        self.vocabulary = np.unique(np.concatenate([h for _, h in words])) if words else np.zeros(0, np.uint64)
        at: dict[bytes, set[str]] = {}
        pairs = [np.zeros(0, np.int64)]
        for item, h in words:
            codes = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int64)
            pairs.append(self.pair(codes[:-1], codes[1:]))
            k = min(window, len(codes))
            for j in range(len(codes) - k + 1):
                at.setdefault(codes[j : j + k].tobytes(), set()).add(item)
        self.pairs = np.unique(np.concatenate(pairs))
        by_length: dict[int, list[bytes]] = {}
        for key in at:
            by_length.setdefault(len(key) // 8, []).append(key)
        self.patterns = {k: (np.frombuffer(b"".join(v), np.int64).reshape(-1, k), [sorted(at[x]) for x in v]) for k, v in by_length.items()}
        self.shortest = min(by_length, default=0)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * (len(self.vocabulary) + 1) + b

    def codes(self, words: Words) -> np.ndarray:
        """1 and up for words of the vocabulary, 0 for others."""
        if not len(self.vocabulary):
            return np.zeros(len(words.starts), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words.hash, at + 1, 0)

    def stretches(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """codes; first and last + 1 word of each stretch that may hold an occurrence."""
        codes = self.codes(words)
        n = len(codes)
        if not n or not self.shortest:
            return codes, np.zeros(0, np.int64), np.zeros(0, np.int64)
        tied = np.zeros(n, bool)  # to the word before
        maybe = np.flatnonzero((codes[1:] > 0) & (codes[:-1] > 0)) + 1
        if len(self.pairs) and len(maybe):
            key = self.pair(codes[maybe - 1], codes[maybe])
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            tied[maybe[self.pairs[at] == key]] = True
        firsts = words.first[:-1]
        tied[firsts[firsts < n]] = False
        start = np.flatnonzero((codes > 0) & ~tied)
        stop = np.flatnonzero((codes > 0) & ~np.append(tied[1:], False)) + 1
        long = stop - start >= self.shortest
        return codes, start[long], stop[long]


class _Member:
    """What a shard keeps of a chunk: its place in the batch and its texts' words, not their bytes."""

    def __init__(self, words: Words) -> None:
        self.row, self.n, self.first, self.counts = words.chunk.first, words.chunk.n, words.first, words.counts


class _Shard:
    """Documents since the last index was built, and their stretches."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.word: list[np.ndarray] = []
        self.members: list[_Member] = []
        self.symbols = self.words = self.bytes = 0

    def take(self, words: Words, codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        if len(start):
            length = stop - start
            at = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            ends = np.cumsum(length)
            self.codes.append(np.insert(codes[at], ends, 0))
            self.word.append(np.insert(at, ends, -1) + self.words * (np.insert(at, ends, -1) >= 0))
            self.symbols += len(self.codes[-1])
        self.words += len(codes)
        self.bytes += len(words.chunk.data)
        self.members.append(_Member(words))

    @property
    def full(self) -> bool:
        return self.symbols >= SHARD_SYMBOLS or self.bytes >= SHARD_BYTES

    def hits(self, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, int, list]]:
        """(first words, pattern of each, length, items of patterns) for each window length."""
        if not self.codes:
            return
        codes, word = np.concatenate(self.codes), np.concatenate(self.word)
        index = FMIndex(codes, len(phrases.vocabulary))
        for k, (patterns, items) in phrases.patterns.items():
            lo, hi = index.search(patterns)
            n = hi - lo
            if n.sum():
                rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                yield word[index.locate(rows)], np.repeat(np.arange(len(patterns)), n), k, items


def _close(shard: _Shard, phrases: Phrases, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a shard with this block's spans and items added to those of the blocks before."""
    members = shard.members
    starts = np.cumsum([0, *(len(m.first) and int(m.first[-1]) for m in members)])
    edges, pairs = [], set()
    owner = np.concatenate([starts[k] + m.first[:-1] for k, m in enumerate(members)])  # first word of each text
    filled = np.flatnonzero(np.concatenate([m.counts for m in members]) > 0)
    for at, pattern, k, items in shard.hits(phrases):
        edges.append((at, k))
        both = np.unique(filled[np.searchsorted(owner[filled], at, "right") - 1] * len(items) + pattern)
        for d, p in zip((both // len(items)).tolist(), (both % len(items)).tolist(), strict=True):
            pairs.update((d, i) for i in items[p])
    found: dict[int, list[str]] = {}
    for d, i in pairs:
        found.setdefault(d, []).append(i)
    hit = np.zeros(shard.words, bool)
    for at, k in edges:
        hit |= covered(len(hit), at, k)
    done = 0
    for m, w in enumerate(members):
        own = hit[starts[m] : starts[m + 1]]
        rows = batch.slice(w.row, w.n)
        old_spans, old_items = rows.column(3).to_pylist(), rows.column(4).to_pylist()
        spans, items = [], []
        for i in range(w.n):
            mine = own[w.first[i] : w.first[i + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))) if mine.any() else mine[:0]
            spans.append((old_spans[i] or []) + [{"at": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            items.append((old_items[i] or []) + sorted(found.get(done + i, [])))
        done += w.n
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(w.counts.astype(np.int64)), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string())), rows.column(5)], _NAMES)


def _scan(phrases: Phrases, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shard = _Shard()
        for chunk in chunks(batch.column(1)):
            words = Words(chunk, ALNUM, True)
            shard.take(words, *phrases.stretches(words))
            if shard.full:
                yield from _close(shard, phrases, batch)
                shard = _Shard()
        if shard.members:
            yield from _close(shard, phrases, batch)


_SPANS = pa.list_(pa.struct([("at", pa.int64()), ("end", pa.int64())]))
_NAMES = ["doc_id", "text", "n_words", "spans", "items", "extra"]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges spans; n_hit, and the text without them."""
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            w = Words(chunk, ALNUM, True)
            rows = batch.slice(chunk.first, chunk.n)
            texts, merged, hits, items = rows.column(1).cast(pa.binary()).to_pylist(), [], [], []
            for i, (spans, named) in enumerate(zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), strict=True)):
                out: list[dict] = []
                for s in sorted(spans, key=lambda s: s["at"]):
                    if out and s["at"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], s["end"])
                    else:
                        out.append(dict(s))
                merged.append(out)
                hits.append(sum(s["end"] - s["at"] for s in out))
                items.append(sorted(set(named)))
                if out:
                    whole, first, at, parts = chunk.text(i), w.first[i], 0, []
                    for s in out:
                        begin, end = w.starts[first + s["at"]] - chunk.bounds[i], w.ends[first + s["end"] - 1] - chunk.bounds[i]
                        parts.append(whole[at:begin])
                        at = end
                    texts[i] = b"".join([*parts, whole[at:]])
            yield pa.RecordBatch.from_arrays([rows.column(0), strings(texts), rows.column(2), pa.array(hits, pa.int64()), pa.array(merged, _SPANS), pa.array(items, pa.list_(pa.string())), rows.column(5)], ["doc_id", "kept_text", "n_words", "n_hit", "spans", "items", "extra"])


def _blocks(benchmark: DataFrame) -> Iterator[Phrases]:
    """The benchmark in blocks whose size is checked before any is sent."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).filter("t is not null")
    words = items.agg(F.sum(F.floor(F.length("t") / 2) + 1)).first()[0] or 0
    n = max(1, -(-int(words) // BLOCK_WORDS))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield Phrases([(r.i, r.t) for r in part.collect()])


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, kept_text, n_words, n_hit, spans (of words), items and extra (the other columns) of every row of docs."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    extra = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("int")
    spans = "array<struct<at:bigint,end:bigint>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(spans).alias("spans"), F.array().cast("array<string>").alias("items"), extra.alias("extra"))
    kind = rows.schema["extra"].dataType.simpleString()
    shape = f"doc_id long, text string, n_words long, spans {spans}, items array<string>, extra {kind}"
    waiting: list[Phrases] = []
    for phrases in _blocks(benchmark):
        if len(waiting) == AT_ONCE:
            rows = materialise(rows.mapInArrow(_scans(waiting), shape), "decontaminate")
            waiting = []
        waiting.append(phrases)
    scans = _scans(waiting)
    # scans and merging follow each other in one worker
    return rows.mapInArrow(lambda batches: _finish(scans(batches)), f"doc_id long, kept_text string, n_words long, n_hit long, spans {spans}, items array<string>, extra {kind}")


def _scans(blocks: list[Phrases]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One block's scan after the other's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for phrases in blocks:
            batches = _scan(phrases, batches)
        return batches

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; from the others, occurrences are cut out. Columns stay as they are."""
    kept = scan(docs, benchmark).filter(~contaminated())
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    return kept.select(*((columns[c] if c in columns else F.col("extra").getField(c)).alias(c) for c in docs.columns))


def contaminated():
    """The rule: some hit, and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
