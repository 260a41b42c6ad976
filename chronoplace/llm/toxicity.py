"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is a hashed n-gram (3 to 5 code points, A-Z lower-cased) and is
present or absent in a text. From labelled texts the share of toxic and of other
texts with each n-gram gives its log-count ratio r; a feature's input value is r
where the n-gram is present. Features whose presence differs most between the
classes (chi-squared) are kept, at most FEATURES of them, and logistic
regression is fitted to them on the driver.

Training takes at most TRAIN_ROWS labelled rows, those with the least hash of
doc_id, and never rows that are held out; at most FEATURES entries of two bytes
for each come to the driver, 330 MB if every text had all of them. The counts per n-gram are fixed-size
arrays (2 x 2**BITS), summed from the tasks' own sums. Scoring is one pass over
whole texts without a shuffle; the model (weights of 2**BITS features, almost
all zero) is a constant size.

Defined results: null and empty texts have no n-grams and score by the bias;
without labels, or with labels of one class, all texts get the same score (0
without a toxic one, 1 without another); repeated rows give repeated results (in
training, of rows that repeat a labelled id the least text counts); bytes that
aren't UTF-8 are read as U+FFFD; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplace.llm.quality import labelled_sample, labelled_texts
from chronoplace.llm.textnp import Chunk, chunks, valid

BITS = 18
SIZES = (3, 4, 5)
TRAIN_ROWS = 20_000
FEATURES = 8192
SLICES = 64
THRESHOLD = 0.3
#: Least chi-squared of a feature that is kept: one in ten thousand reaches it by chance, some 26 of all buckets.
CHANCE, RIDGE = 15.0, 3.0


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def code_points(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of a chunk's texts and their bounds."""
    lead = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    points[(points >= 65) & (points <= 90)] += np.uint32(32)
    return points, lead[chunk.bounds]


def features(points: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: (bucket, start) of every n-gram that lies within one text."""
    n = len(points)
    scaled = points * np.uint32(0x9E3779B1)
    for size in SIZES:
        if n < size:
            continue
        h = np.full(n - size + 1, size * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
        for j in range(size):
            h ^= scaled[j : n - size + 1 + j]
            h *= np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(15)
        ok = np.ones(len(h), bool)
        for back in range(1, size):
            at = bounds[1:] - back
            ok[at[(at >= 0) & (at < len(ok))]] = False
        at = np.flatnonzero(ok)
        yield h[at] >> np.uint32(32 - BITS), at


def _present(chunk: Chunk, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs of a chunk, in order; only `wanted` buckets, if given."""
    points, bounds = code_points(chunk)
    pairs = [np.zeros(0, np.int64)]
    owner = np.repeat(np.arange(chunk.n), np.diff(bounds))
    for bucket, at in features(points, bounds):
        if wanted is not None:
            good = wanted[bucket]
            bucket, at = bucket[good], at[good]
        pairs.append((owner[at] << BITS) | bucket.astype(np.int64))
    both = np.unique(np.concatenate(pairs))
    return both >> BITS, both & ((1 << BITS) - 1)


class Model:
    def __init__(self, bias: float, weights: np.ndarray) -> None:
        self.bias, self.weights = bias, weights
        self.wanted = weights != 0

    def score(self, chunk: Chunk) -> np.ndarray:
        text, bucket = _present(chunk, self.wanted)
        margin = self.bias + np.bincount(text, self.weights[bucket], chunk.n)
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def _class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts of each class, and texts with each bucket by class."""
    width = (1 << BITS) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in map(valid, chunks(batch.column(1))):
                mine = label[chunk.first : chunk.first + chunk.n]
                texts += np.bincount(mine, minlength=2)
                text, bucket = _present(chunk)
                for c in (0, 1):
                    seen[c] += np.bincount(bucket[mine[text] == c], minlength=1 << BITS)
        if texts.any():
            blobs = [seen[:, s * width : (s + 1) * width].astype("<i8").tobytes() for s in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(blobs), pa.array([int(texts[0])] * SLICES), pa.array([int(texts[1])] * SLICES)], ["slice", "seen", "n0", "n1"])

    def total(key: tuple, table: pa.Table) -> pa.Table:
        seen = sum(np.frombuffer(b.as_py(), "<i8") for b in table["seen"])
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "seen": [seen.tobytes()], "n0": [sum(table["n0"].to_pylist())], "n1": [sum(table["n1"].to_pylist())]})

    schema = "slice int, seen binary, n0 long, n1 long"
    parts = rows.mapInArrow(run, schema).groupBy("slice").applyInArrow(total, schema).collect()
    if not parts:
        return np.zeros(2), np.zeros((2, 1 << BITS))
    parts.sort(key=lambda r: r["slice"])
    seen = np.concatenate([np.frombuffer(r["seen"], "<i8").reshape(2, -1) for r in parts], axis=1)
    return np.array([parts[0]["n0"], parts[0]["n1"]], float), seen.astype(float)


def fit(counts: np.ndarray, cols: np.ndarray, ratio: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 300, rate: float = 0.1, block: int = 1 << 20) -> tuple[float, np.ndarray]:
    """Logistic regression with an L2 penalty, by full-batch Adam; deterministic.

    Row i has the features of counts[i] entries of cols, each with its feature's ratio as value. Rows are gone
    through in blocks of about `block` entries, so working memory is the entries themselves (two bytes each).
    """
    width, ends = len(ratio), np.concatenate([[0], np.cumsum(counts)])
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + block, block), "left").clip(0, len(y)))
    cuts = np.unique(np.concatenate([[0], cuts, [len(y)]]))
    w, bias = np.zeros(width), float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb, scaled = ridge * w, 0.0, w * ratio
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mine = cols[ends[a] : ends[b]]
            row = np.repeat(np.arange(b - a), counts[a:b])
            miss = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, scaled[mine], b - a), -30, 30))) - y[a:b]
            g = g + np.bincount(mine, miss[row], width) * ratio
            gb += miss.sum()
        g, gb = g / len(y), gb / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c) / (np.sqrt(v / d) + 1e-8)
        bias -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return bias, w


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    chosen = labelled_sample(labels, "toxic", most, ~held_out())
    rows = labelled_texts(docs, chosen)
    n, seen = _class_counts(rows)
    if not n[0] or not n[1]:
        return Model(40.0 if n[1] else -40.0, np.zeros(1 << BITS))
    share = (seen + 1) / (n[:, None] + 2)
    ratio = np.log(share[1] / share[0])
    both = seen.sum(0)
    expected = both * n[1] / n.sum()
    chi = np.where(both >= 3, (seen[1] - expected) ** 2 / np.maximum(expected * (1 - both / n.sum()), 1e-9), 0)
    top = np.argsort(-chi, kind="stable")[:FEATURES]
    top = np.sort(top[chi[top] > CHANCE])
    if not len(top):
        return Model(float(np.log(n[1] / n[0])), np.zeros(1 << BITS))
    wanted = np.zeros(1 << BITS, bool)
    wanted[top] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in map(valid, chunks(batch.column(1))):
                text, bucket = _present(chunk, wanted)
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=chunk.n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], ["label", "buckets"])

    got = rows.mapInArrow(run, "label int, buckets array<int>").toArrow()
    lists, y = got["buckets"].combine_chunks(), got["label"].to_numpy().astype(float)
    cols = np.searchsorted(top, np.asarray(lists.flatten())).astype(np.uint16)
    bias, w = fit(np.asarray(lists.value_lengths()).astype(np.int64), cols, ratio[top], y)
    weights = np.zeros(1 << BITS)
    weights[top] = w * ratio[top]
    return Model(bias, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in map(valid, chunks(batch.column(2))):
                rate = model.score(chunk)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(chunk.first, chunk.n) for i in (0, 1)), pa.array(rate), pa.array((rate >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
