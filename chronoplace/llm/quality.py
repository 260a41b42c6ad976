"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from one vectorised pass over the bytes of each text. Trees are
grown on the driver from a bounded sample of labelled rows (TRAIN_ROWS, those
with the least hash of doc_id), flattened into node arrays (feature, threshold,
left, right, value) and scored for whole batches at once. Some statistics are
bound to be monotone: more symbols, repeats, duplicate lines or a more dominant
word never raise a document's score. Splits that would break this are refused,
and children inherit bounds at the mean of their parents' values.

A document is kept if it has no base failure and its score is at least KEEP. The
base failures: fewer than 50 words, or more than half of the words in 3-word
windows that occur twice or more in the text.

Defined results: null and empty texts have no words and fail; documents without
labels are scored like all others; without any labels (or with one class only)
the model is constant and only the base failures decide; repeated rows give
repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplace.llm.textnp import NON_SPACE, Words, bytes_hash, chunks, covered, pair

TRAIN_ROWS = 20_000
KEEP = 0.5
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Model inputs, and whether more of one may raise (1) or lower (-1) the score; 0: free.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "longest_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "top_word_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "mark_share": 0,
    "bang_share": -1,
    "words_per_line": 0,
}


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Flags that are set in each text; counted in place, as prefix sums would take eight bytes for each of text."""
    return np.array([np.count_nonzero(flags[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.int64)


def _times(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each value occurs in its own text; (count of each, first index of each distinct, inverse)."""
    keyed = pair(hashes, owner.astype(np.uint64))
    _, first, inverse, counts = np.unique(keyed, return_index=True, return_inverse=True, return_counts=True)
    return counts[inverse], first, counts


def measure(w: Words) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts and the feature matrix of a chunk's texts."""
    chunk, data, bounds, n = w.chunk, w.chunk.data, w.chunk.bounds, w.chunk.n
    words, owner = w.counts, w.owner()
    lead = (data & 0xC0) != 0x80
    chars = _per_text(w.inside & lead, bounds)
    symbols = _per_text(SYMBOLS[data], bounds)

    cut = np.flatnonzero(data == 10)
    text_of_cut = np.searchsorted(bounds, cut, "right") - 1
    starts = np.sort(np.concatenate([bounds[:-1], cut + 1]), kind="stable")
    ends = np.sort(np.concatenate([cut, bounds[1:]]), kind="stable")
    line_owner = np.sort(np.concatenate([np.arange(n), text_of_cut]), kind="stable")
    real = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)  # a word starts in the line that holds it
    starts, ends, line_owner = starts[real], ends[real], line_owner[real]
    lines = np.bincount(line_owner, minlength=n)
    if len(starts):
        _, first, _ = _times(line_owner, bytes_hash(data, starts, ends))
        dup_lines = lines - np.bincount(line_owner[first], minlength=n)
    else:
        dup_lines = np.zeros(n, np.int64)

    grams, at = w.grams(3)
    if len(at):
        many, _, _ = _times(owner[at], grams)
        repeats = _per_text(covered(len(owner), at[many > 1], 3), w.first)
    else:
        repeats = np.zeros(n, np.int64)

    distinct, top, longest = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(owner):
        _, first, counts = _times(owner, w.hash)
        distinct = np.bincount(owner[first], minlength=n)
        np.maximum.at(top, owner[first], counts)
        np.maximum.at(longest, owner, w.ends - w.starts)
    upper = _per_text((data >= 65) & (data <= 90), bounds)
    letters = upper + _per_text((data >= 97) & (data <= 122), bounds)
    digits = _per_text((data >= 48) & (data <= 57), bounds)
    bangs = _per_text(data == 33, bounds)
    marks = _per_text((data == 44) | (data == 46) | (data == 59) | (data == 58), bounds)
    per = np.maximum(words, 1)
    matrix = np.stack(
        [np.log1p(words), chars / per, longest, symbols / per, dup_lines / np.maximum(lines, 1), repeats / per, distinct / per, top / per, upper / np.maximum(letters, 1), digits / np.maximum(chars, 1), marks / per, bangs / per, words / np.maximum(lines, 1)],
        axis=1,
    )
    base = dict(zip(BASE, (words, chars, symbols, dup_lines, repeats), strict=True))
    return base, matrix


class Trees:
    """Flattened boosted trees: one set of node arrays, a root for each tree."""

    def __init__(self, bias: float, roots: list[int], nodes: np.ndarray) -> None:
        self.bias, self.roots = bias, np.asarray(roots, np.int64)
        self.feature = nodes[:, 0].astype(np.int64)
        self.threshold, self.value = nodes[:, 1], nodes[:, 4]
        self.left, self.right = nodes[:, 2].astype(np.int64), nodes[:, 3].astype(np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Newton boosting of the logistic loss over binned features."""
    if not len(y) or y.min() == y.max():
        bias = 20.0 if not len(y) or y.max() > 0 else -20.0
        return Trees(bias, [], np.zeros((0, 5)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)
    share = y.mean()
    bias = float(np.log(share / (1 - share)))
    margin, nodes, roots = np.full(len(y), bias), [], []

    def leaf(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + ridge), lo, hi))

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        me = len(nodes)
        nodes.append(None)
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if level < depth:
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                b = binned[rows, f]
                left_g = np.cumsum(np.bincount(b, g[rows], len(cuts[f]) + 1))[:-1]
                left_h = np.cumsum(np.bincount(b, h[rows], len(cuts[f]) + 1))[:-1]
                right_g, right_h = sum_g - left_g, sum_h - left_h
                left_v, right_v = np.clip(-left_g / (left_h + ridge), lo, hi), np.clip(-right_g / (right_h + ridge), lo, hi)
                gain = -(left_g * left_v + 0.5 * (left_h + ridge) * left_v**2) - (right_g * right_v + 0.5 * (right_h + ridge) * right_v**2)
                own = leaf(sum_g, sum_h, lo, hi)
                gain += sum_g * own + 0.5 * (sum_h + ridge) * own**2
                ok = (left_h >= least) & (right_h >= least) & (monotone[f] * (right_v - left_v) >= 0)
                gain = np.where(ok, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, left_v[k], right_v[k]))
        if best[1] is None:
            nodes[me] = (-1, 0.0, 0, 0, rate * leaf(sum_g, sum_h, lo, hi))
            return me
        f, k, left_v, right_v = best[1]
        go = binned[rows, f] <= k
        middle = (left_v + right_v) / 2
        low_side = {1: (lo, middle, middle, hi), -1: (middle, hi, lo, middle), 0: (lo, hi, lo, hi)}[monotone[f]]
        left = build(rows[go], g, h, level + 1, *low_side[:2])
        right = build(rows[~go], g, h, level + 1, *low_side[2:])
        nodes[me] = (f, cuts[f][k], left, right, 0.0)
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        at = len(nodes)
        roots.append(build(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-9), 0, -4.0, 4.0))
        one = Trees(0.0, [roots[-1]], np.asarray(nodes, float))
        assert roots[-1] == at
        margin += one.margin(x)
    return Trees(bias, roots, np.asarray(nodes, float))


def labelled_sample(labels: DataFrame, column: str, most: int, where=None) -> DataFrame:
    """At most `most` labelled doc_ids, those with the least hash: bounded, and the same whatever the partitioning."""
    rows = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows if where is None else rows.filter(where)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """label and text of the chosen doc_ids, one row for each: of rows that repeat an id the least text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Trees:
    rows = labelled_texts(docs, labelled_sample(labels, "quality", most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                x = measure(Words(chunk, NON_SPACE))[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    got = rows.mapInArrow(run, "label int, x array<double>").toArrow()
    # rows are put in order so that the model doesn't depend on partitioning
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = got["label"].to_numpy().astype(float)
    order = np.lexsort((y, *x.T[::-1])) if len(y) else np.zeros(0, int)
    return grow(x[order], y[order], list(FEATURES.values()))


def score(docs: DataFrame, model: Trees, keep: float = KEEP) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                base, x = measure(Words(chunk, NON_SPACE))
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                rate = model.score(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.n), *(pa.array(base[c].astype(np.int64)) for c in BASE), pa.array(failed), pa.array(rate), pa.array(~failed & (rate >= keep))],
                    ["doc_id", *BASE, "base_failed", "score", "kept"],
                )

    schema = f"doc_id long, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of docs that are kept, with all their columns, unchanged. One pass, no join."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for chunk in chunks(batch.column(at)):
                base, x = measure(Words(chunk, NON_SPACE))
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                good.append(~failed & (model.score(x) >= KEEP))
            yield batch.filter(pa.array(np.concatenate(good))) if good else batch

    return docs.mapInArrow(run, docs.schema)
