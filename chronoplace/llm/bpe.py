"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Explode. Texts are split into pre-tokens with positions. Tokens are not sent
   one by one: a block of whole texts (BLOCK_BYTES) lists its distinct
   pre-tokens once, dealt into buckets by hash, and its texts become sequences of
   indices into that list. Both are written to the shared folder.
2. Encode. The lists meet by bucket; each distinct pre-token of a bucket is
   encoded once, for all blocks.
3. Join back. Ids return to their blocks, sequences are replaced by ids and cut
   into documents by position.
4. Decode. Ids join the token-byte table (one row for each id of the vocabulary,
   a fixed size) and the bytes are put together by position.

What crosses the network are distinct words per block and compressed index
sequences, so a word or text that makes up a third of the corpus costs a list
entry for each block. Buckets grow with the session's shuffle partitions.

The pre-tokeniser is the public pattern
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
worked out on classes of code points instead of by a regular expression.

Words are told apart by their bytes, never by a hash alone.

Defined results: null and empty texts have no tokens; repeated rows, also with
equal doc_ids, give a row each; doc_id may be null; bytes that aren't UTF-8 are
read as U+FFFD.
"""

from __future__ import annotations

import base64
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoplace.llm.textnp import Chunk, chunks, distinct, tidy, valid
from chronoplace.shared import bucketed

BLOCK_BYTES = 8 << 20
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = range(4)
# Code points with the Unicode property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def worker_cache() -> dict:
    """One dict for each worker process; it outlives a task."""
    return sys.modules.setdefault("_chronoplace_cache", type(sys)("_chronoplace_cache")).__dict__


class Splitter:
    """Pre-token starts of a chunk. Only the runs of classes are pickled; tables are made where they are used."""

    def __init__(self) -> None:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                shift = lambda i: i + 0x800 * (i >= 0xD800)
                table[shift(m.start()) : shift(m.end() - 1) + 1] = kind
        table[0xD800:0xE000] = OTHER
        table[WHITE] = SPACE
        cut = np.flatnonzero(np.diff(table)) + 1
        self.kinds, self.lengths = table[np.concatenate([[0], cut])], np.diff(np.concatenate([[0], cut, [len(table)]]))

    def table(self) -> np.ndarray:
        cache = worker_cache()
        if "classes" not in cache:
            cache["classes"] = np.repeat(self.kinds, self.lengths)
        return cache["classes"]

    def split(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all pre-tokens, and the number of them in each text."""
        data = chunk.data
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(chunk.n, np.int64)
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        bounds = np.concatenate([[0], np.cumsum(lead)])[chunk.bounds]
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.table()[points]
        n = len(kind)
        begins = np.zeros(n + 1, bool)
        begins[bounds] = True  # a text's first code point; also position n
        text_start, text_end = begins[:-1], begins[1:]

        space, plain = kind == SPACE, points == 32
        before_space = np.concatenate([[False], space[:-1]]) & ~text_start
        after_word = np.concatenate([~space[1:], [False]]) & ~text_end  # followed by a non-space of the same text
        before_plain = np.concatenate([[False], plain[:-1]]) & ~text_start
        changed = np.concatenate([[True], kind[1:] != kind[:-1]]) | text_start
        # Spaces: a run starts a token; its last one, before a word, stands apart from the rest and, if it is
        # the plain space, leads the word. Others start where the class changes, unless a plain space leads.
        start = np.where(space, ~before_space | after_word, changed & ~before_plain)

        quote = np.flatnonzero((points == 39) & start)
        if len(quote):
            near = np.zeros((2, len(quote)), np.uint32)
            same = np.cumsum(text_start)
            for j in (1, 2):
                ok = (quote + j < n) & (same[np.minimum(quote + j, n - 1)] == same[quote])
                near[j - 1, ok] = points[quote[ok] + j]
            a, b = near
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ~one & np.logical_or.reduce([(a == ord(x)) & (b == ord(y)) for x, y in ("re", "ve", "ll")])
            for size, hit in ((2, quote[one]), (3, quote[two])):
                start[hit + 1] = False
                after = hit + size
                after = after[after < n]
                start[after] = True
        starts = at[start]
        counts = np.add.reduceat(np.append(start, False).astype(np.int64), np.minimum(bounds[:-1], n))
        counts[bounds[1:] == bounds[:-1]] = 0
        return starts, np.append(starts[1:], len(data)), counts


class Vocabulary:
    """Ranks of a rank file, and the token-byte table as one buffer with offsets."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.tokens = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        self.path = path

    def encoding(self) -> tiktoken.Encoding:
        cache = worker_cache()
        if ("encoding", self.path) not in cache:
            cache["encoding", self.path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={v: k for k, v in self.tokens.items()}, special_tokens={})
        return cache["encoding", self.path]

    def piece(self) -> Callable[[bytes], list[int]]:
        """Ids of one pre-token."""
        return self.encoding()._core_bpe.encode_single_piece

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        cache = worker_cache()
        if ("table", self.path) not in cache:
            top = max(self.tokens, default=-1) + 1
            parts = [self.tokens.get(i, b"") for i in range(top)]
            cache["table", self.path] = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return cache["table", self.path]


def gather(values: np.ndarray, bounds: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[bounds[p]:bounds[p + 1]] of each pick, end to end, and the running length."""
    lengths = bounds[picks + 1] - bounds[picks]
    ends = np.cumsum(lengths)
    at = np.repeat(bounds[picks] - (ends - lengths), lengths)
    at += np.arange(len(at))
    return values[at], np.concatenate([[0], ends])


LEVEL = 9


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, byte planes apart, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), LEVEL)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def _pack_skewed(values: np.ndarray) -> bytes:
    """Values of which most are small: one byte each, 255 for those that follow as larger ones."""
    small = zstandard.compress(np.minimum(values, 255).astype(np.uint8).tobytes(), LEVEL)
    return len(small).to_bytes(8, "little") + small + _pack(values[values >= 255])


def _unpack_skewed(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    out = np.frombuffer(zstandard.decompress(blob[8 : 8 + size]), np.uint8).astype("<u4")
    out[out == 255] = _unpack(blob[8 + size :])
    return out


_BLOCK = "block long, bucket int, sizes binary, words binary, doc_ids array<long>, counts array<int>, buckets binary, sequence binary"


class _Block:
    """Whole texts that share a list of distinct pre-tokens. Texts themselves aren't kept."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.times = np.zeros(0, np.int64)
        #: Of each chunk, each token's index into the list.
        self.parts: list[np.ndarray] = []
        self.ids: list = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def take(self, chunk: Chunk, ids: list, splitter: Splitter) -> None:
        starts, ends, counts = splitter.split(chunk)
        if len(starts):
            _, first, times, index = distinct(chunk.data, starts, ends)
            raw = chunk.data.tobytes()
            words = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            found = list(map(self.place.get, words))
            for i in [i for i, x in enumerate(found) if x is None]:
                found[i] = self.place[words[i]] = len(self.place)
            if len(self.place) > len(self.times):
                self.times = np.concatenate([self.times, np.zeros(len(self.place), np.int64)])
            place = np.array(found, np.int32)
            self.times[place] += times
            self.parts.append(place[index])
        self.ids += ids
        self.counts.append(counts)
        self.size += len(chunk.data)

    def distinct(self) -> tuple[np.ndarray, list[bytes]]:
        """Each token's index into the distinct pre-tokens, and those, commonest first and equals in byte order (which
        compresses best)."""
        words = list(self.place)
        by_bytes = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = by_bytes[np.argsort(-self.times[: len(words)][by_bytes], kind="stable")]
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        parts, self.parts = self.parts, []
        sequence = np.concatenate([place[p] for p in parts]) if parts else np.zeros(0, np.uint32)
        return sequence, [words[i] for i in order.tolist()]

    def rows(self, block: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
        sequence, words = self.distinct()
        bucket = np.array([zlib.crc32(w) for w in words], np.int64) % n_buckets
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        lists = []
        for b in range(n_buckets):
            if edges[b] < edges[b + 1]:
                mine = [words[i] for i in order[edges[b] : edges[b + 1]].tolist()]
                lists.append({"block": block, "bucket": b, "sizes": _pack(np.array([len(w) for w in mine])), "words": zstandard.compress(b"".join(mine), LEVEL)})
        counts = np.concatenate(self.counts)
        lists.append({"block": block, "doc_ids": self.ids, "counts": counts.tolist(), "buckets": _pack(bucket), "sequence": _pack_skewed(sequence)})
        yield pa.RecordBatch.from_pylist(lists, _ARROW)


_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("sizes", pa.binary()), ("words", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("buckets", pa.binary()), ("sequence", pa.binary())])


def _explode(docs: DataFrame, n_buckets: int) -> DataFrame:
    splitter = Splitter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tidy()  # what the worker's last task has left
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for chunk in map(valid, chunks(batch.column(1))):
                block.take(chunk, batch.column(0).slice(chunk.first, chunk.n).to_pylist(), splitter)
                if block.size >= BLOCK_BYTES:
                    yield from block.rows(number, n_buckets)
                    number, block = number + 1, _Block()
                    tidy()
        if block.ids:
            yield from block.rows(number, n_buckets)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK)


def _encode(words: DataFrame, vocabulary: Vocabulary, n_buckets: int) -> DataFrame:
    """block, bucket, and for each word of the list the number of its ids and the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = vocabulary.piece()
        bucket, known = None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                raw, at, ids, counts = zstandard.decompress(row["words"]), 0, [], []
                for size in _unpack(row["sizes"]).tolist():
                    word = raw[at : at + size]
                    at += size
                    got = known.get(word)
                    if got is None:
                        got = known[word] = piece(word)
                    ids += got
                    counts.append(len(got))
                out.append({"block": row["block"], "bucket": bucket, "n": _pack(np.array(counts)), "ids": _pack(np.array(ids))})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.binary()), ("ids", pa.binary())]))
            tidy()

    dealt = words.repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block long, bucket int, n binary, ids binary")


def decode_ids(ids: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> list[bytes]:
    """Bytes of each run of `counts` ids: the join with the token-byte table."""
    values, bounds = vocabulary.table()
    raw, ends = gather(values, bounds, ids.astype(np.int64))
    cut = ends[np.concatenate([[0], np.cumsum(counts)])]
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _groups(counts: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` tokens."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, min(to, len(counts))
        at = to


def _reassemble(joined: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, counts, buckets, sequence, lists = (batch.column(j)[i] for j in range(5))
                n, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
                for x in sorted(lists.as_py() or [], key=lambda x: x["bucket"]):
                    n.append(_unpack(x["n"]))
                    ids.append(_unpack(x["ids"]))
                n, ids = np.concatenate(n).astype(np.int64), np.concatenate(ids)
                bucket = _unpack(buckets.as_py())
                if len(n) != len(bucket):
                    raise ValueError("a block's word lists are not whole")
                # lists hold words by bucket, in each by frequency; sequences count by frequency
                starts, order = np.concatenate([[0], np.cumsum(n)]), np.argsort(bucket, kind="stable")
                lo, hi = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
                lo[order], hi[order] = starts[:-1], starts[1:]
                sequence, counts = _unpack_skewed(sequence.as_py()), np.asarray(counts.values)
                cut = np.concatenate([[0], np.cumsum(counts)])
                keys = doc_ids.values
                for a, b in _groups(counts):
                    picks = sequence[cut[a] : cut[b]]
                    length = hi[picks] - lo[picks]
                    ends = np.cumsum(length)
                    at = np.repeat(lo[picks] - (ends - length), length)
                    at += np.arange(len(at))
                    out = ids[at]
                    edge = np.concatenate([[0], ends])[cut[a : b + 1] - cut[a]]
                    raw = out.astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(a, b - a), pa.array(np.diff(edge)), pa.array([raw[4 * x : 4 * y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary()), pa.array(decode_ids(out, np.diff(edge), vocabulary), pa.binary())],
                        ["doc_id", "n_tokens", "ids", "decoded"],
                    )
                del sequence, ids, lo, hi, starts
                tidy()

    return joined.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded bytes of every row of docs(doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    vocabulary = Vocabulary(path)
    n_buckets = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # in buckets of blocks: texts' sequences stay where they are, what comes to them are their words' ids
    blocks = bucketed(_explode(docs, n_buckets), "blocks", "block", max(1, n_buckets // 2), "none")
    coded = _encode(blocks.filter("bucket is not null").select("block", "bucket", "sizes", "words"), vocabulary, n_buckets)
    lists = coded.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "ids")).alias("lists"))
    texts = blocks.filter("bucket is null").select("block", "doc_ids", "counts", "buckets", "sequence")
    return _reassemble(texts.join(lists, "block", "left").select("doc_ids", "counts", "buckets", "sequence", "lists"), vocabulary)


def digest(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
