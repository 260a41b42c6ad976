"""Vectorised text primitives shared by the operators of this subpackage.

Texts come from Arrow as one byte buffer with offsets. Everything here works on
that buffer with numpy: words are byte ranges, a range's identity is a 64-bit
hash of its length and of its bytes, eight at a time, and the identity of k words
in a row is built from those of halves. Each step passes through a bijective
mixer, so no sum or power of the input carries over into the result: texts made
to collide under polynomial hashes (Thue-Morse words) don't collide here, and two
ranges of one length of at most eight bytes never do. A second, independent lane
(another salt) widens an identity to 128 bits; `distinct` compares bytes. No
Python object is made per word. Texts are taken whole, in chunks of whole
documents, so that memory follows the chunk (or the longest single text), not the
partition; what a chunk used is handed back to the system after it.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
CHUNK_BYTES = 1 << 19
#: Ranges of more bytes than this are hashed one by one.
LONG = 256

#: Salts of independent hash functions.
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)

#: Words are maximal runs of bytes other than ASCII white space (0x09-0x0D, 0x20).
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words are maximal runs of ASCII letters and digits and of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two values in order."""
    return mix(a * np.uint64(0xD1342543DE82EF95) ^ b)


def bytes_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = FIRST) -> np.ndarray:
    """Hash of data[s:e] for each range; equal bytes give equal hashes wherever they stand."""
    size = (ends - starts).astype(np.int64)
    state = mix(size.astype(np.uint64) * np.uint64(SECOND) + np.uint64(salt))
    if not len(state):
        return state
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, 0, (1,))
    left, at, open_ = size, starts, np.arange(len(size))
    while len(open_):
        some = (left > 0) & (left <= LONG)
        open_, at, left = open_[some], at[some], left[some]
        state[open_] = mix(state[open_] ^ (eights[at] & _KEEP[np.minimum(left, 8)]))
        at, left = at + 8, left - 8
    raw, key = memoryview(data), int(salt).to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG).tolist():
        state[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return state


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a + size] equals data[b:b + size], for each."""
    same = np.ones(len(size), bool)
    if not len(size):
        return same
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, 0, (1,))
    open_, done = np.flatnonzero((a != b) & (size <= LONG)), 0
    while len(open_):
        open_ = open_[size[open_] > done]
        same[open_] &= ((eights[a[open_] + done] ^ eights[b[open_] + done]) & _KEEP[np.minimum(size[open_] - done, 8)]) == 0
        done += 8
    raw = memoryview(data)
    for i in np.flatnonzero((a != b) & (size > LONG)).tolist():
        same[i] = raw[a[i] : a[i] + size[i]] == raw[b[i] : b[i] + size[i]]
    return same


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first place, count) of each distinct range, and each range's index into them. Bytes decide, not hashes."""
    hashes = bytes_hash(data, starts, ends)
    values, first, index, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    size = ends - starts
    if (size[first[index]] == size).all() and same_bytes(data, starts, starts[first[index]], size).all():
        return values, first, times, index
    raw, seen = memoryview(data), {}
    index = np.array([seen.setdefault(bytes(raw[s:e]), len(seen)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    _, first, times = np.unique(index, return_index=True, return_counts=True)
    return hashes[first], first, times, index


def tidy() -> None:
    """Hands free memory back to the system: what a chunk needed isn't kept by a worker that waits for the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


class Chunk:
    """A few whole texts: `data` bytes, `bounds` of the n texts in it, `first` row in the batch."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int) -> None:
        self.data, self.bounds, self.first, self.n = data, bounds, first, len(bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def chunks(column: pa.Array | pa.ChunkedArray, most: int | None = None) -> Iterator[Chunk]:
    """Cuts a string column into chunks of whole texts; a null is an empty text."""
    most = CHUNK_BYTES if most is None else most
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        to = min(to, n)
        yield Chunk(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], at)
        at = to
    tidy()


def valid(chunk: Chunk) -> Chunk:
    """The chunk with U+FFFD in place of bytes that aren't UTF-8."""
    try:
        str(memoryview(np.ascontiguousarray(chunk.data)), "utf-8")
        return chunk
    except UnicodeDecodeError:
        texts = [chunk.text(i).decode("utf-8", "replace").encode() for i in range(chunk.n)]
        return Chunk(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), chunk.first)


def strings(texts: list[bytes | None]) -> pa.Array:
    """A string column of these bytes as they are."""
    raw = pa.array(texts, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(raw), raw.buffers(), raw.null_count)


class Words:
    """The words of a chunk: byte ranges, the first word of each text (n + 1 values) and hashes."""

    def __init__(self, chunk: Chunk, table: np.ndarray, lower: bool = False) -> None:
        data, bounds = chunk.data, chunk.bounds
        inside = table[data]
        filled = bounds[:-1] < bounds[1:]
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1]
        at = bounds[:-1][filled]
        fresh[at] = inside[at]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        at = bounds[1:][filled] - 1
        last[at] = inside[at]
        self.chunk, self.inside, self.lower = chunk, inside, lower
        self.starts = np.flatnonzero(fresh)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)
        self._lanes: dict[int, np.ndarray] = {}

    def lane(self, salt: int) -> np.ndarray:
        """Hash of each word under a salt."""
        if salt not in self._lanes:
            data = _LOWER[self.chunk.data] if self.lower else self.chunk.data
            self._lanes[salt] = bytes_hash(data, self.starts, self.ends, salt)
        return self._lanes[salt]

    @property
    def hash(self) -> np.ndarray:
        return self.lane(FIRST)

    def places(self, k: int) -> np.ndarray:
        """Start word of every run of k words that lies within one text."""
        n = len(self.starts)
        ok = np.ones(max(0, n - k + 1), bool)
        for back in range(1, k):  # a run that starts fewer than k words before a text's end crosses it
            at = self.first[1:] - back
            # a short text's words before its start belong to the text before it: those runs cross too
            ok[at[(at >= 0) & (at < len(ok))]] = False
        return np.flatnonzero(ok)

    def runs(self, k: int, salt: int = FIRST) -> np.ndarray:
        """Hash of the k words from each word on, as far as the chunk has k: built from runs of half the length."""
        return runs(self.lane(salt), k)

    def grams(self, k: int, salt: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start word) of every run of k words that lies within one text."""
        at = self.places(k)
        return (self.runs(k, salt)[at], at) if len(at) else (np.zeros(0, np.uint64), at)

    def sequences(self, texts: np.ndarray) -> np.ndarray:
        """Hash of the whole word sequence of each of some short texts with words."""
        out = self.hash[self.first[texts]]
        for j in range(1, int(self.counts[texts].max(initial=0))):
            more = self.counts[texts] > j
            out[more] = pair(out[more], self.hash[self.first[texts[more]] + j])
        return mix(out ^ self.counts[texts].astype(np.uint64))

    def owner(self) -> np.ndarray:
        """The text (index in the chunk) of each word."""
        return np.repeat(np.arange(self.chunk.n), self.counts)


def runs(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each place on."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    n, done, out, power, size = len(values) - k + 1, 0, None, values, 1
    while True:
        if k & size:
            out = power[:n] if out is None else pair(out, power[done : done + n])
            done += size
        if done == k:
            return out
        power, size = pair(power[: len(power) - size], power[size:]), 2 * size


def sums(values: np.ndarray, firsts: np.ndarray, counts: np.ndarray, salt: int = SECOND) -> np.ndarray:
    """Digest of each stretch values[f:f + c]: the sum of its values, each mixed with its place in the stretch."""
    place = np.arange(len(values)) - np.repeat(firsts, counts)
    mixed = mix(values ^ mix(place.astype(np.uint64) + np.uint64(salt)))
    total = np.add.reduceat(mixed, firsts) if len(firsts) else np.zeros(0, np.uint64)
    return mix(total ^ counts.astype(np.uint64))


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Mask of n positions that lie in any [start, start + length)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + length, 1)
    return np.cumsum(edge[:-1]) > 0
