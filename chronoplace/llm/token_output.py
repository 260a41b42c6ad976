"""Training-order materialisation: token ids in fixed-stride shards, in a keyed random order.

1. Packing. Documents are encoded and dealt into blocks by a hash of doc_id and
   text; in each block, in the order of that hash, their ids stand end to end, each
   document closed by END, and are cut into records of STRIDE ids. Only a block's last
   record is filled up (with PAD). The number of blocks follows the number of
   documents alone, so records and their numbers don't depend on how files are
   split or how many tasks there are.
2. Slots. Records are numbered 0 to N - 1: the counts of the blocks (at most
   MAX_BLOCKS rows) are summed and a block's offset added to the place inside it. A
   keyed Feistel network permutes the next even power of two above N; walking its
   cycle until a value below N comes up makes it a permutation of 0 to N - 1, so each
   record has a global slot, worked out where it stands, without a sort of random
   keys and without collisions.
3. Shards. Slots are cut into ranges of PER_SHARD; each range is one raw file,
   shard-NNNNNNNN.bin, written in the order of slots. Every record is STRIDE
   little-endian unsigned 16-bit ids, so slot s is at byte 2 * STRIDE * (s % PER_SHARD)
   of shard s // PER_SHARD, and a reader can start, stop and resume anywhere by slot.
   A task writes a shard under a name of its own and renames it when it is whole, so
   one that runs again, or twice, does no harm.

Shards are written through Arrow's file systems, so the folder may be a mounted one
(file:) or a store that Arrow opens by URI (s3:, gs:, hdfs:).

Defined results: null and empty texts have no ids and are in no record; repeated
rows are packed as often as they occur (rows that are equal can't be told apart);
doc_id may be null; an empty table gives no shards; bytes that aren't UTF-8 are read
as U+FFFD; input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoplace.llm.bpe import Splitter, Vocabulary
from chronoplace.llm.textnp import chunks, distinct, valid
from chronoplace.shared import drop, fresh_path, materialise

STRIDE = 1024
PER_SHARD = 4096
#: Fills up a record; closes a document. No token has these ids.
PAD, END = 0xFFFF, 0xFFFE
#: Documents in a block, about, and the most blocks there are: beyond, blocks grow.
PER_BLOCK, MAX_BLOCKS = 4096, 1 << 16
ROUNDS = 4
#: Rounds in which shards are written: what is shuffled at once is that part of the records, beside the packed ones and the
#: shards that stand already.
WAVES = 2
#: Steps of a walk that isn't over after the usual number; the chance that one is longer is nil.
LONG_WALK = 1 << 12
#: Distinct pre-tokens that a worker remembers at most; beyond, it starts anew.
KNOWN = 1 << 18


@dataclass(frozen=True)
class Permutation:
    """Keyed permutation of 0 to n - 1."""

    n: int
    key: str = "order"

    @property
    def half(self) -> int:
        """Bits of each half of the Feistel network; 4**half >= n."""
        half = 1
        while 4**half < self.n:
            half += 1
        return half

    def round_keys(self) -> list[int]:
        return [int.from_bytes(hashlib.sha256(f"{self.key}/{i}".encode()).digest()[:7], "little") for i in range(ROUNDS)]

    def once(self, x: Column) -> Column:
        mask = (1 << self.half) - 1
        left, right = F.shiftrightunsigned(x, self.half), x.bitwiseAND(F.lit(mask))
        for k in self.round_keys():
            left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(k)).bitwiseAND(F.lit(mask)))
        return F.shiftleft(left, self.half).bitwiseOR(right)

    def slots(self, df: DataFrame, column: str, name: str = "slot", most: int = 64) -> DataFrame:
        """Adds the slot of each number. The domain is less than four times n, so a walk is over after a few steps;
        each of the `most` steps leaves at most about 3/4 of the rows outside. Those still outside walk LONG_WALK steps
        more, and the query fails if one is outside even then."""
        out = df.withColumn(name, self.once(F.col(column).cast("long")))
        for steps in (most, LONG_WALK):
            walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col(name), lambda x, _: F.when(x < self.n, x).otherwise(self.once(x)))
            out = out.withColumn(name, F.when(F.col(name) < self.n, F.col(name)).otherwise(walk))
        left = F.raise_error(F.lit(f"a number has no slot below {self.n}")).cast("long")
        return out.withColumn(name, F.when(F.col(name) < self.n, F.col(name)).otherwise(left))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, order (the hash that blocks go by) and ids (unsigned 16-bit, END last) of every row with ids."""
    splitter, vocabulary = Splitter(), Vocabulary(path)
    if max(vocabulary.tokens, default=0) >= END:
        raise ValueError("ids don't fit into 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # an unsigned 16-bit array; Spark runs on little-endian machines, and shards are little-endian
        piece, known, pack = vocabulary.piece(), {}, partial(array, "H")
        end = pack([END]).tobytes()
        for batch in batches:
            for chunk in map(valid, chunks(batch.column(2))):
                starts, ends, counts = splitter.split(chunk)
                if not len(starts):
                    continue
                _, first, _, inverse = distinct(chunk.data, starts, ends)
                raw = chunk.data.tobytes()
                if len(known) > KNOWN:
                    known = {}
                words = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                lists = list(map(known.get, words))
                for i in [i for i, x in enumerate(lists) if x is None]:
                    lists[i] = known[words[i]] = pack(piece(words[i])).tobytes()
                sizes = np.array([len(x) for x in lists]) // 2
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.frombuffer(b"".join(lists), "<u2")
                length = sizes[inverse]
                run_ends = np.cumsum(length)
                at = np.repeat(bounds[inverse] - (run_ends - length), length)
                ids = flat[at + np.arange(len(at))].tobytes()
                cut = np.concatenate([[0], run_ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
                rows = [ids[2 * a : 2 * b] + end if a < b else None for a, b in zip(cut[:-1], cut[1:], strict=True)]
                out = pa.RecordBatch.from_arrays([*(batch.column(i).slice(chunk.first, chunk.n) for i in (0, 1)), pa.array(rows, pa.binary())], ["doc_id", "order", "ids"])
                yield out.filter(out.column(2).is_valid())

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, "text").alias("order"), "text").mapInArrow(run, "doc_id long, order long, ids binary")


_RECORD = pa.schema([("block", pa.int32()), ("place", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("packed", pa.binary())])


class _Packer:
    """The records of one block, as its documents come in."""

    def __init__(self, block: int, stride: int) -> None:
        self.block, self.stride, self.place = block, stride, 0
        self.open()

    def open(self) -> None:
        self.parts, self.doc_ids, self.starts, self.n = [], [], [], 0

    def take(self, doc_id: int | None, ids: bytes) -> Iterator[dict]:
        at = 0
        while at < len(ids):
            part = ids[at : at + 2 * (self.stride - self.n)]
            self.parts.append(part)
            self.doc_ids.append(doc_id)
            self.starts.append(self.n)
            self.n += len(part) // 2
            at += len(part)
            if self.n == self.stride:
                yield self.close()

    def close(self) -> dict:
        whole = b"".join(self.parts).ljust(2 * self.stride, b"\xff")
        row = {"block": self.block, "place": self.place, "doc_ids": self.doc_ids, "starts": self.starts, "n_tokens": self.n, "packed": zstandard.compress(whole, 3)}
        self.place += 1
        self.open()
        return row


def records(docs: DataFrame, path: str, stride: int = STRIDE) -> DataFrame:
    """block, place in the block, doc_ids and where each begins in the record, n_tokens, packed (the record, compressed)."""
    bits = max(1, min(MAX_BLOCKS, -(-docs.count() // PER_BLOCK)) - 1).bit_length()
    rows = encoded(docs, path).withColumn("block", F.shiftrightunsigned("order", 64 - bits).cast("int"))
    dealt = rows.repartition(F.col("block")).sortWithinPartitions("block", "order", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out = None, []
        for batch in batches:
            for doc_id, block, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if packer is None or packer.block != block:
                    if packer is not None and packer.n:
                        out.append(packer.close())
                    packer = _Packer(block, stride)
                out += packer.take(doc_id, ids)
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, _RECORD)
                    out = []
        if packer is not None and packer.n:
            out.append(packer.close())
        if out:
            yield pa.RecordBatch.from_pylist(out, _RECORD)

    return dealt.select("doc_id", "block", "ids").mapInArrow(run, "block int, place long, doc_ids array<long>, starts array<int>, n_tokens int, packed binary")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _store(folder: str) -> tuple[object, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


def _write_shards(rows: DataFrame, folder: str, stride: int, per_shard: int) -> DataFrame:
    """Writes the shards that a task's sorted rows make up; a row for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        shard, temp, out = None, "", None

        def finish() -> None:
            out.close()
            store.move(temp, f"{root}/{shard_name(shard)}")

        for batch in batches:
            crcs = []
            for slot, blob in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if slot // per_shard != shard:
                    if out is not None:
                        finish()
                    shard, temp = slot // per_shard, f"{root}/.writing-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temp)
                whole = zstandard.decompress(blob)
                out.write(whole)
                crcs.append(zlib.crc32(whole))
            slots = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(slots // per_shard), pa.array(slots % per_shard), *(batch.column(i) for i in (1, 2, 3)), pa.array(crcs, pa.int64())],
                ["slot", "shard", "record", "doc_ids", "starts", "n_tokens", "record_crc32"],
            )
        if out is not None:
            finish()

    return rows.mapInArrow(run, "slot long, shard long, record long, doc_ids array<long>, starts array<int>, n_tokens int, record_crc32 long")


def materialise_order(docs: DataFrame, path: str, key: str = "order", stride: int = STRIDE, per_shard: int = PER_SHARD, out: str | None = None) -> tuple[DataFrame, str]:
    """Writes the shards; a row for each record (slot, shard, record, doc_ids, starts, n_tokens, record_crc32), and the shards' folder."""
    spark = docs.sparkSession
    packed = materialise(records(docs, path, stride), "records", "none")
    counts = packed.groupBy("block").agg(F.count("*").alias("c"))
    offsets = counts.select("block", (F.sum("c").over(Window.orderBy("block")) - F.col("c")).alias("from"))  # at most MAX_BLOCKS rows
    n = packed.count()
    numbered = packed.join(F.broadcast(offsets), "block").withColumn("number", F.col("from") + F.col("place"))
    slotted = Permutation(n, key).slots(numbered, "number").select("slot", "doc_ids", "starts", "n_tokens", "packed")
    n_shards = max(1, -(-n // per_shard))
    out = out or fresh_path(spark, "shards")
    waves = [(k * n_shards // WAVES, (k + 1) * n_shards // WAVES) for k in range(WAVES)]
    rows = []
    for first, last in waves:
        if first == last:
            continue
        parts = min(last - first, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        mine = slotted.filter((F.col("slot") >= first * per_shard) & (F.col("slot") < last * per_shard))
        # whole shards to a task, neighbours together
        dealt = mine.repartitionById(parts, ((F.floor(F.col("slot") / per_shard) - first) * parts / (last - first)).cast("int"))
        rows.append(materialise(_write_shards(dealt.sortWithinPartitions("slot"), out, stride, per_shard), "shard-rows"))
    written = rows[0]
    for more in rows[1:]:
        written = written.unionByName(more)
    drop(packed)
    return written, out


def read(spark: SparkSession, path: str, first: int, last: int, stride: int = STRIDE, per_shard: int = PER_SHARD) -> DataFrame:
    """slot and ids (unsigned 16-bit) of slots first to last - 1: each task reads one stretch of one shard from where it begins."""
    shards = range(first // per_shard, -(-last // per_shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                at, to = max(first, shard * per_shard), min(last, (shard + 1) * per_shard)
                with store.open_input_file(f"{root}/{shard_name(shard)}") as file:
                    file.seek(2 * stride * (at - shard * per_shard))
                    while at < to and (whole := file.read(2 * stride)):
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([whole], pa.binary())], ["slot", "ids"])
                        at += 1

    return spark.range(shards.start, shards.stop, 1, max(1, min(len(shards), 10_000))).mapInArrow(run, "slot long, ids binary")


def digest(written: DataFrame) -> DataFrame:
    """Where each record stands, the documents in it, and the CRC of its bytes."""
    return written.select("slot", "shard", "record", "doc_ids", "starts", "n_tokens", "record_crc32")
