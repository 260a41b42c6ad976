"""N-gram Jaccard join: documents link when their sets of 5-word shingles have similarity 0.75 or more.

The join is a blocked product of the sparse document-by-shingle incidence matrix
with its transpose. Most of the product can't reach the bound, so it is cut down
by sizes first, and what is left is verified on whole sets.

1. Sets. Each text's distinct shingle hashes (words with A-Z lower-cased); equal sets are one node from here
   on (copies need no pairs). Tasks also count shingles into fixed-size sketches
   (2**SKETCH cells), whose sum orders shingles from rare to common.
2. Columns. A pair that links shares ceil(0.75 n) shingles of either set, so
   among the n - ceil(0.75 n) + 1 first of either in a common order there is one
   that both hold. Only these enter the matrix, rare ones first, so passages
   that many documents share stay out. Columns with one node are dropped.
3. Contraction. In each column every node is paired with the column's central
   node; each node's most frequent partner is verified, if what they share of the
   matrix leaves the bound open. Groups of near copies collapse to few components in a
   pair per node, not in all pairs.
4. Product. In columns that still hold several components, blocks (component by
   component) are multiplied: overlap counts are summed for each pair of nodes of
   different components, and a pair is discarded when its count plus what may
   still follow, min(n_a - i, n_b - j), stays below 3/7 (n_a + n_b). Every pair
   that is left is verified. Pairs within a component need no proof.
5. Components of all links; every document gets the least doc_id of its own.

Nothing depends on a cap: hot columns are only ever aggregated (with map-side
combining) or joined in a way that Spark can split.

Defined results: a text of fewer than five words has its whole sequence as its
one shingle; null, empty and wordless texts have none and link with nothing; a
null doc_id has a null component and links nothing; rows with one doc_id count as
one document for reachability; repeated rows give a row each. A set is known by a
128-bit digest of its shingle hashes: its first half is the node's number, and where
two sets share that, all but one of them go by their second half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoplace.llm.components import components
from chronoplace.llm.textnp import NON_SPACE, SECOND, Words, chunks, mix, pair
from chronoplace.shared import drop, materialise

WORDS = 5
SKETCH = 22
SLICES = 64
#: A column is dealt out at once, without asking whether it is shared, from this many times the mean count of a cell.
HOT = 64
#: Rows of a key list that may be broadcast (8 MB at most); longer ones are joined by a shuffle.
FEW = 200_000
#: Rows from which a component counts as large.
LARGE = 500
# 100 * overlap >= 75 * union, as overlap * 7 >= 3 * (n_a + n_b)
SHARE, PAIR = (75, 100), (7, 3)


class Sets:
    """The shingle sets of a chunk's texts: `values`, sorted and distinct within [edges[i], edges[i + 1]) of text i."""

    def __init__(self, w: Words, k: int = WORDS) -> None:
        grams, at = w.grams(k)
        owner = w.owner()[at] if len(at) else at
        short = np.flatnonzero((w.counts > 0) & (w.counts < k))
        if len(short):
            grams, owner = np.concatenate([grams, w.sequences(short)]), np.concatenate([owner, short])
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        self.values, self.owner = grams[fresh], owner[fresh]
        self.edges = np.searchsorted(self.owner, np.arange(w.chunk.n + 1))
        self.sizes = np.diff(self.edges)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.edges[i] : self.edges[i + 1]]

    def digests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts with a set, and the two halves of each one's digest): sums of its shingles under two mixers."""
        full = np.flatnonzero(self.sizes)
        if not len(full):
            return full, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        n = self.sizes[full].astype(np.uint64)
        one, two = (np.add.reduceat(mix(self.values ^ np.uint64(salt)), self.edges[full]) for salt in (0, SECOND))
        return full, pair(one, n), pair(two, one ^ n)

    def nodes(self, strays: frozenset[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts with a set, node of each, second half of each one's digest)."""
        full, one, two = self.digests()
        node, check = node_half(one).view(np.int64), two.view(np.int64)
        if strays:
            stray = np.array([x in strays for x in zip(node.tolist(), check.tolist(), strict=True)], bool)
            node = np.where(stray, check, node)
        return full, node, check


def node_half(one: np.ndarray) -> np.ndarray:
    """The half of a digest that numbers nodes."""
    return one


def _sets_of(column: pa.Array) -> Iterator[tuple[object, Sets]]:
    for chunk in chunks(column):
        yield chunk, Sets(Words(chunk, NON_SPACE, True))


_SETS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])


def _sets(docs: DataFrame) -> DataFrame:
    """A row for each document (node, check, n), and each task's shingle counts in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH, np.uint8)
        for batch in batches:
            for chunk, sets in _sets_of(batch.column(2)):
                cells, times = np.unique(sets.values >> np.uint64(64 - SKETCH), return_counts=True)
                counts[cells] = np.minimum(counts[cells] + times, 255)
                full, node, check = sets.nodes(frozenset())
                ids = np.full(chunk.n, -1)
                ids[full] = np.arange(len(full))
                pick = pa.array(ids, mask=ids < 0)
                none = pa.nulls(chunk.n, pa.int32()), pa.nulls(chunk.n, pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(chunk.first, chunk.n) for i in (0, 1)), pa.array(node).take(pick), pa.array(check).take(pick), pa.array(sets.sizes.astype(np.int64)), *none], schema=_SETS)
        if counts.any():
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 5 + [pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in counts.reshape(SLICES, -1)])], schema=_SETS)

    return docs.mapInArrow(run, "doc_id long, text_key long, node long, check long, n long, slice int, counts binary")


def _order(rows: DataFrame) -> tuple[np.ndarray, int]:
    """The summed sketch, 2**SKETCH cells whatever the input, and the count from which a cell is hot."""

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for blob in batch.column("counts"):
                part = np.frombuffer(blob.as_py(), np.uint8).astype(np.uint32)
                sums = part if sums is None else sums + part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(sums, 0xFFFF).astype("<u2").tobytes()])], ["slice", "counts"])

    got = rows.groupBy("slice").applyInArrow(total, "slice int, counts binary").collect()
    if not got:
        return np.zeros(1 << SKETCH, np.uint16), 1
    cells = np.concatenate([np.frombuffer(r["counts"], "<u2") for r in sorted(got, key=lambda r: r["slice"])])
    return cells, max(1000, min(int(HOT * cells.mean()), 0xFFFF))


def _columns(docs: DataFrame, cells: np.ndarray, hot: int, strays: frozenset[tuple[int, int]]) -> DataFrame:
    """token, node, n, pos, hot: the first n - ceil(0.75 n) + 1 shingles of each set, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets_of(batch.column(0)):
                full, node, _ = sets.nodes(strays)
                if not len(full):
                    continue
                count = cells[sets.values >> np.uint64(64 - SKETCH)]
                order = np.lexsort((sets.values, count, sets.owner))
                place = np.arange(len(order)) - np.repeat(sets.edges[:-1], sets.sizes)
                take = sets.sizes - -(-SHARE[0] * sets.sizes // SHARE[1]) + 1
                good = place < take[sets.owner]
                first, of = order[good], np.searchsorted(full, sets.owner[good])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (sets.values[first].view(np.int64), node[of], sets.sizes[full][of].astype(np.int64), place[good].astype(np.int64), count[first] >= hot)],
                    ["token", "node", "n", "pos", "hot"],
                )

    return docs.select("text").mapInArrow(run, "token long, node long, n long, pos long, hot boolean")


def _shared(columns: DataFrame) -> DataFrame:
    """Entries of columns that two or more nodes hold; hot columns are taken to be shared."""
    packed = columns.select("token", "node", (F.shiftleft("n", 32) + F.col("pos")).alias("np"), "hot")
    # one read of the texts for both: hot entries only differ in the key they are dealt by
    salt = F.when(F.col("hot"), F.col("node")).otherwise(F.lit(0))
    by = Window.partitionBy("token", "salt").orderBy("node")
    around = packed.withColumn("salt", salt).withColumn("before", F.lag("node").over(by)).withColumn("after", F.lead("node").over(by))
    cold = (F.col("before") != F.col("node")) | (F.col("after") != F.col("node"))
    kept = around.filter((F.col("hot") & F.col("before").isNull()) | (~F.col("hot") & F.coalesce(cold, F.lit(False))))
    # partitioned by token and salt already: no further shuffle
    kept = kept.select("token", "salt", "node", "np").distinct()
    return kept.select("token", "node", F.shiftright("np", 32).alias("n"), (F.col("np").bitwiseAND(F.lit(0xFFFFFFFF))).alias("pos"))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            good = []
            a, ta = batch.column(0).to_pylist(), batch.column(2)
            at = 0
            for chunk, sets in _sets_of(batch.column(3)):
                for i in range(chunk.n):
                    other = sets.of(i)
                    if a[at] != last:
                        last = a[at]
                        ((_, one),) = _sets_of(ta.slice(at, 1))
                        mine = one.of(0)
                    both = len(mine) + len(other)
                    few, many = (mine, other) if len(mine) < len(other) else (other, mine)
                    overlap = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum()) if len(few) * 4 >= len(many) * 3 else 0
                    good.append(PAIR[0] * overlap >= PAIR[1] * both)
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["a", "b"])

    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    whole = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return whole.mapInArrow(run, "a long, b long")


def _partners(entries: DataFrame) -> DataFrame:
    """Each node with the one of its columns' central nodes that it meets most often.

    A column's central node is the one with the largest share of its own first shingles in shared columns: of a
    group of near copies, the one with the fewest changes of its own, to which most of the others are near.
    """
    shares = entries.groupBy("node").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    # the share in thousandths above, the node's low bits below, so that ties have one order
    rank = F.shiftleft(F.floor(F.col("c") * 1000 / _taken(F.col("n"))), 50).bitwiseOR(F.col("node").bitwiseAND(F.lit((1 << 50) - 1)))
    ranked = entries.select("token", "node", "n", "pos").join(shares.select("node", rank.alias("rank")), "node")
    hubs = ranked.groupBy("token").agg(F.max_by(F.struct("node", "n", "pos"), "rank").alias("hub"))
    hubs = hubs.select("token", F.col("hub.node").alias("hub"), F.col("hub.n").alias("m"), F.col("hub.pos").alias("q"))
    met = entries.join(hubs, "token").filter("node != hub").groupBy("node", "hub").agg(F.count("*").alias("c"), *(F.max(x).alias(x) for x in ("n", "m", "pos", "q")))
    # Of two sets' first shingles, those of the one whose last comes first in the order are either shared or missing from
    # the other; and before the last that is shared, what isn't shared is missing from either. So many at most are left to
    # share. A link that is missed here, for sharing shingles in columns with another centre, is met again in the product.
    most = F.least(F.greatest(F.col("n") - _taken(F.col("n")), F.col("m") - _taken(F.col("m"))), F.col("n") - F.col("pos") - 1, F.col("m") - F.col("q") - 1) + F.col("c")
    best = met.filter(PAIR[0] * most >= PAIR[1] * (F.col("n") + F.col("m"))).groupBy("node").agg(F.max(F.struct("c", "hub")).alias("best"))
    return best.select(F.col("best.hub").alias("a"), F.col("node").alias("b"))


def _taken(n: Column) -> Column:
    """How many of a set's n shingles enter the matrix."""
    return n - F.ceil(n * SHARE[0] / SHARE[1]) + 1


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is known to be small; else Spark joins it by shuffling."""
    return F.broadcast(df) if df.count() <= FEW else df


def _texts(known: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and text of the nodes in pairs: of equal sets' documents, the one with the least doc_id."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    who = sets.filter("doc_id is not null and node is not null").join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("who"))
    keys = materialise(who.select("node", "who.doc_id", "who.text_key"), "keys")
    texts = materialise(known.join(_few(keys), ["doc_id", "text_key"]).select("node", "text").dropDuplicates(["node"]), "texts")
    drop(keys)
    return texts


def _product(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, the working table that they read). Pairs (a, b) of nodes of different components that may still reach the bound. entries: token, node, n, pos, component."""
    mixed = entries.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("token")
    # In the first column that two nodes share, neither holds an earlier shingle of the other: from there on they have
    # at most n - pos left to share. So a pair that links passes the bound there, and is met there at the latest; the
    # columns in which it passes are the first of those that it shares. Heavily changed copies end here, before any pair.
    reach = F.col("n") - F.col("pos")
    entries = materialise(entries.join(mixed, "token", "left_semi").withColumn("reach", reach), "mixed")
    blocks = entries.groupBy("token", "component").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach"))
    x = blocks.select("token", F.col("component").alias("ca"), F.col("least").alias("la"), F.col("most").alias("ma"), F.col("reach").alias("ra"))
    y = blocks.select("token", F.col("component").alias("cb"), F.col("least").alias("lb"), F.col("most").alias("mb"), F.col("reach").alias("rb"))
    # a block whose sizes are too far apart, or whose best reach is too short, is empty
    blocks = x.join(y, "token").filter("ca < cb and 4 * ma >= 3 * lb and 4 * mb >= 3 * la and 7 * least(ra, rb) >= 3 * (la + lb)").select("token", "ca", "cb", "lb", "mb", F.col("rb").alias("most"))
    left = entries.select("token", F.col("component").alias("ca"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("reach").alias("ra"))
    right = entries.select("token", F.col("component").alias("cb"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("reach").alias("rb"))
    # nodes of one side that can't reach any of the other's end before the second join
    rows = blocks.join(left, ["token", "ca"]).filter("4 * na >= 3 * lb and 4 * mb >= 3 * na and 7 * least(ra, most) >= 3 * (na + lb)").drop("lb", "mb", "most")
    cells = rows.join(right, ["token", "cb"]).filter("4 * na >= 3 * nb and 4 * nb >= 3 * na and 7 * least(ra, rb) >= 3 * (na + nb)")
    sums = cells.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    bound = F.col("c") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    return sums.filter(PAIR[0] * bound >= PAIR[1] * (F.col("na") + F.col("nb"))).select("a", "b"), entries


def _strays(sets: DataFrame) -> frozenset[tuple[int, int]]:
    """(node, check) of the sets that share a node with another set of a lesser check; of n sets some n**2 / 2**65 do."""
    clash = sets.filter("node is not null").groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most")).filter("least != most")
    rows = sets.join(clash, "node").filter("check != least").select("node", "check").distinct()
    return frozenset((r.node, r.check) for r in rows.collect())


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    rows = materialise(_sets(docs), "sets")
    sets = rows.filter("slice is null").select("doc_id", "text_key", "node", "check", "n")
    cells, hot = _order(rows.filter("slice is not null").select("slice", "counts"))
    strays = _strays(sets)
    if strays:
        known_as = F.array(*(F.struct(F.lit(a).alias("node"), F.lit(b).alias("check")) for a, b in sorted(strays)))
        sets = sets.withColumn("node", F.when(F.array_contains(known_as, F.struct("node", "check")), F.col("check")).otherwise(F.col("node")))
    known = docs.filter("doc_id is not null and text is not null")
    entries = materialise(_shared(_columns(known, cells, hot, strays)), "columns")
    pairs = materialise(_partners(entries), "pairs")
    texts = _texts(known, sets, pairs)
    near = materialise(_verify(pairs, texts), "links")
    drop(pairs, texts)
    group = components(near)
    placed = entries.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    pairs, mixed = _product(placed)
    pairs = materialise(pairs, "pairs")
    drop(entries, mixed)
    texts = _texts(known, sets, pairs)
    links = materialise(near.unionByName(_verify(pairs, texts)), "links")
    drop(near, pairs, texts)
    group = components(links)
    drop(links)
    # rows that share a doc_id tie their components together
    placed = materialise(sets.join(group, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    drop(rows)
    return _least(placed)


def _least(placed: DataFrame) -> DataFrame:
    """The least doc_id of each component; several components of one doc_id are one."""
    own = placed.filter("doc_id is not null and component is not null")
    twice = own.groupBy("doc_id").agg(F.min("component").alias("b"), F.max("component").alias("hi")).filter("b != hi")
    if not twice.isEmpty():
        ties = own.join(twice.select("doc_id", "b"), "doc_id").filter("component != b").select(F.col("component").alias("a"), "b")
        joined = components(ties).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        placed = placed.join(joined, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    least = placed.filter("doc_id is not null and component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size"))
    least = materialise(least, "least")
    # large components are few: their rows stay where they are, and only the others are dealt by component
    large = least.filter(F.col("size") > LARGE).select("component", "component_id")
    if 0 < large.count() <= FEW:
        many = placed.join(F.broadcast(large), "component")
        rest = placed.join(F.broadcast(large.select(F.col("component").alias("c"))), F.col("component") == F.col("c"), "left_anti")
        out = rest.join(least.select("component", "component_id"), "component", "left").unionByName(many)
    else:
        out = placed.join(least.select("component", "component_id"), "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the least doc_id; rows without a doc_id stay.

    Of rows that repeat a doc_id one stays: the longest text, and the least of those.
    """
    found = materialise(join(docs), "components")
    twice = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1")
    kept = docs.join(_few(found.filter("doc_id != component_id").select("doc_id").distinct()), "doc_id", "left_anti")
    if not twice.isEmpty():
        by = Window.partitionBy("doc_id").orderBy(F.length("text").desc_nulls_last(), "text")
        # the row is set aside, so that no column of the input meets one made here
        marked = kept.filter("doc_id is not null").select(F.struct("*").alias("row"), "doc_id", "text").select("row", F.row_number().over(by).alias("place"))
        kept = marked.filter("place = 1").select("row.*").unionByName(kept.filter("doc_id is null"))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
