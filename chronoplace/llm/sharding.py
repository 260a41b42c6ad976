"""Sharding by a hierarchical weighted hash tree (law `key`).

Native: DataFrame functions only.

A tree has regions, racks and shards; a rack weighs what its shards weigh, a
region what its racks do. A key descends from the root: at each level every child
of the chosen node draws -ln(u) / weight, u from a hash of the key and the child's
name, and the least draw is gone down to. That is a weighted draw at each level, and
a child's draw depends on its own weight and name alone. So when a shard's weight
changes, the draws of its rack and region change with it and no others do: keys move
into or out of that region at the first level, into or out of that rack at the second
(if they stay in the region), and between its shards at the third; keys elsewhere stay
where they are. A shard that is added as a region of its own changes no existing
weight and so takes rows only into itself; `grown` does that. A key costs a hash for
each child of the nodes on its way, not for each shard.

Slots number each shard's rows without gaps, in the order of a hash of key, size and
CRC. A single sort for each shard would put a shard's rows in one task, so hashes are
dealt into ranges, ranges are counted, and a row's slot is its range's offset plus its
rank in it. Ranges are as many as the session's shuffle partitions, so they grow with
the cluster; the counts (shards x ranges) are all that is gathered. Slots don't depend
on the number of ranges.

Defined results: a null key is hashed as the empty string; a null text has size
1 and CRC 0; repeated rows take slots of their own (ties have the same columns,
so their order can't be seen); empty tables give empty results; input columns
with clashing names are not carried along; a subtree of weight 0 gets no key, and a
tree without weight is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a hash that are used: as many as 13 hexadecimal digits hold, and a double holds them exactly.
BITS = 52


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    index: int
    weight: float = 1.0


@dataclass(frozen=True)
class Node:
    """A node of the tree; only shards have an index."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    index: int | None = None


def tree(shards: list[Shard]) -> Node:
    """Root, regions, racks, shards. Names are paths, so equal rack names in two regions are two racks."""
    regions: dict[str, dict[str, list[Node]]] = {}
    for s in shards:
        if s.weight < 0:
            raise ValueError("weights must not be negative")
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(Node(f"{s.region}/{s.rack}/{s.index}", s.weight, (), s.index))
    above = lambda name, nodes: Node(name, sum(n.weight for n in nodes), tuple(nodes))
    root = above("", [above(r, [above(f"{r}/{k}", leaves) for k, leaves in racks.items()]) for r, racks in regions.items()])
    if not root.weight:
        raise ValueError("no shard has a weight")
    return root


def grid(n: int, racks: int = 2, per_rack: int = 4) -> list[Shard]:
    """n shards of weight 1 in racks of `per_rack`, regions of `racks` racks."""
    return [Shard(f"region{i // (racks * per_rack)}", f"rack{i // per_rack}", i) for i in range(n)]


def grown(shards: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own."""
    index = max(s.index for s in shards) + 1
    return [*shards, Shard(f"added{index}", "rack", index, weight)]


def hashed(*parts: Column) -> Column:
    """BITS bits of a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def draw(key: Column, child: Column) -> Column:
    """-ln(u) / weight with u in (0, 1] from the key and the child's name."""
    return -F.ln((hashed(key, child["name"]) + 1).cast("double") / float(1 << BITS)) / child["weight"]


def descend(key: Column, root: Node) -> Column:
    """The shard of a key: at each level, the child with the least draw among the chosen node's children."""
    level, chosen = [root], F.lit(0)
    for _ in range(3):
        # each node's children as (name, weight, number in the next level); a child without weight isn't one
        below, lists = [], []
        for node in level:
            mine = [c for c in node.children if c.weight > 0]
            lists.append([(c, len(below) + i) for i, c in enumerate(mine)])
            below += mine
        child = lambda c, i: F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"), F.lit(i).alias("number"))
        children = F.element_at(F.array(*(F.array(*(child(c, i) for c, i in own)) for own in lists)), chosen + 1)
        chosen = F.array_min(F.transform(children, lambda c: F.struct(draw(key, c).alias("draw"), c["number"].alias("number"))))["number"]
        level = below
    return F.element_at(F.array(*(F.lit(leaf.index) for leaf in level)), chosen + 1)


def assign(df: DataFrame, shards: list[Shard], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """Adds the shard of each row. No shuffle."""
    return df.withColumn(name, descend(F.coalesce(F.col(key).cast("string"), F.lit("")), tree(shards)))


def slots(df: DataFrame, key: str = "doc_id", shard: str = "shard", name: str = "slot", order: tuple[str, ...] = ()) -> DataFrame:
    """Adds a row's place in its shard, gapless from 0, in the order of a hash of key and `order` columns."""
    blocks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the hash also takes the other columns: rows that share one key then still spread over the blocks
    hash_ = hashed(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *order)), F.lit("slot"))
    dealt = df.withColumn("__hash", hash_).withColumn("__block", F.floor(F.col("__hash") * float(blocks) / float(1 << BITS)).cast("int"))
    counts = dealt.groupBy(shard, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    within = Window.partitionBy("__block", shard).orderBy("__hash", key, *order)
    ranked = dealt.withColumn("__rank", F.row_number().over(within) - 1)
    joined = ranked.join(offsets.withColumnsRenamed({shard: "__s", "__block": "__b"}), (F.col(shard) == F.col("__s")) & (F.col("__block") == F.col("__b")))
    return joined.withColumn(name, (F.col("__from") + F.col("__rank")).cast("long")).drop("__hash", "__block", "__rank", "__s", "__b", "__from")


def place(df: DataFrame, n: int = 16, shards: list[Shard] | None = None, after: list[Shard] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of a documents table."""
    shards = shards or grid(n)
    rows = df.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = assign(assign(rows, shards), after or grown(shards), name="grown_shard")
    return slots(rows, order=("size", "text_crc32")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
