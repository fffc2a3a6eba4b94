"""Hierarchical weighted hash tree: a row descends region, rack and shard by weighted hash draws.

At a node each child c draws -ln(u) / weight(c), where u is a hash of the row's key and the child's
name; the least draw wins, so children win in proportion to their weights, and a change of one
weight only moves rows to or from that child. The weight of an inner node is the sum of its
shards. A grown tree adds its shard in a region of its own: no weight inside the old regions
changes, so rows move into the new shard alone.

Everything is a column expression; the one shuffle numbers rows within shards. Equal rows are first
counted together, then numbered by prefix sums over hash buckets of a shard (``BUCKETS`` each),
so neither a large shard nor a row repeated many times is ever gathered in one task.

Defined cases: a null text has no bytes (size 8, CRC 0); a null doc_id is a key of its own; repeated
rows get a slot each, next to each other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

BUCKETS = 1024
#: Rows of the table of bases (32 bytes each) that is broadcast at most; slots of one row that are made at once.
BROADCAST_BASES, RUN = 1 << 20, 1 << 16


@dataclass(frozen=True)
class Node:
    """An inner node, or a shard with its number and weight."""

    name: str
    children: tuple[Node, ...] = field(default=())
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(regions: int = 3, racks: int = 2, shards: int = 4) -> Node:
    """A regular tree of equal shards, numbered from 0."""
    number = iter(range(regions * racks * shards))
    return Node("", tuple(Node(f"{r}", tuple(Node(f"{r}/{k}", tuple(Node(f"{r}/{k}/{s}", shard=next(number)) for s in range(shards))) for k in range(racks))) for r in range(regions)))


def grown(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    r, number = len(root.children), sum(1 for _ in _shards(root))
    return Node(root.name, (*root.children, Node(f"{r}", (Node(f"{r}/0", (Node(f"{r}/0/0", shard=number, own_weight=weight),)),))))


def _shards(node: Node):
    if not node.children:
        yield node
    for c in node.children:
        yield from _shards(c)


def _draw(key: Column, child: Node) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(child.weight))


def _child(key: Column, node: Node) -> Column:
    """The position of the child that wins at a node."""
    if len(node.children) == 1:
        return F.lit(0)
    return F.least(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)])["i"]


def with_shard(rows: DataFrame, key: str, root: Node, name: str) -> DataFrame:
    """rows with the shard of their key in a tree of three levels."""
    region, rack = f"_{name}_region", f"_{name}_rack"
    key_ = F.col(key)

    def where(column: Column, options: list[Column]) -> Column:
        out = options[0]
        for i, x in enumerate(options[1:], 1):
            out = F.when(column == i, x).otherwise(out)
        return out

    rows = rows.withColumn(region, _child(key_, root))
    rows = rows.withColumn(rack, where(F.col(region), [_child(key_, r) for r in root.children]))

    def shard(rack_node: Node) -> Column:
        numbers = F.array(*[F.lit(s.shard) for s in rack_node.children])
        return F.get(numbers, _child(key_, rack_node))

    chosen = where(F.col(region), [where(F.col(rack), [shard(k) for k in r.children]) for r in root.children])
    return rows.withColumn(name, chosen.cast("int")).drop(region, rack)


def place(documents: DataFrame, root: Node | None = None, more: Node | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents (doc_id, text)."""
    root = root or tree()
    more = more or grown(root)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    distinct = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    placed = with_shard(with_shard(distinct, "doc_id", root, "shard"), "doc_id", more, "grown_shard")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("size", "text_crc32", "doc_id"), F.lit(BUCKETS)).cast("int"))
    placed = runtime.written(placed, "placed-rows")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("held"))  # at most shards * BUCKETS rows
    base = per_bucket.select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    if sum(1 for _ in _shards(root)) * BUCKETS <= BROADCAST_BASES:
        base = F.broadcast(base)
    numbered = placed.withColumn("upto", F.sum("n").over(within)).join(base, ["shard", "bucket"])
    first = F.col("base") + F.col("upto") - F.col("n")
    numbered = numbered.select("doc_id", "size", "text_crc32", "shard", "grown_shard", first.alias("first"), "n")
    # A row that is repeated often gets its slots run by run, so that no array is longer than RUN.
    runs = numbered.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(RUN).cast("long"))))
    each = F.sequence(F.col("first") + F.col("run"), F.col("first") + F.least(F.col("run") + RUN, F.col("n")) - 1)
    return runs.withColumn("slot", F.explode(each)).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
