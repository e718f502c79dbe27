"""Sharding by a hierarchical weighted hash tree. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from evispan.llm._common import cut


@dataclass(frozen=True)
class Node:
    """A region, a rack or a shard. ``shard`` is set on leaves; ``weight`` of an inner node is the sum below it."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = field(default_factory=tuple)
    shard: int | None = None


def inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def tree(regions: int = 2, racks: int = 3, shards: int = 4, weights: dict[int, float] | None = None) -> Node:
    """Root, ``regions``, ``racks`` a region and ``shards`` a rack; shards are numbered from 0, weight 1 unless given."""
    weights, at, out = weights or {}, 0, []
    for r in range(regions):
        inside = []
        for k in range(racks):
            leaves = [Node(f"shard{at + i}", weights.get(at + i, 1.0), shard=at + i) for i in range(shards)]
            at += shards
            inside.append(inner(f"region{r}/rack{k}", leaves))
        out.append(inner(f"region{r}", inside))
    return inner("root", out)


def leaves(node: Node) -> list[Node]:
    return [node] if node.shard is not None else [x for c in node.children for x in leaves(c)]


def grow(root: Node, weight: float = 1.0) -> Node:
    """One more shard, as a rack and region of its own.

    Nothing below the old regions changes weight, so no draw among old nodes changes: the new region wins some
    rows from the root's draw and every other row stays where it was.
    """
    at = max((x.shard for x in leaves(root)), default=-1) + 1
    name = f"region+{at}"
    return inner(root.name, [*root.children, inner(name, [inner(f"{name}/rack0", [Node(f"shard{at}", weight, shard=at)])])])


def reweigh(root: Node, shard: int, weight: float) -> Node:
    """Another weight for one shard. Rows move only within, into or out of the region and rack that hold it."""
    if root.shard is not None:
        return replace(root, weight=weight) if root.shard == shard else root
    return inner(root.name, [reweigh(c, shard, weight) for c in root.children])


def _draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight with u in (0, 1) from the key and the node's name: the least wins, in proportion to weight."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
    return -F.log(u) / F.lit(float(node.weight))


def place(key: Column, root: Node) -> Column:
    """The shard of a key: from the root down, the child with the least draw at each level.

    Children without weight take no part. A null key draws by the node names alone, so all null keys share a shard.
    """
    if root.shard is not None:
        return F.lit(root.shard)
    live = [c for c in root.children if c.weight > 0]
    if not live:
        raise ValueError(f"{root.name}: no child has weight")
    if len(live) == 1:
        return place(key, live[0])
    best = F.array_min(F.array(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)]))["i"]
    out = place(key, live[-1])
    for i in range(len(live) - 2, -1, -1):
        out = F.when(best == i, place(key, live[i])).otherwise(out)
    return out


def assign(df: DataFrame, root: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard of each row under the law ``key``: id and tree decide, nothing else.

    One row per input row: ``doc_id, size`` (UTF-8 bytes + 8; null text: 8), ``text_crc32`` (unsigned; null text
    as empty), ``law``, ``shard``, ``slot`` (place in its shard, gapless from 0), ``grown_shard`` (with one more
    shard). Repeated rows each get a slot of their own; a null id is a key like any other; an empty table gives none;
    further columns are not looked at.

    The text is read once and never shuffled. Slots: rows are ranked within (shard, input partition), which no
    key or copy group can make larger than an input partition, and counts a partition give the offsets.
    """
    root = root or tree()
    key, text = F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(key.alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place(key, root).alias("shard"), place(key, grow(root)).alias("grown_shard"), F.spark_partition_id().alias("part"))
    rows = cut(rows, "shards")  # one evaluation: the partition number must be the same for counts and rows
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(within).cast("long") - 1)
    return ranked.join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), (F.col("offset") + F.col("rank")).alias("slot"), F.col("grown_shard").cast("int"))
