"""Sharding by a hierarchical weighted hash tree.

A tree has three levels: regions, racks, shards. A key descends from the root; on each level every
child draws -ln(u) / weight, u in (0, 1) a hash of key, level and child, and the smallest draw wins, so
that a child gets rows in proportion to its weight. A draw depends on nothing but the key and the
child's own weight: if a weight changes, keys move only into or out of that child's subtree, and
below the other children nothing moves at all.

Growth (`grown`) adds a shard as a subtree of its own, region and rack included. No weight that
exists changes, so the new shard takes rows and no other shard receives any.

Everything is column arithmetic on the key: the tree, a parameter, is a literal map from node to children.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, numbered, packed, unpacked

SIZE_OVERHEAD = 16


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, racks_per_region: int = 5, shards_per_rack: int = 4) -> list[Leaf]:
    """`shards` equal shards in racks and regions of fixed capacity."""
    per_region = racks_per_region * shards_per_rack
    return [Leaf(s // per_region, s // shards_per_rack, s) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region and rack of its own."""
    top = lambda pick: max((pick(leaf) for leaf in tree), default=-1) + 1
    return [*tree, Leaf(top(lambda x: x.region), top(lambda x: x.rack), top(lambda x: x.shard), weight)]


def _children(tree: list[Leaf], level: int) -> dict[int, list[tuple[int, float]]]:
    """For a level (0 regions, 1 racks, 2 shards): parent -> children with the weights of their subtrees."""
    path = lambda leaf: (0, leaf.region, leaf.rack, leaf.shard)
    weights: dict[int, dict[int, float]] = {}
    for leaf in tree:
        below = weights.setdefault(path(leaf)[level], {})
        child = path(leaf)[level + 1]
        below[child] = below.get(child, 0.0) + leaf.weight
    return {p: sorted(c.items()) for p, c in weights.items()}


def _choice(key: Column, level: int, parent: Column, tree: list[Leaf]) -> Column:
    nodes = F.map_from_entries(F.array(*[
        F.struct(F.lit(p), F.array(*[F.struct(F.lit(c).alias("id"), F.lit(w).alias("w")) for c, w in children]))
        for p, children in sorted(_children(tree, level).items())
    ]))

    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child["id"]), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / child["w"]).alias("draw"), child["id"].alias("id"))

    return F.array_min(F.transform(nodes[parent], draw))["id"]


def place(key: Column, tree: list[Leaf]) -> tuple[Column, Column, Column]:
    """Region, rack and shard of a key (null is a key like any other). Shards of weight 0 get nothing."""
    live = [leaf for leaf in tree if leaf.weight > 0]
    if not live:
        raise ValueError("the tree has no shard with a weight")
    region = _choice(key, 0, F.lit(0), live)
    rack = _choice(key, 1, region, live)
    return region, rack, _choice(key, 2, rack, live)


def shard(docs: DataFrame, tree: list[Leaf], key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Assigns every row a shard and a slot in it.

    Adds size (UTF-8 bytes of the text plus 16), text_crc32 (unsigned), law ('key'), region, rack,
    shard, slot (0, 1, ... without gaps per shard) and grown_shard (with one more shard), in place
    of columns of these names. `keep` names the columns to carry along (default: all).

    Null text: size 16, checksum 0. Null keys share one shard. Repeated rows each get a slot; equal
    keys get equal shards. An empty table gives an empty result.

    Slots are numbered per shard and input task, so no shard's rows meet in one task.
    """
    region, rack, chosen = place(F.col(key), tree)
    later = place(F.col(key), grown(tree))[2]
    added = {
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(SIZE_OVERHEAD)).cast("bigint"),
        "text_crc32": F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("bigint"),
        "law": F.lit("key"),
        "region": region.cast("int"), "rack": rack.cast("int"), "shard": chosen.cast("int"), "grown_shard": later.cast("int"),
    }
    laid = materialize(
        docs.select(packed(docs, [*added, "slot"], keep).alias("__doc"), *[c.alias(n) for n, c in added.items()],
                    F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")),
        "shards",
    )
    out = numbered(laid, ["shard"], "__part", [F.col("__row")], "slot")
    return out.select(*unpacked(out, "__doc"), *added, "slot")
