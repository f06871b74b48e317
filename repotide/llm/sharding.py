"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repotide.llm.common import numbered, rows_in

#: (region, rack, shard, weight)
Leaf = tuple[str, str, int, float]


def even_tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Shards 0.. of weight 1 in racks and regions of fixed sizes."""
    return [(f"region{s // (per_rack * racks)}", f"rack{s // per_rack}", s, 1.0) for s in range(shards)]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region and rack of its own.

    Only the new region's weight changes at the root, so rows move into the new shard and nowhere else.
    """
    n = max((leaf[2] for leaf in tree), default=-1) + 1
    return [*tree, (f"region-of-{n}", f"rack-of-{n}", n, weight)]


def _draw(key: Sequence[Column], path: str, children: Sequence[tuple[str, float]]) -> Column:
    """The child with the longest straw, ``ln(u) / weight`` with u in (0, 1] from a hash of key and node.

    A child's straw depends on its own name and weight alone: when a weight changes, rows move only to
    or from that child.
    """
    def straw(name: str, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(f"{path}/{name}")), 11)
        u = (bits.cast("double") + 1.0) / float(1 << 53)
        return F.struct((F.log(u) / weight).alias("straw"), F.lit(name).alias("name"))

    if len(children) == 1:
        return F.lit(children[0][0])
    return F.array_max(F.array(*[straw(*c) for c in children]))["name"]


def tree_shard(key: Sequence[Column], tree: Sequence[Leaf]) -> Column:
    """Shard of a key: one weighted draw among the regions, one among that region's racks, one among its shards.

    Leaves of weight 0 or less get nothing. A null key is a key like any other.
    """
    leaves = [leaf for leaf in tree if leaf[3] > 0]
    if not leaves:
        raise ValueError("no shard has a positive weight")

    def level(depth: int, path: str, below: list[Leaf]) -> Column:
        named = sorted(below, key=lambda leaf: str(leaf[depth]))
        groups = [(str(k), list(g)) for k, g in itertools.groupby(named, key=lambda leaf: leaf[depth])]
        children = [(name, sum(leaf[3] for leaf in g)) for name, g in groups]
        pick = _draw(key, path, children)
        if depth == 2:
            return pick.cast("int")
        if len(groups) == 1:
            return level(depth + 1, f"{path}/{groups[0][0]}", groups[0][1])
        out = None
        for name, g in groups[:-1]:
            hit, sub = pick == name, level(depth + 1, f"{path}/{name}", g)
            out = F.when(hit, sub) if out is None else out.when(hit, sub)
        name, g = groups[-1]
        return out.otherwise(level(depth + 1, f"{path}/{name}", g))

    return level(0, "", leaves)


def shard_documents(docs: DataFrame, tree: Sequence[Leaf], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, slot and the shard after one more shard for every document.

    Law ``key``: the id and the tree decide. Columns: doc_id, size (UTF-8 bytes plus 1; a null text has
    none), text_crc32 (of the UTF-8 bytes; 0 for null or empty), law, shard, slot (gapless from 0 inside a
    shard), grown_shard. One row per input row: repeated rows get the same shard and different slots, a
    null id is a key like any other, an empty table gives an empty result; other columns are ignored.
    The text is read in the scan and never shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.col(id_col).alias("doc_id")]
    placed = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"),
        tree_shard(key, tree).alias("shard"), tree_shard(key, grown(tree)).alias("grown_shard"))
    out = numbered(placed, ["shard"], ["doc_id", "text_crc32"], "slot", rows_in(docs))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
