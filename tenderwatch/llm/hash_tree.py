"""Sharding by a hierarchical weighted hash tree.

A row descends from the root to a region, a rack and a shard. At every level each child draws
``-ln(u) / weight`` from a hash of the row's id and the child's name, and the smallest draw wins, so
a child gets a share in proportion to its weight. A draw depends on nothing but the row, the name
and the child's own weight: if a weight grows, rows move only into that subtree, if it falls, only
out of it, and all other subtrees keep what they had between them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderwatch.llm.common import numbered
from tenderwatch.sources.storage import settle

SHARDS = 24
REGIONS, RACKS = 3, 2
#: bytes that a row is counted with besides its text
ROW_BYTES = 8


@dataclass(frozen=True)
class Node:
    """A subtree: a shard number, or children by name; the weight of an inner node is their sum."""

    children: Mapping[str, Node] | None = None
    shard: int = -1
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children.values()) if self.children else self.leaf_weight


def tree(base: int = SHARDS, added: int = 0) -> Node:
    """``base`` shards spread over regions of racks, and ``added`` ones, all of equal weight.

    An added shard opens a region of its own: its weight then changes no subtree that holds other
    shards, so rows move into it alone.
    """
    regions: dict[str, Node] = {}
    for r in range(REGIONS):
        racks = {}
        for k in range(RACKS):
            of = range(r * RACKS + k, base, REGIONS * RACKS)
            if of:
                racks[f"k{k}"] = Node({f"s{n}": Node(shard=n) for n in of})
        if racks:
            regions[f"r{r}"] = Node(racks)
    for n in range(base, base + added):
        regions[f"r{REGIONS + n - base}"] = Node({"k0": Node({f"s{n}": Node(shard=n)})})
    return Node(regions)


def _uniform(key: Column, name: str) -> Column:
    """A draw in (0, 1) from the first 48 bits of an MD5 digest, which every SQL engine has."""
    digest = F.substring(F.md5(F.concat(key, F.lit(f"/{name}"))), 1, 12)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 48)


def descend(rows: DataFrame, key: Column, root: Node, name: str) -> DataFrame:
    """Add the shard of ``key`` as ``name``: level by level, the child of the smallest draw."""
    paths: dict[str, Node] = {"": root}
    rows = rows.withColumn("_path", F.lit(""))
    while any(n.children for n in paths.values()):
        step, below = None, {}
        for path, node in paths.items():
            live = {k: c for k, c in (node.children or {}).items() if c.weight > 0}
            below |= {f"{path}{k}.": c for k, c in live.items()}
            draws = [
                F.struct((-F.ln(_uniform(key, path + k)) / c.weight).alias("draw"), F.lit(f"{path}{k}.").alias("to"))
                for k, c in live.items()
            ]
            to = F.least(*draws)["to"] if len(draws) > 1 else draws[0]["to"]
            step = F.when(F.col("_path") == path, to) if step is None else step.when(F.col("_path") == path, to)
        rows, paths = rows.withColumn("_path", step), below
    shards = F.create_map(*[F.lit(x) for path, n in paths.items() for x in (path, n.shard)])
    return rows.withColumn(name, shards[F.col("_path")]).drop("_path")


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Law ``key``: id and shard count decide. ``slot`` numbers the rows of a shard from 0 by id;
    ``grown_shard`` is the shard with one more. NULL text is empty; rows with a NULL id all go one
    way, and rows that repeat an id share a shard. An empty table gives an empty result; other
    columns are never read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = descend(descend(rows, key, tree(shards), "shard"), key, tree(shards, 1), "grown_shard")
    slots = numbered(settle(rows, "placed"), ["shard"], ["doc_id", "text_crc32"], "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard"
    )
