"""Sharding by a hierarchical weighted hash tree.

A document descends from region to rack to shard. At each node every child draws
``-ln(u) / weight`` with ``u`` from a hash of the document's key and the child's name, and
the smallest draw wins, so a child gets its share of weight, and a changed weight moves
documents only into or out of the subtree whose weight changed. ``grow`` puts a new shard
into a region of its own: then documents move only into that shard.

Defined results: the key alone decides the shard; null is a key like any other; repeated
rows go to one shard and get slots of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of a shard that are numbered apart.
CHUNKS = 4096


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def unit_tree(regions: int = 2, racks: int = 2, shards: int = 2) -> list[Leaf]:
    """Equal shards, numbered from 0."""
    places = [(r, k) for r in range(regions) for k in range(racks) for _ in range(shards)]
    return [Leaf(f"region{r}", f"rack{r}.{k}", i) for i, (r, k) in enumerate(places)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own."""
    shard = max(x.shard for x in tree) + 1
    return [*tree, Leaf(f"region+{shard}", f"rack+{shard}", shard, weight)]


def _winner(key: Column, children: Column) -> Column:
    """The child (name, weight, next) with the smallest weighted draw; equal draws: by name."""
    u = lambda c: (F.pmod(F.xxhash64(key, c["name"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    draws = F.transform(children, lambda c: F.struct((-F.log(u(c)) / c["weight"]).alias("d"), c["name"].alias("n"), c["next"].alias("x")))
    return F.array_min(draws)["x"]


def _children(rows: list[tuple[str, float, int]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(x).alias("next")) for n, w, x in rows])


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard of ``key``; leaves of weight 0 get nothing."""
    tree = [x for x in tree if x.weight > 0]
    if not tree:
        raise ValueError("no shard has weight")
    if len({x.shard for x in tree}) < len(tree):
        raise ValueError("shards must be distinct")
    weight = lambda xs: sum(x.weight for x in xs)
    regions = sorted({x.region for x in tree})
    racks = sorted({(x.region, x.rack) for x in tree})
    of_region = {r: [x for x in tree if x.region == r] for r in regions}
    of_rack = {k: [x for x in tree if (x.region, x.rack) == k] for k in racks}
    top = _children([(f"region {r}", weight(of_region[r]), i) for i, r in enumerate(regions)])
    middle = F.array(
        *[_children([(f"rack {r} {k[1]}", weight(of_rack[k]), j) for j, k in enumerate(racks) if k[0] == r]) for r in regions]
    )
    bottom = F.array(*[_children([(f"shard {x.shard}", x.weight, x.shard) for x in of_rack[k]]) for k in racks])
    rack = _winner(key, F.get(middle, _winner(key, top)))
    return _winner(key, F.get(bottom, rack))


def assign(rows: DataFrame, key: str, tree: list[Leaf], chunks: int = CHUNKS) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, which numbers each shard's rows from 0 without gaps.

    A shard is numbered in ``chunks`` pieces by hash of the key: the sizes of the pieces
    give each its first slot, so no task sorts a whole shard.
    """
    others = [c for c in rows.columns if c not in ("shard", "slot", key)]
    placed = rows.drop("shard", "slot").withColumn("shard", shard_of(F.col(key), tree))
    placed = placed.withColumn("_h", F.xxhash64(key)).withColumn("_chunk", F.pmod(F.shiftright("_h", 8), F.lit(chunks)))
    sizes = placed.groupBy("shard", "_chunk").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    numbered = placed.join(first, ["shard", "_chunk"])
    place = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("_h", key, *others))
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    return numbered.select(*kept, "shard", (F.col("_first") + place - 1).alias("slot"))
