"""Sharding by a hierarchical weighted hash tree (operator 7).

A layout is a tree region / rack / shard with weights at the leaves; an
inner node weighs the sum of its leaves. A row descends the tree: at each
level every child draws ``-ln(u) / weight`` with ``u`` a hash of (row key,
child name) in (0, 1), and the smallest draw wins, so a child gets rows in
proportion to its weight. A draw depends on nothing but the key, the child's
name and its weight: changing one shard's weight moves rows only into or out
of the subtrees on its path.

Law ``key``: a shard added by ``grown`` opens a region of its own. No other
weight changes, so the new shard takes rows only into itself and no row
moves between old shards, for any number of added shards.

Only DataFrame functions are used. Rows are numbered within a shard in two
levels (shard x hash bucket, then prefix sums over bucket counts), so no
shard passes through one task.

Defined cases: null key -> hashed as null (one fixed shard); null text ->
no bytes, crc of nothing; repeated rows -> same shard, distinct slots; empty
table -> empty result; extra columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_named, text_of


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(regions: int = 2, racks: int = 3, shards: int = 4) -> list[Leaf]:
    """A full tree of equal shards, numbered from 0 along the leaves."""
    return [Leaf(f"r{r}", f"r{r}/k{k}", (r * racks + k) * shards + s)
            for r in range(regions) for k in range(racks) for s in range(shards)]


def grown(leaves: list[Leaf], added: int = 1, weight: float = 1.0) -> list[Leaf]:
    """``leaves`` and ``added`` new shards, each in a region of its own."""
    first = 1 + max(leaf.shard for leaf in leaves)
    return [*leaves, *[Leaf(f"n{n}", f"n{n}/k0", n, weight) for n in range(first, first + added)]]


def _levels(leaves: list[Leaf]) -> list[dict[str, dict[str, float]]]:
    """Per level: parent name -> child name -> weight."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for leaf in leaves:
        if leaf.weight <= 0:
            continue
        path = ("", leaf.region, leaf.rack, str(leaf.shard))
        for depth in range(3):
            kids = levels[depth].setdefault(path[depth], {})
            kids[path[depth + 1]] = kids.get(path[depth + 1], 0.0) + leaf.weight
    return levels


def _draw(key: Column, depth: int):
    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(depth), child["name"]), 11)
        u = (bits.cast("double") + 0.5) / F.lit(float(2 ** 53))
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["name"].alias("name"))
    return draw


def placement(key: Column, leaves: list[Leaf]) -> Column:
    """The shard (int) that ``key`` descends to."""
    node: Column = F.lit("")
    for depth, level in enumerate(_levels(leaves)):
        children = F.create_map(*[x for parent, kids in level.items() for x in (
            F.lit(parent), F.array(*[F.struct(F.lit(name).alias("name"), F.lit(w).alias("weight"))
                                     for name, w in kids.items()]))])

        node = F.array_min(F.transform(F.element_at(children, node), _draw(key, depth)))["name"]
    return node.cast("int")


def slots(df: DataFrame, shard: str, order: list[str], fine: int = 4096) -> DataFrame:
    """Add ``slot``: 0, 1, ... without gaps within each shard.

    Rows of a shard are split over ``fine`` hash buckets; a window numbers a
    bucket, and prefix sums over one count per (shard, bucket) shift it.
    """
    b = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(fine)))
    counts = b.groupBy(shard, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(shard, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inner = Window.partitionBy(shard, "__b").orderBy(*order)
    return (b.withColumn("__rn", F.row_number().over(inner)).join(shift, [shard, "__b"])
            .withColumn("slot", F.col("__shift") + F.col("__rn") - 1).drop("__b", "__n", "__rn", "__shift"))


def shard_documents(docs: DataFrame, leaves: list[Leaf], key: str = "doc_id", text: str = "text",
                    added: int = 1) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) per row of ``docs``.

    ``grown_shard`` is the shard once ``added`` more shards have been opened.
    """
    d = rows_named(docs, key, text)
    body = text_of(d, text)
    d = d.select(F.col(key), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
                 F.crc32(body.cast("binary")).alias("text_crc32"))
    d = d.withColumn("shard", placement(F.col(key), leaves)).withColumn(
        "grown_shard", placement(F.col(key), grown(leaves, added)))
    return slots(d, "shard", [key, "text_crc32", "size"])
