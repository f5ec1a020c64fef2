"""Placing documents in shards by a hierarchical weighted hash tree.

A topology is a tree of regions, racks and shards; a node weighs as much as its
shards together. A document descends from the root: at each level every child
draws ``-ln(u) / weight`` with ``u`` hashed from the document id and the child, and
the smallest draw wins. A child's draw depends on its own weight alone, so when a
weight changes, documents move only into or out of the subtrees it belongs to.

Everything is a column expression; the only shuffle carries ids and sizes, never text.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the hash that spreads the rows of a shard for numbering.
SPREAD_DIGITS = 2


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = 5, racks: int = 4) -> list[Shard]:
    """Equal shards, ``per_rack`` in a rack and ``racks`` in a region."""
    return [Shard(s // (per_rack * racks), s // per_rack, s) for s in range(shards)]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """``tree`` with one more shard in a region and rack of its own.

    No other subtree gains weight, so documents move only into the new shard.
    """
    return [*tree, Shard(*(max(node[i] for node in tree) + 1 for i in range(3)), weight)]


def _unit(key: Column, level: str, node: Column) -> Column:
    """Number in (0, 1] from 52 bits of a hash."""
    digest = F.md5(F.concat_ws("|", key, F.lit(level), node.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)


def _draw(key: Column, level: str, children: Column) -> Column:
    """The child with the smallest weighted draw, ties to the smaller number."""
    return F.array_min(F.transform(children, lambda c: F.struct(
        (-F.ln(_unit(key, level, c["node"])) / c["weight"]).alias("draw"),
        c["node"].alias("node"))))["node"]


def _children(tree: list[Shard], parent: int | None, child: int) -> Column:
    """Map from a parent's number (0 for the root) to its children with their weights."""
    weights: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for node in tree:
        weights[0 if parent is None else node[parent]][node[child]] += node.weight
    entries: list[Column] = []
    for top, nodes in sorted(weights.items()):
        entries += [F.lit(top), F.array(*(
            F.struct(F.lit(n).alias("node"), F.lit(float(w)).alias("weight"))
            for n, w in sorted(nodes.items()) if w > 0))]
    return F.create_map(*entries)


def place(docs: DataFrame, tree: list[Shard], key: Column, name: str) -> DataFrame:
    """``docs`` with the shard of ``key`` as column ``name``; a null key is one more key."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    region, rack = f"{name}_region", f"{name}_rack"
    return (docs
            .withColumn(region, _draw(key, "region", F.element_at(_children(tree, None, 0), 0)))
            .withColumn(rack, _draw(key, "rack", F.element_at(_children(tree, 0, 1), F.col(region))))
            .withColumn(name, _draw(key, "shard", F.element_at(_children(tree, 1, 2), F.col(rack))))
            .drop(region, rack))


def shard_documents(docs: DataFrame, tree: list[Shard], grown: list[Shard] | None = None,
                    spread_digits: int = SPREAD_DIGITS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) of every document.

    ``size`` is the UTF-8 length plus 16 and ``slot`` numbers the rows of a shard from 0
    without gaps. A shard is numbered in 16 ** ``spread_digits`` pieces, each counted
    first, so no task holds a whole shard; the table of piece counts has at most that many
    rows per shard and is broadcast. A null text counts as empty. Repeated rows get slots
    of their own, and rows with one id share a shard. An empty table gives no rows; other
    columns of ``docs`` are ignored.
    """
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select("doc_id", F.octet_length(body).cast("bigint").alias("size"),
                       F.crc32(body).alias("text_crc32"))
    rows = place(rows, tree, F.col("doc_id"), "shard")
    rows = (place(rows, grown, F.col("doc_id"), "grown_shard") if grown
            else rows.withColumn("grown_shard", F.lit(None).cast("int")))
    piece = F.substring(F.md5(F.concat_ws("|", key, F.lit("slot"))), 1, spread_digits)
    rows = rows.withColumn("size", F.col("size") + 16).withColumn("piece", piece)

    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("rows")).select(
        "shard", "piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "piece").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(order) - 1)
    return numbered.join(F.broadcast(first), ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("first") + F.col("at")).cast("bigint").alias("slot"), "grown_shard")
