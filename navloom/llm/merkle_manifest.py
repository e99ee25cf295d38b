"""Merkle manifest of a data set: one tree per group over rows in order, and one over the groups' roots.

A node is the SHA-256 of its children's digests as hex text, and a row's proof is the siblings on its way up. Rows
get their rank in the group from range-partitioned files; its binary digits are columns, and blocks of 2**BITS ranks
are rolled up by grouping those columns away one after the other, lowest first, each group nesting its children's
structs. All these groupings run on one exchange and one sort. A finished block is one row that holds its subtree; the
blocks' roots are ranks of the next stage, until a group has one block. On the way down a block's row meets the one
path above it, and a transform over the nested children hands each leaf its siblings, so that no leaf is ever joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from navloom.session import settle

BITS = 10  # a block holds 2**BITS nodes, so a row of nested structs stays near 200 KB
_ROW_BITS = 33  # monotonically_increasing_id keeps the row within its partition in so many bits


def field(value: Column) -> Column:
    """`-` for a null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _numbered(rows: DataFrame, order: list[str], label: str) -> tuple[DataFrame, int]:
    """Rows with their rank `r` in the group `g` and the group's size `n`, and the largest size. A partition of the
    files is a range of (g, order), in which a row's place is known; sizes are added up per partition and group."""
    tie = F.monotonically_increasing_id()  # parts equal rows, whichever of them comes first
    by = ["g", *order, "tie"]
    placed = rows.withColumn("tie", tie).repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn("at", F.monotonically_increasing_id())
    placed = settle(placed, label).withColumn("part", F.shiftright("at", _ROW_BITS))
    parts = placed.groupBy("part", "g").agg(F.count("*").alias("held"), F.min("at").alias("first"))
    own = Window.partitionBy("g")
    parts = settle(parts.select("part", "g", (F.sum("held").over(own.orderBy("part")) - F.col("held") - F.col("first")).alias("shift"),
                                F.sum("held").over(own).alias("n")), f"{label}-parts")
    largest = parts.agg(F.max("n")).first()[0] or 0
    return placed.join(parts, ["part", "g"]).withColumn("r", F.col("at") + F.col("shift")).drop("at", "part", "shift"), largest


def _rolled_up(nodes: DataFrame, bits: int) -> DataFrame:
    """(g, n, block, tree) from (g, n, r, h, data): `tree` is the block's root, a struct of its digest and its children. A
    level that a group of n nodes no longer needs passes its only node on."""
    digits = [f"d{k}" for k in range(bits)]
    keys = ["g", "n", "block", *reversed(digits)]
    rows = (nodes.select("g", "n", F.shiftright("r", bits).alias("block"), F.struct("h", "data").alias("node"),
                         *(F.shiftright("r", k).bitwiseAND(1).alias(d) for k, d in enumerate(digits)))
            .repartition("g", "block").sortWithinPartitions(*keys))
    for k, digit in enumerate(digits):
        keys.pop()
        pair = rows.groupBy(*keys).agg(*(F.any_value(F.when(F.col(digit) == i, F.col("node")), F.lit(True)).alias(side) for i, side in enumerate(("left", "right"))))
        parent = F.sha2(F.concat("left.h", F.coalesce("right.h", F.lit(""))), 256)
        rows = pair.select(*keys, F.struct(F.when(F.col("n") > 1 << k, parent).otherwise(F.col("left.h")).alias("h"),
                                           F.array_compact(F.array("left", "right")).alias("kids")).alias("node"))
    return rows.withColumnRenamed("node", "tree")


def _leaves(node: Column, path: Column, level: int) -> Column:
    """The leaves below a node of a level, each with its path: its own sibling first, then those above."""
    if level == 0:
        return F.array(F.struct(node["h"].alias("h"), node["data"].alias("data"), path.alias("path")))
    kids = node["kids"]

    def below(kid: Column, i: Column) -> Column:
        before = F.when(i == 1, kids[0]["h"]).otherwise(F.lit(""))
        after = F.when(i == 0, F.coalesce(F.get(kids, F.lit(1))["h"], F.lit(""))).otherwise(F.lit(""))
        step = F.struct(before.alias("before"), after.alias("after"))
        needed = F.array_repeat(step, F.when(F.col("n") > 1 << (level - 1), 1).otherwise(0))
        return _leaves(kid, F.concat(needed, path), level - 1)

    return F.flatten(F.transform(kids, below))


class _Tree:
    """The trees of all groups, as one settled table of blocks per stage."""

    def __init__(self, rows: DataFrame, order: list[str], label: str, bits: int):
        self.bits, self.stages = bits, []
        nodes, largest = _numbered(rows, order, label)
        while True:
            blocks = settle(_rolled_up(nodes, bits), f"{label}-blocks")
            self.stages.append(blocks)
            if largest <= 1 << bits:
                break
            over = (1 << bits) - 1
            nodes = blocks.select("g", F.shiftright(F.col("n") + over, bits).alias("n"), F.col("block").alias("r"), F.col("tree.h").alias("h"),
                                  F.struct(F.col("block").alias("r")).alias("data"))
            largest = (largest + over) >> bits

    def roots(self) -> DataFrame:
        return self.stages[-1].select("g", F.col("tree.h").alias("h"))

    def paths(self, above: DataFrame) -> DataFrame:
        """(g, up, h, data, path) of every leaf, where `above` has (g, up, path): what is known of a group, and the path
        from its root."""
        found = above.select("g", F.lit(0).cast("long").alias("block"), "up", "path")
        for i, blocks in reversed(list(enumerate(self.stages))):
            leaves = blocks.join(found, ["g", "block"]).select("g", "up", F.explode(_leaves(F.col("tree"), F.col("path"), self.bits)).alias("leaf"))
            found = leaves.select("g", "up", "leaf.*")
            if i:
                found = found.select("g", F.col("data.r").alias("block"), "up", "path")
        return found


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang",
             carry: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """(id, leaf, subroot, root, path) of every row, and the columns in `carry`, which are computed from the row.

    The leaf is the digest of `columns`; leaves of a group ascend by id (null first), then by digest; groups ascend by name,
    null first, bytewise. `path` lists the steps from the leaf to the root as (before, after): the sibling's digest on its
    side, both empty where a node had none. Repeated rows are leaves of their own, and rows that share an id but
    not their content ascend by digest. Empty texts count as values, nulls do not. An empty table gives no rows. Other
    columns are left out, and clashing names do no harm, as all are carried in one struct."""
    group = F.col(group_col).cast("string")
    rows = docs.select(F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group)).alias("g"), F.col(id_col).alias("id"),
                       leaf_digest([F.col(c) for c in columns]).alias("h"),
                       F.struct(F.col(id_col).alias("id"), *(c.alias(f"c{i}") for i, c in enumerate((carry or {}).values()))).alias("data"))
    groups = _Tree(rows, ["id", "h"], "merkle", bits)
    subroots = groups.roots().select(F.lit("").alias("g"), F.col("g").alias("name"), "h", F.struct("g", "h").alias("data"))
    top = _Tree(subroots, ["name"], "merkle-top", bits)
    whole = top.roots().select("g", F.struct(F.col("h").alias("root")).alias("up"), F.array().cast("array<struct<before: string, after: string>>").alias("path"))
    known = top.paths(whole).select("data.g", F.struct(F.col("h").alias("subroot"), "up.root").alias("up"), "path")
    found = groups.paths(settle(known, "merkle-groups"))
    return found.select(F.col("data.id").alias(id_col), F.col("h").alias("leaf"), "up.subroot", "up.root", "path",
                        *(F.col(f"data.c{i}").alias(name) for i, name in enumerate(carry or {})))
