"""Which strings occur in another block, or in an earlier one: the exchange behind the substring operators.

Documents are laid out in blocks of neighbouring ids, once, in a table bucketed by block. A block sends the
distinct keys of its strings to the key's range as one packed array per range, the range answers with one bit
per key, and the answers come back to the block. Text is shuffled once; keys travel as 4 or 8 bytes; a string
that a third of all documents hold is one key per block. A task holds one block, or one range of about the
keys of one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from navloom.llm.ranges import even_ranges, in_range
from navloom.llm.textwords import byte_column, id_column
from navloom.session import scratch_table, settle

BLOCK_BYTES = 8 << 20

KEYS = "block INT, part INT, n INT, keys BINARY"
BITS = "block INT, part INT, n INT, bits BINARY"


def lay_out(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, id, text) in a bucketed table, blocks ascending by id, and the number of blocks. Rows of one id
    share a block; a null id sorts last. The driver holds one bound per block, as in any range partitioning."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = settle(docs.where("id IS NOT NULL").select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")), "sizes")
    bounds = even_ranges(sizes, "id", "size", block_bytes) or [0]
    name = scratch_table(spark, "text-blocks")
    (docs.withColumn("block", in_range(F.col("id"), bounds)).repartition(len(bounds), "block")
     .write.option("compression", "zstd").bucketBy(len(bounds), "block").saveAsTable(name))
    return spark.table(name), len(bounds)


class Block:
    """One block's rows in id order."""

    def __init__(self, table: pa.Table):
        ids = id_column(table.column("id"))
        order = np.argsort(ids, kind="stable")
        table = table.take(pa.array(order)) if len(order) else table
        self.ids = ids[order]
        self.id_values = table.column("id")  # with its nulls
        self.data, self.bounds = byte_column(table.column("text"))
        self.sizes = np.diff(self.bounds)

    def copied(self, side: pa.Table) -> np.ndarray:
        """Which rows are whole copies of a smaller id."""
        listed = {(c["id"], c["digest"]) for row in side.column("copied").to_pylist() for c in row or ()}
        out = np.zeros(len(self.ids), bool)
        for i in np.flatnonzero(np.isin(self.ids, np.array([c[0] for c in listed], np.int64))):
            out[i] = (int(self.ids[i]), hashlib.sha256(self.text(i)).hexdigest()) in listed
        return out

    def text(self, i: int) -> memoryview:
        return memoryview(self.data[self.bounds[i]:self.bounds[i + 1]])


class Packed:
    """Keys of a block by range: distinct, sorted by (range, key); `inverse` leads from each key to its place."""

    def __init__(self, keys: np.ndarray, parts: np.ndarray):
        order = np.lexsort((keys, parts))
        keys, parts = keys[order], parts[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])
        group = np.cumsum(new) - 1
        self.inverse = np.empty(len(keys), np.int64)
        self.inverse[order] = group
        self.order, self.new = order, new
        self.counts = np.bincount(group, minlength=int(new.sum()))
        self.keys, self.parts = keys[new], parts[new]

    def first(self, values: np.ndarray) -> np.ndarray:
        """Per key as given, the smallest of `values` (given beside the keys) over its equals."""
        at = np.flatnonzero(self.new)
        return np.minimum.reduceat(values[self.order], at)[self.inverse] if len(at) else values

    def rows(self, block: int) -> pa.Table:
        parts, at = np.unique(self.parts, return_index=True)
        ends = np.append(at[1:], len(self.parts))
        return pa.table({"block": pa.array([block] * len(parts), pa.int32()), "part": pa.array(parts.astype(np.int32)),
                         "n": pa.array((ends - at).astype(np.int32)),
                         "keys": pa.array([self.keys[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())})

    @staticmethod
    def answers(table: pa.Table, kind: str) -> np.ndarray:
        """The bits of a block, in the order of the keys it sent."""
        table = table.filter(pc.equal(table.column("kind"), kind))
        rows = sorted(zip(table.column("part").to_pylist(), table.column("n").to_pylist(), table.column("bits").to_pylist()))
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, n, b in rows]
        return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


def _answer(table: pa.Table, dtype: type, rule: Callable[[list[np.ndarray]], list[np.ndarray]]) -> pa.Table:
    table = table.sort_by("block")
    keys = [np.frombuffer(k, dtype) for k in table.column("keys").to_pylist()]
    bits = [np.packbits(b).tobytes() for b in rule(keys)]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "n": table.column("n"),
                     "bits": pa.array(bits, pa.binary())})


def elsewhere(keys: list[np.ndarray]) -> list[np.ndarray]:
    """Per block and key: does another block hold it?"""
    _, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    return np.split(counts[inverse] > 1, np.cumsum([len(k) for k in keys])[:-1])


def ask(sent: DataFrame, dtype: type, rule: Callable[[list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    def answered(table: pa.Table) -> pa.Table:
        return _answer(table, dtype, rule)

    return sent.groupBy("part").applyInArrow(answered, BITS)


def per_block(blocks: DataFrame, side: DataFrame, make: Callable[[int, Block, pa.Table], pa.Table], schema: str) -> DataFrame:
    """make(block, its rows, its side rows) for every block that has rows."""
    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def made(table: pa.Table, beside: pa.Table) -> pa.Table:
        return make(table.column("block")[0].as_py(), Block(table), beside) if table.num_rows else nothing

    return blocks.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(made, schema)


def copies(blocks: DataFrame) -> DataFrame:
    """Side rows with the ids of documents whose whole text a smaller id has too, per block."""
    keyed = blocks.where("text IS NOT NULL AND id IS NOT NULL").select("block", "id", F.sha2("text", 256).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    # settled, so that both sides of the join are plain and a text that many have can be split
    later = keyed.join(settle(first.select("digest", "first"), "firsts"), "digest").where("id > first")
    listed = later.groupBy("block").agg(F.collect_set(F.struct("id", "digest")).alias("copied"))
    return listed.select("block", F.lit("copies").alias("kind"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("n"),
                         F.lit(None).cast("binary").alias("bits"), "copied")


def as_side(bits: DataFrame, kind: str) -> DataFrame:
    return bits.select("block", F.lit(kind).alias("kind"), "part", "n", "bits",
                       F.lit(None).cast("array<struct<id: bigint, digest: string>>").alias("copied"))
