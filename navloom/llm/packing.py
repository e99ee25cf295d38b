"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces of at most the longest length. Full pieces are sequences already; the others are dealt
into shards of bounded size and packed there, longest first: a piece goes into the open bin that it leaves least
room in; if it fits none, the bin size whose cost per token, with what the remaining pieces could still add, is
least is opened. In the end every bin shrinks to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.textwords import byte_column, word_bounds
from navloom.session import settle

LENGTHS = (256, 512, 1024, 2048)
OVERHEAD = 16.0  # cost of a sequence beside its tokens
QUADRATIC = 1 / 16384  # cost of attention, per squared token
SHARD_PIECES = 20_000  # pieces packed by one task call

PACKED = "doc_id BIGINT, piece INT, start BIGINT, length INT, bin_id BIGINT, capacity INT, offset INT"


def cost(capacity: int, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> float:
    return overhead + capacity + quadratic * capacity * capacity


def pack(lengths: list[int], capacities: tuple[int, ...], overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> tuple[list[int], list[int], list[int]]:
    """For lengths in descending order: each one's bin and offset, and the bins' capacities.

    Open bins are kept by the room left in them; the bits of one integer tell which amounts of room occur, so the
    tightest bin is the lowest bit at or above the length. Among bins with equal room the latest is taken."""
    costs = [(c, cost(c, overhead, quadratic)) for c in capacities]
    rooms: dict[int, list[int]] = {}
    present, rest = 0, sum(lengths)
    bins, offsets, opened, used = [], [], [], []
    for n in lengths:
        rest -= n
        above = present >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                present ^= 1 << room
        else:
            room = min((c for c in costs if c[0] >= n), key=lambda c: (c[1] / (n + min(c[0] - n, rest)), c[0]))[0]
            b = len(opened)
            opened.append(room)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        room -= n
        if room:
            rooms.setdefault(room, []).append(b)
            present |= 1 << room
    final = [min(c for c in capacities if c >= u) for u in used]
    return bins, offsets, final


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(word_bounds(*byte_column(part.column(1)))[2].astype(np.int64))], names=["doc_id", "n_tokens"])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): words between ASCII white space, a stand-in for a tokenizer's count."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_word_counts, "doc_id BIGINT, n_tokens BIGINT")


def best_fit(docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "n_tokens", capacities: tuple[int, ...] = LENGTHS,
             overhead: float = OVERHEAD, quadratic: float = QUADRATIC, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, capacity, offset): where each piece of a document lies. Pieces start at
    multiples of the longest capacity; a bin's pieces follow one another without a gap, from offset 0.

    A document of no or null tokens is one row of length 0 without a bin. A negative count is an error. Ids may be
    null or repeat: each row is packed. Shards are dealt by a hash of id and piece; their number follows the number
    of pieces, so a shard's size doesn't grow with the data. Other columns are left out."""
    capacities = tuple(sorted(set(capacities)))
    longest = capacities[-1]
    counts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)).alias("n"))
    counts = counts.withColumn("n", F.when(F.col("n") >= 0, F.col("n")).otherwise(F.raise_error(F.lit("negative token count"))))
    counts = counts.withColumn("row", F.monotonically_increasing_id())
    last = F.expr(f"CAST((greatest(n, 1) - 1) DIV {longest} AS INT)")
    pieces = counts.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * longest)
    pieces = settle(pieces.withColumn("length", F.least(F.lit(longest), F.col("n") - F.col("start")).cast("int")).drop("n"), "pieces")
    full = pieces.where((F.col("length") == longest) | (F.col("length") == 0))
    # full pieces have odd bins, numbered by place; packed ones even bins, numbered by shard
    number = F.monotonically_increasing_id() * 2 + 1
    empty = F.col("length") == 0
    full = full.select("doc_id", "piece", "start", "length", F.when(~empty, number).alias("bin_id"), F.when(~empty, F.lit(longest)).alias("capacity"), F.lit(0).alias("offset"))
    part = pieces.where((F.col("length") < longest) & (F.col("length") > 0)).select("doc_id", "piece", "start", "length", "row")
    shards = max(1, -(-part.count() // shard_pieces))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        bins, offsets, final = pack(table.column("length").to_pylist(), capacities, overhead, quadratic)
        bins = np.array(bins, np.int64)
        return pa.table({**{c: table.column(c) for c in ("doc_id", "piece", "start", "length")},
                         "bin_id": pa.array((bins + table.column("shard")[0].as_py() * 2**32) * 2),
                         "capacity": pa.array(np.array(final, np.int32)[bins]), "offset": pa.array(offsets, pa.int32())})

    dealt = part.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(shards)))
    return full.unionByName(dealt.groupBy("shard").applyInArrow(packed, PACKED))


# How a byte-level vocabulary cuts text before merging (fixed value of the public byte-level encodings).
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = SPLIT_PATTERN) -> DataFrame:
    """(doc_id, n_tokens) under a byte-level vocabulary: `ranks_path` names a file of ranks (a base64 token and its
    rank per line) that every executor can open. A null or empty text has no tokens."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(text)) if text else 0 for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(counted, "doc_id BIGINT, n_tokens BIGINT")
