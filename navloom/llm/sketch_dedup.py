"""Near-duplicate documents by SetSketch registers.

A document is a set of word shingles. For register values each shingle draws one truncated exponential from every
one of `REGISTERS` neighbouring intervals, in a permutation of the registers; a register keeps the minimum, stored
as floor(1 - log_b(x)). Registers of a union are the registers' maxima, and two registers agree about as often as
the sets are alike. Documents that agree on a band of registers are candidates, the pair's likelihood (over greater,
smaller and equal registers, the set sizes being known) drops what is far from alike, and full sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom.llm.components import components
from navloom.llm.textwords import byte_column, mix, roll, word_bounds, word_hashes
from navloom.session import settle

REGISTERS = 128
BASE, RATE, TOP = 1.001, 20.0, 65535  # register spacing, rate of the exponentials, largest value
SIGMAS = 6.0  # an estimate so many deviations short of the threshold is dropped
TILE = 100_000  # shingles of a side of a tile, about
NODES = 2_000  # nodes of a side of a tile, about
STRIP = 256  # nodes of a side held against the other's at once, by size
COLUMNS = 2048  # shingles counted at once
STEP = 1024  # documents sketched at once

SKETCH = "doc_id BIGINT, k1 BIGINT, k2 BIGINT, n_shingles BIGINT, registers BINARY, bands ARRAY<BIGINT>"


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending within a row; the bounds of each row among them; and two
    hashes of each row's whole word sequence."""
    starts, ends, counts = word_bounds(data, bounds)
    first = np.concatenate([[0], np.cumsum(counts)])
    hashes = word_hashes(data, starts, ends, lower=True)
    second = word_hashes(data, starts, ends, seed=1, lower=True)
    row = np.repeat(np.arange(len(counts)), counts)
    rolled = mix(roll(hashes, words))
    whole = np.flatnonzero((first[row] + counts[row] - np.arange(len(row)) >= words)) if len(row) else np.zeros(0, np.int64)
    values, of = rolled[whole], row[whole]
    keys = [np.zeros(len(counts), np.uint64) for _ in range(2)]
    short_values, short_rows = [], []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            for j, h in enumerate((hashes, second)):
                keys[j][i] = mix(roll(h[a:b], b - a, j))[0] ^ np.uint64(b - a)
            if b - a < words:  # the whole sequence is one shingle, unlike any of full length
                short_values.append(mix(keys[0][i:i + 1] + np.uint64(b - a)))
                short_rows.append(i)
    if short_rows:
        values, of = np.concatenate([values, *short_values]), np.concatenate([of, short_rows])
        order = np.argsort(of, kind="stable")
        values, of = values[order], of[order]
    at = np.searchsorted(of, np.arange(len(counts) + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    values, of = values[new], of[new]
    return values, np.searchsorted(of, np.arange(len(counts) + 1)), np.stack(keys, 1)


def registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch registers, a row per set. Intervals are taken in ascending order for all shingles at once; a set is
    done when each of its registers holds less than the next interval could bring."""
    n, m = len(bounds) - 1, REGISTERS
    row = np.repeat(np.arange(n), np.diff(bounds))
    seed = mix(values + np.uint64(0x5EED))
    start, stride = (seed & np.uint64(m - 1)).astype(np.int64), ((seed >> np.uint64(32)) & np.uint64(m - 1)).astype(np.int64) | 1
    least = np.ones((n, m))
    flat = least.reshape(-1)
    open_rows = np.diff(bounds) > 0
    for j in range(m):
        draw = (mix(values + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        np.minimum.at(flat, row * m + ((start + j * stride) & (m - 1)), (j + draw) / m)
        check = np.flatnonzero(open_rows)
        done = check[least[check].max(1) <= (j + 1) / m]
        if len(done):
            open_rows[done] = False
            left = open_rows[row]
            values, row, start, stride = values[left], row[left], start[left], stride[left]
            if not len(values):
                break
    with np.errstate(divide="ignore"):
        x = -np.log1p(-np.minimum(least, 1 - 1e-16)) / RATE
        k = np.floor(1 - np.log(x) / np.log(BASE))
    k = np.clip(k, 0, TOP).astype(np.uint16)
    k[np.diff(bounds) == 0] = 0
    return k


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band of four 16-bit registers."""
    bands = np.ascontiguousarray(regs).view(np.uint64)
    return mix(bands + (np.arange(bands.shape[1], dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _sketch(words: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                data, bounds = byte_column(part.column(1))
                values, sets, keys = shingle_sets(data, bounds, words)
                regs = registers(values, sets)
                bands = band_keys(regs).view(np.int64)
                sizes = np.diff(sets)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands.shape[1], 0))]).astype(np.int32)),
                                                 pa.array(bands[sizes > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(keys[:, j].view(np.int64) if len(keys) else np.zeros(0, np.int64)) for j in (0, 1)),
                     pa.array(sizes.astype(np.int64)), pa.array([r.tobytes() for r in regs], pa.binary()), lists],
                    names=["doc_id", "k1", "k2", "n_shingles", "registers", "bands"])
    return sketch


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                values, bounds, _ = shingle_sets(*byte_column(part.column(1)), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))],
                                                 names=["node", "shingles"])
    return sets


def likeness(greater: np.ndarray, smaller: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of greatest likelihood, given how many of a's registers are greater and smaller than
    b's and both set sizes. The likelihood is concave: its slope is halved in on."""
    u = size_a / (size_a + size_b)
    v = 1 - u
    equal = REGISTERS - greater - smaller
    scale = (BASE - 1) / BASE
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    tiny = 1e-12
    for _ in range(40):
        j = (low + high) / 2
        xa, xb = u - v * j, v - u * j
        pa_, pb_ = (-np.log1p(-x * scale) / np.log(BASE) for x in (xa, xb))
        da, db = (scale / (1 - x * scale) / np.log(BASE) for x in (xa, xb))
        slope = -greater * v * da / np.maximum(pa_, tiny) - smaller * u * db / np.maximum(pb_, tiny) \
            + equal * (v * da + u * db) / np.maximum(1 - pa_ - pb_, tiny)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


def _alike(percent: int):
    floor = percent / 100 - SIGMAS * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(byte_column(batch.column(i))[0], np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            na, nb = (batch.column(i).to_numpy().astype(np.float64) for i in (4, 5))
            keep = likeness((a > b).sum(1), (a < b).sum(1), na, nb) >= floor
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])
    return alike


def _confirmed(nodes: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are alike."""
    side = nodes.select("node", "registers", "n_shingles")
    x, y = (side.select(*(F.col(c).alias(f"{c}_{s}") for c in side.columns)) for s in "xy")
    near = (pairs.join(x, F.col("a") == F.col("node_x")).join(y, F.col("b") == F.col("node_y"))
            .where(F.least("n_shingles_x", "n_shingles_y") * 100 >= F.greatest("n_shingles_x", "n_shingles_y") * percent)
            .select("a", "b", "registers_x", "registers_y", "n_shingles_x", "n_shingles_y")
            .mapInArrow(_alike(percent), "a BIGINT, b BIGINT").distinct())
    near = settle(near, "near")
    x, y = (sets.select(F.col("node").alias(s), F.col("shingles").alias(f"set_{s}")) for s in "ab")
    both = near.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")).cast("long"))
    alike = both.where(F.col("common") * 100 >= (F.size("set_a") + F.size("set_b") - F.col("common")) * percent)
    return settle(alike.select("a", "b").distinct(), "links")


def _joining(percent: int):
    """Of a tile's few (`few`) against its other nodes: links that join different components, enough to join all that
    are linked."""
    def joining(table: pa.Table) -> pa.Table:
        few = table.column("few").to_numpy(zero_copy_only=False).astype(bool)
        node, root = (table.column(c).to_numpy() for c in ("node", "root"))
        sets = table.column("shingles").combine_chunks()
        if isinstance(sets, pa.ChunkedArray):
            sets = pa.concat_arrays(sets.chunks)
        sizes = sets.value_lengths().to_numpy()
        _, column = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(node)), sizes)
        n_columns = int(column.max()) + 1 if len(column) else 0
        shared = (np.bincount(column, few[owner], n_columns) > 0) & (np.bincount(column, ~few[owner], n_columns) > 0)
        place = np.cumsum(shared) - 1
        inside = shared[column]
        column, owner = place[column[inside]], owner[inside]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        # by size, so that nodes of a strip meet those of sizes that can be alike only
        sides = [np.flatnonzero(own)[np.argsort(sizes[own], kind="stable")] for own in (few, ~few)]
        (na, ra, sa), (nb, rb, sb) = ((node[s], root[s], sizes[s].astype(np.int64)) for s in sides)
        strips = [(at, min(at + STRIP, len(sa))) for at in range(0, len(sa), STRIP)]
        spans = [(int(np.searchsorted(sb * 100, sa[x] * percent)), int(np.searchsorted(sb * percent, sa[y - 1] * 100, "right"))) for x, y in strips]
        within = np.empty(len(node), np.int64)
        for s in sides:
            within[s] = np.arange(len(s))
        common = np.zeros((len(sa), len(sb)), np.float32)
        for low in range(0, int(shared.sum()), COLUMNS):
            x, y = np.searchsorted(column, [low, low + COLUMNS])
            held = []
            for own in (few, ~few):
                at = np.flatnonzero(own[owner[x:y]]) + x
                side = np.zeros((int(own.sum()), COLUMNS), np.float32)
                side[within[owner[at]], column[at] - low] = 1
                held.append(side)
            for (c, d), (e, f) in zip(strips, spans):
                common[c:d, e:f] += held[0][c:d] @ held[1][e:f].T
        parent: dict[int, int] = {}

        def find(r: int) -> int:
            while parent.setdefault(r, r) != r:
                r = parent[r]
            return r

        out = []
        for (c, d), (e, f) in zip(strips, spans):
            both = common[c:d, e:f].astype(np.int64)
            linked = (both * 100 >= (sa[c:d, None] + sb[None, e:f] - both) * percent) & (ra[c:d, None] != rb[None, e:f])
            i, j = np.nonzero(linked)
            i, j = i + c, j + e
            _, one = np.unique(np.stack([ra[i], rb[j]]), axis=1, return_index=True)
            for k in one.tolist():
                x, y = find(int(ra[i[k]])), find(int(rb[j[k]]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(na[i[k]]), int(nb[j[k]])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})
    return joining


def _tiled(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of a bucket. Placed is (bucket, node, root, n_shingles). All nodes outside a
    bucket's largest component are held against all of its nodes, in tiles of a bounded number of shingles and of nodes."""
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("nodes"), F.sum("n_shingles").alias("shingles"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("nodes", "root"))["root"].alias("largest"), F.min("root").alias("low"), F.max("root").alias("high"),
                                          F.sum("shingles").alias("all"), F.max(F.struct("nodes", "root", "shingles"))["shingles"].alias("most"),
                                          F.sum("nodes").alias("all_nodes"), F.max("nodes").alias("most_nodes"))

    def tiles(shingles: Column, nodes: Column) -> Column:
        return F.ceil(F.greatest(shingles / TILE, nodes / NODES)).cast("int")

    mixed = settle(largest.where("low < high").select("bucket", "largest", tiles(F.col("all") - F.col("most"), F.col("all_nodes") - F.col("most_nodes")).alias("few_tiles"),
                                                      tiles(F.col("all"), F.col("all_nodes")).alias("all_tiles")), "mixed")
    placed = placed.join(mixed, "bucket")
    spread = F.xxhash64("node")
    few = placed.where("root <> largest").select("bucket", "node", "root", F.lit(True).alias("few"), F.pmod(spread, F.col("few_tiles")).cast("int").alias("i"),
                                                 F.explode(F.sequence(F.lit(0), F.col("all_tiles") - 1)).alias("j"))
    every = placed.select("bucket", "node", "root", F.lit(False).alias("few"), F.explode(F.sequence(F.lit(0), F.col("few_tiles") - 1)).alias("i"),
                          F.pmod(spread, F.col("all_tiles")).cast("int").alias("j")).select(*few.columns)
    filled = few.unionByName(every).join(sets, "node")
    return filled.groupBy("bucket", "i", "j").applyInArrow(_joining(percent), "a BIGINT, b BIGINT").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: documents whose sets of `words`-word shingles have
    100 * intersection >= percent * union are linked, and component_id is the smallest id reachable.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer words is one shingle. Equal word
    sequences are one node, so copies cost nothing further. In each bucket one node is compared with all others. In a
    bucket whose nodes then are in several components, all nodes outside the largest one are compared with all
    nodes, so that every pair in a bucket is in one component or was compared; tiles return no more links than
    join their components. A pair at the threshold shares no band, and so no bucket, once in twenty million.

    A null or empty text has no shingles and links with nothing. A row with a null id links with nothing, has a
    null component_id and is kept. Rows that share an id are one document: what links with one links with all.
    Other columns are left out."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = settle(docs.mapInArrow(_sketch(words), SKETCH), "sketches")
    linkable = sketched.where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = settle(linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), "nodes")
    nodes = linkable.join(reps.withColumnRenamed("node", "doc_id"), ["k1", "k2", "doc_id"], "left_semi").withColumnRenamed("doc_id", "node")

    members = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last")
    active = settle(members.join(settle(shared.select("bucket", "pivot"), "shared"), "bucket"), "buckets")
    needed = active.select(F.col("node").alias("doc_id")).distinct()
    sets = settle(docs.join(needed, "doc_id", "left_semi").mapInArrow(_sets(words), "node BIGINT, shingles ARRAY<BIGINT>"), "sets")

    pairs = active.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = _confirmed(nodes, sets, pairs, percent)
    roots = settle(components(links), "roots")
    rest = active.where("node <> pivot").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"), "n_shingles")
    links = links.unionByName(settle(_tiled(settle(rest, "rest"), sets, percent), "joining"))
    roots = settle(components(links), "roots")

    found = sketched.select("doc_id", "k1", "k2", "n_shingles").join(reps, ["k1", "k2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    own = F.when(linked, F.col("node")).otherwise(F.col("doc_id"))
    found = found.select("doc_id", "n_shingles", own.alias("node")).join(roots, "node", "left")
    component = F.coalesce("root", "node")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
