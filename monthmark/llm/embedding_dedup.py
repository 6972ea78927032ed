"""Embedding near-dedup: int8 tile products with error bounds, full precision only where needed.

Equal vectors are one. The others are dealt by hash into blocks of about TILE rows, and every pair of
blocks is multiplied in 8-bit whole numbers, each vector with a scale of its own. A unit vector x and its
quantised form x' differ by a vector of known length e, so

    |x.y - x'.y'| <= e(x) + (1 + e(x)) e(y)

holds for every pair: products that stay below the limit even with the bound added cannot be links, those
above it with the bound taken off must be, and only the rest is computed again in double
precision. A tile returns, for each of its vectors, the number of links and one link into
its group, never the links themselves.

Blocks are stored once, as they were read, and every task reads the two groups of blocks it multiplies from there
(a Cartesian product of their files): no pair of blocks is shuffled or stored, so disk grows with the vectors
and only time with their square. A task holds one group of stored blocks, a pair of them in full, and sums of links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthmark.llm.common import quoted, written
from monthmark.llm.components import components

#: Cosine from which vectors are linked, rows of a block, rows of a tile worked on at once.
LIMIT, TILE, STRIP = 0.95, 4096, 512

#: Bytes of blocks in a file at about, rows of links that a task sums up at once.
FILE_BYTES, MERGE_ROWS = 1 << 25, 1 << 20

#: Room for rounding in sums that are themselves in double precision.
SLACK = 1e-9


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole numbers of 8 bits, scale, length of the error) of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    off = unit - q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt(np.einsum("ij,ij->i", off, off)) * (1 + SLACK) + SLACK


class Block:
    """Vectors of one block with what tile products need."""

    def __init__(self, ids: bytes, copies: bytes, values: bytes, q: bytes, scale: bytes, error: bytes):
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        self.values = np.frombuffer(values, np.float64).reshape(len(self.ids), -1)
        self.q = np.frombuffer(q, np.int8).reshape(self.values.shape)
        self.scale, self.error = np.frombuffer(scale, np.float64), np.frombuffer(error, np.float64)
        # Products of whole numbers are exact in floats up to 2**24.
        self.number = self.q.astype(np.float32 if self.q.shape[1] * 127 * 127 < 1 << 24 else np.float64)


def tile_links(a: Block, b: Block, limit: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) with cosine >= limit, a strip at a time; each pair once if same."""
    far_scale, far_error = b.scale.max(), b.error.max()
    for at in range(0, len(a.ids), STRIP):
        rows = slice(at, min(at + STRIP, len(a.ids)))
        product = a.number[rows] @ b.number.T
        least = (limit - a.error[rows] - (1 + a.error[rows]) * far_error) / (a.scale[rows] * far_scale)
        r, c = np.nonzero(product >= least[:, None]) if least.min() > 0 else np.indices(product.shape).reshape(2, -1)
        value = product[r, c] * a.scale[rows][r] * b.scale[c]
        r = r + at
        if same:
            keep = r < c
            r, c, value = r[keep], c[keep], value[keep]
        bound = a.error[r] + (1 + a.error[r]) * b.error[c]
        sure = value - bound >= limit
        open_ = np.flatnonzero(~sure & (value + bound >= limit))
        for k in range(0, len(open_), 1 << 16):
            part = open_[k:k + (1 << 16)]
            sure[part] = np.einsum("ij,ij->i", a.values[r[part]], b.values[c[part]]) >= limit
        yield r[sure], c[sure]


def _grouped(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest label of everything the links x-y connect."""
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            return label


def _unpacked(ids: bytes, copies: bytes, values: bytes, kind: str) -> Block:
    """A stored block: unit vectors and their quantised forms are made again for each product, not stored."""
    unit = unit_rows(np.frombuffer(values, kind).reshape(len(ids) // 8, -1).astype(np.float64))
    return Block(ids, copies, unit.tobytes(), *[x.tobytes() for x in quantised(unit)])


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(ids, n, other) of many tiles with one row for each id: links summed, one link into its group."""
    ids, n, other = (np.concatenate(x) for x in zip(*parts))
    known, at = np.unique(np.concatenate([ids, other]), return_inverse=True)
    count = np.zeros(len(known), np.int64)
    np.add.at(count, at[:len(ids)], n)
    return known, count, known[_grouped(np.arange(len(known)), at[:len(ids)], at[len(ids):])]


def _pack(blocks: DataFrame, kind: str) -> DataFrame:
    """One row for each block of (dim, block, id, copies, v), values as numbers of `kind`."""

    def run(key, part):
        import pyarrow as pa

        row = {"dim": key[0].as_py(), "block": key[1].as_py(), "ids": np.array(part["id"], np.int64).tobytes(),
               "copies": np.array(part["copies"], np.int64).tobytes(),
               "values": np.array(part["v"].combine_chunks().flatten(), kind).tobytes()}
        return pa.Table.from_pylist([row], pa.schema(
            [("dim", pa.int32()), ("block", pa.int64())] + [(c, pa.binary()) for c in list(row)[2:]]))

    return blocks.groupBy("dim", "block").applyInArrow(run, "dim int, block long, ids binary, copies binary, values binary")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", limit: float = LIMIT,
                 tile: int = TILE) -> DataFrame:
    """(key, n_links, component_id, kept) for each row.

    Vectors of equal length are linked at a cosine of `limit` or more, in double precision. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing. n_links counts the other
    rows linked directly, copies included; component_id is the smallest key reachable by links; kept
    marks its row. Keys are whole numbers; rows that share a key share its links, and rows without key
    link with nothing and are kept, component null.
    """
    if not 0 < limit <= 1:
        raise ValueError("the limit is above 0 and at most 1")
    # Floats stay floats until they are multiplied, which halves what is stored and shuffled of them.
    short = isinstance(df.schema[vector].dataType, T.ArrayType) and isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    kind = "float32" if short else "float64"
    v = F.col(quoted(vector)) if short else F.transform(F.col(quoted(vector)), lambda x: x.cast("double"))
    good = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) \
        & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(quoted(key)).cast("long").alias("id"), v.alias("v"))
    rows = written(rows.withColumn("good", F.coalesce(good & F.col("id").isNotNull(), F.lit(False)))
                   .withColumn("f1", F.xxhash64("v")).withColumn("f2", F.xxhash64(F.lit(1), F.col("v"))), "vectors")
    real = rows.where("good")
    first = written(real.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                                 F.min_by("v", "id").alias("v")), "distinct-vectors")
    dims = first.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / tile).alias("blocks"))
    placed = (first.withColumn("dim", F.size("v")).join(F.broadcast(dims), "dim")  # a row for each vector length
              .select("dim", F.pmod(F.xxhash64("f1", "f2"), F.col("blocks")).alias("block"),
                      F.col("rep").alias("id"), "copies", "v"))
    held = dims.agg(F.sum(F.col("blocks") * F.col("dim")).alias("n")).first()["n"] or 0
    files = max(df.sparkSession.sparkContext.defaultParallelism, -(-held * tile * np.dtype(kind).itemsize // FILE_BYTES))
    blocks = written(_pack(placed.repartition(files, "dim", "block"), kind), "blocks")
    other = blocks.toDF("o_dim", "other", *[f"o_{c}" for c in blocks.columns[2:]])
    # Every pair of files meets in a task that reads both; of blocks that differ, the smaller number is on the left.
    pairs = blocks.join(other.hint("shuffle_replicate_nl"), (F.col("dim") == F.col("o_dim")) & (F.col("block") <= F.col("other")))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        def batch_of(ids, n, to):
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(to)], ["id", "n", "other"])

        at, a, found, rows = None, None, [], 0
        for batch in batches:
            for row in zip(*batch.columns):
                dim, block, *left, _, second = (x.as_py() for x in row[:7])
                same = block == second
                if at != (dim, block):  # the left block stays while the right ones pass
                    at, a = (dim, block), _unpacked(*left, kind)
                b = a if same else _unpacked(*(x.as_py() for x in row[7:]), kind)
                n = len(a.ids)
                ids = a.ids if same else np.concatenate([a.ids, b.ids])
                shift = 0 if same else n
                copies = a.copies if same else np.concatenate([a.copies, b.copies])
                count, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for r, c in tile_links(a, b, limit, same):
                    if len(r):
                        c = c + shift
                        count += np.bincount(r, copies[c], len(ids)).astype(np.int64)
                        count += np.bincount(c, copies[r], len(ids)).astype(np.int64)
                        label = _grouped(label, r, c)
                linked = np.flatnonzero(count)
                if len(linked):
                    found.append((ids[linked], count[linked], ids[label[linked]]))
                    rows += len(linked)
                if rows >= MERGE_ROWS:
                    found = [_merged(found)]
                    rows = len(found[0][0])
                    if 2 * rows > MERGE_ROWS:
                        yield batch_of(*found[0])
                        found, rows = [], 0
        if found:
            yield batch_of(*_merged(found))

    found = written(pairs.mapInArrow(run, "id long, n long, other long"), "tile-links")
    counts = written(found.groupBy("id").agg(F.sum("n").alias("n")), "link-counts")
    groups = written(components(found.select("id", "other")), "vector-groups")
    out = (rows.select("id", "good", "f1", "f2")
           .join(first.select("f1", "f2", "rep", "copies", F.lit(True).alias("good")), ["f1", "f2", "good"], "left")
           .join(counts.withColumnRenamed("id", "rep"), "rep", "left")
           .join(groups.withColumnRenamed("id", "rep"), "rep", "left"))
    component = F.coalesce("component", "rep", "id")
    return out.select(
        F.col("id").alias(key),
        (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
