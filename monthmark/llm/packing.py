"""Best-fit packing of tokenised documents into sequences of bounded length.

Planning sees lengths only: a histogram of at most `size` counts. Lengths are taken from the longest
down, and all pieces of a length go at once into the open sequences with the least room that is
enough, as many to a sequence as fit; sequences with equal room are one entry of the plan, however
many they are. The plan is what best-fit decreasing would do piece by piece, and its number of
entries depends on `size`, not on the corpus.

A piece finds its slot by its rank among the pieces of its length. Ranks need no shuffle: a task
numbers the pieces of each length as it encodes them, and a table with one row for each task and
length holds how many come before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthmark.llm.common import by_bytes, chunks, quoted, written
from monthmark.llm.token_binary import encoder

SIZE, END = 1024, 2


def plan_slots(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Entries (length, rank, sequences, pieces, first sequence, offset) of best-fit decreasing.

    Pieces of the length from that rank on go to so many sequences, `pieces` to each, behind `offset`.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # (first sequence, sequences) by room left
    used, out = 0, []
    for length in sorted(counts, reverse=True):
        rank, left, fits = 0, counts[length], length
        while left:
            while fits <= size and not room[fits]:
                fits += 1
            if fits > size:  # none has room: open as many as these pieces need
                fits = size
                opened = -(-left // (size // length))
                room[size].append((used, opened))
                used += opened
            first, n = room[fits].pop()
            each = fits // length
            whole = min(n, left // each)
            for sequences, pieces in ((whole, each), (1 if whole < n and left > whole * each else 0, left - whole * each)):
                if sequences:
                    out.append((length, rank, sequences, pieces, first, size - fits))
                    room[fits - pieces * length].append((first, sequences))
                    first, n = first + sequences, n - sequences
                    rank, left = rank + sequences * pieces, left - sequences * pieces
            if n:
                room[fits].append((first, n))
    return out


def _encoded(df: DataFrame, path: str, key: str, text: str, size: int, end_id: int) -> DataFrame:
    """(key, piece, start, length, ids, ids_crc32, part, place) of all pieces.

    ids are little-endian u32; place counts the pieces of that length before it in its task, part.
    """
    names = ["key", "piece", "start", "length", "ids", "ids_crc32", "part", "place"]

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, of, four = TaskContext.get().partitionId(), encoder(path), np.dtype("<u4")
        tail = np.array([end_id], four).tobytes()
        placed = np.zeros(size + 1, np.int64)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
        for whole in batches:
            for batch in by_bytes(whole, 1):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                keys = batch.column(0).to_pylist()
                for a, b in chunks(texts, 1 << 22):
                    cols: list[list] = [[] for _ in names]
                    for k, ids in zip(keys[a:b], of.encode(texts[a:b], four)):
                        ids += tail
                        n = len(ids) // 4
                        # Only the first piece may be shorter.
                        cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                        for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
                            own = ids[4 * x:4 * y]
                            for c, v in zip(cols, (k, i, x, y - x, own, zlib.crc32(own), part, int(placed[y - x]))):
                                c.append(v)
                            placed[y - x] += 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    chosen = df.select(F.col(quoted(key)).cast("long").alias("key"), F.col(quoted(text)).alias("text"))
    return chosen.mapInArrow(run, "key long, piece int, start long, length long, ids binary, ids_crc32 long, part int, place long")


def pack_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE,
                   end_id: int = END) -> DataFrame:
    """(key, piece, start, length, ids, ids_crc32, sequence_id, offset) for each piece of each row.

    Ids come from the tokenizers file at `path`, then `end_id`; `ids` are little-endian u32. Documents of more than
    `size` ids are cut, the first piece taking what does not fill a sequence. Sequences hold up to `size` ids
    without gaps, numbered from 0. Null and empty texts are documents of the end id alone. Rows
    that share a key, and rows without key, are documents of their own. Keys are whole numbers; other columns are
    not read. An empty table has no pieces.
    """
    if size < 1:
        raise ValueError("a sequence holds an id at least")
    spark = df.sparkSession
    pieces = written(_encoded(df, path, key, text, size, end_id), "pieces")
    # One row for each task and length.
    runs = written(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # As many rows as lengths, `size` at most; so the plan's size does not depend on the corpus either.
    counts = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = written(spark.createDataFrame(plan_slots(counts, size), "length long, rank long, sequences long, pieces long, "
                                         "first long, at long").coalesce(1), "packing-plan")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # The entries that a task's pieces of a length reach into: they follow each other by rank.
    met = (runs.join(F.broadcast(plan), "length")
           .where((F.col("rank") < F.col("before") + F.col("n")) & (F.col("rank") + F.col("sequences") * F.col("pieces") > F.col("before")))
           .groupBy("length", "part").agg(F.first("before").alias("before"), F.collect_list(
               F.struct("rank", "sequences", "pieces", "first", "at")).alias("entries")))
    rank = F.col("before") + F.col("place")
    own = F.filter("entries", lambda e: (rank >= e["rank"]) & (rank < e["rank"] + e["sequences"] * e["pieces"]))[0]
    placed = pieces.join(met, ["length", "part"]).withColumn("e", own).withColumn("nth", rank - F.col("e.rank"))
    return placed.select(
        F.col("key").alias(key), "piece", "start", "length", "ids", "ids_crc32",
        (F.col("e.first") + F.expr("nth div e.pieces")).alias("sequence_id"),
        (F.col("e.at") + F.col("nth") % F.col("e.pieces") * F.col("length")).alias("offset"))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of packed pieces: whole sequences, each bounded by the sequence size."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(held, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
