"""MinHash near-dedup: DartMinHash signatures, banded joining, exact checks.

A document is the weighted set of its five-word shingles, a shingle weighing as much as it
occurs (the n-th occurrence is cell n, so weighted similarity is that of the sets of cells).
Darts are thrown into the plane of cells and time: those of a cell arrive like a Poisson stream whose
gaps are read off hashes, so equal cells get equal darts in every document. A document sees the
darts of its cells up to a time at which enough are expected to hit all coordinates (later for
the rare document with an open one); each dart falls on a coordinate by hash, and the earliest of
each coordinate is kept. Coordinates of two documents agree with the probability of their similarity. Long
documents throw few darts for each shingle: the work is the size of the text plus k log k.

Documents with equal cells are one from then on. In each bucket of equal bands all members are
compared with one leader: the member that meets most others, over all bands, so the original of many
copies leads them wherever it is. Members linked to their leader are one class already. Those that are not
are compared with all members of that leader's buckets in blocks, by matrix products of their cells,
which return a few links into a class and never pairs. No link between documents that share a bucket is
lost, and groups of copies do not become all their pairs.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthmark.llm.common import by_bytes, free_name, quoted, settle, sole_keeper, written
from monthmark.llm.components import components

#: Words of a shingle, bands and rows of the signature, similarity as a fraction.
WIDTH, BANDS, ROWS, SIMILAR = 5, 24, 4, (4, 5)

#: Entries of a worker's cache of word hashes; documents and cells of a block; columns multiplied at once.
#: They bound memory only.
KEPT_ENTRIES, BLOCK_DOCS, BLOCK_CELLS, COLUMNS = 600_000, 1024, 500_000, 2048

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORDS: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def cells_of(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell) of all shingle occurrences, in order; texts of fewer words are one shingle."""
    from xxhash import xxh64_intdigest

    sole_keeper("near_dedup", _WORDS.clear)
    if len(_WORDS) > KEPT_ENTRIES:
        _WORDS.clear()
    split = [t.lower().split() for t in texts]
    words = [w for s in split for w in s]
    for w in set(words):
        if w not in _WORDS:
            _WORDS[w] = xxh64_intdigest(w)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = np.array([len(s) for s in split], np.int64)
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(ends, size) - np.arange(len(words))  # words from here to the end of the text
    value = np.zeros(len(words), np.uint64)
    for k in range(width):
        n = len(words) - k
        if n > 0:
            inside = left[:n] > k
            value[:n] = np.where(inside, mixed(value[:n] * _A + h[k:] + np.uint64(k + 1)), value[:n])
    starts = (left >= width) | ((np.repeat(size, size) < width) & (left == np.repeat(size, size)))
    of, value = of[starts], value[starts]
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    nth = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    return of, mixed(value + nth.astype(np.uint64) * _A)


def dart_signatures(of: np.ndarray, cell: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures of n sets of cells, one row of k coordinates each (0 for empty sets)."""
    out = np.zeros((n, k), np.uint64)
    weight = np.bincount(of, minlength=n)
    until = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        use = todo[of]
        doc, base = of[use], cell[use]
        time = np.zeros(len(doc))
        docs, darts, times = [], [], []
        turn = 0
        while len(doc):
            turn += 1
            dart = mixed(base + np.array([turn], np.uint64) * _C)
            time = time - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53))
            seen = time < until[doc]
            doc, base, time, dart = doc[seen], base[seen], time[seen], dart[seen]
            docs.append(doc)
            darts.append(dart)
            times.append(time)
        doc, dart = np.concatenate(docs), np.concatenate(darts)
        late_first = np.argsort(np.concatenate(times))[::-1]
        place = doc * k + (mixed(dart ^ _A) % np.uint64(k)).astype(np.int64)
        flat = np.zeros(n * k, np.uint64)
        flat[place[late_first]] = dart[late_first] | np.uint64(1)  # of equal places the last one stays
        rows = flat.reshape(n, k)
        full = todo & (rows != 0).all(axis=1)
        out[full] = rows[full]
        todo &= ~full
        until[todo] *= 2
    return out


def sketches(df: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, mark, n, f1, f2, bands): cells, a 128-bit hash of them, and band hashes of (key, text, mark)."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in by_bytes(whole, 1, 4 << 20):
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                of, cell = cells_of(texts)
                n = np.bincount(of, minlength=len(texts))
                sums = [np.zeros(len(texts), np.uint64) for _ in range(2)]
                for s, salt in zip(sums, (_A, _B)):
                    np.add.at(s, of, mixed(cell ^ salt))
                sign = dart_signatures(of, cell, len(texts), bands * rows).reshape(-1, bands, rows)
                band = np.zeros(sign.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    band = mixed(band * _A + sign[:, :, r])
                flat = pa.array(band.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists],
                    ["key", "mark", "n", "f1", "f2", "bands"])

    return df.mapInArrow(run, "key long, mark long, n long, f1 long, f2 long, bands array<long>")


def overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, shared, total) for pairs (a, b): cells in common and in either of the two texts (key, text)."""
    both = (pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
            .select("a", "b", "ta", "tb"))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        recent: OrderedDict = OrderedDict()  # the smaller text of many pairs

        def cells(key, text):
            got = recent.pop(key, None)
            if got is None:
                got = np.unique(cells_of([(text or "").encode()])[1])
            recent[key] = got
            if len(recent) > 64:
                recent.popitem(last=False)
            return got

        for whole in batches:
            for batch in by_bytes(whole, 3):
                shared, total = [], []
                for a, b, ta, tb in zip(*[batch.column(i) for i in range(4)]):
                    x, y = cells(a.as_py(), ta.as_py()), cells(b.as_py(), tb.as_py())
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    shared.append(n)
                    total.append(len(x) + len(y) - n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())],
                    ["a", "b", "shared", "total"])

    return both.mapInArrow(run, "a long, b long, shared long, total long")


def _blocks_of(members: DataFrame, texts: DataFrame) -> DataFrame:
    """One row for each block of a leader's members: (leader, block, blocks, keys, near, ends, cells)."""
    size = members.groupBy("leader").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_CELLS)).alias("blocks"))
    placed = (members.join(written(size, "block-sizes"), "leader")
              .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))).join(texts, "key")
              .select("leader", "block", "blocks", "key", "near", "text"))

    def run(group, part):
        import pyarrow as pa

        sets = [np.unique(c) for c in _separate([t or "" for t in part["text"].to_pylist()])]
        row = {"leader": group[0].as_py(), "block": group[1].as_py(), "blocks": part["blocks"][0].as_py(),
               "keys": np.array(part["key"], np.int64).tobytes(), "near": np.array(part["near"], np.uint8).tobytes(),
               "ends": np.cumsum([len(c) for c in sets]).astype(np.int64).tobytes(), "cells": np.concatenate(sets).tobytes()}
        return pa.Table.from_pylist([row], pa.schema([(c, pa.int64()) for c in list(row)[:3]]
                                                     + [(c, pa.binary()) for c in list(row)[3:]]))

    return placed.groupBy("leader", "block").applyInArrow(
        run, "leader long, block long, blocks long, keys binary, near binary, ends binary, cells binary")


def _separate(texts: list[str]) -> list[np.ndarray]:
    of, cell = cells_of([t.encode() for t in texts])
    return np.split(cell, np.searchsorted(of, np.arange(1, len(texts))))


def shared_cells(a: np.ndarray, a_of: np.ndarray, n: int, b: np.ndarray, b_of: np.ndarray, m: int) -> np.ndarray:
    """How many cells each of n sets has in common with each of m sets."""
    out = np.zeros((n, m), np.float32)  # whole numbers, exact up to 2**24
    common = np.intersect1d(a, b)
    for k in range(0, len(common), COLUMNS):
        part = common[k:k + COLUMNS]
        sides = []
        for cells, of, rows in ((a, a_of, n), (b, b_of, m)):
            at = np.minimum(np.searchsorted(part, cells), len(part) - 1)
            hit = part[at] == cells
            side = np.zeros((rows, len(part)), np.float32)
            side[of[hit], at[hit]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _tile_links(blocks: DataFrame, up: int, down: int) -> DataFrame:
    """(a, b): for each document far from its leader a link into each class it is linked with in a tile."""
    parts = ["keys", "near", "ends", "cells"]
    left = blocks.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    right = blocks.select("leader", F.col("block").alias("other"), *[F.col(c).alias(f"o_{c}") for c in parts])
    pairs = left.join(right, ["leader", "other"]).select(*parts, *[f"o_{c}" for c in parts])

    def opened(keys, near, ends, cells):
        ends = np.frombuffer(ends, np.int64)
        size = np.diff(ends, prepend=0)
        return (np.frombuffer(keys, np.int64), np.frombuffer(near, np.uint8).astype(bool), size,
                np.frombuffer(cells, np.uint64), np.repeat(np.arange(len(ends)), size))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in zip(*batch.columns):
                raw = [x.as_py() for x in row]
                ka, na, sa, ca, oa = opened(*raw[:4])
                kb, nb, sb, cb, ob = opened(*raw[4:])
                shared = shared_cells(ca, oa, len(ka), cb, ob, len(kb)).astype(np.int64)
                linked = shared * down >= (sa[:, None] + sb - shared) * up
                linked &= ~(na[:, None] & nb) & (ka[:, None] != kb)  # the near ones are one class already
                found = []
                for links, x, y, y_near in ((linked, ka, kb, nb), (linked.T, kb, ka, na)):
                    # All near members share a class: one of them will do. Far ones each count.
                    some = links[:, y_near]
                    r = np.flatnonzero(some.any(axis=1))
                    if len(r):
                        found.append((x[r], y[y_near][some[r].argmax(axis=1)]))
                both = linked & ~na[:, None] & ~nb
                r, c = np.nonzero(both)
                if len(r):
                    label = _grouped(np.arange(len(ka) + len(kb)), r, c + len(ka))
                    ids = np.concatenate([ka, kb])
                    moved = np.flatnonzero(label != np.arange(len(ids)))
                    found.append((ids[moved], ids[label[moved]]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


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


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS,
                    rows: int = ROWS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(key, class_id, n_cells, kept) for each row: the smallest key linked with it, directly or not.

    Texts are linked at a weighted similarity of their shingles of `similar` or more; a text of fewer than
    five words is one shingle, a null or empty one links with nothing. Keys are whole numbers; rows that
    share a key are one document with all their links, and rows without key stay alone (class null, kept).
    `kept` marks the row with the smallest key.
    """
    up, down = similar
    chosen = df.select(F.col(quoted(key)).cast("long").alias("key"), F.col(quoted(text)).alias("text"))
    chosen = chosen.withColumn("mark", F.xxhash64("text"))  # tells texts of one key apart
    texts = chosen.where(F.col("key").isNotNull())
    sketch = written(sketches(chosen, bands, rows), "sketches")
    real = sketch.where((F.col("n") > 0) & F.col("key").isNotNull())
    # Equal sets of cells are one from here on, under a number of their own; a row with the smallest key stands for them.
    first = written(real.groupBy("f1", "f2").agg(F.min(F.struct("key", "mark")).alias("rep"))
                    .select("f1", "f2", "rep.*", F.monotonically_increasing_id().alias("id")), "equal")
    stands = first.select("key", "mark", "id")
    reps = real.select("key", "mark", "bands").join(stands, ["key", "mark"]).select(F.col("id").alias("key"), "bands").dropDuplicates(["key"])
    banded = written(reps.select("key", F.posexplode("bands").alias("band", "hash")), "bands")
    # Buckets with one member link nothing.
    sizes = written(banded.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    inside = written(banded.join(sizes, ["band", "hash"]), "inside")
    meets = written(inside.groupBy("key").agg(F.sum("n").alias("meets")), "meets")
    rank = F.max(F.struct("meets", (-F.col("key")).alias("k")))
    leaders = written(inside.select("band", "hash", "key").join(meets, "key").groupBy("band", "hash")
                      .agg((-rank["k"]).alias("leader")), "leaders")
    led = written(inside.select("band", "hash", "key").join(leaders, ["band", "hash"])
                  .where(F.col("key") != F.col("leader")).select("leader", "key").distinct(), "led")
    # Texts of the members of some bucket. All sizes take the same way: texts meet ids in a shuffle.
    ids = led.select("key").union(led.select("leader")).distinct().hint("merge")
    named = stands.join(ids.withColumnRenamed("key", "id"), "id")
    wanted = written(texts.join(named.hint("merge"), ["key", "mark"]).select(F.col("id").alias("key"), "text").dropDuplicates(["key"]), "compared")
    compared = written(overlaps(led.toDF("a", "b"), wanted), "overlaps")
    linked = F.col("shared") * down >= F.col("total") * up
    links = compared.where(linked).select("a", "b")
    # Leaders with a member that is not linked to them.
    open_leaders = written(compared.where(~linked).groupBy(F.col("a").alias("leader")).agg(
        F.count(F.lit(1)).alias("far")), "open-leaders")
    cells = real.join(stands, ["key", "mark"]).groupBy(F.col("id").alias("key")).agg(F.max("n").alias("n"))
    members = (compared.select(F.col("a").alias("leader"), F.col("b").alias("key"), linked.alias("near"))
               .join(open_leaders, "leader").join(cells, "key").select("leader", "key", "near", "n"))
    # A leader with a single far member and no other has nothing more to compare.
    members = members.join(written(members.groupBy("leader").agg(F.count(F.lit(1)).alias("all")), "led-sizes")
                           .where("all > 1"), "leader").drop("all")
    blocks = written(_blocks_of(written(members, "far-groups"), wanted), "far-blocks")
    links = links.unionByName(written(_tile_links(blocks, up, down), "far-links"))
    # A key with several sets of cells links each of them with its lowest.
    cut = F.struct("f1", "f2")
    several = written(real.groupBy("key").agg(F.min(cut).alias("low"), F.max(cut).alias("high")).where("low <> high")
                      .select("key", "low"), "several")
    own = first.select("f1", "f2", "id")
    shared = (real.select("key", "f1", "f2").join(several, "key").select("f1", "f2", "low").distinct().join(own, ["f1", "f2"])
              .select(F.col("id").alias("a"), F.col("low.f1").alias("f1"), F.col("low.f2").alias("f2"))
              .join(own.withColumnRenamed("id", "b"), ["f1", "f2"]).select("a", "b"))
    joined = written(first.join(written(components(links.unionByName(shared)).toDF("id", "component"), "components"), "id", "left")
                     .withColumn("component", F.coalesce("component", "id")), "joined")
    lowest = written(joined.groupBy("component").agg(F.min("key").alias("class_id")), "lowest-keys")
    of_cells = written(joined.join(lowest, "component").select("f1", "f2", "class_id"), "classes-of-cells")
    classes = written(real.select("key", "f1", "f2").join(of_cells, ["f1", "f2"]).select("key", "class_id").distinct(), "classes")
    out = (sketch.select("key", "n").join(classes, "key", "left")
           .withColumn("class_id", F.coalesce("class_id", "key")))
    return out.select(F.col("key").alias(key), "class_id", F.col("n").alias("n_cells"),
                      F.coalesce(F.col("key") == F.col("class_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of one document of each group of near copies, the one with the smallest key; all columns stay.

    Of rows that share that key and their text one stays, the smallest by the other columns; rows of the key with other
    texts stay as well. Rows without key, and null or empty texts, are no copies of another row. An empty table stays empty.
    """
    settle(df.sparkSession)
    name, words = quoted(key), F.xxhash64(F.col(quoted(text)))
    gone = (near_duplicates(df, key, text).where(~F.col("kept"))
            .select(F.col(name).alias(mark := free_name(df, "_gone"))).distinct())
    rest = df.join(gone, F.col(name) == F.col(mark), "left_anti")
    # Few rows are repeated; only those meet, and of each set only the smallest one travels.
    same = free_name(df, "_same")
    several = written(df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias(mark), words.alias(same))
                      .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(mark, same), "repeated-rows")
    meet = (F.col(name) == F.col(mark)) & (words == F.col(same))
    others = [c for c in df.columns if c not in (key, text)]
    first = (rest.join(several, meet, "left_semi").groupBy(F.col(name).alias("k"), F.col(quoted(text)).alias("t"))
             .agg(F.min(F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("end"))).alias("r")))
    at = {key: "k", text: "t", **{c: f"r.c{i}" for i, c in enumerate(others)}}
    return rest.join(several, meet, "left_anti").unionByName(first.select(*[F.col(at[c]).alias(c) for c in df.columns]))
