"""Hard-negative mining: exact whole-number scores from products in a residue number system.

Components are whole numbers. A score is the inner product of two vectors; it is taken modulo several
small primes, each by one float32 matrix product over residues around zero, small enough for every sum
to be exact below 2**24. The scores' largest size follows from the longest vector (Cauchy and
Schwarz); the primes' product is above twice that, so Chinese remaindering gives the signed score back.

Anchors meet rows in tiles, dealt by hash into blocks of about ANCHORS and ROWS. First, rows of an
anchor's own label: a tile returns its first few, a window over tiles keeps the anchor's positives. They fix
the range of scores of wanted negatives, so in a second pass, over rows of all labels, a tile
returns its first few other-label rows in each range, and a window keeps the first of those. Neither
a label nor an anchor is ever gathered whole, whatever share of the rows it has.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthmark.llm.common import quoted, written

#: Rows of a tile's two sides. They bound memory only.
ANCHORS, ROWS = 512, 4096

#: Squared lengths stay below this, so scores, and nine times them, fit into 64 bits.
LONGEST = 2.0 ** 58

#: Sums of residue products below this are exact in float32.
EXACT = 1 << 24


@functools.cache
def primes_for(dim: int, bound: int) -> tuple[int, ...]:
    """Odd primes, the largest first, whose product exceeds 2 * bound + 1."""
    # Residues reach (p - 1) / 2, and dim of their products are summed; longer vectors are summed in parts.
    top = max(3, min(2 * int((EXACT // max(1, min(dim, SEGMENT))) ** 0.5) + 1, 1 << 15))
    found, product = [], 1
    for p in range(top - (top % 2 == 0), 2, -2):
        if all(p % q for q in range(3, int(p ** 0.5) + 1, 2)) and (p - 1) ** 2 // 4 * min(dim, SEGMENT) < EXACT:
            found.append(p)
            product *= p
            if product > 2 * bound + 1:
                return tuple(found)
    raise ValueError("no primes for this length")


#: Components that are summed in one product.
SEGMENT = 1024


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p - 1) / 2 to (p - 1) / 2."""
    r = np.mod(x, p)
    return r - p * (r > p // 2)


def residues(q: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """(primes, rows, components) in 16 bits."""
    return np.stack([centred(q, p) for p in primes]).astype(np.int16)


def scores(a: np.ndarray, b: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """Exact inner products of all rows, from residues of both sides."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        total = np.zeros((a.shape[1], b.shape[1]), np.int64)
        for at in range(0, a.shape[2], SEGMENT):
            part = slice(at, at + SEGMENT)
            total += (a[k][:, part].astype(np.float32) @ b[k][:, part].astype(np.float32).T).astype(np.int64)
        # Digits of the mixed-radix form around zero, which is unique and carries the sign.
        for q, d in zip(primes, digits):
            total = (total - d) % p * pow(q, -1, p)
        digits.append(centred(total, p))
    value = digits[-1]
    for p, d in zip(primes[-2::-1], digits[-2::-1]):
        value = value * p + d
    return value


def first_positives(score: np.ndarray, allowed: np.ndarray, most: int) -> list[np.ndarray]:
    """For each line the columns of its `most` highest allowed scores, ties by column."""
    out = []
    for line, ok in zip(score, allowed):
        at = np.flatnonzero(ok)
        if len(at) > most:
            least = np.partition(line[at], len(at) - most)[len(at) - most]
            at = at[line[at] >= least]
        out.append(at[np.argsort(-line[at], kind="stable")][:most])
    return out


def first_in_ranges(score: np.ndarray, allowed: np.ndarray, low: list[np.ndarray], high: list[np.ndarray],
                    most: int) -> list[list[np.ndarray]]:
    """For each line and each of its ranges the columns of the `most` highest allowed scores in it."""
    out = []
    for line, ok, lows, highs in zip(score, allowed, low, high):
        if not len(lows):
            out.append([])
            continue
        at = np.flatnonzero(ok & (line >= lows.min()) & (line <= highs.max()))
        at = at[np.argsort(-line[at], kind="stable")]
        found = -line[at]  # ascending
        out.append([at[(n := np.searchsorted(found, -h)):min(n + most, np.searchsorted(found, -l, side="right"))]
                    for l, h in zip(lows.tolist(), highs.tolist())])
    return out


def score_range(positive: int, low: int, high: int) -> tuple[int, int]:
    """Whole numbers s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _side(table, shape: tuple[int, int]):
    """(row numbers, ids, labels, residues) of a tile's side, by ascending id."""
    table = table.sort_by([("id", "ascending"), ("row", "ascending")])
    raw = np.frombuffer(b"".join(table["residues"].to_pylist()), np.int16)
    # A row holds its residues prime by prime.
    return (np.array(table["row"]), np.array(table["id"]), np.array(table["label"]),
            raw.reshape(table.num_rows, *shape).transpose(1, 0, 2))


def _vectors(df: DataFrame, key: str, vector: str, label: Column, is_anchor: Column, scale: int) -> DataFrame:
    """(row, id, label, anchor, dim, longest, residues) of rows that take part, stored."""
    parts = F.transform(F.col(quoted(vector)), lambda x: x.cast("double"))
    chosen = df.select(F.col(quoted(key)).cast("long").alias("id"), label.cast("long").alias("label"),
                       is_anchor.alias("anchor"), parts.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Squares are of whole numbers, or one off in the last place of a double.
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * scale + 1, F.lit(2.0)))
    rows = (chosen.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
            .withColumn("length", length).where(F.col("length") < LONGEST))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "mining-vectors")
    # Stored, so its size is known: one row for each vector length.
    dims = written(rows.groupBy("dim").agg(F.ceil(F.max("length")).cast("long").alias("longest")), "mining-lengths")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            dim, longest = (np.array(col[c]) for c in ("dim", "longest"))
            ends = np.cumsum(dim)
            flat = np.floor(scale * np.array(col["v"].flatten(), np.float64)).astype(np.int64)
            packed = [residues(flat[e - d:e][None], primes_for(int(d), int(m))).tobytes()
                      for d, m, e in zip(dim.tolist(), longest.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([*[col[c] for c in kept], pa.array(packed, pa.binary())], [*kept, "residues"])

    kept = ["row", "id", "label", "anchor", "dim", "longest"]
    return written(rows.join(dims, "dim").select(*kept, "v").mapInArrow(
        run, "row long, id long, label long, anchor boolean, dim int, longest long, residues binary"), "mining-residues")


def _tiles(anchors: DataFrame, rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """work(key, anchors' table, rows' table) for each pair of an anchor block and a row block of a key.

    Rows are repeated for each anchor block and anchors for each row block, whose numbers come from counts.
    """
    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    rows = rows.toDF(*rows.columns)  # columns of its own, as both sides come from one table
    sizes = written(blocks(anchors, ANCHORS, "n_a").join(blocks(rows, ROWS, "n_r"), keys), "mining-blocks")
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = anchors.join(sizes, keys).withColumn("a", dealt("n_a")).withColumn("r", every("n_r")).drop("n_a", "n_r")
    r = rows.join(sizes, keys).withColumn("r", dealt("n_r")).withColumn("a", every("n_a")).drop("n_a", "n_r")
    return a.groupBy(*keys, "a", "r").cogroup(r.groupBy(*keys, "a", "r")).applyInArrow(work, schema)


def hard_negatives(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
                   is_anchor: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x) in double precision, scores are exact inner products. For each row of
    `is_anchor` (default: keys divisible by 100) its first `positives` other rows of the same label, and for each of them
    the first `negatives` rows of other labels with low/100 <= negative score / positive score <= high/100, as products
    of whole numbers. Higher scores come first, ties by smaller key.

    Rows with a null key, label, vector or component, with a component that is not finite, or with a squared
    whole-number length of about 2**58 or more (their scores would not fit) take no part. Vectors meet vectors of the same
    number of components; empty ones score 0. Rows that share a key are rows of their own, so an anchor's copy may be its
    positive. An anchor without positives, or a positive without negatives, has no rows, nor has an empty table.
    """
    tag = F.col(quoted(label)) if isinstance(label, str) else label
    chosen = F.col(quoted(key)) % 100 == 0 if is_anchor is None else is_anchor
    rows = _vectors(df, key, vector, tag, chosen, scale)
    anchors = rows.where("anchor").drop("anchor")
    rows = rows.drop("anchor")

    def same_label(anchor_table, row_table):
        import pyarrow as pa

        out = {n: [] for n in ("row", "id", "score", "other")}
        if anchor_table.num_rows and row_table.num_rows:
            dim, longest = anchor_table["dim"][0].as_py(), anchor_table["longest"][0].as_py()
            primes = primes_for(dim, longest)
            number, ids, _, a = _side(anchor_table, (len(primes), dim))
            r_number, r_ids, _, b = _side(row_table, (len(primes), dim))
            value = scores(a, b, primes)
            for i, at in enumerate(first_positives(value, number[:, None] != r_number[None, :], positives)):
                for j in at.tolist():
                    out["row"].append(int(number[i]))
                    out["id"].append(int(ids[i]))
                    out["score"].append(int(value[i, j]))
                    out["other"].append(int(r_ids[j]))
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    def other_label(anchor_table, row_table):
        import pyarrow as pa

        names = ("row", "id", "place", "positive", "positive_score", "score", "other")
        out = {n: [] for n in names}
        if anchor_table.num_rows and row_table.num_rows:
            dim, longest = anchor_table["dim"][0].as_py(), anchor_table["longest"][0].as_py()
            primes = primes_for(dim, longest)
            number, ids, labels, a = _side(anchor_table, (len(primes), dim))
            _, r_ids, r_labels, b = _side(row_table, (len(primes), dim))
            wanted = dict(zip(anchor_table["row"].to_pylist(), anchor_table["wanted"].to_pylist()))
            value = scores(a, b, primes)
            lists = [wanted[n] for n in number.tolist()]
            ranges = [np.array([score_range(p["score"], low, high) for p in ps], np.int64).reshape(-1, 2) for ps in lists]
            found = first_in_ranges(value, labels[:, None] != r_labels[None, :], [x[:, 0] for x in ranges],
                                    [x[:, 1] for x in ranges], negatives)
            for i, (ps, hits) in enumerate(zip(lists, found)):
                for p, at in zip(ps, hits):
                    for j in at.tolist():
                        for n, v in zip(names, (number[i], ids[i], p["place"], p["other"], p["score"], value[i, j], r_ids[j])):
                            out[n].append(int(v))
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    near = _tiles(anchors, rows, ["dim", "label"], same_label, "row long, id long, score long, other long")
    order = [F.desc("score"), F.asc("other")]
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("place") <= positives)
    # As many entries as there are positives wanted.
    wanted = written(near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "other", "score"))).alias("wanted")),
                     "mining-positives")
    far = _tiles(anchors.join(wanted, "row"), rows, ["dim"], other_label,
                 "row long, id long, place long, positive long, positive_score long, score long, other long")
    best = Window.partitionBy("row", "place").orderBy(*order)
    far = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return far.select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int"),
                      F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
