"""Merkle manifest of a table: digests of rows, a tree for each group, a tree over the groups.

A node is the SHA-256 of its children's digests as lower-case hexadecimal text, side by side; every
`arity` consecutive nodes of a level form a run with one parent, the last run may be shorter.

Rows are numbered in their group by a sample sort and cut into chunks of arity ** LEVELS rows. In
a chunk a node stands in the row of its first leaf, so on level j its run's other nodes are a fixed
number of rows away: lag and lead columns with offsets of i * arity ** j, masked by the node's slot
and the length of its run, are its siblings, and first children hash the parents. All levels
of a chunk share one shuffle and one sort. Tops of chunks are the rows of the next, far smaller, table;
going down again, a chunk takes its siblings above from the one row of its top. No group is ever
in one task, and neither texts nor proofs are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmark.functions.ranking import range_rank
from monthmark.llm.common import quoted, written

#: Levels of the tree inside a chunk: 1,024 rows of a binary tree. Bounds memory only.
LEVELS = 10

#: Steps of a leaf that has nothing beside it.
EMPTY = "CAST(array() AS array<struct<left: string, right: string>>)"

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of values in turn: `-` for null, else UTF-8 bytes, a colon and the value."""
    def one(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*[one(v) for v in values]))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, level by level from below, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def _climbed(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """nodes (g, m, pos, h, ...) with chunk, steps inside the chunk, and the chunk's top."""
    span = arity ** levels
    chunk = "(PARTITION BY g, chunk ORDER BY pos)"
    so_far = "(PARTITION BY g, chunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    others = [quoted(c) for c in nodes.columns] + ["chunk"]
    df = nodes.selectExpr("*", f"pos div {span} AS chunk", "h AS h0")
    for j in range(levels):
        stride = arity ** j
        slot = f"(pos div {stride} % {arity})"
        run = f"least({arity}, (m + {stride - 1}) div {stride} - (pos div {stride} - {slot}))"
        df = df.selectExpr("*", *[f"{f}(h{j}, {i * stride}) OVER {chunk} AS {f}{i}" for i in range(1, arity) for f in ("lag", "lead")])
        left = ", ".join(f"if({slot} >= {i}, lag{i}, '')" for i in range(arity - 1, 0, -1))
        right = ", ".join(f"if({slot} + {i} < {run}, lead{i}, '')" for i in range(1, arity))
        here = f"pos % {stride} = 0 AND m > {stride}"  # a node's row, while several nodes remain
        df = df.selectExpr(*others, *[f"{s}{i}" for i in range(j) for s in ("l", "r")],
                           f"if({here}, concat({left}), null) AS l{j}", f"if({here}, concat({right}), null) AS r{j}",
                           f"if(pos % {stride * arity} = 0, if(m > {stride}, sha2(concat(h{j}, {right}), 256), h{j}), null) AS h{j + 1}")
    # Rows behind a node's first one take its siblings from there.
    df = df.selectExpr(*others, f"last(h{levels}, true) OVER {so_far} AS top",
                       *[f"last({s}{j}, true) OVER {so_far} AS {s}{j}" for j in range(levels) for s in ("l", "r")])
    steps = ", ".join(f"named_struct('left', l{j}, 'right', r{j})" for j in range(levels))
    steps = f"filter(array({steps}), s -> s.left IS NOT NULL)" if levels else EMPTY
    return df.selectExpr(*others, "top", f"{steps} AS steps")


def _tiers(nodes: DataFrame, arity: int, levels: int) -> list[tuple[DataFrame, int]]:
    """The nodes, the tops of their chunks, and so on until a chunk holds any group; levels of each."""
    span, tiers = arity ** levels, []
    while (most := nodes.agg(F.max("m")).first()[0] or 1) > span:
        tiers.append((nodes, levels))
        tops = _climbed(nodes, arity, levels).where(F.col("pos") % span == 0)
        nodes = written(tops.selectExpr("g", f"(m + {span - 1}) div {span} AS m", "chunk AS pos", "top AS h"), "merkle-tops")
    return [*tiers, (nodes, next(n for n in range(levels + 1) if arity ** n >= most))]


def _down(tiers: list[tuple[DataFrame, int]], arity: int, above: DataFrame | None = None) -> DataFrame:
    """The lowest tier with steps, subroot and root; `above` has (g, up, root) of each group."""
    *lower, (nodes, levels) = tiers
    out = _climbed(nodes, arity, levels).withColumn("subroot", F.col("top"))
    if above is None:
        out = out.withColumn("root", F.col("top"))
    else:  # Here a group has the rows of one chunk at most.
        out = out.join(above, "g").withColumn("steps", F.concat("steps", "up")).drop("up")
    for nodes, levels in reversed(lower):
        upper = written(out.selectExpr("g", "pos AS chunk", "steps AS up", "subroot", "root"), "merkle-paths")
        out = (_climbed(nodes, arity, levels).join(upper, ["g", "chunk"])
               .withColumn("steps", F.concat("steps", "up")).drop("up"))
    return out


def prove(leaves: DataFrame, key: str, group: str, leaf: str, keep: Sequence[str] = (), arity: int = 2,
          levels: int = LEVELS) -> DataFrame:
    """(key, group, leaf, position, *keep, steps, subroot, root) for each row.

    Leaves of a group ascend by key, null keys first, ties by digest; subroots ascend by the group's
    bytes, null first. `steps` is an array of (left, right) siblings' digests from the leaf up, '' where
    a run has none; `folded` and `proof_digest` read it. A lone leaf is its group's subroot, a
    lone group's subroot the root. Repeated rows are leaves of their own. An empty table has no rows.
    """
    if arity < 2 or levels < 1:
        raise ValueError("runs have two nodes at least, chunks one level")
    if len({key, group, leaf, *keep}) < 3 + len(keep):
        raise ValueError("key, group, leaf and kept columns are different ones")
    kept = [f"k{i}" for i in range(len(keep))]
    name = F.coalesce(F.concat(F.lit("v"), F.col(quoted(group)).cast("string")), F.lit("n"))  # never null, same order
    rows = leaves.select(F.col(quoted(key)).alias("key"), F.col(quoted(group)).alias("group"), name.alias("g"),
                         F.col(quoted(leaf)).alias("h"), *[F.col(quoted(c)).alias(k) for c, k in zip(keep, kept)])
    nodes = written(range_rank(rows, ["g"], ["key", "h"], "pos", "m"), "merkle-leaves")
    tiers = _tiers(nodes, arity, levels)
    subroots = written(_climbed(tiers[-1][0], arity, tiers[-1][1]).where("pos = 0").selectExpr(
        "'' AS g", "g AS member", "top AS h"), "merkle-subroots")
    groups = written(range_rank(subroots, ["g"], ["member"], "pos", "m"), "merkle-groups")
    above = written(_down(_tiers(groups, arity, levels), arity).selectExpr("member AS g", "steps AS up", "root"), "merkle-roots")
    return _down(tiers, arity, above).select(
        F.col("key").alias(key), F.col("group").alias(group), F.col("h").alias(leaf), F.col("pos").alias("position"),
        *[F.col(k).alias(c) for c, k in zip(keep, kept)], "steps", "subroot", "root")


def merkle_manifest(df: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS,
                    changed: dict[str, Column] | None = None, arity: int = 2, levels: int = LEVELS) -> DataFrame:
    """(key, group, leaf, changed_leaf, position, steps, subroot, root) for each row of a table.

    A leaf is the digest of the row's `fields`; `changed_leaf` the same with some fields replaced by
    expressions over the row, null where the first of them is null. Nulls in any field are values of
    their own, empty texts are not null, long texts are hashed whole where they are read. Other columns are not read.
    Ties, repeated rows and empty tables: see `prove`.
    """
    value = {c: F.col(quoted(c)) for c in fields}
    other = {**value, **(changed or {})}
    test = next(iter(changed.values())).isNotNull() if changed else F.lit(False)
    leaves = df.select(F.col(quoted(key)).alias("a"), F.col(quoted(group)).alias("b"),
                       leaf_digest(list(value.values())).alias("leaf"),
                       F.when(test, leaf_digest(list(other.values()))).alias("changed_leaf"))
    # Texts are read and hashed once, not again for every pass of the sort.
    proved = prove(written(leaves, "leaves"), "a", "b", "leaf", ["changed_leaf"], arity, levels)
    return proved.select(F.col("a").alias(key), F.col("b").alias(group), "leaf", "changed_leaf", "position", "steps",
                         "subroot", "root")


def tamper_check(df: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents.

    Where 7 divides crc32(doc_id as text), the row is folded as if n_chars were greater by one; nulls stay.
    """
    grown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0,
                   F.col("n_chars").cast("decimal(20,0)") + 1)
    rows = merkle_manifest(df, changed={"n_chars": grown})
    rows = rows.withColumn("folded_root", folded(F.coalesce("changed_leaf", "leaf"), F.col("steps")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
