"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthmark.llm.common import written

#: The number of rounds grows with the logarithm of the longest path; this is far above it.
MOST_ROUNDS = 60


def _lowest(edges: DataFrame) -> DataFrame:
    # Stored, so that the join has an exchange of its own and a hot node's links can be split.
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has a link.

    links: two columns of whole numbers. Alternates two steps until nothing changes: every
    node passes the smallest node it knows to its larger neighbours, then to its smaller ones.
    Hot nodes only ever meet a minimum; no neighbourhood is gathered.
    """
    a, b = links.columns
    edges = written(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _lowest(both).select("u", F.least("u", "m").alias("m"))
        # A node's smallest neighbour keeps its link as (m, node) if the node is larger.
        wide = (both.join(m, "u").where(F.col("v") > F.col("u"))
                .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        wide = written(wide, "links")
        m = _lowest(wide)
        joined = wide.join(m, "u")
        edges = written(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                        .unionByName(m.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
