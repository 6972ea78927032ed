"""Joins whose many-row side may hold a hot key, and tasks as many as rows ask for."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task may well take. Keys beyond are dealt over as many tasks as that asks for.
ROWS_PER_SALT = 100_000

#: Rows of an aggregate that a task may well hold.
ROWS_PER_TASK = 250_000

#: Whole rows that a task may well sort.
ROWS_PER_SORT = 500_000

#: Hot keys at most, the ones with most rows: their table stays small however large the data are, and a key
#: that is not among them has less than this share of all rows.
MOST_HOT = 10_000


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n", rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(_h0, _h1, ..., _salts): keys of more than `rows_per_salt` rows and the tasks they are dealt over.

    `counts` has one row for each key; counts may be too high, which only costs repeats.
    """
    names = [F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]
    return (counts.where(F.col(n) > rows_per_salt).orderBy(F.desc(n), *keys).limit(MOST_HOT)
            .select(*names, F.ceil(F.col(n) / rows_per_salt).cast("int").alias("_salts")))


def in_tasks(df: DataFrame, keys: list[str], n: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows dealt by a hash of `keys` over as many tasks as `n` rows ask for.

    An aggregate by these keys then needs no other shuffle, and its tasks hold no more rows as tables grow, whatever
    number of shuffle partitions is set. For keys that few rows share: rows are dealt before they are combined.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // rows_per_task))
    return df.repartition(tasks, *keys)


def in_ranges(df: DataFrame, keys: list[str], counted: DataFrame, rows_per_task: int = ROWS_PER_SORT) -> DataFrame:
    """The rows dealt by ranges of `keys`, over more tasks than shuffle partitions are set where rows ask for more.

    A task then sorts about `rows_per_task` rows however large the table is, and need not spill them. `counted` has
    as many rows as df, roughly, and is cheap to count.
    """
    tasks = -(-counted.count() // rows_per_task)
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartitionByRange(*keys)
    return df.repartitionByRange(tasks, *keys)


def _met(keys: list[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_h{i}") for i, k in enumerate(keys)])


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner",
                counts: DataFrame | None = None, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Join that deals the rows of each hot key over as many tasks as its count asks for.

    `few` has one row (or few) for each key; rows of cold keys are joined as they are, rows of hot ones
    are repeated once for each task. Run-time skew handling cannot split a join whose side comes
    straight out of an aggregation on its key; dealing by a salt works for any plan. The rows of a hot key
    are dealt by a hash of `spread_by`. `counts` (keys and n) spares counting `many` where they are known.
    """
    if counts is None:
        counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(hot_keys(counts, keys, "n", rows_per_salt))  # MOST_HOT rows at most
    names = [f"_h{i}" for i in range(len(keys))]
    salts = F.coalesce("_salts", F.lit(1))
    dealt = (many.join(hot, _met(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int"))
             .drop(*names, "_salts"))
    repeated = (few.join(hot, _met(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
                .drop(*names, "_salts"))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")
