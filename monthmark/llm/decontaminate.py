"""Benchmark decontamination: SimHash of item-sized windows, exact checks of candidates.

DataFrame functions only. A window can reach the wanted similarity only if it shares most of an
item's shingles, so it holds one of any (1 - similarity) share of them plus one: the
rarest in the corpus are taken as anchors, and only stretches of documents around an anchor are looked at. There every
window of the item's size gets a 64-bit fingerprint, one vote of each shingle occurrence for each bit. Votes roll: a
shingle adds its own where it enters a window and takes them back where it leaves. Fingerprints are
cut into BLOCKS blocks: any two that differ in at most RADIUS bits differ in at most RADIUS / BLOCKS bits
of some block. Items are stored under all values within so many flipped bits of each of their blocks, so one equality join on
(size, block, value) finds all windows within the radius, of whatever item. What is left is compared exactly,
by weighted similarity of shingles (shared occurrences over all occurrences).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthmark.llm.common import free_name, quoted, settle, written

#: Words of a shingle, similarity as a fraction, bits by which fingerprints may differ. Two texts of the
#: wanted similarity differ in about 10 of 64 bits, with a deviation of 3; unrelated ones in 32, with one of 4.
WIDTH, SIMILAR, RADIUS, BITS, BLOCKS = 5, (4, 5), 19, 64, 4

_SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space; none for null."""
    cut = F.trim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(F.length(cut) > 0, F.split(F.lower(cut), r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def shingles(hashes: Column, width: int) -> Column:
    """Hashes of all runs of `width` word hashes."""
    starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0)))
    if width == 1:
        return F.transform(starts, lambda x: F.xxhash64(x))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, width)]))


def _hashes(word_list: Column) -> Column:
    return F.transform(word_list, lambda w: F.xxhash64(w))


def _votes(h: Column) -> list[Column]:
    """One vote for each bit, two to a number: votes are fewer than 2**32."""
    half = BITS // 2
    one = lambda b: F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1).cast("long"))
    return [one(b) + F.shiftleft(one(b + half), 32) for b in range(half)]


def _print(votes: list[Column], n: Column) -> Column:
    """The fingerprint of n votes: a bit is set if more than half of them are for it."""
    half = BITS // 2
    mark = F.lit(0).cast("long")
    for b, v in enumerate(votes):
        low, high = v.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned(v, 32)
        for count, bit in ((low, b), (high, b + half)):
            mark = mark.bitwiseOR(F.shiftleft((count * 2 > n).cast("long"), bit))
    return mark


def fingerprints(df: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """(keys, print) of the hashes in an array column."""
    counted = (df.select(*keys, F.explode(hashes).alias("h")).groupBy(*keys)
               .agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"v{b}") for b, v in enumerate(_votes(F.col("h")))]))
    return counted.select(*keys, _print([F.col(f"v{b}") for b in range(BITS // 2)], F.col("n")).alias("print"))


def rolling_fingerprints(regions: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, start, print) of all runs of m hashes in the array r, which begins at place c * m of its document."""
    # A hash and the one that leaves when it enters; 0 has no vote.
    moves = F.transform("r", lambda x, i: F.struct(x.alias("h"), F.coalesce(F.get("r", i - F.col("m")), F.lit(0).cast("long")).alias("gone")))
    rows = (regions.select(*ids, "m", F.posexplode(moves).alias("i", "e"))
            .select(*ids, "m", "i", *[(a - b).alias(f"v{k}") for k, (a, b) in enumerate(zip(_votes(F.col("e.h")), _votes(F.col("e.gone"))))]))
    # A region is no longer than two items.
    upto = Window.partitionBy(*ids).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select(*ids, "m", "i", *[F.sum(f"v{k}").over(upto).alias(f"v{k}") for k in range(BITS // 2)])
    return (summed.where(F.col("i") >= F.col("m") - 1)
            .select(*ids, (F.col("c") * F.col("m") + F.col("i") - F.col("m") + 1).alias("start"),
                    _print([F.col(f"v{k}") for k in range(BITS // 2)], F.col("m")).alias("print")))


def _blocks(mark: Column) -> Column:
    """(block, value) of all blocks of a fingerprint."""
    wide = BITS // BLOCKS
    return F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(mark, k * wide)
                                        .bitwiseAND(F.lit((1 << wide) - 1).cast("long")).alias("value")) for k in range(BLOCKS)]))


def close_prints(windows: DataFrame, marks: DataFrame, ids: list[str], radius: int = RADIUS) -> DataFrame:
    """(ids, copy, differing): windows (ids, size, print) and marks (copy, size, print) of one size within the radius."""
    wide, flips = BITS // BLOCKS, radius // BLOCKS
    spelt = (marks.select("copy", "size", F.col("print").alias("other"), _blocks(F.col("print")).alias("b"))
             .select("copy", "size", "other", "b.block", "b.value", F.lit(0).alias("from")))
    # Flipped bits ascend; place `wide` flips none.
    for _ in range(flips):
        spelt = (spelt.select("copy", "size", "other", "block", "value", F.explode(F.sequence("from", F.lit(wide))).alias("at"))
                 .select("copy", "size", "other", "block",
                         F.when(F.col("at") < wide, F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))))
                         .otherwise(F.col("value")).alias("value"),
                         F.least(F.col("at") + 1, F.lit(wide)).alias("from")))
    # Thousands of values for each item: more than its size on disk lets expect, so it is never sent to all.
    spelt = spelt.drop("from").hint("merge")
    differing = F.bit_count(F.col("print").bitwiseXOR(F.col("other")))
    return (windows.select(*ids, *(["size"] if "size" not in ids else []), "print", _blocks(F.col("print")).alias("b"))
            .select("*", "b.block", "b.value").drop("b").join(spelt, ["size", "block", "value"])
            .select(*ids, "copy", differing.cast("int").alias("differing")).where(F.col("differing") <= radius).distinct())


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    return left.join(named, _all([_same(k, f"_{k}") for k in keys])).drop(*[f"_{k}" for k in keys])


#: What tells windows apart: document, its text, words of the item, stretch of the document and place.
REGION = ["doc", "row", "size", "c"]
PLACE = [*REGION, "start"]


def candidates(df: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str,
               similar: tuple[int, int]) -> dict[str, DataFrame] | None:
    """Stored tables: items, their shingles (parts), regions, windows with their prints, and close ones; None without items."""
    up, down = similar
    docs = df.select(F.col(quoted(key)).alias("doc"), _hashes(words(F.col(quoted(text)))).alias("h"))
    # Rows that share a key may differ in text.
    docs = docs.withColumn("row", F.xxhash64("h"))
    # Items of one text are one until the end.
    bench = written(items.select(F.col(quoted(item)).alias("item"), words(F.col(quoted(item_text))).alias("w"))
                    .where(F.size("w") > 0)
                    .select("item", F.xxhash64("w").alias("copy"), _hashes(F.col("w")).alias("h"), F.size("w").alias("size"),
                            F.least(F.size("w"), F.lit(WIDTH)).alias("width")).dropDuplicates(["item", "copy"]), "items")
    widths = sorted(r[0] for r in bench.select("width").distinct().collect())  # WIDTH at most
    if not widths:
        return None

    def runs(h: Column) -> Column:
        out = F.array().cast("array<bigint>")
        for w in widths:
            out = F.when(F.col("width") == w, shingles(h, w)).otherwise(out)
        return out

    texts = written(bench.dropDuplicates(["copy"]).select("copy", "size", "width", runs(F.col("h")).alias("r")), "item-texts")
    parts = written(texts.select("copy", "size", "width", F.posexplode("r").alias("q", "s")), "item-shingles")

    # Where shingles of items occur.
    found = None
    for w in widths:
        wanted = written(parts.where(F.col("width") == w).select("s").distinct(), "wanted")
        hits = (docs.select("doc", "row", F.size("h").alias("n"), F.posexplode(shingles(F.col("h"), w)).alias("p", "s"))
                .join(wanted, "s").withColumn("width", F.lit(w)))
        found = hits if found is None else found.unionByName(hits)
    found = written(found.select("doc", "row", "n", "width", "s", "p").distinct(), "hits")

    # The rarest shingles of each item, just so many that no match can miss all of them.
    often = found.groupBy("width", "s").agg(F.count(F.lit(1)).alias("often"))
    own = Window.partitionBy("copy")
    ranked = (parts.join(often, ["width", "s"], "left")
              .withColumn("often", F.coalesce("often", F.lit(0)))
              .withColumn("nth", F.row_number().over(own.orderBy("often", "s", "q")))
              .withColumn("all", F.count(F.lit(1)).over(own)))
    anchors = written(ranked.where(F.col("nth") <= F.col("all") - F.ceil(F.col("all") * up / down) + 1)
                      .select("size", "width", "s").distinct(), "anchors")

    # Stretch c holds the windows that start at c * m, ..., c * m + m - 1; those with an anchor are in two of them at most.
    m = F.least("size", "n") - F.col("width") + 1
    over = lambda a: F.floor(a / F.col("m")).cast("int")
    chunks = (found.join(anchors, ["width", "s"]).withColumn("m", m)
              .withColumn("c", F.explode(F.sequence(
                  over(F.greatest(F.lit(0), F.col("p") - F.col("m") + 1)),
                  over(F.least(F.col("p"), F.col("n") - F.col("width") + 1 - F.col("m"))))))
              .select(*REGION, "width", "m").distinct())
    stretch = F.slice("h", F.col("c") * F.col("m") + 1, 2 * F.col("m") + F.col("width") - 2)
    regions = written(_with(written(chunks, "chunks"), docs, ["doc", "row"]).withColumn("h", stretch)
                      .select(*REGION, "width", "m", runs(F.col("h")).alias("r")).dropDuplicates(REGION), "regions")

    windows = written(rolling_fingerprints(regions, REGION), "windows")
    marks = written(fingerprints(texts, ["copy", "size"], "r"), "item-prints")
    close = written(close_prints(windows, marks, PLACE), "close")
    return {"items": bench, "parts": parts, "regions": regions, "windows": windows, "close": close}


def benchmark_matches(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                      item: str = "item_id", item_text: str = "text", similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(key, item, start, n_words, differing, similarity): the best window of each document and item that match.

    A window has as many words as the item (all of a shorter document) and starts at word `start`;
    the first of equally good ones counts. Windows whose fingerprints differ in more than RADIUS bits are not compared.
    Items of fewer than five words are one shingle; empty and null
    ones match nothing, nor do empty and null texts; without items or documents there are no rows. Whole texts are
    read, however long. Items or documents that share their key are matched each
    and reported once, a null key included. Other columns are not read.
    """
    up, down = similar
    found = candidates(df, items, key, text, item, item_text, similar)
    if found is None:
        return df.select(F.col(quoted(key)).alias(key)).limit(0).select(
            F.col(quoted(key)), *[F.lit(None).cast(t).alias(c) for c, t in (
                (item, items.schema[item].dataType), ("start", "int"), ("n_words", "int"),
                ("differing", "int"), ("similarity", "double"))])
    at = [*PLACE, "copy", "differing", "m", "width"]
    mine = F.slice("r", F.col("start") - F.col("c") * F.col("m") + 1, F.col("m"))
    held = (_with(found["close"], found["regions"], REGION).select(*at, F.explode(mine).alias("s"))
            .groupBy(*at, "s").agg(F.count(F.lit(1)).alias("n")))
    theirs = found["parts"].groupBy("copy", "s").agg(F.count(F.lit(1)).alias("ni"))
    shared = held.join(theirs, ["copy", "s"]).groupBy(*at).agg(F.sum(F.least("n", "ni")).alias("shared"))
    total = F.col("m") + F.col("size") - F.col("width") + 1 - F.col("shared")
    matched = (shared.where(F.col("shared") * down >= total * up)
               .withColumn("similarity", F.col("shared") / total)
               .join(found["items"].select("item", "copy"), "copy"))
    best = (matched.groupBy("doc", "item")
            .agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), (F.col("m") + F.col("width") - 1).alias("words"),
                                "differing")).alias("b")))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item), (-F.col("b.s")).alias("start"),
                       F.col("b.words").alias("n_words"), F.col("b.differing").alias("differing"),
                       F.col("b.similarity").alias("similarity"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def without_benchmark(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                      item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows whose text holds no item; all columns stay."""
    settle(df.sparkSession)
    name = free_name(df, "_gone")
    gone = benchmark_matches(df, items, key, text, item, item_text).select(
        F.col(quoted(key)).alias(name)).distinct()
    return df.join(written(gone, "contaminated"), F.col(quoted(key)).eqNullSafe(F.col(name)), "left_anti")
