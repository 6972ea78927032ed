"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark.

Words are known by 64-bit hashes. The model is a set of files of sorted arrays, cut into
shards that grow in number with the corpus:

  words   hashes of the training tokens in order (a token's number is its place over all
          shards), their counts, and for each number how many different tokens precede it
          and how many follow it once, twice, and more often
  pairs   codes (number of the first) * (V + 1) + (number of the second) in order, and their
          counts; V stands for the start of a text. A pair's shard comes from a hash of its code,
          so pairs of a frequent word spread over all shards

Tasks count before they shuffle. Nothing but the list of files and a few sums reaches the
driver; workers map the files and look tokens up by binary search. V is below 2**32.

The score of a text is the sum over its tokens w after u of log10 of
  P(w|u) = max(c(uw) - D(c(uw)), 0) / c(u) + gamma(u) * P1(w)
  P1(w)  = max(p(w) - D'(p(w)), 0) / T + gamma' / (V + 1)
with p the number of different predecessors, T their sum, and modified Kneser-Ney discounts
for counts 1, 2 and 3 or more on both levels. All unknown tokens share one place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmark.llm.arrays import forget, from_planes, in_planes, mapped, save_array
from monthmark.llm.common import by_bytes, quoted
from monthmark.sources.staging import scratch_path

#: Bytes of text for each shard; pairs and distinct words held by a task before they are
#: counted and sent on; entries of a worker's cache. They bound memory only.
SHARD_BYTES, HELD_PAIRS, HELD_WORDS, KEPT_ENTRIES = 24 << 20, 3_000_000, 1_000_000, 600_000

#: Stands for the end of a text among the words. No word holds a space.
END = b" end"

MIX = np.uint64(0x9E3779B97F4A7C15)

_NUMBERS: dict[str, dict[bytes, int]] = {}


@dataclass
class Model:
    folder: str
    shards: int
    offsets: list[int] = field(default_factory=list)   # first number of each shard, and V
    hashes: list[str] = field(default_factory=list)
    counts: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    stats: list[str] = field(default_factory=list)
    tokens: int = 0
    texts: int = 0
    pair_types: int = 0
    discounts: tuple[float, float, float] = (0.5, 0.5, 0.5)
    low_discounts: tuple[float, float, float] = (0.5, 0.5, 0.5)
    low_gamma: float = 1.0

    @property
    def size(self) -> int:
        return self.offsets[-1]


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text between ASCII white space, A-Z in lower case, and the end."""
    return [*text.lower().split(), END]


def hash_of(words: Iterable[bytes], n: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, n)


def _range_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _pair_shard(codes: np.ndarray, shards: int) -> np.ndarray:
    return _range_shard(codes * MIX ^ (codes >> np.uint64(29)), shards)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values of each."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *[np.add.reduceat(v[order], first) for v in values]


def _batch(rows: dict, schema):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict(rows, schema)


def _blobs(keys: np.ndarray, values: list[np.ndarray], shard: np.ndarray, shards: int, kind: int = 0):
    """Sorted keys as differences and their values, one row for each shard."""
    import pyarrow as pa

    schema = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary())]
                       + [(f"v{i}", pa.binary()) for i in range(len(values))])
    order = np.argsort(shard.astype(np.uint32), kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
    for s in range(shards):
        part = order[cuts[s]:cuts[s + 1]]
        if len(part):
            steps = np.diff(keys[part], prepend=np.uint64(0))
            row = {"shard": [s], "kind": [kind], "keys": [in_planes(steps)]}
            row |= {f"v{i}": [in_planes(v[part].astype("<u8"))] for i, v in enumerate(values)}
            yield _batch(row, schema)


BLOB = "shard int, kind int, keys binary, "


def _by_shard(blobs: DataFrame, run, schema: str) -> DataFrame:
    """run(shard, rows of its blobs) for each shard; yields result batches."""
    names = blobs.columns

    def each(batches: Iterable) -> Iterator:
        now, rows = None, []
        for batch in batches:
            for row in zip(*[batch.column(i) for i in range(len(names))]):
                shard = row[0].as_py()
                if shard != now and rows:
                    yield run(now, rows)
                    rows = []
                now = shard
                rows.append(tuple(x.as_py() for x in row[1:]))
        if rows:
            yield run(now, rows)

    return blobs.repartition("shard").sortWithinPartitions("shard").mapInArrow(each, schema)


def _decoded(rows: list[tuple], n_values: int) -> list[np.ndarray]:
    keys = [np.cumsum(from_planes(r[1], "<u8"), dtype=np.uint64) for r in rows]
    values = [[from_planes(r[2 + i], "<u8") for r in rows] for i in range(n_values)]
    if not rows:
        return [np.zeros(0, np.uint64)] * (1 + n_values)
    return [np.concatenate(keys), *map(np.concatenate, values)]


def _small(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16
                         else np.uint32 if top < 1 << 32 else np.uint64)


def _texts(batches: Iterable, column: int) -> Iterator:
    import pyarrow as pa

    for whole in batches:
        for batch in by_bytes(whole, column, 6 << 20):
            yield batch, [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _count_words(texts: DataFrame, model: Model) -> list:
    import pyarrow as pa

    shards, folder = model.shards, model.folder

    def count(batches: Iterable) -> Iterator:
        held: Counter = Counter()

        def sent():
            hashes = hash_of(held, len(held))
            keys, n = _summed(hashes, np.fromiter(held.values(), np.uint64, len(held)))
            return _blobs(keys, [n], _range_shard(keys, shards), shards)

        for _, batch in _texts(batches, 0):
            for text in batch:
                held.update(words_of(text))
            if len(held) > HELD_WORDS:
                yield from sent()
                held.clear()
        yield from sent()

    def merge(shard: int, rows: list[tuple]):
        keys, n = _summed(*_decoded(rows, 1))
        return _batch({"shard": [shard], "hashes": [save_array(folder, "hashes", keys)],
                       "counts": [save_array(folder, "counts", _small(n))], "n": [len(keys)],
                       "total": [int(n.sum())]},
                      pa.schema([("shard", pa.int32()), ("hashes", pa.string()), ("counts", pa.string()),
                                 ("n", pa.int64()), ("total", pa.int64())]))

    blobs = texts.mapInArrow(count, BLOB + "v0 binary")
    # One row for each shard.
    return _by_shard(blobs, merge, "shard int, hashes string, counts string, n long, total long").collect()


def numbers(model: Model, words: list[bytes]) -> np.ndarray:
    """Numbers of the words, -1 for unknown ones."""
    if model.folder not in _NUMBERS:
        _NUMBERS.clear()
        _NUMBERS[model.folder] = {}
    known = _NUMBERS[model.folder]
    if len(known) > KEPT_ENTRIES:
        known.clear()
    new = [w for w in set(words) if w not in known]
    if new:
        hashes = hash_of(new, len(new))
        found = np.full(len(new), -1, np.int64)
        shard = _range_shard(hashes, model.shards)
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s)
            table = mapped(model.hashes[s]) if model.hashes[s] else np.zeros(0, np.uint64)
            if len(table):
                place = np.minimum(np.searchsorted(table, hashes[at]), len(table) - 1)
                found[at] = np.where(table[place] == hashes[at], place + model.offsets[s], -1)
        known.update(zip(new, found.tolist()))
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _numbered(model: Model, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of all tokens, of the tokens before them, first token of each text)."""
    split = [words_of(t) for t in batch]
    starts = np.cumsum([0, *map(len, split)])[:-1]
    w = numbers(model, [x for words in split for x in words])
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[starts] = model.size
    return w, u, starts


def _count_pairs(texts: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """Pair files of all shards: rows of files and sums, and of statistics by word."""
    import pyarrow as pa

    shards, folder, base = model.shards, model.folder, np.uint64(model.size + 1)

    def count(batches: Iterable) -> Iterator:
        forget(folder)
        held: list[np.ndarray] = []

        def sent():
            codes = np.concatenate(held) if held else np.zeros(0, np.uint64)
            codes.sort()
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else []
            n = np.diff(np.append(first, len(codes))).astype(np.uint64)
            codes = codes[first] if len(codes) else codes
            return _blobs(codes, [n], _pair_shard(codes, shards), shards)

        for _, batch in _texts(batches, 0):
            w, u, _ = _numbered(model, batch)
            held.append(u.astype(np.uint64) * base + w.astype(np.uint64))
            if sum(map(len, held)) > HELD_PAIRS:
                yield from sent()
                held = []
        yield from sent()

    def merge(shard: int, rows: list[tuple]):
        codes, n = _summed(*_decoded(rows, 1))
        u, w = codes // base, codes % base
        one, two = n == 1, n == 2
        contexts = _summed(u, one.astype(np.uint64), two.astype(np.uint64), (n > 2).astype(np.uint64))
        followers = _summed(w, np.ones(len(w), np.uint64))
        tops = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        return _batch(
            {"shard": [shard], "codes": [save_array(folder, "codes", codes)],
             "n": [save_array(folder, "n", _small(n))],
             "contexts": [[save_array(folder, f"context{i}", a) for i, a in enumerate(contexts)]],
             "followers": [[save_array(folder, f"follower{i}", a) for i, a in enumerate(followers)]],
             "types": [len(codes)], "tops": [tops]},
            pa.schema([("shard", pa.int32()), ("codes", pa.string()), ("n", pa.string()),
                       ("contexts", pa.list_(pa.string())), ("followers", pa.list_(pa.string())),
                       ("types", pa.int64()), ("tops", pa.list_(pa.int64()))]))

    blobs = texts.mapInArrow(count, BLOB + "v0 binary")
    return _by_shard(blobs, merge, "shard int, codes string, n string, contexts array<string>, "
                                   "followers array<string>, types long, tops array<long>").collect()


def _word_statistics(spark, model: Model, pair_rows: list) -> list:
    """For each shard of words its slice of what all pair files say about them."""
    import pyarrow as pa

    folder, offsets = model.folder, model.offsets
    parts = [(list(r["contexts"]), list(r["followers"])) for r in pair_rows]

    def gather(batches: Iterable) -> Iterator:
        forget(folder)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                lo, hi = offsets[s], offsets[s + 1] + (s == model.shards - 1)  # the start comes last
                out = np.zeros((4, hi - lo), np.uint64)
                for contexts, followers in parts:
                    for names, rows in ((followers, (0,)), (contexts, (1, 2, 3))):
                        keys = mapped(names[0])
                        a, b = np.searchsorted(keys, np.array([lo, hi], np.uint64))
                        at = (keys[a:b] - np.uint64(lo)).astype(np.int64)
                        for row, name in zip(rows, names[1:]):
                            out[row, at] += mapped(name)[a:b]
                preceded = out[0]
                tops = [int((preceded == k).sum()) for k in (1, 2, 3, 4)]
                yield _batch({"shard": [s], "stats": [save_array(folder, "stats", out.T.astype(np.uint64).reshape(-1))],
                              "tops": [tops]},
                             pa.schema([("shard", pa.int32()), ("stats", pa.string()),
                                        ("tops", pa.list_(pa.int64()))]))

    tasks = spark.range(model.shards, numPartitions=model.shards).select(F.col("id").cast("int").alias("shard"))
    return tasks.mapInArrow(gather, "shard int, stats string, tops array<long>").collect()


def discounts(tops: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many types occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = tops
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * b / a if a else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.01), 0.99 * k) for k, d in enumerate(raw, 1))


def train(texts: DataFrame) -> Model:
    """Count a model over the only column of `texts`; nulls are empty texts."""
    spark = texts.sparkSession
    texts = texts.toDF("text")
    size, n = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    model = Model(scratch_path(spark, "ngrams"), max(4, -(-(size or 0) // SHARD_BYTES)), texts=n)
    found = {r["shard"]: r for r in _count_words(texts, model)}
    model.hashes = [found[s]["hashes"] if s in found else "" for s in range(model.shards)]
    model.counts = [found[s]["counts"] if s in found else "" for s in range(model.shards)]
    sizes = [found[s]["n"] if s in found else 0 for s in range(model.shards)]
    model.offsets = [0, *np.cumsum(sizes).tolist()]
    model.tokens = sum(r["total"] for r in found.values())
    if model.size >= (1 << 32) - 1:
        raise ValueError("more than 2**32 - 2 distinct words")
    pairs = _count_pairs(texts, model)
    of = {r["shard"]: r for r in pairs}
    model.pairs = [(of[s]["codes"], of[s]["n"]) if s in of else ("", "") for s in range(model.shards)]
    model.pair_types = sum(r["types"] for r in pairs)
    model.discounts = discounts([sum(r["tops"][k] for r in pairs) for k in range(4)])
    stats = {r["shard"]: r for r in _word_statistics(spark, model, pairs)}
    model.stats = [stats[s]["stats"] for s in range(model.shards)]
    tops = [sum(r["tops"][k] for r in stats.values()) for k in range(4)]
    model.low_discounts = discounts(tops)
    if model.pair_types:
        d1, d2, d3 = model.low_discounts
        more = model.size - tops[0] - tops[1]
        model.low_gamma = (d1 * tops[0] + d2 * tops[1] + d3 * more) / model.pair_types
    return model


def _discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)], 0.0)


def _per_word(model: Model, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, statistics in four columns) of numbers, zero for -1; the start counts texts."""
    count, stats = np.zeros(len(w), np.float64), np.zeros((len(w), 4), np.float64)
    order = np.argsort(w, kind="stable")
    cuts = np.searchsorted(w[order], [0, *model.offsets[1:-1], model.size + 1])
    for s in range(model.shards):
        at = order[cuts[s]:cuts[s + 1]]
        if len(at):
            place = w[at] - model.offsets[s]
            stats[at] = mapped(model.stats[s]).reshape(-1, 4)[place]
            real = w[at] < model.size
            if real.any():
                count[at[real]] = mapped(model.counts[s])[place[real]]
            count[at[~real]] = model.texts
    return count, stats


def _pair_counts(model: Model, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros(len(w), np.float64)
    known = np.flatnonzero((u >= 0) & (w >= 0))
    codes = u[known].astype(np.uint64) * np.uint64(model.size + 1) + w[known].astype(np.uint64)
    shard = _pair_shard(codes, model.shards)
    order = np.lexsort((codes, shard))
    cuts = np.searchsorted(shard[order], np.arange(model.shards + 1, dtype=np.uint64))
    for s in range(model.shards):
        at = order[cuts[s]:cuts[s + 1]]
        if len(at) and model.pairs[s][0]:
            table, n = mapped(model.pairs[s][0]), mapped(model.pairs[s][1])
            place = np.minimum(np.searchsorted(table, codes[at]), len(table) - 1)
            out[known[at]] = np.where(table[place] == codes[at], n[place], 0)
    return out


def log_probabilities(model: Model, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 P(w|u), training count of w) of tokens given by number."""
    # Each distinct number is looked up once.
    distinct, at = np.unique(np.concatenate([w, u]), return_inverse=True)
    counts, stats = _per_word(model, distinct)
    at_w, at_u = at[:len(w)], at[len(w):]
    spread = model.low_gamma / (model.size + 1)
    low = _discounted(stats[:, 0], model.low_discounts) / max(model.pair_types, 1) + spread
    total = counts[at_u]
    gamma = (stats[:, 1:] @ np.array(model.discounts))[at_u]
    n = _pair_counts(model, u, w)
    seen = total > 0
    high = np.divide(_discounted(n, model.discounts) + gamma * low[at_w], total, where=seen,
                     out=np.zeros(len(w)))
    followed = seen & (gamma > 0)
    return np.log10(np.where(followed, high, low[at_w])), counts[at_w]


def in_training(key: Column) -> Column:
    """Whether a row is for learning; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    The model learns from the rows that are not held out; both scores are sums of log10 over
    all tokens. A null text counts as empty and has one token, its end. Without training rows
    every token has probability 1 / (V + 1) = 1. Rows with equal or null keys are kept.
    """
    chosen = df.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"),
                       (~in_training(F.col(quoted(key)))).alias("held_out"))
    model = train(chosen.where(~F.col("held_out")).select("text"))
    unseen = np.log10(model.tokens + model.size + 1)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        forget(model.folder)
        for batch, texts in _texts(batches, 1):
            w, u, starts = _numbered(model, texts)
            score, counts = log_probabilities(model, w, u)
            n = np.diff(np.append(starts, len(w)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                 pa.array(np.full(len(n), model.tokens)),
                 pa.array(np.add.reduceat(np.log10(counts + 1) - unseen, starts)),
                 pa.array(np.add.reduceat(score, starts))],
                ["_key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = (f"_key {df.schema[key].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, "
              "train_tokens long, base_score double, score double")
    return chosen.select("key", "text", "held_out").mapInArrow(run, schema).withColumnRenamed("_key", key)
