"""Toxicity: a subsequence string-kernel SVM with Nystroem landmarks.

Kernel. A word is its letters between the marks ^ and $; other characters, and the blanks in
runs of single letters, are inserted characters and skipped. Words are compared by all
subsequences of four characters that span at most seven, each weighing DECAY to the power of its
span, divided by the root of the word's squared weights. A sentence's kernel is the sum over
its words.

Training. Sentences carry their document's label; landmarks are the words with the most
distinct use in toxic documents and a share of common others. Sentences are mapped to
K(s, Z) K(Z, Z)^(-1/2) and a linear SVM with squared hinge loss is fitted; then only the
best sentence of each toxic document stays positive and the fit is repeated (toxic documents hold
harmless sentences too).

Scoring. The SVM is linear in the subsequences, so its landmark expansion collapses to one
weight for each subsequence (kept in a hashed table of fixed size), and a word's margin takes one pass over
its characters. A document's score is a logistic function of how many of its words exceed some
margins, their share and the largest margin, fitted on labelled documents that the SVM has not seen.

The fit uses a bounded sample, `Bounds`: so many labelled documents of each class, in hash order,
up to a length. Everything else covers whole texts of all rows.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmark.llm.common import by_bytes, quoted, sole_keeper

#: Subsequence length, longest span, weight of each step, size of the table of weights.
LENGTH, SPAN, DECAY, TABLE_BITS = 4, 7, 0.6, 20

#: Landmarks, rounds of choosing sentences, regularisation.
LANDMARKS, ROUNDS, SVM_C = 256, 3, 0.2

#: Entries of a worker's cache. Bounds memory only.
KEPT_ENTRIES = 600_000

_OFFSETS = [(0, *c) for c in combinations(range(1, SPAN), LENGTH - 1)]
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SPACED = re.compile(r"(?<!\S)\w(?:[\s.*_-]\w){2,}(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)|\n")
_KEPT: dict[int, dict[str, float]] = {}


@dataclass(frozen=True)
class Bounds:
    """Labelled documents of each class used for fitting, and their longest text in characters."""

    toxic: int = 1500
    clean: int = 2500
    longest: int = 6_000


@dataclass(frozen=True)
class Model:
    """Weights of subsequences, margins that are counted, and the logistic function over them."""

    number: int
    weights: np.ndarray | None
    margins: np.ndarray
    logistic: np.ndarray
    constant: float = 0.0


def words_of(text: str) -> list[str]:
    """Lower-case white-space tokens; a run of single characters is one token."""
    low = text.lower()
    if _SPACED.search(low):
        low = _SPACED.sub(lambda m: _NOT_LETTERS.sub("", m[0]), low)
    return low.split()


def sentences_of(text: str) -> list[list[str]]:
    """Letters of the words of each sentence."""
    split = ([c for w in words_of(s) if (c := _NOT_LETTERS.sub("", w))] for s in _SENTENCE.split(text))
    return [s for s in split if s]


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, table place, weight) of all subsequences, one set of gaps at a time."""
    marked = ["^" + _NOT_LETTERS.sub("", w) + "$" for w in words]
    size = np.array([len(w) for w in marked])
    code = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(marked)), size)
    for gaps in _OFFSETS:
        last = gaps[-1]
        n = len(code) - last
        if n <= 0:
            continue
        whole = of[:n] == of[last:]
        h = np.zeros(n, np.uint64)
        for g in gaps:
            h = (h ^ code[g:g + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        yield of[:n][whole], (h[whole] >> np.uint64(64 - TABLE_BITS)).astype(np.int64), DECAY ** (last + 1)


def margins_of(words: list[str], weights: np.ndarray) -> np.ndarray:
    """SVM margins of single words."""
    total, square = np.zeros(len(words)), np.zeros(len(words))
    for of, place, weight in subsequences(words):
        total += np.bincount(of, weights[place], len(words)) * weight
        square += np.bincount(of, minlength=len(words)) * weight ** 2
    return total / np.sqrt(np.maximum(square, DECAY ** (2 * LENGTH)))


def _explicit(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(table places in use, their weights in each landmark)."""
    found = list(subsequences(landmarks))
    places = np.unique(np.concatenate([p for _, p, _ in found]))
    table = np.zeros((len(places), len(landmarks)), np.float32)
    square = np.zeros(len(landmarks))
    for of, place, weight in found:
        np.add.at(table, (np.searchsorted(places, place), of), weight)
        square += np.bincount(of, minlength=len(landmarks)) * weight ** 2
    return places, (table / np.sqrt(np.maximum(square, DECAY ** (2 * LENGTH)))).astype(np.float32)


def _landmark_products(words: list[str], explicit: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Kernel of each word with each landmark."""
    places, table = explicit
    slot = np.full(1 << TABLE_BITS, -1, np.int32)
    slot[places] = np.arange(len(places))
    out = np.zeros((len(words), table.shape[1]), np.float32)
    square = np.zeros(len(words))
    for of, place, weight in subsequences(words):
        square += np.bincount(of, minlength=len(words)) * weight ** 2
        hit = np.flatnonzero(slot[place] >= 0)
        for a in range(0, len(hit), 20_000):
            part = hit[a:a + 20_000]
            rows = of[part]  # in order
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            out[rows[first]] += np.float32(weight) * np.add.reduceat(table[slot[place[part]]], first, axis=0)
    return out / np.sqrt(np.maximum(square, DECAY ** (2 * LENGTH)))[:, None].astype(np.float32)


def _sentence_sums(words: list[str], members: np.ndarray, lengths: np.ndarray, explicit: tuple[np.ndarray, np.ndarray],
                   root: np.ndarray, at_once: int = 20_000) -> np.ndarray:
    """Sum of the mapped words of each sentence, some words at a time: no table of all words is held."""
    x = np.zeros((len(lengths), root.shape[1]), np.float32)
    by_word = np.argsort(members, kind="stable")
    of = np.repeat(np.arange(len(lengths)), lengths)
    for a in range(0, len(words), at_once):
        mapped = _landmark_products(words[a:a + at_once], explicit) @ root
        lo, hi = np.searchsorted(members, [a, a + at_once], sorter=by_word)
        tokens = np.sort(by_word[lo:hi])  # in reading order, so sentences ascend
        for b in range(0, len(tokens), at_once):
            part = tokens[b:b + at_once]
            sentence = of[part]
            first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
            x[sentence[first]] += np.add.reduceat(mapped[members[part] - a], first, axis=0)
    return x


def _landmarks(words: list[str], members: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> list[str]:
    """Words by how much more often toxic documents hold them, and common others.

    members: the words' numbers in reading order, doc: the document of each.
    """
    held = np.unique(doc * len(words) + members)
    bad = np.bincount((held % len(words))[toxic[held // len(words)]], minlength=len(words))
    good = np.bincount(held % len(words), minlength=len(words)) - bad
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    lead = np.sqrt(bad) * np.log((bad / n_bad + 1e-4) / (good / n_good + 1e-4))
    first = sorted(np.flatnonzero(bad).tolist(), key=lambda w: (-lead[w], words[w]))[:3 * LANDMARKS // 4]
    chosen = dict.fromkeys(words[w] for w in first)
    for w in sorted(np.flatnonzero(good).tolist(), key=lambda w: (-good[w], words[w])):
        if len(chosen) == LANDMARKS:
            break
        chosen.setdefault(words[w])
    return list(chosen)


def _svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared hinge loss on some rows of x, by Newton steps over those inside the margin.

    The last value is the bias. Rows are taken a few thousand at a time, so nothing is copied whole.
    """
    n = x.shape[1]
    w = np.zeros(n + 1)
    penalty = np.eye(n + 1)
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        gram, pull = penalty.copy(), np.zeros(n + 1)
        for a in range(0, len(rows), 4096):
            part = np.ones((min(4096, len(rows) - a), n + 1))
            part[:, :n] = x[rows[a:a + 4096]]
            tag, c = y[a:a + 4096], SVM_C * weight[a:a + 4096]
            inside = tag * (part @ w) < 1
            part, tag, c = part[inside], tag[inside], c[inside]
            gram += (part.T * c) @ part
            pull += part.T @ (c * tag)
        new = np.linalg.solve(gram, pull)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _pooled(margins: np.ndarray, levels: np.ndarray) -> np.ndarray:
    n = len(margins)
    if not n:
        return np.zeros(2 * len(levels) + 1)
    over = (margins[:, None] > levels).sum(axis=0)
    return np.array([margins.max(), *np.log1p(over), *np.sqrt(100 * over / (n + 20))])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(means, scales, coefficients, bias) in one array, by penalised Newton steps."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([0.1] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(penalty + (z.T * np.maximum(p * (1 - p), 1e-6)) @ z, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return np.concatenate([mean, scale, w])


def fit(texts: list[str], toxic: np.ndarray, share: float | None = None) -> Model:
    """A model from labelled texts, of which `share` are toxic where the sample comes from.

    Without both classes every text gets that share.
    """
    own = float(toxic.mean()) if len(toxic) else 0.0
    share = own if share is None else share
    if len(texts) < 4 or own in (0.0, 1.0):
        return Model(0, None, np.zeros(0), np.zeros(0), share)
    half = np.zeros(len(texts), bool)
    for t in (False, True):  # every other document of each class
        half[np.flatnonzero(toxic == t)[::2]] = True
    learn = np.flatnonzero(half)
    tags = toxic[learn]
    # Words become numbers as they are read; sentences follow each other in one array.
    number: dict[str, int] = {}
    read, lengths, of = array("q"), [], []
    for d, i in enumerate(learn.tolist()):
        for sentence in sentences_of(texts[i]):
            read.extend([number.setdefault(w, len(number)) for w in sentence])
            lengths.append(len(sentence))
            of.append(d)
    if not lengths:
        return Model(0, None, np.zeros(0), np.zeros(0), share)
    words, members = list(number), np.frombuffer(read, np.int64)
    lengths, of = np.array(lengths), np.array(of)
    landmarks = _landmarks(words, members, np.repeat(of, lengths), tags)
    explicit = _explicit(landmarks)
    kernel = _landmark_products(landmarks, explicit).astype(np.float64)
    value, vector = np.linalg.eigh((kernel + kernel.T) / 2)
    root = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    x = _sentence_sums(words, members, lengths, explicit, root.astype(np.float32))
    del number, words
    bad = tags[of]
    positive = bad.copy()
    for _ in range(ROUNDS):
        rows = np.flatnonzero(positive | ~bad)
        y = np.where(positive, 1.0, -1.0)[rows]
        balance = np.where(y > 0, (y < 0).sum() / max(1, (y > 0).sum()), 1.0)
        w = _svm(x, rows, y, np.sqrt(balance))
        score = x @ w[:-1].astype(np.float32) + w[-1]
        best = np.full(len(learn), -np.inf)
        np.maximum.at(best, of, score)
        positive = bad & (score >= best[of])
    weights = np.zeros(1 << TABLE_BITS, np.float32)
    weights[explicit[0]] = explicit[1] @ (root @ w[:-1]).astype(np.float32)
    # The logistic function learns from the other half.
    rest = np.flatnonzero(~half)
    margins = [margins_of(ws, weights) if (ws := words_of(texts[i])) else np.zeros(0) for i in rest]
    top = np.array([m.max() if len(m) else 0.0 for m, t in zip(margins, toxic[rest]) if t])
    scale = max(float(np.quantile(top, 0.5)), 1e-3)
    levels = scale * np.array([0.35, 0.5, 0.65, 0.8])
    logistic = _logistic(np.array([_pooled(m, levels) for m in margins]), toxic[rest].astype(float))
    # The sample holds more toxic texts than its source.
    odds = lambda p: np.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    logistic[-1] += odds(share) - odds(float(toxic[rest].mean()))
    return Model(int(abs(hash(weights.tobytes()))), weights, levels, logistic)


def probability(model: Model, margins: np.ndarray) -> float:
    if model.weights is None:
        return model.constant
    x = _pooled(margins, model.margins)
    n = len(x)
    z = ((x - model.logistic[:n]) / model.logistic[n:2 * n]) @ model.logistic[2 * n:3 * n] + model.logistic[3 * n]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def scores_of(model: Model, texts: list[str]) -> list[float]:
    """Probabilities of whole texts; each distinct word's margin is worked out once."""
    if model.weights is None:
        return [model.constant] * len(texts)
    if model.number not in _KEPT:
        _KEPT.clear()
        _KEPT[model.number] = {}
    kept = _KEPT[model.number]
    if len(kept) > KEPT_ENTRIES:
        kept.clear()
    split = [words_of(t) for t in texts]
    new = list({w for words in split for w in words if w not in kept})
    for a in range(0, len(new), 20_000):
        part = new[a:a + 20_000]
        kept.update(zip(part, margins_of(part, model.weights).tolist()))
    return [probability(model, np.fromiter(map(kept.__getitem__, words), np.float64, len(words)))
            for words in split]


def held_out(key: Column) -> Column:
    """Whether a label may not be learnt from; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, bounds: Bounds, key: str, text: str) -> DataFrame:
    """(text, toxic, share): labelled texts for fitting, at most `bounds.toxic` + `bounds.clean` rows in a fixed
    order, and the share of toxic labels."""
    usable = (docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))
              .where(F.col("text").isNotNull() & (F.length("text") <= bounds.longest) & ~held_out(F.col("key"))))
    tags = (labels.select(F.col(quoted(key)).alias("key"), F.col("toxic").cast("int").alias("toxic"))
            .where(F.col("toxic").isin(0, 1) & F.col("key").isNotNull()).groupBy("key").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("key"))))
    share = tags.agg(F.avg("toxic")).first()[0] or 0.0
    # Labels of usable texts are cut by hash before texts are joined: each of them has a row at least.
    filled = tags.join(usable.select("key").distinct(), "key", "left_semi")
    chosen = [filled.where(F.col("toxic") == t).orderBy(F.xxhash64("key"), "key").limit(n)
              for t, n in ((1, bounds.toxic), (0, bounds.clean))]
    rows = usable.join(F.broadcast(chosen[0].unionByName(chosen[1])), "key")
    picked = [rows.where(F.col("toxic") == t).orderBy(F.xxhash64("key"), "key", "text").limit(n)
              for t, n in ((1, bounds.toxic), (0, bounds.clean))]
    return picked[0].unionByName(picked[1]).select("text", "toxic", F.lit(share).alias("share"))


def sample(docs: DataFrame, labels: DataFrame, bounds: Bounds, key: str, text: str) -> tuple[list, float]:
    """The training rows themselves, and the share of toxic labels."""
    rows = training_rows(docs, labels, bounds, key, text).collect()
    return rows, rows[0]["share"] if rows else 0.0


def fitted(rows: DataFrame) -> Model:
    """The model of a sample, fitted in one task: the sample is bounded, and only weights reach the driver."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        texts, toxic, share = [], [], 0.0
        for batch in batches:
            texts += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
            share = batch.column(2)[0].as_py() if batch.num_rows else share
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(texts, np.array(toxic, bool), share))]},
                                         pa.schema([("model", pa.binary())]))

    # Coalescing keeps the order of the two parts and of their rows.
    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], np.zeros(0, bool))


def _scored(df: DataFrame, labels: DataFrame, key: str, text: str, bounds: Bounds, keep: list[str]) -> DataFrame:
    """(key, held_out, score, predicted, k0, k1, ...) of each row, with the columns to keep."""
    model = fitted(training_rows(df, labels, bounds, key, text))
    names = [f"k{i}" for i in range(len(keep))]
    chosen = df.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"),
                       held_out(F.col(quoted(key))).alias("held_out"),
                       *[F.col(quoted(c)).alias(k) for c, k in zip(keep, names)])

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        sole_keeper("toxicity", _KEPT.clear)
        for whole in batches:
            for batch in by_bytes(whole, 1):
                score = np.array(scores_of(model, [t or "" for t in batch.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(score, pa.float64()),
                     pa.array((score >= 0.5).astype(np.int32)), *batch.columns[3:]],
                    ["key", "held_out", "score", "predicted", *names])

    return chosen.mapInArrow(run, ", ".join([
        f"key {df.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int",
        *[f"{k} {df.schema[c].dataType.simpleString()}" for c, k in zip(keep, names)]]))


def score_toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   bounds: Bounds = Bounds()) -> DataFrame:
    """(key, held_out, score, predicted) for each row.

    `labels` has the key and `toxic` (0, 1; others and nulls are ignored, the larger of several counts).
    Only texts and labels of rows that are not held out are learnt from. Null texts count as empty and are
    scored like texts without a suspicious word. Rows with equal or null keys are kept. Without labels of
    both kinds each score is the share of toxic ones.
    """
    return _scored(df, labels, key, text, bounds, []).withColumnRenamed("key", key)


def without_toxic(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                  bounds: Bounds = Bounds()) -> DataFrame:
    """The rows that are not predicted to be toxic; all columns stay."""
    scored = _scored(df, labels, key, text, bounds, df.columns)
    return scored.where(F.col("predicted") == 0).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(df.columns)])
