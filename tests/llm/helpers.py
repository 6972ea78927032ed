"""Small tables and plain reference versions for the corpus operators."""

import random
from collections import Counter

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that a careless operator would confuse with its own.
CLASHES = ["key", "size", "score", "h", "v", "ids", "copies", "k0", "class_id", "start", "item_id", "_gone"]


def docs_of(spark, rows, clashes=True):
    """documents from (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, FIELDS)
    if clashes:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(-1).alias(c) for c in CLASHES])
    return df


def prose(seed, n, vocabulary=400):
    """n words drawn at random."""
    r = random.Random(seed)
    words = [f"w{r.randrange(vocabulary)}" for _ in range(n)]
    return " ".join(words)


def edited(text, seed, share=0.02):
    r = random.Random(seed)
    words = text.split()
    for k in r.sample(range(len(words)), max(1, int(share * len(words)))):
        words[k] = f"x{r.randrange(10 ** 6)}"
    return " ".join(words)


def shingles(text, width=5):
    w = (text or "").lower().split()
    if not w:
        return Counter()
    return Counter(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def similarity(a, b):
    shared = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


def groups_of(ids, links):
    """Smallest id reachable from each id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
