import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthmark.llm import hard_negatives as hn


def test_scores_are_exact():
    r = np.random.default_rng(1)
    for dim, top in ((0, 1), (1, 3), (64, 300), (64, 1 << 25), (1500, 1000), (2500, 1 << 22)):
        a, b = (r.integers(-top, top + 1, (n, dim)) for n in (5, 9))
        if dim:
            a[0], b[0], b[1] = top, top, -top
        bound = dim * top * top
        primes = hn.primes_for(dim, bound)
        assert math.prod(primes) > 2 * bound and len(set(primes)) == len(primes)
        want = a.astype(object) @ b.astype(object).T if dim else np.zeros((5, 9))
        assert (hn.scores(hn.residues(a, primes), hn.residues(b, primes), primes) == want).all()


def brute(rows, every=100, positives=5, negatives=10):
    """Rows (vec_id, vector, label) by plain loops."""
    kept = [(k, [math.floor(256 * float(np.float64(x))) for x in v], label) for k, v, label in rows
            if k is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(k, v, label, n) for n, (k, v, label) in enumerate(kept) if sum(x * x for x in v) < 2 ** 57]
    out = []
    for k, v, label, n in kept:
        if k % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, lab) for i, w, lab, m in kept if m != n and len(w) == len(v)]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            hits = sorted(s for s in scored if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:negatives]
            out += [(k, p, r, i, -ps, -s) for r, (s, i, _) in enumerate(hits, 1)]
    return sorted(out)


def table_of(n=420, dim=6):
    r = np.random.default_rng(2)
    rows = []
    for k in range(n):
        v = (r.normal(size=dim) * 0.4).round(1 if k % 3 else 4)  # rounded ones tie
        rows.append((k, v.tolist(), [0, 0, 0, 1, 2, 3][k % 6]))
    rows += [(1000 + k, rows[100][1], k % 3) for k in range(60)]  # copies of an anchor
    rows += [(2000, [0.0] * dim, 0), (2100, [0.5, 0.25], 1), (2101, [0.5, 0.5], 1), (2102, [0.25, 0.25], 2),
             (2200, [], 1), (2201, [], 1), (2202, [], 2), (2300, [3e4] * dim, 9), (2301, [-3e4] * dim, 9), (2302, [2e4] * dim, 8)]
    odd = [(3000, None, 0), (3100, [1.0] * dim, None), (3200, [float("nan")] + [1.0] * (dim - 1), 0), (None, [1.0] * dim, 0),
           (3300, [None] + [1.0] * (dim - 1), 0), (3400, [float("inf")] + [1.0] * (dim - 1), 0), (3500, [1e300] * dim, 0)]
    return rows + odd + [rows[200], rows[200]]  # repeated rows


@pytest.mark.parametrize("anchors,rows", [(512, 4096), (2, 37)])
def test_equals_brute_force(spark, monkeypatch, anchors, rows):
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    monkeypatch.setattr(hn, "ROWS", rows)
    data = table_of()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").select(
        "*", *[F.lit(-1).alias(c) for c in ("row", "id", "dim", "score", "other", "anchor")])
    got = hn.hard_negatives(df.repartition(4))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(data)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hn.hard_negatives(df).count() == 0
