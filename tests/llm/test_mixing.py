import math

import pytest
from pyspark.sql import functions as F

from monthmark.llm.mixing import mix_sources, mixed_documents
from tests.llm.helpers import docs_of


def shared_out(sizes, weights, share, cap):
    """Targets by resharing the excess until none is above; sizes in source order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_ and rest > 1e-9:
        total = sum(w[i] for i in open_)
        over = {i for i in open_ if rest * w[i] / total > cap * sizes[i]}
        if not over:
            for i in open_:
                target[i] = rest * w[i] / total
            break
        for i in over:
            target[i] = cap * sizes[i]
            rest -= target[i]
        open_ -= over
    return target


def rows():
    out = []
    for s, n in (("a", 300), ("b", 40), ("Z", 120), (None, 60), ("é", 3)):
        out += [(len(out) + i, "w " * (1 + (i * 37) % 90), s) for i in range(n)]
    out += [(10_000, "long " * 30_000, "a"), (10_001, None, "b"), (10_002, "", "only empty"), (None, "no key at all", "b"),
            (5, "w " * 6, "a"), (5, "w " * 6, "a")]
    return out


def test_targets_and_words_taken(spark):
    data = rows()
    got = mix_sources(docs_of(spark, data)).collect()
    assert len(got) == len(data)
    names = sorted({s for *_, s in data if s is not None}, key=lambda s: s.encode()) + [None]
    size = {s: sum(len((t or "").split()) for _, t, x in data if x == s) for s in names}
    want = dict(zip(names, shared_out([size[s] for s in names], (3, 1, 2), 1.5, 2)))
    by_size = {}
    for k, t, s in data:
        by_size[k] = (len((t or "").split()), s)
    taken = dict.fromkeys(names, 0)
    for r in got:
        n, s = by_size[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == size[s] and math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r["taken"] <= 2 * n and r["taken"] == r["copies"] * n
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - want[s]) <= max(100, 0.02 * want[s]), (s, taken[s], want[s])
    again = mix_sources(docs_of(spark, data[::-1]).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_documents_are_repeated(spark):
    df = docs_of(spark, rows())
    out = mixed_documents(df)
    assert out.columns == df.columns
    words = out.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert words > 0
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(df).collect()}
    counted = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(counted.get(k, 0) == n * (3 if k == 5 else 1) for k, n in copies.items() if k not in (5,))


def test_empty_and_bad_arguments(spark):
    assert mix_sources(docs_of(spark, [])).count() == 0
    r = mix_sources(docs_of(spark, [(1, None, None), (2, "", "x")])).collect()
    assert [(x["target"], x["taken"]) for x in r] == [(0.0, 0), (0.0, 0)]
    with pytest.raises(ValueError):
        mix_sources(docs_of(spark, []), cap=1)
