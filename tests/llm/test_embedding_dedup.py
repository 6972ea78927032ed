import numpy as np
import pytest
from pyspark.sql import functions as F

from monthmark.llm.embedding_dedup import Block, near_vectors, quantised, tile_links, unit_rows
from tests.llm.helpers import groups_of


def vectors(n=160, d=24):
    r = np.random.default_rng(4)
    base = r.normal(size=(n, d))
    rows = [(i, base[i].tolist()) for i in range(n)]
    for i in range(40):  # around the limit, far above it, and copies
        rows.append((1000 + i, (base[i % 8] + r.normal(size=d) * (0.05 + 0.01 * i)).tolist()))
        rows.append((2000 + i, (base[20] * (i + 1) + r.normal(size=d) * 1e-3).tolist()))
        rows.append((3000 + i, base[i // 10].tolist()))
    return rows


def brute(rows):
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    c = x @ x.T >= 0.95
    np.fill_diagonal(c, False)
    ids = [k for k, _ in rows]
    groups = groups_of(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(c))])
    return dict(zip(ids, c.sum(axis=1))), groups


ODD = [(5001, None), (5002, []), (5003, [0.0] * 24), (5004, [float("nan")] + [1.0] * 23), (5005, [float("inf")] + [1.0] * 23),
       (5006, [None] + [1.0] * 23), (5007, [1.0, 2.0]), (5008, [2.0, 4.0]), (5009, [1e300, 2e300]), (5010, [1e-320, 2e-320]), (None, [1.0, 2.0])]


@pytest.mark.parametrize("tile", [4096, 50])
def test_links_equal_brute_force(spark, tile):
    rows = vectors()
    n, groups = brute(rows)
    df = spark.createDataFrame(rows + ODD, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("label"), F.lit(1).alias("id"))
    got = near_vectors(df, tile=tile).collect()
    assert len(got) == len(rows) + len(ODD)
    for r in got:
        k = r["vec_id"]
        if k in groups:
            assert (r["n_links"], r["component_id"], r["kept"]) == (n[k], groups[k], groups[k] == k), k
        elif k in (5007, 5008, 5009, 5010):
            assert r["n_links"] == 3 and r["component_id"] == 5007
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, k, True)


def test_empty_and_bad_limit(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(df).count() == 0
    with pytest.raises(ValueError):
        near_vectors(df, limit=0)


def block(x):
    u = unit_rows(x)
    q, s, e = quantised(u)
    return Block(np.arange(len(x)).tobytes(), np.ones(len(x), np.int64).tobytes(), u.tobytes(), q.tobytes(), s.tobytes(), e.tobytes()), u


@pytest.mark.parametrize("limit", [0.2, 0.9, 0.95, 1.0])
def test_bounds_lose_and_add_nothing(limit):
    r = np.random.default_rng(2)
    centre = r.normal(size=16)
    a, u = block(centre + r.normal(size=(700, 16)) * 0.4)
    b, v = block(centre + r.normal(size=(300, 16)) * 0.4)
    found = {(int(i), int(j)) for rr, cc in tile_links(a, b, limit, False) for i, j in zip(rr, cc)}
    assert found == set(zip(*map(lambda z: z.tolist(), np.nonzero(np.einsum("id,jd->ij", u, v) >= limit))))


def test_pairs_of_blocks_are_not_shuffled(spark, monkeypatch):
    """Blocks meet where their files are read: a shuffle of pairs would grow with the square of the vectors."""
    from monthmark.llm import embedding_dedup as module

    plans, plain = {}, module.written
    monkeypatch.setattr(module, "written", lambda df, name: plans.update(
        {name: df._jdf.queryExecution().executedPlan().toString()}) or plain(df, name))
    rows = vectors(60)
    n, groups = brute(rows)
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=20).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {k: (n[k], groups[k]) for k in groups}
    assert "Exchange" not in plans["tile-links"] and "CartesianProduct" in plans["tile-links"]


def test_floats_are_linked_in_double_precision(spark):
    rows = [(k, np.float32(v).tolist()) for k, v in vectors(80)]
    n, groups = brute(rows)
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), tile=30).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {k: (n[k], groups[k]) for k in groups}


def test_links_of_many_tiles_are_summed():
    from monthmark.llm.embedding_dedup import _merged

    parts = [([5, 9], [1, 1], [5, 5]), ([9, 7], [2, 2], [7, 7]), ([1, 2], [3, 3], [1, 1])]
    ids, n, other = _merged([tuple(np.array(x) for x in p) for p in parts])
    assert dict(zip(ids.tolist(), n.tolist())) == {5: 1, 9: 3, 7: 2, 1: 3, 2: 3}
    label = dict(zip(ids.tolist(), other.tolist()))
    assert label[5] == label[9] == label[7] and label[1] == label[2] != label[5]
