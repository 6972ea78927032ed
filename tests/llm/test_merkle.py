import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from monthmark.llm.merkle import folded, merkle_manifest, proof_digest, prove, tamper_check
from tests.llm.helpers import CLASHES, FIELDS


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes, arity):
    """(root, steps of each node), steps as (left, right) digests."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, n in enumerate(at):
            run = n - n % arity
            steps[i].append(("".join(level[run:n]), "".join(level[n + 1:run + arity])))
            at[i] = n // arity
        level = [H(*level[i:i + arity]) for i in range(0, len(level), arity)]
    return (level[0] if level else None), steps


def brute(rows, arity=2):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, members = [], []
    for g in names:
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        members.append(ordered)
        trees.append(tree([leaf_of(r) for r in ordered], arity))
    root, over = tree([t[0] for t in trees], arity)
    out = []
    for (sub, steps), ordered, above in zip(trees, members, over):
        for r, own in zip(ordered, steps):
            path = own + above
            h = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                h = leaf_of((*r[:4], r[4] + 1))
            for a, b in path:
                h = H(a, h, b)
            out.append((r[0], leaf_of(r), sub, root, H(*[a + b for a, b in path]), h, h == root))
    return out


def rows_of(n):
    langs = ["en", "de", None, "", "Zz", "é", "en", "en"]
    return [(k, None if k % 11 == 0 else f"text {k} é" * (k % 5), langs[k % 8], None if k % 13 == 0 else f"s{k % 3}",
             None if k % 9 == 0 else k) for k in range(n)]


ODD = [(None, "no key", "en", "s", 3), (None, None, None, None, None), (5, "again", "en", "s", 1), (6, "lone", "xx", "s", 4),
       (6, "lone", "en", "s", 4), (6, "lone", "en", "s", 4), (7, "long " * 60_000, "en", "s", 300_000), (-8, "", "de", "", 0)]


@pytest.mark.parametrize("levels,arity", [(10, 2), (2, 2), (1, 2), (2, 3)])
def test_proofs_equal_brute_force(spark, levels, arity):
    rows = rows_of(90) + ODD
    df = spark.createDataFrame(rows, FIELDS).select("*", *[F.lit(-1).alias(c) for c in CLASHES + ["g", "h", "pos", "m", "up"]])
    grown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1)
    got = merkle_manifest(df.repartition(5), changed={"n_chars": grown}, arity=arity, levels=levels)
    got = got.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof"),
                     folded(F.coalesce("changed_leaf", "leaf"), F.col("steps")).alias("folded"))
    by = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got.collect()), key=by) == sorted((r[:6] for r in brute(rows, arity)), key=by)


def test_tampered_rows_fail(spark):
    rows = rows_of(60)
    got = {r["doc_id"]: tuple(r) for r in tamper_check(spark.createDataFrame(rows, FIELDS)).collect()}
    want = {r[0]: (*r[:5], *r[5:]) for r in brute(rows)}
    assert got == want
    assert {v[-1] for v in got.values()} == {True, False}


def test_lone_leaf_and_empty_table(spark):
    row = (3, "only", "en", "s", 4)
    got = tamper_check(spark.createDataFrame([row], FIELDS)).collect()
    assert [tuple(r) for r in got] == brute([row]) and got[0]["subroot"] == got[0]["leaf"] == got[0]["root"]
    assert tamper_check(spark.createDataFrame([], FIELDS)).count() == 0


def test_very_large_count_does_not_overflow(spark):
    # crc32("11") is no multiple of 7, so find a key that is.
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 0)
    row = (key, "t", "en", "s", 2 ** 63 - 1)
    assert [tuple(r) for r in tamper_check(spark.createDataFrame([row], FIELDS)).collect()] == brute([row])


def test_bad_arguments(spark):
    df = spark.createDataFrame([(1, "a", "b")], "k long, g string, leaf string")
    with pytest.raises(ValueError):
        prove(df, "k", "g", "leaf", arity=1)
    with pytest.raises(ValueError):
        prove(df, "k", "k", "leaf")
