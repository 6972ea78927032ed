import numpy as np

from monthmark.llm.components import components
from monthmark.llm.near_dedup import cells_of, dart_signatures, near_duplicates, without_near_duplicates
from tests.llm.helpers import docs_of, edited, groups_of, prose, shingles, similarity


def corpus():
    rows = [(i, prose(i, 120)) for i in range(40)]
    n = 100
    for i in range(0, 12):  # near copies, exact copies, and chains of edits
        base = rows[i][1]
        rows += [(n, base), (n + 1, edited(base, n, 0.015)), (n + 2, base.upper())]
        chain = base
        for k in range(4):
            chain = edited(chain, 1000 * n + k, 0.012)
            rows.append((n + 3 + k, chain))
        n += 10
    rows += [(900 + i, edited(prose(77, 300), i, 0.008)) for i in range(40)]  # a group with a common origin
    rows += [(500, None), (501, ""), (502, ""), (503, "two words"), (504, "two  words"), (505, "a b c d e"), (506, "a b c d e f"),
             (507, "a b c d e f g h i j"), (None, "no key"), (None, "no key"), (3, prose(3, 120)), (508, prose(5, 9000)), (509, prose(5, 9000)),
             (510, "the same " * 500), (511, "the same " * 480)]
    return rows


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows if k is not None]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and similarity(x, y) >= 0.8]
    return groups_of({k for k, _ in sets}, [p for p in links if p[0] != p[1]])


def test_classes_equal_brute_force(spark):
    rows = corpus()
    got = near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        k = r["doc_id"]
        assert r["class_id"] == (want[k] if k is not None else None), k
        assert r["kept"] == (k is None or want[k] == k)


def test_keys_with_several_texts_keep_all_links(spark):
    rows = []
    for i in range(12):  # key i has three texts, each with a copy or near copy under another key
        texts = [prose(3000 + 3 * i + k, 90) for k in range(3)]
        rows += [(i, t) for t in texts] + [(100 + 3 * i, texts[0]), (101 + 3 * i, edited(texts[1], i, 0.012)), (102 + 3 * i, edited(texts[2], i, 0.012))]
    rows += [(5, None), (7, prose(3000, 90))]  # the last one connects two keys
    want = brute(rows)
    got = near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want and len(set(want.values())) == 11
    assert all(r["class_id"] == want[r["doc_id"]] and r["kept"] == (r["class_id"] == r["doc_id"]) for r in got)


def test_one_of_each_group_stays(spark):
    rows = corpus()
    df = docs_of(spark, rows)
    out = without_near_duplicates(df)
    assert out.columns == df.columns
    want = brute(rows)
    assert sorted(r["doc_id"] for r in out.where("doc_id is not null").collect()) == sorted({k for k, _ in rows if k is not None and want[k] == k})
    assert out.where("doc_id is null").count() == 2


def test_empty(spark):
    assert near_duplicates(docs_of(spark, [])).count() == 0
    assert [r["kept"] for r in near_duplicates(docs_of(spark, [(1, None)])).collect()] == [True]


def test_signatures_estimate_weighted_similarity():
    base = prose(1, 400)
    texts = [base, edited(base, 2, 0.02), edited(base, 3, 0.1), base + " " + base, "a b c d e f"]
    of, cell = cells_of([t.encode() for t in texts])
    sign = dart_signatures(of, cell, len(texts), 2000)
    assert (sign != 0).all()
    for i in range(len(texts)):
        for j in range(i):
            true = similarity(shingles(texts[i]), shingles(texts[j]))
            assert abs((sign[i] == sign[j]).mean() - true) < 0.05
    assert np.array_equal(sign, dart_signatures(of, cell, len(texts), 2000))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (200, 200), (70, 75), (75, 72)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = groups_of({x for p in links for x in p if p[0] != p[1]}, [p for p in links if p[0] != p[1]])
    assert got == want


def test_repeated_rows_stay_once(spark):
    rows = [(4, prose(9, 60)), (2, prose(9, 60)), (2, prose(9, 60)), (2, prose(9, 60)), (3, prose(8, 60)), (3, prose(7, 60)), (None, "x"), (None, "x"),
            (5, None), (5, None), (6, "")]
    df = docs_of(spark, rows)
    out = without_near_duplicates(df)
    assert out.columns == df.columns
    want = [(2, prose(9, 60)), (3, prose(8, 60)), (3, prose(7, 60)), (None, "x"), (None, "x"), (5, None), (6, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)
    assert without_near_duplicates(docs_of(spark, [])).count() == 0
