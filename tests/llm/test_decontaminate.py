import random

from pyspark.sql import functions as F

from monthmark.llm.decontaminate import PLACE, RADIUS, SIMILAR, benchmark_matches, candidates, close_prints, without_benchmark
from tests.llm.helpers import docs_of, edited, prose, shingles, similarity

ITEMS = [(i, prose(500 + i, 20 + 7 * i)) for i in range(8)] + [(20, "short one"), (21, "a b c d e"), (22, None), (23, ""), (24, "the the " * 10),
                                                               (3, "second text of a repeated item id here"), (30, prose(500, 20))]


def corpus():
    rows = [(i, prose(i, 150)) for i in range(20)]
    for i in range(8):
        t = ITEMS[i][1]
        w = t.split()
        rows += [(100 + i, prose(i, 40) + " " + t.upper() + "\n" + prose(50 + i, 30)), (120 + i, t), (140 + i, t + " tail"),
                 (160 + i, "lead " + " ".join(w[:len(w) // 2] + ["extra"] + w[len(w) // 2:]) + " x y z"),
                 (180 + i, prose(i, 10) + " " + edited(t, i, 0.001) + " " + prose(i, 10)), (200 + i, " ".join(w[:-2])), (220 + i, " ".join(w[2:] + ["q"] * 9)),
                 (240 + i, " ".join(w[: len(w) // 2]))]
    return rows + [(300, None), (301, ""), (302, "a short one here"), (303, "short"), (304, "x a b c d e y"), (305, "the " * 3000), (306, prose(503, 41) * 1),
                   (None, ITEMS[2][1]), (307, ITEMS[1][1]), (307, ITEMS[1][1]), (308, prose(9, 20000) + " " + ITEMS[4][1]),
                   (309, "second text of a repeated item id here"), (310, "the the " * 10)]


def best_window(doc, item):
    w, n = (doc or "").lower().split(), len(item.lower().split())
    width = min(5, n)
    target = shingles(item, width)
    best = 0.0
    for s in range(max(1, len(w) - n + 1)):
        part = w[s:s + n]
        if len(part) >= width:
            best = max(best, similarity(shingles(" ".join(part), width), target))
    return best


def test_matches_equal_brute_force(spark):
    rows = corpus()
    items = spark.createDataFrame(ITEMS, "item_id long, text string").select("*", F.lit(1).alias("doc"), F.lit(2).alias("h"))
    df = docs_of(spark, rows)
    got = {(r["doc_id"], r["item_id"]): r for r in benchmark_matches(df, items).collect()}
    want = {}
    for k, t in rows:
        for i, x in ITEMS:
            if x and t:
                s = best_window(t, x)
                if s >= 0.8:
                    want[k, i] = max(s, want.get((k, i), 0))
    assert set(got) == set(want)
    for k, r in got.items():
        assert abs(r["similarity"] - want[k]) < 1e-12 and r["differing"] <= RADIUS
    clean = without_benchmark(df, items)
    assert clean.columns == df.columns
    gone = {k for k, _ in want}
    assert sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(str(k) for k, _ in rows if k not in gone)
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_reordered_copies_equal_brute_force(spark):
    rows, items = [], []
    for i in range(4):
        w = [f"i{i}w{k}" for k in range(100 - i)]
        if i == 3:
            w[60:80] = w[10:30]  # a passage that the item holds twice
        items.append((i, " ".join(w)))
        lead, tail = prose(i, 80), prose(40 + i, 120)
        moved = {"halves": w[50:] + w[:50], "thirds": w[66:] + w[33:66] + w[:33], "both": w[:5] + ["new"] * 2 + w[5:90] + w[92:],
                 "shifted": ["new"] * 7 + w[:-7], "lost": w[20:] + w[:20][::-1], "twice": w[40:60] + w, "apart": w[:50] + ["far"] * 90 + w[50:],
                 "repeated": (w[10:30] * 6)[:100], "short": w[45:90] + w[:45]}
        for k, part in enumerate(moved.values()):
            rows += [(100 * i + k, f"{lead} {' '.join(part)} {tail}"), (100 * i + 20 + k, " ".join(part)), (100 * i + 40 + k, " ".join(part) + " " + tail)]
    rows += [(900, "y " * 90 + items[0][1]), (900, " ".join(items[0][1].split()[50:] + items[0][1].split()[:50]))]
    got = {(r["doc_id"], r["item_id"]): r for r in benchmark_matches(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for k, t in rows:
        for i, x in items:
            if (s := best_window(t, x)) >= 0.8:
                want[k, i] = max(s, want.get((k, i), 0))
    assert (0, 0) in want and set(got) == set(want)
    text = dict(rows[:-2])
    for (k, i), r in got.items():
        assert abs(r["similarity"] - want[k, i]) < 1e-12
        if k in text:
            w, n = text[k].split(), len(items[i][1].split())
            first = next(s for s in range(max(1, len(w) - n + 1)) if best_window(" ".join(w[s:s + n]), items[i][1]) >= want[k, i] - 1e-12)
            assert r["start"] == first and r["n_words"] == min(n, len(w))


def test_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert benchmark_matches(docs_of(spark, []), items).count() == 0
    none = benchmark_matches(docs_of(spark, [(1, "x")]), items.limit(0))
    assert none.columns == ["doc_id", "item_id", "start", "n_words", "differing", "similarity"] and none.count() == 0
    assert without_benchmark(docs_of(spark, [(1, "x"), (2, None)]), items.where("text is null")).count() == 2


def test_blocks_find_all_prints_within_the_radius(spark):
    rng = random.Random(8)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    marks = [(i, 10 + i % 2, rng.getrandbits(64)) for i in range(12)]
    windows = [(k, 10 + rng.randrange(2), rng.getrandbits(64)) for k in range(300)]
    for k in range(300, 700):
        _, size, base = marks[k % 12]
        for b in rng.sample(range(64), rng.randrange(26)):
            base ^= 1 << b
        windows.append((k, size, base))
    # The hardest case: as many bits in each block as the radius allows.
    hard = sum(0b1111 << (16 * b) for b in range(3)) | 0b1111 << 60
    windows.append((700, marks[0][1], marks[0][2] ^ hard))
    for radius in (0, 7, 19):
        got = close_prints(spark.createDataFrame([(k, s, signed(x)) for k, s, x in windows], "start long, size int, print long"),
                           spark.createDataFrame([(c, s, signed(x)) for c, s, x in marks], "copy long, size int, print long"), ["start"], radius)
        want = {(k, c, d) for k, s, x in windows for c, t, y in marks if s == t and (d := (x ^ y).bit_count()) <= radius}
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        assert radius < 7 or len(want) > 50


def test_prints_reject_most_windows(spark):
    items = [(i, prose(700 + i, 40)) for i in range(6)]
    rows = []
    for i, t in items:
        w = t.split()
        # Passages too short for a match hold anchors all the same.
        rows += [(10 * i + k, " ".join([prose(80 + 10 * i + k, 60), *w[4 * k:4 * k + 8], prose(20 + k, 60)])) for k in range(9)]
        rows.append((10 * i + 9, prose(i, 60) + " " + t + " " + prose(30 + i, 60)))
    found = candidates(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"),
                       "doc_id", "text", "item_id", "text", SIMILAR)
    windows, close = found["windows"].count(), found["close"].select(*PLACE).distinct().count()
    assert windows > 1000 and 0 < close < windows / 5
    assert found["close"].agg(F.max("differing")).first()[0] <= RADIUS
