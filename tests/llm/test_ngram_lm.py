import math
import zlib
from collections import Counter

from monthmark.llm.ngram_lm import discounts, score_texts
from tests.llm.helpers import docs_of, prose

ROWS = [(i, prose(i, 60, 25)) for i in range(60)] + [(100, None), (101, ""), (102, "New UNSEEN words here"), (103, prose(1, 9000, 25)),
                                                      (5, prose(5, 60, 25)), (None, "w1 w2")]


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in low.replace("\t", " ").split(" ") if w] + [0]


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2


def test_scores_equal_a_plain_model(spark):
    train = [tokens(t) for k, t in ROWS if not held(k)]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([1, *t[:-1]], t))
    before, total, follow = Counter(w for _, w in pairs), Counter(), {}
    for (u, _), n in pairs.items():
        total[u] += n
        follow.setdefault(u, [0, 0, 0])[min(n, 3) - 1] += 1
    tops = lambda x: [sum(n == k for n in x.values()) for k in (1, 2, 3, 4)]
    d, e = discounts(tops(pairs)), discounts(tops(before))
    less = lambda n, d: max(n - (0, *d)[min(n, 3)], 0)
    n_all, v, t = sum(c.values()), len(c), len(pairs)
    spread = sum(e[min(n, 3) - 1] for n in before.values()) / t / (v + 1)
    low = lambda w: less(before[w], e) / t + spread

    def p(w, u):
        if not total[u]:
            return low(w)
        return (less(pairs[u, w], d) + sum(a * b for a, b in zip(d, follow[u])) * low(w)) / total[u]

    assert math.isclose(sum(low(w) for w in c) + low("new"), 1)
    assert math.isclose(sum(p(w, b"w3") for w in c) + p("new", b"w3"), 1)
    texts = {k: x for k, x in ROWS}
    got = score_texts(docs_of(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        w = tokens(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(r["doc_id"]), len(w), n_all)
        assert r["n_known"] == sum(c[x] > 0 for x in w)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n_all + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(x, u)) for u, x in zip([1, *w[:-1]], w)), rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    assert score_texts(docs_of(spark, [])).count() == 0
    alone = next(i for i in range(100) if held(i))
    r = score_texts(docs_of(spark, [(alone, "a b")])).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)
