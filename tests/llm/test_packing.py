import random
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from monthmark.llm.packing import pack_documents, plan_slots, sequences  # noqa: E402
from monthmark.llm.token_binary import encoder  # noqa: E402
from tests.llm.helpers import docs_of, prose  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(lengths, size):
    """Number of sequences of best-fit decreasing, piece by piece."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= n
        else:
            room.append(size - n)
    return len(room)


@pytest.mark.parametrize("seed,size,n", [(1, 20, 300), (2, 64, 500), (3, 7, 200), (4, 1, 5), (5, 100, 1)])
def test_plan_is_best_fit(seed, size, n):
    r = random.Random(seed)
    lengths = [r.choice([size, r.randint(1, size), 1 + size // 3]) for _ in range(n)]
    counts = Counter(lengths)
    filled, ranks = {}, Counter()
    for length, rank, seqs, pieces, first, at in plan_slots(counts, size):
        assert rank == ranks[length] and seqs > 0 and pieces > 0
        ranks[length] += seqs * pieces
        for s in range(first, first + seqs):
            assert filled.get(s, 0) == at
            filled[s] = at + pieces * length
            assert filled[s] <= size
    assert ranks == counts and sorted(filled) == list(range(len(filled)))
    assert len(filled) == best_fit(lengths, size)


def test_plan_grows_with_lengths_not_counts():
    counts = {n: 10 ** 9 + 7 * n for n in range(1, 1025)}
    plan = plan_slots(counts, 1024)
    assert sum(e[2] * e[3] for e in plan) == sum(counts.values()) and len(plan) < 20_000


def test_pieces(spark):
    rows = [(9, prose(1, 900)), (-4, None), (2, ""), (5, "same text"), (5, "same text"), (None, "no key"), (7, prose(2, 30_000)),
            *[(100 + k, prose(k, 3 + k * 7 % 90)) for k in range(150)]]
    size = 128
    packed = pack_documents(docs_of(spark, rows).repartition(6), PATH, size=size)
    got = packed.collect()
    lib = encoder(PATH).library
    want = Counter()
    for k, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % size or size
        cuts = [0, *range(head, len(ids) + 1, size)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(k, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= size
    assert len(places) == best_fit([r["length"] for r in got], size)
    whole = {r["sequence_id"]: r for r in sequences(packed).collect()}
    assert len(whole) == len(places)
    for s, held in places.items():
        assert whole[s]["n_tokens"] * 4 == len(whole[s]["ids"]) == 4 * sum(n for _, n in held)


def test_empty_table_and_bad_size(spark):
    assert pack_documents(docs_of(spark, []), PATH).count() == 0
    with pytest.raises(ValueError):
        pack_documents(docs_of(spark, []), PATH, size=0)


def test_pieces_of_odd_units(spark):
    rows = [(1, "x word, y word### word%%% z"), (2, "a \0, b \0\0. " + "z" * 40 + ", " + "z" * 40), (3, " a<|endoftext|>, é.\n\nß!")]
    got = pack_documents(docs_of(spark, rows).coalesce(1), PATH).collect()
    lib = encoder(PATH).library
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == {
        k: lib.encode(t, add_special_tokens=False).ids + [2] for k, t in rows}
