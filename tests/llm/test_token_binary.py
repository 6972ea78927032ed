import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from monthmark.llm import token_binary  # noqa: E402
from monthmark.llm.token_binary import (encoder, pack, ranks_of, read_shard, read_token_files, token_files,  # noqa: E402
                                        unpack, write_shard, write_token_files)
from tests.llm.helpers import docs_of, prose  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_coding_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        v = (r.integers(0, 1 << 32, n) >> r.integers(0, 32, n)).astype(np.uint32)
        data = b"xyz" + pack(v)
        back, end = unpack(data, 3, n)
        assert (back == v).all() and end == len(data)
    edge = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint32)
    assert (unpack(pack(edge), 0, len(edge))[0] == edge).all()
    assert len(pack(edge)) == 2 + 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4


def test_shard_round_trip():
    keys, lengths, ranks = read_shard(write_shard([3, None, -7], np.array([2, 0, 1]), np.array([5, 300, 70000])))
    assert keys == [3, None, -7] and lengths.tolist() == [2, 0, 1] and ranks.tolist() == [5, 300, 70000]


def test_encoder_equals_library():
    of = encoder(PATH)
    texts = ["", " a", "one two\nthree  four", "tab\tinside word", "<|endoftext|> x", "a   b", "é è\n\nü", "zero​width x"]
    for t, ids in zip(texts, of.encode(texts, of.kind)):
        assert np.frombuffer(ids, of.kind).tolist() == of.library.encode(t, add_special_tokens=False).ids


def test_a_full_cache_keeps_units_met_again(monkeypatch):
    monkeypatch.setattr(token_binary, "KEPT_ENTRIES", 60)
    of = token_binary.UnitEncoder(PATH)
    for k in range(40):
        texts = [f"{k} common words, again. " + " ".join(f"u{k}x{j}" for j in range(15)), f"first{k}", f"one{k}\ntwo"]
        for t, ids in zip(texts, of.encode(texts, of.kind)):
            assert np.frombuffer(ids, of.kind).tolist() == of.library.encode(t, add_special_tokens=False).ids
        assert len(of.kept) + len(of.first) <= 60 + 40
        assert k == 0 or {"common", "words,", "again."} <= of.kept.keys()
    for k in range(100):  # texts of one unit each fill the other part of the cache
        of.encode([f"alone{k}"], of.kind)
        assert len(of.first) <= 61
    busy = [f"b{j}" for j in range(90)]
    for _ in range(3):  # more units in use than fit
        assert np.frombuffer(of.encode(["x " + " ".join(busy)], of.kind)[0], of.kind).tolist() == \
            of.library.encode("x " + " ".join(busy), add_special_tokens=False).ids


def test_a_worker_has_few_texts_in_hand(spark, tmp_path, monkeypatch):
    seen, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = token_binary.written

    def noted(df, kind):
        seen.append(int(spark.conf.get(name)))
        return held(df, kind)

    monkeypatch.setattr(token_binary, "written", noted)
    before = spark.conf.get(name)
    rows = [(k, "w " * (k % 7)) for k in range(2 * token_binary.BATCH_ROWS + 5)]
    write_token_files(docs_of(spark, rows), PATH, str(tmp_path / "t"))
    assert seen == [token_binary.BATCH_ROWS] and spark.conf.get(name) == before
    assert read_token_files(spark, str(tmp_path / "t")).count() == len(rows)


def test_files(spark, tmp_path):
    rows = [(9, "later text"), (-4, None), (2, ""), (5, "same text"), (5, "same text"), (None, "no key"), (7, prose(1, 30000)),
            *[(100 + k, prose(k, 50)) for k in range(40)]]
    got = token_files(docs_of(spark, rows), PATH).collect()
    assert len(got) == len(rows)
    lib = encoder(PATH).library
    ids = {}
    for k, t in rows:
        ids.setdefault(k, []).append(lib.encode(t or "", add_special_tokens=False).ids + [2])
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        want = ids[r["doc_id"]][0]
        assert (r["start"], r["n_tokens"]) == (start, len(want))
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    write_token_files(docs_of(spark, rows), PATH, str(tmp_path / "t"), end_id=70000)  # needs four bytes
    back = read_token_files(spark, str(tmp_path / "t"), keep_ids=True).where("doc_id = 9").first()
    assert np.frombuffer(back["ids"], "<u4").tolist() == ids[9][0][:-1] + [70000]
    ranks = spark.read.parquet(str(tmp_path / "t/ranks")).orderBy("rank").collect()
    assert ranks[0]["rank"] == 0 and len({r["id"] for r in ranks}) == len(ranks)


def test_empty_table(spark):
    assert token_files(docs_of(spark, []), PATH).count() == 0


def test_ranks_are_by_frequency(spark):
    counts = np.zeros(10, np.int64)
    counts[[3, 5, 8]] = 2, 7, 2
    df = spark.createDataFrame([(bytearray(counts.tobytes()),), (bytearray(counts.tobytes()),), (None,)], "counts binary")
    assert ranks_of(df).tolist() == [5, 3, 8]


def test_units_are_looked_up_whole():
    import pyarrow as pa

    r = np.random.default_rng(3)
    names = ["a", "a\0", "\0", "\0\0", "é" * 11, "é" * 12, "x" * 23, "x" * 24, "x" * 25, "x" * 22 + "y", "", "日本" * 20]
    names += ["".join(chr(97 + c) for c in r.integers(0, 4, n)) for n in r.integers(1, 40, 200_000)]
    names = list(dict.fromkeys(names))
    known, others = names[::2], names[1::2]
    of = token_binary.UnitTable()
    for a in range(0, len(known), 30_000):
        part = known[a:a + 30_000]
        of.add(pa.array(part, pa.large_string()), np.arange(a, a + len(part)))
    assert len(of) == len(known) and of.keys() == set(known)
    assert of.find(pa.array(known, pa.large_string())).tolist() == list(range(len(known)))
    assert (of.find(pa.array(others, pa.large_string())) == -1).all()
    assert of.find(pa.array(names, pa.large_string()).slice(1, 3)).tolist() == [-1, 1, -1]
    assert of.find(pa.array([], pa.large_string())).tolist() == []


def test_encoder_equals_library_on_odd_units():
    of = token_binary.UnitEncoder(PATH)
    texts = ["x word, y", "a \0, b", "a \0 b \0\0 c", "q it's, it'll. don't! '", "w <|endoftext|>, a<|endoftext|>. <|endoftext|", "s |> a|> b>",
             "m " + "z" * 30 + " " + "z" * 31 + ", " + "z" * 30, "d 12, x_ y_. __ é, ñ### 日本。 日本, ²,", "e é, ‍, a‍.",
             "k " + "," * 9 + " a" + "," * 8 + " b" + "." * 9 + " c###%%%$$$", "\n", " ", "", "  a", "a  b", "a\n b", "t\n\nu,\nv.\nw, x",
             "o \x0b, p\x1c, q\x85."]
    for _ in range(2):  # new units, then known ones
        for t, ids in zip(texts, of.encode(texts, of.kind)):
            assert np.frombuffer(ids, of.kind).tolist() == of.library.encode(t, add_special_tokens=False).ids, t


def test_words_that_differ_in_marks_are_encoded_once(monkeypatch):
    of, seen = token_binary.UnitEncoder(PATH), []
    plain = of.library

    class Noted:
        def __getattr__(self, name):
            return getattr(plain, name)

        def encode_batch_fast(self, texts, **how):
            seen.extend(w for t in texts for w in t.split())
            return plain.encode_batch_fast(texts, **how)

    monkeypatch.setattr(of, "library", Noted())
    text = "x " + " ".join(f"{w}{m}" for w in ("aneses", "thblere") for m in ("", ",", "###", "%%%", ")", '."'))
    assert np.frombuffer(of.encode([text], of.kind)[0], of.kind).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert sorted(seen) == ["aneses", "thblere"]
