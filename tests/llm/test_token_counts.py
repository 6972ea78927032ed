import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from monthmark.llm.token_counts import counter, counts_of, longest_within, prefix_token_counts  # noqa: E402
from tests.llm.helpers import docs_of  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def encoded(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


ODD = ["", " ", "  a", "a  b", "it's we're they'll 've 'r", "x<|endoftext|>y <|endoftext|>", "\n\n a\n b\t\n c",
       "ab  c　 d", "a" * 300, "=" * 200, "日本語 テスト é", "a\r\n\r\nb  ", "x   <|endoftext|>  <|end",
       "1234 5 6'7''re're", "tail \n", "​ zero"]


@pytest.mark.parametrize("text", ODD)
def test_every_prefix_is_exact(library, text):
    table = counter(PATH).deltas([text])[0]
    assert counts_of(table).tolist() == [encoded(library, text[:k]) for k in range(len(text) + 1)]


def test_random_texts(library):
    r = random.Random(3)
    letters = " \n\t'realvs<|>.1é日endoftext "
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(30))) for _ in range(300)]
    for text, table in zip(texts, counter(PATH).deltas(texts)):
        assert counts_of(table).tolist() == [encoded(library, text[:k]) for k in range(len(text) + 1)]


def test_truncation(library):
    text = "Reading and writing, reading and writing again. " * 20
    table = counter(PATH).deltas([text])[0]
    cut = longest_within(table, 50)
    assert encoded(library, text[:cut]) <= 50 < encoded(library, text[:cut + 1])
    assert longest_within(table, 0) == 0 and longest_within(table, 10 ** 6) == len(text)


def test_rows(spark, library):
    long = "many words of a very long text " * 6000
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "no key"), (4, long), (5, "é" * 2000)]
    got = prefix_token_counts(docs_of(spark, rows), PATH, keep_prefixes=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t or "" for k, t in rows if k == r["doc_id"])
        n = encoded(library, text)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)
        assert counts_of(r["prefix_deltas"])[-1] == n and encoded(library, text[:r["fit_chars"]]) <= 1024
    assert prefix_token_counts(docs_of(spark, []), PATH).count() == 0
