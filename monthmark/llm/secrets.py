"""Secret scans: one automaton pass finds keywords, expressions are tried only at its hits.

The Aho-Corasick automaton holds the keywords of all kinds and, for long hexadecimal runs,
all groups of four hexadecimal digits: a run of 32 digits cannot avoid them, prose rarely
has one. A kind's expression is anchored at a hit and never searches. Kinds whose tokens
carry a checksum are kept only if it is right.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmark.llm.common import by_bytes, quoted

# The expressions, alphabets and lengths of the kinds.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
HEX_DIGITS = "0123456789abcdef"
HEX_GROUP = 4


def _crc_base62(text: str) -> bool:
    """Thirty characters followed by their CRC-32 in six base-62 digits."""
    body, tail = text[4:34], text[34:40]
    crc, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, r = divmod(crc, 62)
        digits = BASE62[r] + digits
    return digits == tail


def _base58_check(text: str) -> bool:
    """Base 58 of a payload and the first four bytes of its double SHA-256."""
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    try:
        raw = n.to_bytes(82, "big")
    except OverflowError:
        return False
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


#: Kind: keywords in lower case, anchored expression, test of a match. Order breaks ties.
KINDS: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"),
               re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                          r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII),
               lambda m: len(m[2]) >= 8),
    "access": (("akia",), re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": ((), re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
               re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: _crc_base62(m[0])),
    "npm": (("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: _crc_base62(m[0])),
    "xprv": (("xprv",), re.compile(f"xprv[{BASE58}]{{107}}(?![{BASE58}])"),
             lambda m: _base58_check(m[0])),
}
BASE_KINDS = ("assign", "access", "hex")
CHECKED_KINDS = ("github", "npm", "xprv")

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_AUTOMATON = None


def automaton():
    """Keyword and hexadecimal groups with the kind each belongs to; one for each worker."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, (words, _, _) in KINDS.items():
            for w in words:
                a.add_word(w, (kind, len(w)))
        for digits in product(HEX_DIGITS, repeat=HEX_GROUP):
            a.add_word("".join(digits), ("hex", HEX_GROUP))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of a text, by start and order of kinds.

    For each kind the matches are those of a search from left to right without overlaps, of
    which the ones that fail its test are then dropped.
    """
    low = text.lower()
    if len(low) != len(text):  # some letters grow when lowered
        low = text.translate(_LOWER)
    done = dict.fromkeys(KINDS, 0)
    out = []
    for last, (kind, n) in automaton().iter(low):
        start = last + 1 - n
        if start < done[kind]:
            continue
        _, pattern, good = KINDS[kind]
        m = pattern.match(text, start)
        if m:
            done[kind] = m.end()
            if good(m):
                out.append((kind, start, m.end()))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): spans is an array of (kind, start, end) in code points, end exclusive.

    A null text counts as empty and has no spans. Rows with equal or null keys are kept.
    Texts are scanned whole. Other columns are not read.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in by_bytes(whole, 1):
                found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t)] if t else []
                         for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["_key", "spans"])

    chosen = df.select(F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_text"))
    schema = (f"_key {df.schema[key].dataType.simpleString()}, "
              "spans array<struct<kind:string,start:bigint,end:bigint>>")
    return chosen.mapInArrow(run, schema).withColumnRenamed("_key", key)


def joined(spans: Column) -> Column:
    """`kind:start:end`, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind, hash of the base spans and all spans of `scan_secrets` as text."""
    spans = F.col("spans")
    count = lambda kinds: F.size(F.filter(spans, lambda s: s["kind"].isin(*kinds))).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return scanned.select(
        F.col(quoted(key)), *[count([k]).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"),
        count(CHECKED_KINDS).alias("n_checked"))
