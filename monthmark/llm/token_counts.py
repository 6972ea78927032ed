"""Token counts: exact number of BPE tokens at every prefix of a text.

For a piece of text the prefix table is filled from left to right. The encoding of a prefix
ends in exactly one token t for which the encoding of what stands before, ending in token s,
stays as it is when t follows (the pair s, t encodes to itself). So
`count(prefix) = count(prefix without t) + 1`, and no prefix is ever encoded again. Where the
pre-tokenizer's decision depends on what follows (runs of white space, contractions, special
strings) the table holds the count of the prefix as if the text ended there.

The table is kept as differences of two bytes for each code point, from which truncation and
budget questions are answered by a running sum.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, compress
from operator import sub

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthmark.llm.common import by_bytes, quoted
from monthmark.llm.units import pieces, unit

#: Entries of a worker's cache, characters of a pre-token filled together with others, and
#: how many of them at once. They bound memory only.
KEPT_ENTRIES, KEPT_LENGTH, BATCH = 500_000, 48, 20_000

#: Multiplier of the hash by which substrings are looked up among the tokens.
BASE = np.uint64(0x9E3779B97F4A7C15)

_SPACE = re.compile(r"\s")

_COUNTERS: dict[str, PrefixCounter] = {}


def byte_alphabet() -> dict[int, str]:
    """Printable character of every byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class PrefixCounter:
    """Prefix tables for one byte-level BPE file (vocabulary, merges, added tokens)."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = set(spec["model"]["vocab"])
        self.names = sorted(self.vocab)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" "))
                  for m in spec["model"]["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.split: dict[str, tuple[str, str]] = {}
        for m in merges:
            self.split.setdefault(m[0] + m[1], m)
        self.rank_of = {name: self.rank[m] for name, m in self.split.items()}
        self.unmerged = len(merges) + 1
        self.longest = max(map(len, self.vocab))
        self.letters = byte_alphabet()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = special
        self.special_pattern = regex.compile(
            "|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.inside = {self.letters[b] for b in range(0x80, 0xC0)}  # not the first byte of a character
        to_byte = {c: b for b, c in self.letters.items()}
        by_length: dict[int, list[tuple[int, int]]] = {}
        for number, name in enumerate(self.names):
            if all(c in to_byte for c in name):
                h = 0
                for c in name:
                    h = (h * int(BASE) + to_byte[c] + 1) & (1 << 64) - 1
                by_length.setdefault(len(name), []).append((h, number))
        self.by_length = {n: (np.array([h for h, _ in x], np.uint64), np.array([k for _, k in x]))
                          for n, x in ((n, sorted(x)) for n, x in by_length.items())}
        # Most substrings are no token: one bit for the top of each hash tells so at once.
        self.maybe = np.zeros(1 << 20, bool)
        for hashes, _ in self.by_length.values():
            self.maybe[hashes >> np.uint64(44)] = True
        self.pair_keys, self.pair_ok = np.full(1, ~np.uint64(0)), np.zeros(1, bool)
        self.steps: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def _fits(self, last: str, token: str) -> bool:
        """Whether both tokens stay as they are side by side, `last` being "" at the start.

        Merges are undone at the seam, the latest first. Had the two parts now touching been
        a merge due before the one just undone, the seam would have closed then. Of equal
        merges the left one is due first.
        """
        if not last:
            return True
        due = self.unmerged
        while self.rank.get((last, token), self.unmerged) >= due:
            a, b = self.rank_of.get(last, -1), self.rank_of.get(token, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                due, last = a, self.split[last][1]
            else:
                due, token = b + 1, self.split[token][0]
        return False

    def piece(self, s: str) -> list[int]:
        """Token counts of all prefixes of one pre-token, given in byte letters."""
        last, count = [""], [0]
        for i in range(1, len(s) + 1):
            for n in range(min(i, self.longest), 0, -1):
                token = s[i - n:i]
                if token in self.vocab and self._fits(last[i - n], token):
                    last.append(token)
                    count.append(count[i - n] + 1)
                    break
            else:
                raise ValueError("no token ends a piece")
        return count[1:]

    def _of_piece(self, text: str) -> list[int] | tuple:
        """Counts at the code points of one pre-token."""
        if text.isascii():
            return self.piece(text.translate(self.letters))
        letters = text.encode().decode("latin-1").translate(self.letters)
        ends = [c not in self.inside for c in letters[1:]] + [True]
        return list(compress(self.piece(letters), ends))

    def _pairs_fit(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """`_fits` for arrays of token numbers; -1 stands for the start."""
        keys = ((last + 1).astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        known = self.pair_keys[at] == keys
        if not known.all():
            new = np.unique(keys[~known])
            ok = [self._fits(self.names[(k >> 32) - 1] if k >> 32 else "", self.names[k & 0xFFFFFFFF])
                  for k in new.tolist()]
            place = np.searchsorted(self.pair_keys, new)
            self.pair_keys = np.insert(self.pair_keys, place, new)
            self.pair_ok = np.insert(self.pair_ok, place, ok)
            at = np.searchsorted(self.pair_keys, keys)
        return self.pair_ok[at]

    def learn(self, pre_tokens: list[str]) -> None:
        """Keep the tables of many pre-tokens, filled column by column for all of them at once."""
        raw = [t.encode() for t in pre_tokens]
        order = sorted(range(len(raw)), key=lambda k: -len(raw[k]))
        raw = [raw[k] for k in order]
        size = np.array([len(r) for r in raw])
        n_rows, width = len(raw), int(size[0])
        grid = np.zeros((n_rows, width + 1), np.uint8)
        grid[np.arange(width + 1) < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
        # Hash of every prefix; that of bytes i-n..i is at[i] - at[i - n] * BASE**n.
        at = np.zeros((width + 1, n_rows), np.uint64)
        for i in range(1, width + 1):
            at[i] = at[i - 1] * BASE + grid[:, i - 1] + np.uint64(1)
        last = np.full((width + 1, n_rows), -1, np.int64)
        count = np.zeros((width + 1, n_rows), np.int16)
        power = [np.uint64(pow(int(BASE), n, 1 << 64)) for n in range(width + 1)]
        for i in range(1, width + 1):
            open_rows = np.arange(int(np.searchsorted(-size, -i, side="right")))
            for n in range(i, 0, -1):
                if n not in self.by_length or not len(open_rows):
                    continue
                hashes, numbers = self.by_length[n]
                wanted = at[i, open_rows] - at[i - n, open_rows] * power[n]
                hit = np.flatnonzero(self.maybe[wanted >> np.uint64(44)])
                if not len(hit):
                    continue
                wanted = wanted[hit]
                place = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
                same = hashes[place] == wanted
                hit, place = hit[same], place[same]
                rows, token = open_rows[hit], numbers[place]
                fits = self._pairs_fit(last[i - n, rows], token)
                rows = rows[fits]
                last[i, rows] = token[fits]
                count[i, rows] = count[i - n, rows] + 1
                open_rows = np.delete(open_rows, hit[fits])
            if len(open_rows):
                raise ValueError("no token ends a piece")
        # Only positions at the end of a code point count.
        ends = (np.arange(1, width + 1) <= size[:, None]) & ((grid[:, 1:] & 0xC0) != 0x80)
        flat = count[1:].T[ends]
        steps = np.diff(flat, prepend=np.int16(0))
        stops = np.cumsum(ends.sum(axis=1))
        starts = np.concatenate([[0], stops[:-1]])
        steps[starts] = flat[starts]
        data = steps.astype("<i2").tobytes()
        for k, a, b in zip(order, starts.tolist(), stops.tolist()):
            self.steps[pre_tokens[k]] = data[2 * a:2 * b]

    def _steps(self, pre_token: str) -> bytes:
        counts = self._of_piece(pre_token)
        return array("h", map(sub, counts, chain((0,), counts))).tobytes()

    def plain(self, text: str) -> list[int]:
        """Counts at all code points of a text in which special strings are ordinary text."""
        out: list[int] = []
        base, before, space = 0, 0, ""
        for m in self.pattern.finditer(text):
            t = m.group()
            counts = list(self._of_piece(t))
            if t in ("'re", "'ve", "'ll"):  # cut in two, the quote and the letter stand apart
                counts[1] = counts[0] + self._of_piece(t[1])[-1]
            here = [base + c for c in counts]
            if space and t[0].isspace():  # the run up to here would be one piece
                here[0] = before + self._of_piece(space + t[0])[-1]
            out += here
            space = t if t.isspace() else ""
            before, base = base, base + counts[-1]
        return out

    def prefixes(self, text: str) -> list[int]:
        """Counts at all code points of any text."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return self.plain(text)
        out: list[int] = []
        base = at = 0
        for m in self.special_pattern.finditer(text):
            head = text[at:m.start()]
            counts = self.plain(head + m.group()[:-1])
            base_here = base + (counts[len(head) - 1] if head else 0) + 1
            out += [base + c for c in counts] + [base_here]
            base, at = base_here, m.end()
        return out + [base + c for c in self.plain(text[at:])]

    def deltas(self, texts: list[str]) -> list[bytes]:
        """For each whole text the differences of its prefix counts, two bytes a code point."""
        cut = [pieces(t) for t in texts]
        if len(self.inner) > KEPT_ENTRIES:
            self.inner, self.steps = {}, {}
        inner = self.inner
        found = [list(map(inner.get, rest)) for _, rest in cut]
        unknown = [i for i, f in enumerate(found) if None in f]
        self._keep({k for i in unknown for k, f in zip(cut[i][1], found[i]) if f is None})
        for i in unknown:
            found[i] = map(inner.__getitem__, cut[i][1])
        return [self._differences(first) + b"".join(f) for (first, _), f in zip(cut, found)]

    def _keep(self, keys: set[str]) -> None:
        steps, plain, new = self.steps, [], set()
        for key in keys:
            text = unit(key)
            if self._tricky(text):
                self.inner[key] = self._differences(text)
            else:
                plain.append((key, found := self.pattern.findall(text)))
                new.update(t for t in found if t not in steps)
        short = [t for t in new if len(t) <= KEPT_LENGTH]
        for a in range(0, len(short), BATCH):
            self.learn(short[a:a + BATCH])
        for t in new:
            if t not in steps:
                steps[t] = self._steps(t)
        for key, found in plain:
            self.inner[key] = b"".join(map(steps.__getitem__, found))

    def _tricky(self, text: str) -> bool:
        """White space after the start, quotes and special strings look beyond their piece."""
        return "'" in text or _SPACE.search(text, 1) is not None or any(s in text for s in self.special)

    def _differences(self, text: str) -> bytes:
        if not self._tricky(text):
            return b"".join(self.steps.get(t) or self._steps(t) for t in self.pattern.findall(text))
        counts = self.prefixes(text)
        return array("h", map(sub, counts, chain((0,), counts))).tobytes()


def counter(path: str) -> PrefixCounter:
    """One counter for each worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def counts_of(deltas: bytes) -> np.ndarray:
    """Token count of every prefix: element k is that of the first k code points."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(deltas, dtype="<i2"), dtype=np.int64)])


def longest_within(deltas: bytes, limit: int) -> int:
    """Code points of the longest prefix of at most `limit` tokens (-1: not even the empty one)."""
    fits = np.flatnonzero(counts_of(deltas) <= limit)
    return int(fits[-1]) if len(fits) else -1


def prefix_token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                        limit: int = 1024, keep_prefixes: bool = False) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, fit_chars[, prefix_deltas]) for each row.

    `fit_chars` is the code points of the longest prefix within `limit` tokens;
    `prefix_deltas` the whole prefix table (see `counts_of`). A null text counts as empty: no
    bytes, no tokens. Rows with equal or null keys are kept as they are. Other columns are
    not read.
    """
    schema = (f"{quoted(key)} {df.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, "
              "over_limit boolean, fit_chars long" + (", prefix_deltas binary" if keep_prefixes else ""))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        of = counter(path)
        for whole in batches:
            for batch in by_bytes(whole, 1):
                tokens, fit, tables = [], [], []
                for table in of.deltas([t or "" for t in batch.column(1).to_pylist()]):
                    n = int(np.frombuffer(table, dtype="<i2").sum(dtype=np.int64))
                    tokens.append(n)
                    fit.append(longest_within(table, limit) if n > limit else len(table) // 2)
                    if keep_prefixes:
                        tables.append(table)
                size = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
                n_tokens = pa.array(tokens, pa.int64())
                columns = [batch.column(0), size, n_tokens, pc.greater(n_tokens, limit),
                           pa.array(fit, pa.int64())]
                names = [key, "n_bytes", "n_tokens", "over_limit", "fit_chars"]
                if keep_prefixes:
                    columns.append(pa.array(tables, pa.binary()))
                    names.append("prefix_deltas")
                yield pa.RecordBatch.from_arrays(columns, names)

    chosen = df.select(F.col(quoted(key)), F.col(quoted(text)).alias("_text" if key != "_text" else "_t"))
    return chosen.mapInArrow(run, schema)
