"""Cutting a text at places where a byte-level BPE always starts a new piece.

The pre-tokenizer never looks back, and a single space (or line feed) in front of a
non-space always opens a piece. Units cut there can be encoded on their own and joined, so
a worker keeps the result of each distinct unit instead of encoding a word again and again.
"""

from __future__ import annotations

import re

import numpy as np

#: At a unit's end behind a letter or digit these are a piece of their own. A quote could be part of a contraction.
MARKS = ".,;:!?#$%&*+-/=@^~_()[]{}<>|\\`\""

_UNSAFE = re.compile(r"[ \n](?:\s|\Z)")
#: The same for Arrow, whose \s is ASCII only.
_UNSAFE_ARROW = (r"[ \n](?:[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
                 r"|\z)")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> tuple[str, list[str]]:
    """(first unit, keys of the other units); see `unit` for what a key stands for."""
    if _UNSAFE.search(text):
        first, *rest = _SAFE_SPACE.split(text)
    else:
        first, *rest = text.replace("\n", " \n").split(" ")
    return first, rest


def unit(key: str) -> str:
    """The characters a key stands for: a line start holds its own separator."""
    return key if key[:1] == "\n" else " " + key


def split_units(texts: list[str]):
    """(order, keys, ends): the keys of all texts as one Arrow array, a text's keys up to its end.

    The n-th run of keys belongs to texts[order[n]]; its first key is the text's first unit.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    whole = pa.array(texts, pa.large_string())
    unsafe = pc.match_substring_regex(whole, _UNSAFE_ARROW).to_numpy(zero_copy_only=False)
    plain, odd = np.flatnonzero(~unsafe).tolist(), np.flatnonzero(unsafe).tolist()
    lists = []
    if plain:
        lines = pc.replace_substring(whole.take(pa.array(plain)) if odd else whole, "\n", " \n")
        lists.append(pc.split_pattern(lines, " "))
    if odd:
        lists.append(pa.array([[first, *rest] for first, rest in (pieces(texts[i]) for i in odd)],
                              pa.large_list(pa.large_string())))
    ends = np.cumsum(np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists]))
    words = pa.concat_arrays([x.flatten() for x in lists])
    return plain + odd, words, ends.astype(np.int64)


def cut_tails(units, marks: str):
    """(bare units, positions of those that end in marks behind a letter or digit, their marks as numbers).

    Others stay as they are, and so do units with more than eight marks. A number holds the marks' bytes, lowest first.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    bare = pc.ascii_rtrim(units, characters=marks)
    size, rest = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (units, bare))
    at = np.flatnonzero((size > rest) & (size - rest <= 8) & (rest > 0))
    before = pc.utf8_slice_codeunits(bare.take(pa.array(at)), -1).dictionary_encode()
    opens = np.array([c.isalnum() for c in before.dictionary.to_pylist()], bool)
    at = at[opens[before.indices.to_numpy(zero_copy_only=False)]]
    cut = np.zeros(len(units), bool)
    cut[at] = True
    tails = units.take(pa.array(at))
    ends = np.frombuffer(tails.buffers()[1], np.int64, len(at) + 1, 8 * tails.offset)[1:] if len(at) else np.zeros(0, np.int64)
    data = np.frombuffer(tails.buffers()[2], np.uint8) if len(at) else np.zeros(0, np.uint8)
    numbers = np.zeros(len(at), np.uint64)
    long = (size - rest)[at]
    for k in range(8):
        more = np.flatnonzero(long > k)
        numbers[more] |= data[(ends - long)[more] + k].astype(np.uint64) << np.uint64(8 * k)
    return pc.if_else(pa.array(cut), bare, units), at, numbers
