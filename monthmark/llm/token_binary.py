"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding.

A corpus is encoded once, ids are replaced by their rank of frequency (so common ids need one
byte), and whole documents are packed in ascending key order into shards. A shard is one
binary value, kept in Parquet so that Spark's committer handles lost and repeated tasks:

    b"RVB1", u32 documents, u64 ids, then
    documents bytes (1: key present, 0: null), documents keys as little-endian i64,
    the documents' lengths, then the ids' ranks, each coded as below

A coded list of n values is ceil(n/4) control bytes followed by the data bytes. Every control
byte holds four two-bit lengths minus one (lowest bits first); a value takes one to four
little-endian data bytes. Decoding looks the lengths up in a table of the 256 control bytes.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monthmark.llm.common import by_bytes, chunks, quoted, settle, small_batches, sole_keeper, written
from monthmark.llm.units import MARKS, cut_tails, split_units, unit
from monthmark.sources.staging import scratch_path

MAGIC, HEADER = b"RVB1", struct.Struct("<4sIQ")

#: Ids after which a shard is closed, entries of a worker's cache, bytes and characters of text that a worker has in
#: hand at once, and rows sent to it at once. They bound memory only.
SHARD_IDS, KEPT_ENTRIES, SLICE_BYTES, SLICE_CHARS, BATCH_ROWS = 1 << 20, 600_000, 1 << 21, 1 << 20, 1000

#: Lengths of the four values behind each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1

#: Masks of the lowest 0 to 8 bytes of a number.
LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_ENCODERS: dict[str, UnitEncoder] = {}


def pack(values: np.ndarray) -> bytes:
    """Control bytes and data bytes of unsigned values below 2**32."""
    v = np.ascontiguousarray(values, dtype="<u4")
    size = 1 + (v >= 1 << 8) + (v >= 1 << 16) + (v >= 1 << 24)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[:len(v)] = size - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes() + data.tobytes()


def unpack(buffer: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """(n values, position behind them) of a coded list that starts at `at`."""
    n_control = -(-n // 4)
    control = np.frombuffer(buffer, np.uint8, n_control, at)
    size = LENGTHS[control].reshape(-1)[:n]
    end = np.cumsum(size)
    data = np.frombuffer(buffer, np.uint8, int(end[-1]) if n else 0, at + n_control)
    start = end - size
    out = data[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out, at + n_control + len(data)


def write_shard(keys: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    valid = np.array([k is not None for k in keys], np.uint8)
    ids = np.array([k if k is not None else 0 for k in keys], "<i8")
    return (HEADER.pack(MAGIC, len(keys), len(ranks)) + valid.tobytes() + ids.tobytes()
            + pack(lengths) + pack(ranks))


def read_shard(buffer: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    magic, n_docs, n_ids = HEADER.unpack_from(buffer)
    if magic != MAGIC:
        raise ValueError("not a shard of ranked ids")
    at = HEADER.size
    valid = np.frombuffer(buffer, np.uint8, n_docs, at)
    keys = np.frombuffer(buffer, "<i8", n_docs, at + n_docs)
    lengths, at = unpack(buffer, at + 9 * n_docs, n_docs)
    ranks, _ = unpack(buffer, at, n_ids)
    return [int(k) if ok else None for k, ok in zip(keys, valid)], lengths.astype(np.int64), ranks


class UnitTable:
    """Slots of units, looked up for a whole array of them at once.

    A unit of up to 23 bytes stands as three numbers, its bytes and its length, in open
    addressing; longer ones are looked up by name. Units are compared whole, never by hash alone.
    """

    def __init__(self):
        self.numbers, self.places = np.zeros((1 << 16, 3), np.uint64), np.zeros(1 << 17, np.int32)
        self.long: dict[str, int] = {}
        self.short = 0
        self.odd = np.random.default_rng().integers(0, 1 << 63, 4).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def __len__(self) -> int:
        return self.short + len(self.long)

    def keys(self) -> set[str]:
        rows = self.numbers[self.places[self.places > 0] - 1]
        return {r.tobytes()[:r.tobytes()[-1]].decode() for r in rows} | self.long.keys()

    def slots(self) -> np.ndarray:
        return np.concatenate([self.places[self.places > 0] - 1, np.array(list(self.long.values()), np.int64)])

    def _home(self, numbers: np.ndarray) -> np.ndarray:
        h = numbers[:, 0] * self.odd[0] + numbers[:, 1] * self.odd[1] + numbers[:, 2] * self.odd[2]
        h = (h ^ (h >> np.uint64(32))) * self.odd[3]
        return (h >> np.uint64(65 - len(self.places).bit_length())).astype(np.int64)

    def find(self, units) -> np.ndarray:
        """Slot of each unit of an Arrow array, -1 if it has none."""
        numbers, size = in_numbers(units)
        out = np.full(len(size), -1, np.int64)
        rest = np.flatnonzero(size < 24)
        if len(rest) < len(size):
            far = np.flatnonzero(size > 23)
            out[far] = [self.long.get(k, -1) for k in units.take(far).to_numpy(zero_copy_only=False)]
            numbers = numbers[rest]
        at = self._home(numbers)
        while len(rest):
            here = self.places[at] - 1
            held = self.numbers[here]
            same = (held[:, 0] == numbers[:, 0]) & (held[:, 1] == numbers[:, 1]) & (held[:, 2] == numbers[:, 2]) & (here >= 0)
            out[rest[same]] = here[same]
            on = np.flatnonzero(~same & (here >= 0))
            rest, numbers, at = rest[on], numbers[on], (at[on] + 1) % len(self.places)
        return out

    def add(self, units, slots: np.ndarray) -> None:
        """Give slots, from 0 on, to distinct units that have none."""
        numbers, size = in_numbers(units)
        short = size < 24
        if not short.all():
            far = np.flatnonzero(~short)
            self.long.update(zip(units.take(far).to_numpy(zero_copy_only=False), slots[far].tolist()))
            numbers, slots = numbers[short], slots[short]
        self._place(numbers, slots)

    def _place(self, numbers: np.ndarray, slots: np.ndarray) -> None:
        if not len(slots):
            return
        while slots.max() >= len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
        if 2 * (self.short + len(slots)) > len(self.places):
            old = self.places[self.places > 0].astype(np.int64) - 1
            n = len(self.places)
            while 2 * (self.short + len(slots)) > n:
                n *= 2
            self.places, self.short = np.zeros(n, np.int32), 0
            self._place(self.numbers[old], old)
        self.numbers[slots] = numbers
        self.short += len(slots)
        at = self._home(numbers)
        while len(slots):
            free = np.flatnonzero(self.places[at] == 0)
            self.places[at[free]] = slots[free] + 1
            # Of several units at one place the last stays there.
            on = np.flatnonzero(self.places[at] != slots + 1)
            slots, at = slots[on], (at[on] + 1) % len(self.places)

    def kept_of(self, slots: np.ndarray, slot_of: np.ndarray) -> UnitTable:
        """A table of the units in these slots, `slot_of` giving the new slot of each (-1: left out)."""
        out = UnitTable()
        rows = self.numbers[slots]
        short = rows[:, 2] > 0
        out._place(rows[short], slot_of[slots[short]])
        out.long = {k: int(slot_of[s]) for k, s in self.long.items() if slot_of[s] >= 0}
        return out


def in_numbers(units) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each unit as three numbers, the last holding its length as well; lengths). Of long units only the lengths count."""
    n = len(units)
    offsets = np.frombuffer(units.buffers()[1], np.int64, n + 1, 8 * units.offset) if n else np.zeros(1, np.int64)
    data = np.zeros(int(offsets[-1] - offsets[0]) + 24, np.uint8)
    if len(data) > 24:
        data[:-24] = np.frombuffer(units.buffers()[2], np.uint8, len(data) - 24, int(offsets[0]))
    start, size = offsets[:-1] - offsets[0], np.diff(offsets)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each position on
    out = np.empty((n, 3), np.uint64)
    for k in range(3):
        out[:, k] = eight[start + 8 * k] & LOWEST[np.clip(size - 8 * k, 0, 8)]
    out[:, 2] |= size.astype(np.uint64) << np.uint64(56)
    return out, size


class UnitEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct unit once.

    Words are split, numbered and looked up as arrays, so Python looks at new units only; the
    ids of a unit stand in one growing array and are gathered by position. A full cache keeps the
    units it has met again.
    """

    def __init__(self, path: str):
        # Spark already runs one worker a core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        names = self.library.get_vocab(with_added_tokens=True)
        #: Two bytes an id where the vocabulary allows it.
        self.kind = np.dtype(id_kind(max(names.values()) + 1))
        # Tokens that start with a space or a line feed, in byte letters.
        self.opens = np.zeros(max(names.values()) + 1, bool)
        for name, number in names.items():
            self.opens[number] = name[0] in "\u0120\u010A"
        #: Marks that are in no added token, which may stand across pieces.
        inside = "".join(t.content for t in self.library.get_added_tokens_decoder().values())
        self.marks = "".join(m for m in MARKS if m not in inside)
        self.first: dict[str, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        self.kept, self.tails, self.slots = UnitTable(), {}, 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.again = np.zeros(1 << 16, bool)
        self.flat, self.used = np.zeros(1 << 18, self.kind), 0

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New slots for units whose ids stand one behind the other."""
        n, m = self.slots, len(sizes)
        while n + m > len(self.start):
            self.start, self.size, self.again = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.again))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[n:n + m] = self.used + np.cumsum(sizes) - sizes
        self.size[n:n + m] = sizes
        self.used += len(ids)
        self.slots += m
        return np.arange(n, n + m)

    def _trim(self) -> None:
        """Let go of the units not met since they came or were last spared; of all, if those left would crowd the cache."""
        spared = np.sort(self.kept.slots())
        spared = spared[self.again[spared]]
        if len(spared) > KEPT_ENTRIES * 3 // 4:
            spared = spared[:0]
        slot_of = np.full(self.slots, -1, np.int64)
        slot_of[spared] = np.arange(len(spared))
        kept, ids, sizes = self.kept.kept_of(spared, slot_of), self._of(spared), self.size[spared]
        self.first = {}
        self._clear()
        self._keep(ids, sizes)
        self.kept = kept

    def _of(self, slots: np.ndarray) -> np.ndarray:
        """Ids of the units in these slots, one behind the other."""
        size = self.size[slots]
        upto = np.cumsum(size)
        return self.flat[np.repeat(self.start[slots] - (upto - size), size) + np.arange(size.sum())]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)

    def _start(self, text: str) -> bytes:
        ids = self.first.get(text)
        if ids is None:
            ids = self._ids(text).tobytes() if text else b""
            if len(text) < 64:
                self.first[text] = ids
        return ids

    def encode(self, texts: list[str], kind: np.dtype) -> list[bytes]:
        """For each text its ids as little-endian numbers of `kind`."""
        if kind != self.kind:
            return [np.frombuffer(i, self.kind).astype(kind).tobytes() for i in self.encode(texts, self.kind)]
        if not texts:
            return []
        if len(self.kept) + len(self.first) > KEPT_ENTRIES:
            self._trim()
        order, words, ends = split_units(texts)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        # The first unit of a text has no separator in front; it counts as empty here.
        opening = np.concatenate([[0], ends[:-1]])
        used = np.ones(len(codes), bool)
        used[opening] = False
        wanted = np.zeros(len(coded.dictionary), bool)
        wanted[codes[used]] = True
        slot = np.zeros(len(wanted), np.int64)
        at = np.flatnonzero(wanted)
        units = coded.dictionary.take(at)
        found = self.kept.find(units)
        missing = np.flatnonzero(found < 0)
        self.again[found[found >= 0]] = True
        if len(missing):
            found[missing] = self._learn(units.take(missing))
        slot[at] = found
        of = slot[codes]
        size = np.where(used, self.size[of], 0)
        upto = np.cumsum(size)
        source = np.repeat(self.start[of] - (upto - size), size) + np.arange(upto[-1])
        data, width = self.flat[source].tobytes(), self.kind.itemsize
        heads = words.take(opening).to_pylist()
        stops = (upto[ends - 1] * width).tolist()
        out: list[bytes] = [b""] * len(texts)
        before = 0
        for i, head, stop in zip(order, heads, stops):
            out[i] = self._start(head) + data[before:stop]
            before = stop
        return out

    def _learn(self, units) -> np.ndarray:
        """Slots of new units. Marks behind a letter or digit open a piece, so words that differ in them share their ids."""
        bare, tailed, tails = cut_tails(units, self.marks)
        coded = bare.dictionary_encode()
        slots = self.kept.find(coded.dictionary)
        new = np.flatnonzero(slots < 0)
        if len(new):
            names = coded.dictionary.take(new)
            order, ids, sizes = self._encode_units(names.to_numpy(zero_copy_only=False).tolist())
            slots[new[order]] = self._keep(ids, sizes)
            self.kept.add(names, slots[new])
        out = slots[coded.indices.to_numpy(zero_copy_only=False)]
        if len(tailed):
            numbers, which = np.unique(tails, return_inverse=True)
            for t in numbers.tolist():
                if t not in self.tails:
                    ids = self._ids(t.to_bytes(8, "little").rstrip(b"\0").decode())
                    self.tails[t] = int(self._keep(ids, np.array([len(ids)]))[0])
            both = np.stack([out[tailed], np.array([self.tails[t] for t in numbers.tolist()])[which]], axis=1)
            # The bare word was met, and may be again without the mark.
            self.again[both[:, 0]] = True
            out[tailed] = self._keep(self._of(both.reshape(-1)), self.size[both].sum(axis=1))
            self.kept.add(units.take(tailed), out[tailed])
        return out

    def _encode_units(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, sizes): the n-th run of ids belongs to keys[order[n]]."""
        # Units open pieces, so many of them are encoded as one text and taken apart again.
        opened = np.array([k[:1] == "\n" for k in keys], bool)
        spaced, plain, others, done = np.flatnonzero(~opened).tolist(), np.flatnonzero(opened).tolist(), [], []

        def encode(groups: list[tuple[list[int], str]]) -> None:
            coded = self.library.encode_batch_fast([t for _, t in groups], add_special_tokens=False)
            for (g, _), found in zip(groups, coded):
                part = np.array(found.ids, self.kind)
                # Inside these units there is no white space: only their first token opens.
                cuts = self.opens[part].nonzero()[0]
                if len(cuts) != len(g):
                    others.extend(g)
                else:
                    done.append((g, part, np.diff(cuts, append=len(part))))

        groups = []
        for a in range(0, len(spaced), 100):
            g = spaced[a:a + 100]
            text = " " + " ".join([keys[i] for i in g])
            if text.isprintable() and text.count(" ") == len(g):
                groups.append((g, text))
            else:
                plain += g
        fit = [i for i in plain if keys[i][1:].isprintable() and " " not in keys[i]]
        others += sorted(set(plain) - set(fit))
        groups += [(g, "".join([unit(keys[i]) for i in g])) for g in (fit[a:a + 100] for a in range(0, len(fit), 100))]
        for a in range(0, len(groups), 200):
            encode(groups[a:a + 200])
        for i in others:
            ids = self._ids(unit(keys[i]))
            done.append(([i], ids, np.array([len(ids)], np.int64)))
        return (np.array([i for g, _, _ in done for i in g], np.int64), np.concatenate([x for _, x, _ in done]),
                np.concatenate([x for _, _, x in done]))


def id_kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encoder(path: str) -> UnitEncoder:
    """One encoder for each worker and file."""
    sole_keeper("encoder", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def encode_ids(df: DataFrame, path: str, key: str, text: str, end_id: int) -> DataFrame:
    """(key, tie, ids, width, counts): ids of the whole text and the end id, in `width` bytes each.

    `tie` is a checksum of the ids. A task's last row holds only the counts of its ids.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("key", pa.int64()), ("tie", pa.int64()), ("ids", pa.binary()),
                            ("width", pa.int32()), ("counts", pa.binary())])
        of = encoder(path)
        # The end id has to fit as well.
        kind = np.dtype(of.kind if end_id < 1 << 16 else "<u4")
        tail = np.array([end_id], kind).tobytes()
        total = np.zeros(max(len(of.opens), end_id + 1), np.int64)
        for whole in batches:
            for batch in by_bytes(whole, 1, SLICE_BYTES):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids = [i + tail for a, b in chunks(texts, SLICE_CHARS) for i in of.encode(texts[a:b], kind)]
                total += np.bincount(np.frombuffer(b"".join(ids), kind), minlength=len(total))
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(np.full(n, kind.itemsize, np.int32)), pa.nulls(n, pa.binary())], schema=schema)
        yield pa.RecordBatch.from_pydict({"key": [None], "tie": [None], "ids": [None], "width": [None],
                                          "counts": [total.tobytes()]}, schema)

    chosen = df.select(F.col(quoted(key)).cast("long").alias("key"), F.col(quoted(text)).alias("text"))
    return chosen.mapInArrow(run, "key long, tie long, ids binary, width int, counts binary")


def ranks_of(encoded: DataFrame) -> np.ndarray:
    """Id of each rank, the most frequent first, ties by id. As long as the vocabulary at most."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.column(0):
                total = np.frombuffer(row.as_py(), np.int64)
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    counts = (encoded.select("counts").where(F.col("counts").isNotNull()).mapInArrow(run, "id long, n long")
              .groupBy("id").agg(F.sum("n").alias("n")))
    return np.array([r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()], np.int64)


def write_token_files(df: DataFrame, path: str, target: str, key: str = "doc_id", text: str = "text",
                      end_id: int = 2) -> None:
    """Write shards and the table of ranks of a corpus below `target`.

    Null texts are documents with the end id only. Rows come in ascending key order, null keys
    first; rows of one key are ordered by a checksum of their ids, then the ids. Keys are whole
    numbers. Other columns are not read.
    """
    spark = df.sparkSession
    with small_batches(spark, BATCH_ROWS):
        encoded = written(encode_ids(df, path, key, text, end_id), "ids")
    order = ranks_of(encoded)
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(order)], "rank long, id long") \
        .coalesce(1).write.parquet(f"{target}/ranks")
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        parts: list[bytes] = []
        held = width = 0

        def shard():
            lengths = np.array([len(p) // width for p in parts], np.int64)
            ids = np.frombuffer(b"".join(parts), f"<u{width}")
            payload = write_shard(keys, lengths, rank[ids])
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "before": [before], "n_ids": [len(ids)],
                 "payload": [payload]},
                pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()),
                           ("n_ids", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            for k, ids, width in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                keys.append(k)
                parts.append(ids.as_py())
                held += len(parts[-1]) // width
                if held >= SHARD_IDS:
                    yield shard()
                    seq, before = seq + 1, before + held
                    keys, parts, held = [], [], 0
        if keys:
            yield shard()

    rows = encoded.where(F.col("counts").isNull()).select("key", "ids", "width", "tie")
    with small_batches(spark, BATCH_ROWS):
        (rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "ids")
         .mapInArrow(run, "part int, seq int, before long, n_ids long, payload binary")
         .write.parquet(f"{target}/shards"))


def read_token_files(spark: SparkSession, target: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) for each document in the files.

    `start` counts the ids of all documents before it; `ids` are little-endian u32.
    """
    shards = spark.read.parquet(f"{target}/shards")
    # Bounded by the vocabulary.
    ranked = spark.read.parquet(f"{target}/ranks").orderBy("rank").collect()
    id_of = np.array([r["id"] for r in ranked], "<u4")
    # One row for each partition of the writer.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for offset, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, lengths, ranks = read_shard(payload.as_py())
                ids = id_of[ranks]
                ends = np.cumsum(lengths)
                cut = [ids[e - n:e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist())]
                columns = [pa.array(keys, pa.int64()), pa.array(offset + ends - lengths),
                           pa.array(lengths), pa.array([zlib.crc32(c) for c in cut], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(cut, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    return (shards.join(F.broadcast(parts), "part")
            .select((F.col("offset") + F.col("before")).alias("offset"), "payload")
            .mapInArrow(run, schema))


def token_files(df: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                end_id: int = 2) -> DataFrame:
    """Write a corpus to new files below the shared folder and read them back."""
    settle(df.sparkSession)
    target = scratch_path(df.sparkSession, "token-files")
    write_token_files(df, path, target, key, text, end_id)
    return read_token_files(df.sparkSession, target)
