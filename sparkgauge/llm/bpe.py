"""Byte-level BPE, encoding and decoding.

Two tiers: a minimal perfect hash over the vocabulary resolves a pre-token that is a whole entry; any other is merged by
a heap over its linked bytes, in O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textvec

#: Pre-tokens remembered by each Python worker, and the longest one that is.
REMEMBERED, LONGEST = 450_000, 64
#: Rows that go back to Spark at a time.
ROWS = 512


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: a base64 token and its rank on each line."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _hash(key: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little")


def _place(h: int, d: int, n: int) -> int:
    """The slot that displacement ``d`` gives a key: another pseudo-random one for each ``d``."""
    return (((h ^ d * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 24) % n


class PerfectHash:
    """A minimal perfect hash by hash and displace: n keys fill n slots, with one small integer per bucket."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 2)
        self.keys: list[bytes] = [b""] * n
        self.shift = [0] * self.buckets
        by: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in keys:
            h = _hash(key)
            by[h % self.buckets].append((h, key))
        taken, order = bytearray(n), sorted(range(self.buckets), key=lambda i: -len(by[i]))
        free = None
        for i in order:
            group = by[i]
            if len(group) > 1:
                d = 0
                while True:
                    slots = [_place(h, d, n) for h, _ in group]
                    if len({*slots}) == len(slots) and not any(taken[s] for s in slots):
                        break
                    d += 1
                    if d > 1 << 22:
                        raise ValueError("two keys have one hash")
                self.shift[i] = d
            elif group:
                free = free or (s for s in range(n) if not taken[s])
                slots = [next(free)]
                self.shift[i] = -1 - slots[0]  # a lone key has its slot written down
            else:
                continue
            for s, (_, key) in zip(slots, group, strict=True):
                taken[s] = 1
                self.keys[s] = key

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1 if it isn't one of the keys."""
        if not self.n:
            return -1
        h = _hash(key)
        d = self.shift[h % self.buckets]
        s = -1 - d if d < 0 else _place(h, d, self.n)
        return s if self.keys[s] == key else -1


class _Known(dict):
    """Pre-tokens and their packed ids; one that isn't there is encoded, and remembered unless it is long."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.bpe.piece_ids(piece)).tobytes()
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class Bpe:
    """Encoder and decoder of one rank table; picklable, so it can be broadcast (its size is the vocabulary's)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.table = PerfectHash(list(ranks))
        self.at_slot = [ranks[k] for k in self.table.keys]
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: always the pair of lowest rank, the leftmost of equals, until none is in the table."""
        get, n = self.ranks.get, len(piece)
        if n < 2:
            return [self.ranks[piece]] if n else []
        # a part is named by its first byte: where the next one starts, and where the one before does
        after, before = [*range(1, n + 1)], [*range(-1, n)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, stop = pop(heap)
            j = after[i]
            if j < 0 or j >= n or after[j] != stop:
                continue  # one of its halves has been merged since
            after[j], after[i] = -1, stop
            if stop < n:
                before[stop] = i
                end = after[stop]
                if (r := get(piece[i:end])) is not None:
                    push(heap, (r, i, end))
            j = before[i]
            if j >= 0 and (r := get(piece[j:stop])) is not None:
                push(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(self.ranks[piece[i:j]])
            i = j
        return out

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        slot = self.table.slot(raw)
        return (self.at_slot[slot],) if slot >= 0 else tuple(self.merge(raw))

    def encoder(self):
        """A function from a text to its ids as packed 32-bit integers, with a bounded memory of pre-tokens."""
        find, known = regex.compile(self.pattern).findall, _Known(self)
        look = known.__getitem__

        def encode(text: str) -> bytes:
            if len(known) > REMEMBERED:
                known.clear()
            return b"".join(map(look, find(text)))

        return encode

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of many ids at once."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids) or not ends[-1]:
            return np.zeros(0, np.uint8)
        return self.blob[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + n, n)]


def _encode(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model.value.encoder()
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                ids = [encode(t) if t else b"" for t in textvec.strings(part.column(at))]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                flat = np.frombuffer(b"".join(ids), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns) if i != at), lists], names=[*(n for i, n in enumerate(part.schema.names) if i != at), "ids"])

    return run


def _decoded(bpe: Bpe, lists: pa.ListArray) -> pa.Array:
    """The bytes of each row's ids; none for null."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(bpe.lengths[ids]))[np.append(0, np.cumsum(counts))]
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(bpe.decode(ids).tobytes())])


def _decode(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(model.value, part.column(at))], names=[*part.schema.names, "decoded"])

    return run


def _both(model, at: int):
    """Encoding and then decoding in one Python worker: two functions in a row would each hold one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _encode(model, at)(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, _decoded(model.value, part.column("ids"))], names=[*part.schema.names, "decoded"])

    return run


def bpe_encode(docs: DataFrame, bpe: Bpe, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ids (array of int) for each row of ``docs``; null and empty texts have no ids, rows are never merged.

    Only ``keep`` and the text are read, so other columns' names can't clash.
    """
    model = docs.sparkSession.sparkContext.broadcast(bpe)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    return rows.mapInArrow(common.lean(_encode(model, len(keep))), common.schema(rows, "_text", "ids array<int>"))


def bpe_decode(encoded: DataFrame, bpe: Bpe) -> DataFrame:
    """``encoded`` with decoded (binary): the bytes of its ids; null ids count as none."""
    model = encoded.sparkSession.sparkContext.broadcast(bpe)
    return encoded.mapInArrow(common.lean(_decode(model, encoded.columns.index("ids"))), common.schema(encoded, "", "decoded binary"))


def round_trip(docs: DataFrame, bpe: Bpe, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 (of the decimal ids joined by a space) and decoded_sha256 of each row of ``docs``."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    both = rows.mapInArrow(common.lean(_both(docs.sparkSession.sparkContext.broadcast(bpe), len(keep))), common.schema(rows, "_text", "ids array<int>, decoded binary"))
    return both.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
