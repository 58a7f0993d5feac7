"""Best-fit packing of token sequences by exact-complement hashing.

Only how often each length occurs matters for a packing, and lengths have an upper bound (the capacity), so
the plan is made from a histogram of at most ``capacity`` counts whatever the corpus' size: for each longest
length left, an index of the single, pair and triple sums of the lengths still available is asked for the
exact gap, and combinations that fill it are consumed as often as their counts allow. What has no exact
complement is packed by best fit. The plan is a list of patterns with multiplicities; Spark gives each
piece its rank among the pieces of its length, and the rank tells the sequence and the place in it.

Defined results: null text is empty, its only id the separator; repeated rows are pieces of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, materialize, salted_prefix
from .tokens import encoder, lean, text_slices

CAPACITY = 2048
SLICE_BYTES, BATCH_ROWS = 1 << 20, 2000  # text that a worker encodes at once; documents sent to it at once


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, sep_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with the separator, cut only where longer than ``capacity``."""

    def run(batches):
        enc, sep = encoder(tokenizer, True), np.array([sep_id], "<u4")
        for b in batches:
            for part in text_slices(b, 1, SLICE_BYTES):
                ids, at = enc.encode(part.column(1))
                out = []
                for doc_id, lo, hi in zip(part.column(0).to_pylist(), at, at[1:], strict=False):
                    own = np.append(ids[lo:hi], sep)
                    out += [(doc_id, k, x, min(capacity, len(own) - x), zlib.crc32(own[x : x + capacity])) for k, x in enumerate(range(0, len(own), capacity))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Lengths:
    """Counts of the lengths left, with the sums that one, two or three of them make."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for k, n in counts.items():
            self.left[k] = n
        self.pairs: np.ndarray | None = None

    def take(self, items: tuple[int, ...], times: int) -> None:
        for x in items:
            self.left[x] -= times
            if not self.left[x]:
                self.pairs = None  # a length is gone: the pair sums are indexed anew

    def often(self, items: tuple[int, ...]) -> int:
        return min(int(self.left[x]) // items.count(x) for x in set(items))

    def _pair(self, gap: int) -> tuple[int, int] | None:
        """Two lengths that sum to ``gap``, the larger as large as it can be."""
        a = np.arange(gap - 1, (gap + 1) // 2 - 1, -1)
        both = a[(self.left[a] > 0) & (self.left[gap - a] > 0)]
        for x in both[:2]:
            if 2 * x != gap or self.left[x] > 1:
                return int(x), int(gap - x)
        return None

    def fill(self, first: int, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill ``gap`` exactly beside ``first``."""
        self.left[first] -= 1
        try:
            if self.left[gap]:
                return (gap,)
            if two := self._pair(gap):
                return two
            if self.pairs is None:
                has = (self.left > 0).astype(np.float32)
                size = 1 << (2 * len(has)).bit_length()
                self.pairs = np.fft.irfft(np.fft.rfft(has, size) ** 2)[: len(has)] > 0.5
            c = np.arange(gap - 2, 0, -1)
            for x in c[(self.left[c] > 0) & self.pairs[gap - c]]:
                self.left[x] -= 1
                two = self._pair(int(gap - x))
                self.left[x] += 1
                if two:
                    return (int(x), *two)
            return None
        finally:
            self.left[first] += 1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how often each is used; every counted length is used up."""
    s, out = _Lengths(counts, capacity), []
    if n := int(s.left[capacity]):
        out.append(((capacity,), n))
        s.left[capacity] = 0
    residual: dict[int, int] = {}
    for first in range(capacity - 1, 0, -1):
        while s.left[first]:
            rest = s.fill(first, capacity - first)
            if rest is None:
                residual[first] = int(s.left[first])
                s.take((first,), residual[first])
                break
            items = (first, *rest)
            times = s.often(items)
            s.take(items, times)
            out.append((items, times))
    return out + _best_fit(residual, capacity)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit on whole groups of equal bins: the longest first, into the fullest bins that have room."""
    open_: dict[int, list[list]] = defaultdict(list)  # room -> [pattern, how many such bins]
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = next((r for r in range(size, capacity + 1) if open_.get(r)), None)
            if room is None:
                each = capacity // size
                whole, n = divmod(n, each)
                if whole:
                    open_[capacity - each * size].append([(size,) * each, whole])
                if n:
                    open_[capacity - n * size].append([(size,) * n, 1])
                break
            group = open_[room][-1]
            k = min(n, group[1])
            group[1] -= k
            if not group[1]:
                open_[room].pop()
            open_[room - size].append([(*group[0], size), k])
            n -= k
    return [(tuple(p), k) for groups in open_.values() for p, k in groups]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ids_crc32, ...)."""
    with batches_of(pieces.sparkSession, BATCH_ROWS):
        pieces = materialize(pieces, "pieces")
    counts = {r.length: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, base = defaultdict(list), 0  # for each length: first rank, items a sequence, first sequence, first offset
    used: dict[int, int] = defaultdict(int)
    for items, times in plan(counts, capacity):
        at = 0
        for size in sorted(set(items), reverse=True):
            each = items.count(size)
            runs[size].append((used[size], each, base, at))
            used[size] += each * times
            at += each * size
        base += times
    table = {k: np.array(v, np.int64) for k, v in runs.items()}

    def place(batches):
        for b in batches:
            size, rank = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            seq, off = np.empty_like(rank), np.empty_like(rank)
            for k in np.unique(size):
                at, t = np.flatnonzero(size == k), table[int(k)]
                r = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
                x = rank[at] - r[:, 0]
                seq[at], off[at] = r[:, 2] + x // r[:, 1], r[:, 3] + x % r[:, 1] * k
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(size), pa.array(seq), pa.array(off)], [*b.schema.names[2:], "length", "sequence_id", "offset"])

    ranked = salted_prefix(pieces.withColumn("__one", F.lit(1).cast("long")), ["length"], ["doc_id", "piece", "start", "ids_crc32"], "__one", "__rank")
    rest = [c for c in pieces.columns if c != "length"]
    kinds = dict(pieces.dtypes)
    return ranked.select("length", "__rank", *rest).mapInArrow(place, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", length long, sequence_id long, offset long")
