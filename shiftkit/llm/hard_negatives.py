"""Hard negatives by a vertical scan of columns that stops early (BOND).

Vectors are stored by dimension in blocks of BLOCK rows. For an anchor the dimensions are read in descending order of its
own magnitudes, STEP at a time; what the dimensions not yet read can still add lies between sums of the block's smallest
and largest values times the anchor's, so each row's score has a lower and an upper bound. Rows whose bounds cannot reach
the windows asked for, or the k best found in them so far, leave the bitmap, until what is left has exact scores.

All rows are scanned twice, for positives and for the windows below them. Anchors are broadcast ANCHORS at a time (each
turn scans the rows again), a task keeps k rows an anchor and window, and hands those on once. Scores are exact integers:
doubles where they hold every sum, else 64-bit, else Python's integers.

Defined results: rows with a null id, label or vector, or a component that is null or not finite, take no part; a shorter
vector counts as filled up with zeros; rows alike in id and score to an anchor count once, and a row with the anchor's id
is not another row; ties go to the smaller id; scores beyond a long are given as the nearest long; an empty table, no
anchor, no positive or an empty window give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, scratch
from .tokens import lean

ANCHORS, BLOCK, STEP, SEED = 16_384, 8192, 8, 5
LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: doubles where they are whole numbers that fit, else Python's integers."""
    y = np.floor(x * float(scale))
    if not len(y) or np.abs(y).max(initial=0) < 2**52:
        return y
    return np.array([[math.floor(v * scale) if abs(v) < 2.0**60 else int(v) * scale for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def _fitting(a: np.ndarray, b: np.ndarray) -> type:
    """A number type that holds every sum of products of a and b."""
    most = int(abs(a).max(initial=0)) * int(abs(b).max(initial=0)) * max(1, a.shape[-1])
    return np.float64 if most < 2**52 else np.int64 if most < 2**62 else object


def _wide(x: np.ndarray, d: int) -> np.ndarray:
    if x.shape[1] >= d:
        return x
    return np.concatenate([x, np.zeros((len(x), d - x.shape[1]), x.dtype)], 1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first distinct (score, id): larger scores first, then smaller ids."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i])), np.int64)
    else:
        if len(scores) > 64 * k:  # all that tie with the k-th distinct one stay
            top = np.unique(scores)[-k:]
            keep = scores >= top[0]
            scores, ids = scores[keep], ids[keep]
        order = np.lexsort((ids, -scores))
    s, i = scores[order], ids[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
    return s[new][:k], i[new][:k]


def _kth(lower: np.ndarray, ids: np.ndarray, sure: np.ndarray, k: int) -> float | int | None:
    """The k-th largest lower bound of rows of different ids among the ``sure`` ones, if it is found among the first few."""
    at = np.flatnonzero(sure)
    if len(at) > 4 * k:
        at = at[np.argpartition(-lower[at], 4 * k)[: 4 * k]]
    seen: set[int] = set()
    for i in at[np.argsort(-lower[at], kind="stable")].tolist():
        seen.add(int(ids[i]))
        if len(seen) == k:
            return lower[i]
    return None


class Block:
    """Rows by dimension, with each dimension's smallest and largest value."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.columns = np.ascontiguousarray(x.T)
        self.low, self.high = (self.columns.min(1), self.columns.max(1)) if len(x) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))

    def scan(self, a: np.ndarray, rows: np.ndarray, windows: list[tuple], held: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
        """Puts the k best of ``rows`` in each window [low, high] (None: no bound) into ``held``, a list of (scores, ids)."""
        kind = _fitting(self.x, a)
        columns = self.columns if self.columns.dtype == kind else self.columns.astype(kind)
        a = a.astype(kind)
        order = np.argsort(-np.abs(a.astype(np.float64)), kind="stable")
        order = order[: int((a != 0).sum())]  # the rest adds nothing
        ends = np.stack([a * self.low.astype(kind), a * self.high.astype(kind)])[:, order]
        zero = np.zeros(1, kind)
        least = np.concatenate([np.cumsum(ends.min(0)[::-1])[::-1], zero]) if len(order) else zero
        most = np.concatenate([np.cumsum(ends.max(0)[::-1])[::-1], zero]) if len(order) else zero
        floors = [max((x for x in (lo, s[k - 1] if len(s) >= k else None) if x is not None), default=None) for (lo, _), (s, _) in zip(windows, held, strict=True)]
        alive, part = rows, np.zeros(len(rows), kind)
        for at in range(0, len(order), STEP):
            dims = order[at : at + STEP]
            values = columns[dims] if len(alive) == len(self.ids) else columns[np.ix_(dims, alive)]
            part = part + a[dims] @ values
            after = min(at + STEP, len(order))
            if after == len(order) or not len(alive):
                break
            upper, lower = part + most[after], part + least[after]
            keep = np.zeros(len(alive), bool)
            for (lo, hi), floor in zip(windows, floors, strict=True):
                inside = np.ones(len(alive), bool) if hi is None else lower <= hi
                if len(alive) > k and kind is not object:  # k rows surely inside: what cannot reach the least of them is out
                    sure = _kth(lower, self.ids[alive], np.ones(len(alive), bool) if lo is None else (lower >= lo) & (upper <= hi), k)
                    floor = sure if floor is None or (sure is not None and sure > floor) else floor
                keep |= inside if floor is None else inside & (upper >= floor)
            if not keep.all():
                alive, part = alive[keep], part[keep]
        for w, (lo, hi) in enumerate(windows):
            ok = np.ones(len(alive), bool)
            if lo is not None:
                ok &= part >= lo
            if hi is not None:
                ok &= part <= hi
            if ok.any():
                s, i = part[ok], self.ids[alive[ok]]
                held[w] = best(np.concatenate([held[w][0].astype(object if kind is object else held[w][0].dtype), s]) if len(held[w][0]) else s, np.concatenate([held[w][1], i]), k)


def _arrays(batch: pa.RecordBatch, scale: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and integer vectors of a batch of (id, label, v), d dimensions wide at least."""
    v = batch.column(2)
    size = np.diff(v.offsets.to_numpy())
    wide = max(d, int(size.max(initial=0)))
    x = np.zeros((len(v), wide))
    x[np.arange(wide) < size[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), integers(x, scale)


def _scanned(rows: DataFrame, anchors: list[tuple[int, int, np.ndarray]], windows: list[list[tuple]], same: bool, k: int, scale: int) -> DataFrame:
    """(a, w, score, id): each task's k best rows of each anchor's windows, of its own label or of all others."""
    shared = rows.sparkSession.sparkContext.broadcast((anchors, windows))

    def run(batches):
        asked, wins = shared.value
        held = [[(np.empty(0), np.empty(0, np.int64)) for _ in w] for w in wins]
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                ids, labels, x = _arrays(b.slice(lo, BLOCK), scale, max((len(v) for _, _, v in asked), default=0))
                block, by_label = Block(ids, labels, x), {}
                for (ident, label, v), w, h in zip(asked, wins, held, strict=True):
                    if not w:
                        continue
                    if label not in by_label:
                        by_label[label] = np.flatnonzero((labels == label) == same)
                    those = by_label[label]
                    if same:
                        those = those[ids[those] != ident]
                    if len(those):
                        block.scan(_wide(v[None, :], x.shape[1])[0], those, w, h, k)
        flat = [(a, w, max(-LONG - 1, min(LONG, int(s))), int(i)) for a, h in enumerate(held) for w, (ss, ii) in enumerate(h) for s, i in zip(ss, ii, strict=True)]
        a, w, s, i = zip(*flat, strict=True) if flat else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(w, pa.int32()), pa.array(s, pa.int64()), pa.array(i, pa.int64())], ["a", "w", "score", "id"])

    found = rows.mapInArrow(lean(run), "a int, w int, score long, id long")
    rank = W.partitionBy("a", "w").orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor: Column, k_pos: int = 5, k_neg: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", anchors_at_once: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor its ``k_pos`` nearest rows of the same label, and for each of those the ``k_neg`` best rows of other
    labels whose score lies between ``low`` and ``high`` per cent of the positive's.
    """
    spark = df.sparkSession
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"), is_anchor.alias("asks"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & fine)
    anchors = materialize(rows.where("asks").select("id", "label", "v").distinct(), "anchors")
    turns = -(-anchors.count() // anchors_at_once)
    rows = rows.select("id", "label", "v")
    out = f"{scratch(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for turn in range(turns):
        some = anchors.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(turns)) == turn).toArrow()  # about anchors_at_once rows
        asked = []
        for b in some.sort_by([("id", "ascending"), ("label", "ascending")]).combine_chunks().to_batches():
            ids, labels, x = _arrays(b, scale, 0)
            asked += list(zip(ids.tolist(), labels.tolist(), x, strict=True))
        if not asked:
            continue
        near = _scanned(rows, asked, [[(None, None)] for _ in asked], True, k_pos, scale).select("a", "rank", "id", "score").orderBy("a", "rank").collect()  # k_pos rows an anchor
        windows: list[list[tuple]] = [[] for _ in asked]
        for r in near:
            windows[r.a].append((-((-low * r.score) // 100), (high * r.score) // 100))
        named_by = [(r.a, r.rank - 1, asked[r.a][0], r.id, r.score) for r in near]
        positives = spark.createDataFrame(named_by, "a int, w int, anchor_id long, positive_id long, positive_score long")
        found = _scanned(rows, asked, windows, False, k_neg, scale)
        named = found.join(F.broadcast(positives), ["a", "w"])
        named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out) if turns else spark.createDataFrame([], schema)
