"""X5, A2. k-means as a function of row keys: seeds by hash races, Lloyd rounds as grouped aggregates.

A seed round gives each row -ln(u) / D for its squared distance D to the nearest centre so far, u a hash of its keys, and takes
the rows of the smallest values: exactly a sample without replacement in proportion to D. Up to ROUNDS rounds are needed,
whatever k. Means and distances are rounded to nine places, so that sums in another order give the same clusters.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import u
from ..functions.shared import written

SEED_ROUNDS, LLOYD_ROUNDS, PLACES, SLICE = 8, 20, 9, 8192


def _rows(x: pa.Array, d: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), d)


def _squared(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, components added in their order."""
    out = np.zeros((len(x), len(at)))
    for j in range(at.shape[1]):
        step = x[:, j, None] - at[None, :, j]
        out += step * step
    return out


def _rounded(v: float) -> float:
    return float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-PLACES), ROUND_HALF_UP)) if abs(v) < 1e18 else float(v)


def nearest_of(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The nearest centre of each row by distances rounded to PLACES, ties to the smaller number; only near ties are rounded."""
    out = np.empty(len(x), np.int64)
    for lo in range(0, len(x), SLICE):
        d = _squared(x[lo : lo + SLICE], at)
        least = d.min(1, keepdims=True)
        best = d.argmin(1)
        near = d <= least + 3 * 10.0**-PLACES + 1e-14 * least
        for i in np.flatnonzero((near & (d != least)).any(1)):
            own = [(_rounded(d[i, j]), j) for j in np.flatnonzero(near[i])]
            best[i] = min(own)[1]
        out[lo : lo + SLICE] = best
    return out


def nearest_centre(x: str, centres: list[list[float]]) -> Column:
    """Number of the nearest centre from 0, ties to the smaller."""
    at = np.array(centres, float)

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        return pa.array(nearest_of(_rows(v, at.shape[1]), at), pa.int32())

    return nearest(F.col(x))


def _least(x: str, centres: list[list[float]]) -> Column:
    """Squared distance to the nearest centre. Rounding keeps order: the least is rounded, not each."""
    at = np.array(centres, float)

    @F.arrow_udf("double")
    def least(v: pa.Array) -> pa.Array:
        rows = _rows(v, at.shape[1])
        return pa.array(np.concatenate([_squared(rows[lo : lo + SLICE], at).min(1) for lo in range(0, len(rows), SLICE)] or [np.empty(0)]))

    return F.round(least(F.col(x)), PLACES)


def seeds(points: DataFrame, keys: list[str], k: int, seed: int = 42) -> list[list[float]]:
    """At most k different rows of points(keys..., x); fewer, if there are no more."""
    draw = lambda i: u(f"centre{i}", *keys, seed=seed)
    first = points.select("x", draw(0).alias("__r"), *keys).orderBy("__r", *keys).limit(1).collect()
    if not first:
        return []
    centres, each, i = [list(first[0].x)], max(1, -(-(k - 1) // SEED_ROUNDS)), 0
    while len(centres) < k:
        i += 1
        far = points.withColumn("__d", _least("x", centres)).where("__d > 0")
        race = far.select("x", (-F.log(1 - draw(i)) / F.col("__d")).alias("__r"), *keys).orderBy("__r", *keys)
        got = race.limit(min(each, k - len(centres))).collect()  # k rows in all
        if not got:
            break
        for r in got:
            if list(r.x) not in centres:
                centres.append(list(r.x))
    return centres


def _means(points: DataFrame, centres: list[list[float]]) -> list:
    """(c, m) of the clusters that have rows: tasks add up their own, one row a cluster."""
    at = np.array(centres, float)

    def added(batches):
        k, d = at.shape
        n, total = np.zeros(k, np.int64), np.zeros((k, d))
        for b in batches:
            x = _rows(b.column(0), d)
            own = nearest_of(x, at)
            n += np.bincount(own, minlength=k)
            for j in range(d):
                total[:, j] += np.bincount(own, x[:, j], k)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there]), pa.array(total[there].tolist(), pa.list_(pa.float64()))], ["c", "n", "s"])

    sums = points.select("x").mapInArrow(added, "c int, n long, s array<double>").groupBy("c")
    return sums.agg(F.array(*[F.round(F.sum(F.col("s")[i]) / F.sum("n"), PLACES) for i in range(at.shape[1])]).alias("m")).collect()  # k rows


def kmeans(points: DataFrame, keys: list[str], k: int, rounds: int = LLOYD_ROUNDS, seed: int = 42) -> list[list[float]]:
    """Centres of points(keys..., x array<double>); a cluster that loses all its rows keeps its centre."""
    points = written(points.select(*keys, F.transform("x", lambda v: F.round(v, PLACES)).alias("x")), "points")  # read in each round
    centres = seeds(points, keys, k, seed)
    for _ in range(rounds if centres else 0):
        new = list(centres)
        for r in _means(points, centres):
            new[r.c] = [v + 0.0 for v in r.m]
        if new == centres:
            break
        centres = new
    return centres
