"""T5. Exact nearest training rows without all pairs: pivots, their cells, and the triangle inequality.

PIVOTS rows picked by a hash of their keys cut the training rows into cells, each row in that of its nearest pivot. A test
row first searches its nearest cells until they hold k rows. The distance of its k-th nearest row so far then leaves out
every cell that lies too far: by the cell's smallest and largest radius, and by the plane between two pivots. In a cell
only rows whose radius is near enough are compared. Cells are dealt to blocks, queries of a cell to turns, of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.keys import digest
from ..functions.shared import written

PIVOTS, BLOCK, ASKED, PAIRED = 512, 4096, 4096, 4096


def _matrix(raw: pd.Series) -> np.ndarray:
    return np.stack(raw.to_list()).astype(float) if len(raw) else np.empty((0, 0))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances, from differences: sums of squares of products would cancel."""
    out = np.empty((len(x), len(y)))
    for lo in range(0, len(x), 256):
        d = x[lo : lo + 256, None, :] - y[None, :, :]
        out[lo : lo + 256] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _search(train: pd.DataFrame, asked: pd.DataFrame, keys: list[str], k: int) -> pd.DataFrame:
    """The k nearest rows of a block for each of its queries, and how many were compared; ties go to the smaller key."""
    train = train.sort_values([f"t_{c}" for c in keys], kind="stable").sort_values("r", kind="stable").reset_index(drop=True)
    in_order = np.empty(len(train), np.int64)  # place of each row by key
    in_order[train[[f"t_{c}" for c in keys]].reset_index().sort_values([f"t_{c}" for c in keys], kind="stable")["index"].to_numpy()] = np.arange(len(train))
    x, r = _matrix(train.t_x), train.r.to_numpy()
    q, far, limit = _matrix(asked.q_x), asked.far.to_numpy(), asked.limit.to_numpy()
    lo, hi = np.searchsorted(r, far - limit, "left"), np.searchsorted(r, far + limit, "right")
    rows, of, dist, compared = [], [], [], []
    for i in range(len(asked)):
        a, b = int(lo[i]), int(hi[i])
        if b <= a:
            continue
        d = x[a:b] - q[i]
        d = np.round(np.einsum("ij,ij->i", d, d), 9)
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
        near = near[np.lexsort((in_order[a + near], d[near]))][:k]
        rows.append(a + near)
        of.append(np.full(len(near), i))
        dist.append(d[near])
        compared.append(np.where(np.arange(len(near)) == 0, b - a, 0))
    if not rows:
        return pd.DataFrame({c: pd.Series(dtype=object) for c in [*[f"q_{c}" for c in keys], "y_true", *[f"t_{c}" for c in keys], "t_y", "d", "compared"]})
    rows, of = np.concatenate(rows), np.concatenate(of)
    out = asked.iloc[of][[*[f"q_{c}" for c in keys], "y_true"]].reset_index(drop=True)
    got = train.iloc[rows][[*[f"t_{c}" for c in keys], "t_y"]].reset_index(drop=True)
    return pd.concat([out, got], axis=1).assign(d=np.concatenate(dist), compared=np.concatenate(compared))


def nearest_rows(train: DataFrame, test: DataFrame, keys: list[str], k: int, pivots: int = PIVOTS) -> DataFrame:
    """(q_keys..., y_true, t_keys..., t_y, d, compared, r): the k nearest of ``train`` (t_keys..., t_y, t_x) for each row of ``test`` (q_keys..., y_true, q_x)."""
    spark = train.sparkSession
    names = [f"t_{c}" for c in keys]
    picked = train.select("t_x", digest("pivot", *names).alias("__h"), *names).orderBy("__h", *names).limit(pivots).select("t_x").collect()  # PIVOTS rows
    at = np.unique(np.array([r.t_x for r in picked], dtype=float), axis=0)
    between = _distances(at, at)

    @F.pandas_udf("struct<cell:int,r:double>")
    def own_cell(x: pd.Series) -> pd.DataFrame:
        d = _distances(_matrix(x), at) if len(x) else np.empty((0, len(at)))
        cell = d.argmin(1) if len(d) else np.empty(0, int)
        return pd.DataFrame({"cell": cell, "r": d[np.arange(len(d)), cell]})

    placed = written(train.withColumn("c", own_cell("t_x")).select(*train.columns, "c.cell", "c.r"), "cells")
    about = {r.cell: (r.n, r.low, r.high) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()}  # PIVOTS rows
    n, low, high = (np.array([about.get(i, (0, np.inf, -np.inf))[j] for i in range(len(at))]) for j in range(3))
    blocks = F.create_map(*[F.lit(v) for i in about for v in (i, -(-int(about[i][0]) // BLOCK))])
    points = placed.withColumn("block", F.pmod(F.xxhash64(*names), blocks[F.col("cell")]).cast("int"))
    visit = T.ArrayType(T.StructType().add("cell", "integer").add("far", "double"))

    @F.pandas_udf(visit)
    def first_cells(x: pd.Series) -> pd.Series:
        out = []
        for d in _distances(_matrix(x), at) if len(x) else []:
            order = np.argsort(d, kind="stable")
            order = order[n[order] > 0]
            order = order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]
            out.append([{"cell": int(i), "far": float(d[i])} for i in order])
        return pd.Series(out, dtype=object)

    @F.pandas_udf(visit)
    def other_cells(x: pd.Series, limit: pd.Series, seen: pd.Series) -> pd.Series:
        out = []
        for d, far, been in zip(_distances(_matrix(x), at) if len(x) else [], limit, seen, strict=True):
            own = int(d.argmin())
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(between[own] > 0, (d * d - d[own] * d[own]) / (2 * between[own]), 0.0)
            least = np.maximum.reduce([d - high, low - d, plane])
            hit = (n > 0) & (least <= far)
            hit[list(been)] = False
            out.append([{"cell": int(i), "far": float(d[i])} for i in np.flatnonzero(hit)])
        return pd.Series(out, dtype=object)

    asks = [f"q_{c}" for c in keys]
    schema = T.StructType([test.schema[c] for c in (*asks, "y_true")] + [train.schema[c] for c in (*names, "t_y")]).add("d", "double").add("compared", "long")

    def searched(of: DataFrame) -> DataFrame:
        turns = F.broadcast(of.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("turns")))  # one row a cell
        dealt = of.join(turns, "cell").withColumn("turn", F.pmod(F.xxhash64(*asks), F.col("turns").cast("long")).cast("int")).drop("turns")
        dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")] - 1)))
        copies = points.join(turns, "cell").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
        run = lambda a, b: _search(a, b, keys, k)
        by = ["cell", "block", "turn"]
        return copies.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(run, schema)

    top = W.partitionBy(*asks).orderBy("d", *names)
    begun = written(test.withColumn("cells", first_cells("q_x")), "asked")
    first = written(searched(begun.withColumn("c", F.explode("cells")).select(*test.columns, "c.cell", "c.far", F.lit(float("inf")).alias("limit"))), "first")
    best = first.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k)
    # Squared distances are rounded to nine places: what may round alike is still looked at.
    far = F.sqrt(F.max("d") + 1e-9) * (1 + 1e-9) + 1e-9
    limits = best.groupBy(*[F.col(c).alias(f"__{c}") for c in asks]).agg(F.when(F.count("*") >= k, far).otherwise(float("inf")).alias("limit"))
    joined = begun.join(limits, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in asks], "left").fillna(float("inf"), ["limit"])
    rest = joined.withColumn("c", F.explode(other_cells("q_x", "limit", F.transform("cells", lambda c: c["cell"]))))
    found = first.unionByName(searched(rest.select(*test.columns, "c.cell", "c.far", "limit")))
    total = W.partitionBy(*asks)
    return found.withColumn("compared", F.sum("compared").over(total)).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k)


def all_pairs(train: DataFrame, test: DataFrame, keys: list[str], k: int, parts: int | None = None) -> DataFrame:
    """(q_keys..., y_true, t_keys..., t_y, d): of each block of training rows those that may be among a test row's k nearest.

    Every pair is compared, PAIRED x PAIRED at once. Products tell roughly how far rows are; what may come among the k nearest of
    a block is measured from differences, component by component. At most k rows a block, and what rounds alike, are handed on.
    """
    names, asks = [f"t_{c}" for c in keys], [f"q_{c}" for c in keys]
    schema = T.StructType([test.schema[c] for c in (*asks, "y_true")] + [train.schema[c] for c in (*names, "t_y")]).add("d", "double")

    def compared(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema.fields})
        x, y = _matrix(a.t_x), _matrix(b.q_x)
        x2, of, rows, dist = (x * x).sum(1), [], [], []
        for lo in range(0, len(y), 256):
            q = y[lo : lo + 256]
            q2 = (q * q).sum(1)
            rough = q2[:, None] + x2[None, :] - 2 * (q @ x.T)
            kth = np.partition(rough, k - 1, 1)[:, k - 1 : k] if len(x) > k else np.full((len(q), 1), np.inf)
            slack = 3e-9 + 1e-12 * (q2[:, None] + x2.max())  # of rounding, and of what products lose
            i, j = np.nonzero(~(rough > kth + 2 * slack))  # NaN stays
            d = np.zeros(len(i))
            for c in range(x.shape[1]):
                step = q[i, c] - x[j, c]
                d += step * step
            of.append(i + lo)
            rows.append(j)
            dist.append(d)
        out = b.iloc[np.concatenate(of)][[*asks, "y_true"]].reset_index(drop=True)
        return pd.concat([out, a.iloc[np.concatenate(rows)][[*names, "t_y"]].reset_index(drop=True)], axis=1).assign(d=np.concatenate(dist))

    def dealt(df: DataFrame, by: list[str], own: str, other: str, pieces: int, copies: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(*by), F.lit(pieces)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    blocks, turns = (parts or max(1, -(-df.count() // PAIRED)) for df in (train, test))
    left = dealt(train, names, "block", "turn", blocks, turns).groupBy("block", "turn")
    return left.cogroup(dealt(test, asks, "turn", "block", turns, blocks).groupBy("block", "turn")).applyInPandas(compared, schema)


def pivots_for(n: int) -> int:
    return max(8, min(PIVOTS, int(math.sqrt(n))))
