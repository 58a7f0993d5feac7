"""Nearest neighbours by cosine through stable projections and kd-trees.

Unit vectors are projected to M dimensions by a Gaussian (2-stable) matrix: the squared projected distance of
a pair over its squared true distance is chi-square with M degrees of freedom. Projected neighbours are taken
in growing distance from kd-trees and verified with the original vectors until the next projected distance
says, with probability CONFIDENCE, that nothing nearer is left.

A kd-tree over a bounded sample (SAMPLE points) cuts the projected space into cells; every vector is indexed
in its cell, large cells are dealt to several blocks of bounded size, and each block has a kd-tree of its own and is
asked a bounded number of queries at once. A query first
searches its own cell, which bounds the distance of its k-th neighbour, then the cells that this bound and the
stopping test leave. Equal vectors are one index entry with its smallest ids, so copies cost nothing.

Defined results: vectors null, zero, or with null or non-finite components take no part, nor do rows with a null
id, nor vectors of another length than the most common one; rows alike in id and vector count once; ties go to
the smaller id; fewer candidates than k: all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import materialize

M, CONFIDENCE, SEED = 8, 0.98, 7
SAMPLE, CELL, CELLS, LEAF = 20_000, 4096, 1 << 14, 32
ASKED, TIED = 2048, 1e-9  # queries that a block is asked at once; squared distance within which vectors of one direction are still looked for


def chi_square_bound(m: int, p: float) -> float:
    """x with P(chi-square of m degrees <= x) = p, for even m, by bisection of the closed form."""
    low, high = 0.0, 100.0 + 10 * m
    for _ in range(100):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


def _matrix(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, M))


def _vectors(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _split(points: np.ndarray, leaf: int) -> tuple[list[tuple[int, float]], list[np.ndarray]]:
    """Median splits on the widest side down to ``leaf`` points: inner nodes in heap order, and the leaves' points."""
    nodes, level = [], [np.arange(len(points))]
    while max(len(x) for x in level) > leaf:
        after = []
        for x in level:
            p = points[x]
            side = int(np.argmax(p.max(0) - p.min(0))) if len(x) else 0
            order = x[np.argsort(p[:, side], kind="stable")] if len(x) else x
            half = len(order) // 2
            nodes.append((side, float(points[order[half], side]) if len(x) else 0.0))
            after += [order[:half], order[half:]]
        level = after
    return nodes, level


def _cells(nodes: list[tuple[int, float]], p: np.ndarray) -> np.ndarray:
    """Which cell of a heap of splits each point falls into."""
    at = np.zeros(len(p), np.int64)
    if nodes:
        side, value = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        for _ in range(int(math.log2(len(nodes) + 1))):
            at = 2 * at + 1 + (p[np.arange(len(p)), side[at]] >= value[at])
    return at - len(nodes)


def _boxes(nodes: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    low, high = [np.full(M, -np.inf)], [np.full(M, np.inf)]
    for i, (side, value) in enumerate(nodes):
        a, b = high[i].copy(), low[i].copy()
        a[side], b[side] = value, value
        low += [low[i], b]
        high += [a, high[i]]
    n = len(nodes)
    return np.array(low[n:]), np.array(high[n:])


def _search(points: pd.DataFrame, queries: pd.DataFrame, k: int, bound: float) -> pd.DataFrame:
    """The k nearest entries of one block for each of its queries; found distances stop the search."""
    v, p = _vectors(points.vec), _vectors(points.proj)
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    _, leaves = _split(p, LEAF)
    leaves = [x for x in leaves if len(x)]
    least = np.array([x[0] for x in points.ids])
    low, high = np.array([p[x].min(0) for x in leaves]), np.array([p[x].max(0) for x in leaves])
    qv, qp, limit = _vectors(queries.vec), _vectors(queries.proj), queries.limit.to_numpy()
    out_q, out_i, out_s = [], [], []
    for j in range(len(queries)):
        q, qn = qv[j], math.sqrt(float(qv[j] @ qv[j]))
        gap = np.maximum(0, np.maximum(low - qp[j], qp[j] - high))
        near = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(near, kind="stable")
        best_i, best_s, worst, at, step = np.empty(0, np.int64), np.empty(0), limit[j], 0, 4
        while at < len(order) and near[order[at]] <= bound * max(worst, TIED):
            rows = np.concatenate([leaves[x] for x in order[at : at + step]])
            at, step = at + step, step * 2
            s = np.einsum("ij,j->i", v[rows], q) / (norm[rows] * qn)
            best_i, best_s = np.concatenate([best_i, rows]), np.concatenate([best_s, s])
            if len(best_i) > k:
                keep = np.lexsort((least[best_i], -best_s))[:k]
                best_i, best_s = best_i[keep], best_s[keep]
            if len(best_i) >= k:
                worst = min(worst, max(0.0, 2 - 2 * float(best_s.min())))
        out_q += [j] * len(best_i)
        out_i.append(best_i)
        out_s.append(best_s)
    i = np.concatenate(out_i) if out_i else np.empty(0, np.int64)
    found, asked = points.iloc[i], queries.iloc[out_q]
    return pd.DataFrame({"qa": asked.ka.to_numpy(), "qb": asked.kb.to_numpy(), "ids": found.ids.to_numpy(), "score": np.concatenate(out_s) if out_s else np.empty(0)})


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of every row where ``is_query`` holds."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & fine)
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dims is None:
        return empty
    rows = rows.where(F.size("v") == dims.d).withColumn("ka", F.xxhash64("v")).withColumn("kb", F.xxhash64("v", F.lit(SEED)))
    # Of equal vectors no more than k + 1 ids can be asked for: the limit applies before the shuffle.
    by_vector = W.partitionBy("ka", "kb").orderBy("id")
    few = rows.withColumn("r", F.dense_rank().over(by_vector)).where(F.col("r") <= k + 1)
    entries = few.groupBy("ka", "kb").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("v").alias("v"))
    g = _matrix(dims.d)

    @F.pandas_udf("struct<vec:binary,proj:binary>")
    def project(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_list()) if len(v) else np.empty((0, len(g)))
        y = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]) @ g
        return pd.DataFrame({"vec": [r.tobytes() for r in x.astype("<f8")], "proj": [r.tobytes() for r in y.astype("<f8")]})

    base = materialize(entries.withColumn("p", project("v")).select("ka", "kb", "ids", "p.vec", "p.proj"), "ann-entries")
    n = base.count()
    chosen = base if n <= SAMPLE else base.where(F.pmod(F.xxhash64("ka", "kb"), F.lit(1 << 40)) < int(SAMPLE / n * (1 << 40)))
    sample = chosen.select("proj", "ka").toPandas().sort_values("ka")
    size = max(CELL, n // CELLS)
    nodes, _ = _split(_vectors(sample.proj), max(LEAF, math.ceil(len(sample) * size / n)))
    low, high = _boxes(nodes)
    bound = chi_square_bound(M, CONFIDENCE)

    @F.pandas_udf("long")
    def cell_of(p: pd.Series) -> pd.Series:
        return pd.Series(_cells(nodes, _vectors(p))) if len(p) else pd.Series([], dtype="int64")

    base = base.withColumn("cell", cell_of("proj"))
    counts = base.groupBy("cell").agg(F.count("*").alias("n"))
    blocks = F.broadcast(counts.select("cell", F.ceil(F.col("n") / (2 * CELL)).alias("blocks")))  # one row a cell, CELLS at most
    points = base.join(blocks, "cell").withColumn("block", F.pmod("ka", "blocks")).drop("blocks")
    asked = rows.where("asks").select("id", "ka", "kb").distinct()
    keys = asked.select("ka", "kb").distinct()
    queries = materialize(base.join(keys, ["ka", "kb"]).select("ka", "kb", "vec", "proj", "cell"), "ann-queries")
    out = "qa long, qb long, ids array<long>, score double"
    none = pd.DataFrame({"qa": pd.Series(dtype="int64"), "qb": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})

    def searched(of: DataFrame) -> DataFrame:
        """``of``: queries with the cell to visit and the squared distance they needn't beat."""
        of = materialize(of, "ann-asked")
        turns = F.broadcast(of.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).alias("turns")))  # one row a cell
        dealt = of.join(blocks, "cell").join(turns, "cell").withColumn("turn", F.pmod(F.xxhash64("ka", F.lit(SEED)), "turns"))
        dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks", "turns")
        asked_points = points.join(turns, "cell").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).drop("turns")
        run = lambda p, q: _search(p, q, k + 1, bound) if len(p) and len(q) else none
        key = ["cell", "block", "turn"]
        return asked_points.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(run, out)

    def best(found: DataFrame) -> DataFrame:
        w = W.partitionBy("qa", "qb").orderBy(F.desc("score"), F.element_at("ids", 1))
        return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)

    first = materialize(searched(queries.withColumn("limit", F.lit(float("inf")))), "ann-first")
    limits = best(first).groupBy("qa", "qb").agg(F.when(F.count("*") > k, F.greatest(F.lit(0.0), 2 - 2 * F.min("score"))).otherwise(float("inf")).alias("limit"))
    todo = queries.join(limits, (queries.ka == limits.qa) & (queries.kb == limits.qb), "left").drop("qa", "qb").fillna(float("inf"), ["limit"])

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def cells_within(p: pd.Series, limit: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for q, far, mine in zip(_vectors(p) if len(p) else [], limit, own, strict=True):
            gap = np.maximum(0, np.maximum(low - q, q - high))
            hit = np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= bound * max(far, TIED))
            out.append(hit[hit != mine])
        return pd.Series(out, dtype=object)

    other = todo.withColumn("cell", F.explode(cells_within("proj", "limit", "cell")))
    found = best(first.unionByName(searched(other))).select("qa", "qb", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.join(found, (asked.ka == found.qa) & (asked.kb == found.qb)).where("id != vec_id")
    rank = W.partitionBy("id", "ka", "kb").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
