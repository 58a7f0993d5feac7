"""X. Folds as a column; train is the other folds, test is the fold."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.keys import dist_rank, u
from ..functions.numeric import finite
from .clusters import LLOYD_ROUNDS, PLACES, kmeans, nearest_centre
from .profile import correlations


def holdout(df: DataFrame, keys: list[str], target: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """X1. Adds ``side``; stratified only with two classes or more, each of two rows or more."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).count()
    c = counts.agg(F.count("*").alias("k"), F.min("count").alias("m")).first()
    part = [target] if c.k > 1 and c.m > 1 else []
    ranked = dist_rank(df, u("holdout", *keys, seed=seed), keys, part, "__rank", uniform=True)
    sizes = df.groupBy(*part).agg(F.count("*").alias("__n"))
    sized = ranked.join(F.broadcast(sizes.withColumnRenamed(target, "__t")), F.col(target).eqNullSafe(F.col("__t"))).drop("__t") if part else ranked.crossJoin(F.broadcast(sizes))
    return sized.withColumn("side", F.when(F.col("__rank") <= F.ceil(F.lit(share) * F.col("__n")), "test").otherwise("train")).drop("__rank", "__n")


def plain_folds(df: DataFrame, keys: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """X3. Adds ``fold`` 1..k by the rank of a hash."""
    return dist_rank(df, u("fold", *keys, seed=seed), keys, None, "__rank", uniform=True).withColumn("fold", ((F.col("__rank") - 1) % k + 1).cast("int")).drop("__rank")


def stratified_folds(df: DataFrame, keys: list[str], target: str, k: int = 5, seed: int = 42) -> DataFrame:
    """X2. One order by class and hash, dealt to folds in turn; plain folds if a class has fewer than k rows."""
    counts = df.groupBy(target).agg(F.count("*").alias("__n"))
    least = counts.where(F.col(target).isNotNull()).agg(F.min("__n")).first()[0]
    if least is None or least < k:
        return plain_folds(df, keys, k, seed)
    before = counts.withColumn("__o", F.coalesce(F.sum("__n").over(W.orderBy(F.asc_nulls_last(target)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = dist_rank(df, u("fold", *keys, seed=seed), keys, [target], "__rank", uniform=True)
    offset = F.broadcast(before.select(F.col(target).alias("__t"), "__o"))  # one row a class
    joined = ranked.join(offset, F.col(target).eqNullSafe(F.col("__t")))
    return joined.withColumn("fold", ((F.col("__rank") + F.col("__o") - 1) % k + 1).cast("int")).drop("__rank", "__o", "__t")


def _features(df: DataFrame, keys: list[str], target: str | None) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys and f.name != target]


def _standardised(df: DataFrame, cols: list[str]) -> dict[str, F.Column]:
    """Missing as 0, mean 0 and population sd 1 (constant columns 0)."""
    x = {c: F.coalesce(finite(F.col(f"`{c}`")), F.lit(0.0)) for c in cols}
    s = df.agg(*[f(x[c]).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (x[c] - s[f"m{i}"]) / (s[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def first_component(df: DataFrame, cols: list[str]) -> list[float]:
    """Loadings of the first principal component of the standardised columns, the largest one positive."""
    filled = df.select(*[F.coalesce(finite(F.col(f"`{c}`")), F.lit(0.0)).alias(c) for c in cols])
    r = np.zeros((len(cols), len(cols)))
    for x in correlations(filled, cols).collect():  # columns squared, not rows
        if x.r is not None:
            r[x.i, x.j] = r[x.j, x.i] = x.r
            r[x.i, x.i] = r[x.j, x.j] = 1.0
    if not r.any():
        r = np.eye(len(cols))
    v = np.linalg.eigh(r)[1][:, -1]
    v = v * np.sign(v[np.argmax(np.abs(v) - 1e-9 * np.arange(len(v)))])
    return [float(x) for x in v]


def covariate_folds(df: DataFrame, keys: list[str], target: str, k: int = 5, seed: int = 42, include_target: bool = False) -> DataFrame:
    """X4. k contiguous blocks along the first principal component; plain folds without a numeric column."""
    cols = _features(df, keys, None if include_target else target)
    if not cols:
        return plain_folds(df, keys, k, seed)
    if len(cols) == 1:
        loadings = [1.0]
    else:
        loadings = first_component(df, cols)
    z = _standardised(df, cols)
    score = F.round(sum((z[c] * w for c, w in zip(cols, loadings, strict=True)), F.lit(0.0)), 9)
    ranked = dist_rank(df, score, keys, None, "__rank")
    n = df.count()
    small, more = n // k, n % k  # ntile: the first ``more`` blocks have one row more
    edge = more * (small + 1)
    r = F.col("__rank") - 1
    fold = F.when(r < edge, F.floor(r / (small + 1))).otherwise(more + F.floor((r - edge) / max(1, small))) + 1
    return ranked.withColumn("fold", fold.cast("int")).drop("__rank")


def population_folds(df: DataFrame, keys: list[str], target: str, k: int = 5, seed: int = 42, include_target: bool = False, rounds: int = LLOYD_ROUNDS) -> DataFrame:
    """X5. Each of k clusters is a fold; an empty cluster's fold takes a fifth of the rows by hash (they leave theirs)."""
    cols = _features(df, keys, None if include_target else target)
    if not cols:
        return plain_folds(df, keys, k, seed)
    z = _standardised(df, cols)
    points = df.withColumn("__x", F.array(*[F.round(z[c], PLACES) for c in cols]))
    centres = kmeans(points.select(*keys, F.col("__x").alias("x")), keys, k, rounds, seed)
    if not centres:
        return df.withColumn("fold", F.lit(1))
    got = points.withColumn("fold", nearest_centre("__x", centres) + 1).drop("__x")
    there = {r.fold for r in got.select("fold").distinct().collect()}
    for empty in sorted(set(range(1, k + 1)) - there):
        got = got.withColumn("fold", F.when(u(f"empty{empty}", *keys, seed=seed) < 0.2, empty).otherwise(F.col("fold")).cast("int"))
    return got


def fold_views(df: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    """X6. Train and test of fold i."""
    return df.where(F.col("fold") != i), df.where(F.col("fold") == i)


def all_folds(df: DataFrame, k: int) -> DataFrame:
    """X6. Every row once a fold, with its role in it."""
    folds = df.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("unit_fold"))
    return df.crossJoin(F.broadcast(folds)).withColumn("role", F.when(F.col("fold") == F.col("unit_fold"), "test").otherwise("train"))


