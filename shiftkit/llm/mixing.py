"""Mixing sources to target weights by temperature.

Each source's share of all tokens is raised to an exponent between 0 (all alike) and 1 (as they are) and
normalised. The exponent is found by bisection: the largest that reaches the target entropy, but never so small
that a source is repeated more often than the limit. The weights are realised as budgets of tokens: a source is
taken in whole permutations of its documents, and a last one up to its budget. All sources are spread over
blocks in proportion, and each block is permuted.

Without a budget it is the smallest that takes every document once at least: nothing is dropped, small sources
repeat. Permutations are orders of hashes of (seed, epoch, document), so they don't depend on partitions.

Defined results: a null source is a source of its own; a document counts one token at least (null and empty
text too); rows alike in all columns are one document whose tokens count together; an empty table gives an empty
result; other columns are carried along or ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import materialize, salted_prefix

ENTROPY, REPEATS, BLOCK_TOKENS, SEED = 0.98, 2.0, 1_000_000, 17


def words(text: str) -> Column:
    """White-space separated words of a column, one at least."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0))).cast("long")


def _weights(tokens: np.ndarray, tau: float) -> np.ndarray:
    x = tau * np.log(tokens / tokens.sum())
    w = np.exp(x - x.max())
    return w / w.sum()


def _bisect(holds, low: float, high: float) -> float:
    """The edge of ``holds``, which is true at ``low`` and false at ``high``."""
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def temperature(tokens: np.ndarray, entropy: float, repeats: float, budget: float | None) -> tuple[float, np.ndarray, float]:
    """Exponent, weights and budget; ``entropy`` is a share of the largest possible one."""
    tokens = np.asarray(tokens, float)
    goal = entropy * math.log(len(tokens))

    def reaches(tau: float) -> bool:
        w = _weights(tokens, tau)
        return -(w * np.log(w)).sum() >= goal - 1e-12

    def total(w: np.ndarray) -> float:
        return budget if budget is not None else float((tokens / w).max())

    def too_often(tau: float) -> bool:
        w = _weights(tokens, tau)
        return (w * total(w) / tokens).max() > repeats + 1e-9

    tau = 1.0 if reaches(1.0) else _bisect(reaches, 0.0, 1.0)
    if too_often(tau) and not too_often(1.0):  # repetition falls as the exponent grows
        tau = 1.0 - _bisect(lambda x: not too_often(1.0 - x), 0.0, 1.0 - tau)
    w = _weights(tokens, tau)
    return tau, w, total(w)


def placements(rows: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """rows(key..., source, n) -> the same with epoch, block, place: one row for each time a document is taken."""
    spark, keys = rows.sparkSession, [c for c in rows.columns if c not in ("source", "n")]
    sources = rows.groupBy("source").agg(F.sum("n").alias("t")).orderBy("source").collect()
    schema = T.StructType([rows.schema["source"]]).add("s_tokens", "long").add("s_budget", "long")
    if not sources:
        return rows.select("*", *[F.lit(0).cast("long").alias(c) for c in ("epoch", "block", "place")])
    _, w, total = temperature(np.array([r.t for r in sources]), entropy, repeats, budget)
    plan = spark.createDataFrame([(r.source, r.t, round(x * total)) for r, x in zip(sources, w, strict=True)], schema).withColumnRenamed("source", "s_source")
    blocks = max(1, math.ceil(total / BLOCK_TOKENS))
    full = (F.col("s_budget") / F.col("s_tokens")).cast("long")
    taken = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")  # one row a source
    taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), full)))
    order = F.xxhash64(F.lit(seed), "epoch", *keys)
    summed = salted_prefix(taken.withColumn("__h", order), ["source", "epoch"], ["__h", *keys], "n", "__start")
    at = F.col("epoch") * F.col("s_tokens") + F.col("__start")
    kept = summed.where(at + F.col("n") <= F.col("s_budget"))
    kept = kept.withColumn("block", F.least(F.lit(blocks - 1).cast("long"), (at / F.col("s_budget") * blocks).cast("long")))
    mixed = W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "block", "epoch", *keys), *keys, "epoch")
    return kept.withColumn("place", F.row_number().over(mixed).cast("long")).select(*rows.columns, "epoch", "block", "place")


def mix(docs: DataFrame, n: Column, source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken, with __epoch, __block and __place."""
    key = F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns)
    keyed = docs.select("*", key[0].alias("__a"), key[1].alias("__c"))
    slim = keyed.select("__a", "__c", F.col(source_col).alias("source"), n.alias("n")).groupBy("__a", "__c", "source").agg(F.sum("n").alias("n"))
    placed = placements(materialize(slim, "mix-rows"), **how).select("__a", "__c", F.col("epoch").alias("__epoch"), F.col("block").alias("__block"), F.col("place").alias("__place"))
    return keyed.join(placed, ["__a", "__c"]).select(*docs.columns, "__epoch", "__block", "__place")
