"""A. Shapley attribution of scoring functions, as joins and means."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import digest
from ..functions.numeric import finite
from ..sources.tables import cap_rows
from .clusters import kmeans


def evaluation_sample(df: DataFrame, keys: list[str], n: int = 500, seed: int = 42) -> DataFrame:
    """A1."""
    return cap_rows(df, keys, n, seed)


def background(df: DataFrame, keys: list[str], cols: list[str], k: int = 100, seed: int = 42) -> DataFrame:
    """A2. k cluster centres of the columns; all rows, if there are no more."""
    rows = df.select(*[F.coalesce(finite(F.col(f"`{c}`")), F.lit(0.0)).alias(c) for c in cols])
    if rows.limit(k + 1).count() <= k:
        return rows
    centres = kmeans(df.select(*keys, F.array(*[F.coalesce(finite(F.col(f"`{c}`")), F.lit(0.0)) for c in cols]).alias("x")), keys, k, seed=seed)
    return df.sparkSession.createDataFrame([tuple(float(x) for x in c) for c in centres], ", ".join(f"`{c}` double" for c in cols))


def linear_importance(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """A3a, A4. (feature, importance) of a linear score in closed form: mean of |w (x - mean)|, largest first."""
    means = df.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in weights])
    renamed = means.select(*[F.col(f"`{c}`").alias(f"__m{i}") for i, c in enumerate(weights)])
    one = df.crossJoin(F.broadcast(renamed)).agg(*[F.avg(F.abs(w * (F.col(f"`{c}`") - F.col(f"__m{i}")))).alias(c) for i, (c, w) in enumerate(weights.items())])
    return one.unpivot([], list(weights), "feature", "importance").orderBy(F.desc("importance"), "feature")


def sampled_importance(sample: DataFrame, reference: DataFrame, keys: list[str], cols: list[str], score: Callable[[DataFrame], DataFrame], permutations: int = 8, seed: int = 42) -> DataFrame:
    """A3b, A4. (feature, importance) of any score: along random orders, features change from a reference row's to the row's.

    ``score`` adds ``score`` to a table of ``cols``. Sample, reference (A1, A2) and permutations are bounded parameters.
    """
    spark = sample.sparkSession
    rng = np.random.default_rng(seed)
    orders = spark.createDataFrame([(p, [int(i) for i in rng.permutation(len(cols))]) for p in range(permutations)], "p int, o array<int>")
    x = sample.select(F.struct(*keys).alias("__key"), F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("__x"))
    r = reference.select(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("__r")).withColumn("__i", digest("reference", "__r").substr(1, 12))
    numbered = r.select("__r", (F.row_number().over(W.orderBy("__i", "__r")) - 1).alias("__n"))  # bounded by A2
    m = max(1, reference.count())
    # Each row meets as many references as there are permutations, picked by hash.
    picks = x.crossJoin(F.broadcast(orders)).withColumn("__n", F.pmod(F.xxhash64(F.lit(seed), "__key", "p"), F.lit(m)).cast("int"))
    met = picks.join(numbered, "__n").drop("__n")
    steps = met.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(cols)))))
    place = lambda i: F.array_position("o", F.lit(i)) <= F.col("step")
    mixed = steps.select("__key", "p", "o", "step", *[F.when(place(i), F.col("__x")[i]).otherwise(F.col("__r")[i]).alias(c) for i, c in enumerate(cols)])
    scored = score(mixed).select("__key", "p", "o", "step", "score")
    path = scored.groupBy("__key", "p", "o").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "score"))), lambda s: s["score"]).alias("s"))  # d + 1 scores
    gain = path.select("__key", F.posexplode("o").alias("k", "f"), "s").select("__key", "f", (F.element_at("s", F.col("k") + 2) - F.element_at("s", F.col("k") + 1)).alias("g"))
    each = gain.groupBy("__key", "f").agg(F.avg("g").alias("g"))
    names = F.array(*[F.lit(c) for c in cols])
    return each.groupBy(F.element_at(names, F.col("f") + 1).alias("feature")).agg(F.avg(F.abs("g")).alias("importance")).orderBy(F.desc("importance"), "feature")


def meta_importance(meta: DataFrame, cols: list[str], delta: str, seed: int = 42) -> DataFrame:
    """A5. Which profile values a gain depends on: a forest of 100 trees of depth 5, then A3b; needs five datasets."""
    rows = meta.where(F.col(delta).isNotNull()).fillna(0.0, cols)
    if rows.count() < 5:
        raise ValueError("fewer than five datasets")
    vec = array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]))
    model = RandomForestRegressor(featuresCol="v", labelCol="y", predictionCol="score", numTrees=100, maxDepth=5, seed=seed).fit(rows.select(vec.alias("v"), F.col(delta).alias("y")))
    reference = background(rows, ["dataset"], cols, 100, seed)
    return sampled_importance(rows, reference, ["dataset"], cols, lambda d: model.transform(d.withColumn("v", vec)), seed=seed)


