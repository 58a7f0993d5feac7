"""The experiment as a few plans over all units: from labelled rows to result rows.

A unit is (fold, condition, pipeline). Families choose their folds (stratified ones, blocks along the first component, clusters), only training
rows are perturbed, each unit fills and scales with its own training rows, scores its features on them, keeps those of its variant, and
every model fits all units at once. Feature sets are stored by unit with commit markers; a unit that is there is a cache
hit. Rows come out in the result schema.

Seconds of a shared job are given to units in proportion to their rows. With more than MAX_BASE columns the base columns are chosen on the clean rows.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.numeric import numeric_columns
from ..functions.shared import written
from ..operators.features import MAX_BASE, MAX_FEATURES, VARIANTS, base_columns, expression, generated, random_ranks
from ..operators.metrics import all_metrics, distances
from ..operators.models import batched
from ..operators.prepare import apply_numeric, fit_modes, fit_numeric, one_hot
from ..operators.profile import binned_information
from ..operators.shifts import PASSING, all_conditions, conditions
from ..operators.splits import covariate_folds, population_folds, stratified_folds
from ..operators.unit_models import class_names
from ..sources.tables import RESULT_SCHEMA, committed, materialise

UNIT = ["unit_fold", "condition"]
SET = ["dataset", "seed", "pipeline", "condition", "unit_fold"]
MODELS = ("gaussian_nb", "logistic_regression")
MOST_LEVELS, SET_ROWS = 1000, 1_000_000


def shifted_units(df: DataFrame, keys: list[str], target: str, chosen: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """All (fold, condition) units of the chosen conditions, each family over its own folds."""
    special = {"covariate_shift": covariate_folds, "population_shift": population_folds}
    families = {r.family for r in chosen.select("family").distinct().collect()}
    out = None
    for own, split in ((families - set(special), stratified_folds), *((families & {f}, s) for f, s in special.items())):
        if own:
            folded = written(split(df, keys, target, k=k, seed=seed), "folds")
            one = all_conditions(folded, keys, target, chosen.where(F.col("family").isin(sorted(own))), k=k, seed=seed)
            out = one if out is None else out.unionByName(one)
    return out


def prepared_units(shifted: DataFrame, keys: list[str], target: str) -> tuple[DataFrame, list[str]]:
    """Each unit filled and scaled with its training rows, texts as one column a level; and the names of the columns."""
    features = [c for c in shifted.columns if c not in (*keys, target, *UNIT, "role", "family", "severity")]
    numeric = [c for c in numeric_columns(shifted) if c in features]
    text = [c for c in features if c not in numeric]
    train = shifted.where("role = 'train'")
    out = shifted
    if text:
        modes = fit_modes(train, text, UNIT)
        out = out.join(F.broadcast(modes), UNIT).withColumns({c: F.coalesce(F.col(f"`{c}`").cast("string"), F.col(f"`{c}__mode`")) for c in text})  # one row a unit
    names = list(numeric)
    for c in text:
        known = [r[0] for r in shifted.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().orderBy(c).limit(MOST_LEVELS + 1).collect()]
        if len(known) > MOST_LEVELS:
            raise ValueError(f"{c} has more than {MOST_LEVELS} levels: prepare it with sparse_prepare")
        out = one_hot(out, c, known)
        names += [f"{c}_{v}" for v in known]
    out = apply_numeric(out, fit_numeric(train, numeric, UNIT), numeric, UNIT) if numeric else out
    return out.select(*UNIT, "role", *keys, target, *[F.col(f"`{c}`") for c in names]), names


def unit_scores(prepared: DataFrame, target: str, every: list[tuple], seed: int = 42) -> DataFrame:
    """(unit..., feature, variance, mi, random_rank) of every feature on each unit's training rows."""
    cell = lambda f: F.struct(F.lit(f[0]).alias("feature"), expression(f).alias("value"))
    long = prepared.where("role = 'train'").select(*UNIT, F.col(target).cast("string").alias("label"), F.explode(F.array(*[cell(f) for f in every])).alias("c"))
    long = long.select(*UNIT, "c.feature", F.round("c.value", 9).alias("value"), F.lit(None).cast("string").alias("level"), "label")
    variance = long.groupBy(*UNIT, "feature").agg(F.var_samp("value").alias("variance"))
    random = random_ranks(prepared.sparkSession, [f[0] for f in every], seed)
    return variance.join(binned_information(long, UNIT), [*UNIT, "feature"], "left").join(F.broadcast(random), "feature")  # one row a feature


def chosen_features(scores: DataFrame, every: list[tuple], pipelines: list[str], k: int = MAX_FEATURES) -> DataFrame:
    """(unit..., pipeline, picks: numbers of the features in ``every``, n_generated) of each unit and variant; ties by name."""
    pool = []
    for p in pipelines:
        made, method, primitives = VARIANTS[p]
        pool += [(p, method, i, f[0]) for i, f in enumerate(every) if f[1] == "identity" or (made and f[1] in primitives)]
    pools = scores.sparkSession.createDataFrame(pool, "pipeline string, method string, i int, feature string")  # variants x features
    value = F.when(F.col("method") == "variance", -F.round(F.coalesce("variance", F.lit(0.0)), 9)).when(F.col("method") == "mi", -F.round(F.coalesce("mi", F.lit(0.0)), 9)).when(F.col("method") == "random", F.col("random_rank"))
    w = W.partitionBy(*UNIT, "pipeline").orderBy("__v", "feature")
    ranked = scores.join(F.broadcast(pools), "feature").withColumn("__v", value).withColumn("__r", F.row_number().over(w))
    own = F.sort_array(F.collect_list(F.when((F.col("__r") <= k) | (F.col("method") == "none"), F.col("i"))))
    return ranked.groupBy(*UNIT, "pipeline").agg(own.alias("picks"), F.count("*").cast("int").alias("n_generated"))


def shift_distances(shifted: DataFrame, cols: list[str]) -> DataFrame:
    """E13 by unit. (unit..., wasserstein, ks_stat) between the clean and the perturbed training rows of a fold, means over columns; 0 where nothing is perturbed."""
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])).alias("s")
    train = shifted.where("role = 'train'")
    moved = train.where(~F.col("family").isin(*PASSING))
    names = moved.select("condition").distinct()
    clean = train.where("family = 'clean'").drop("condition").crossJoin(F.broadcast(names))  # the conditions: 14 rows at most
    both = moved.select(*UNIT, cell, F.lit(False).alias("first")).unionByName(clean.select(*UNIT, cell, F.lit(True).alias("first"))).select(*UNIT, "s.c", "s.x", "first")
    apart = distances(both, F.col("x"), F.col("first"), [*UNIT, "c"]).groupBy(*UNIT).agg(F.avg("wasserstein").alias("wasserstein"), F.avg("ks").alias("ks_stat"))
    same = train.where(F.col("family").isin(*PASSING)).select(*UNIT).distinct().select(*UNIT, F.lit(0.0).alias("wasserstein"), F.lit(0.0).alias("ks_stat"))
    return apart.unionByName(same)


def experiment(
    df: DataFrame, dataset: str, keys: list[str], target: str, chosen: DataFrame | None = None, pipelines: list[str] | None = None, models: tuple[str, ...] = MODELS,
    k: int = 5, seed: int = 42, most: int = MAX_FEATURES, path: str | None = None, positive: str = "1",
) -> DataFrame:
    """Result rows of one dataset and seed: every chosen condition, fold, pipeline and model.

    ``path``: where feature sets are kept by unit; without it they are made anew. Rows without a class are predicted, and count in no metric.
    """
    spark, pipelines = df.sparkSession, pipelines or list(VARIANTS)
    shifted = written(shifted_units(df, keys, target, conditions(spark) if chosen is None else chosen, k, seed), "shifted")
    prepared, names = prepared_units(shifted, keys, target)
    prepared = written(prepared, "prepared")
    began = time.time()
    base = base_columns(prepared.where("role = 'train'"), names, MAX_BASE)
    every = [f for f in generated(base) if f[3]]
    every = [(c, "identity", [c], 0) for c in names] + every
    picks = written(chosen_features(unit_scores(prepared, target, every, seed), every, pipelines, most), "picks")
    wide = picks.agg(F.max(F.size("picks"))).first()[0] or 0
    value = F.transform("picks", lambda i: F.col("__all")[i])
    sets = prepared.withColumn("__all", F.array(*[expression(f) for f in every])).join(F.broadcast(picks), UNIT)  # units x pipelines
    padded = F.concat(value, F.array_repeat(F.lit(0.0), F.lit(wide) - F.size("picks")))
    sets = sets.select(F.lit(dataset).alias("dataset"), F.lit(seed).alias("seed"), "pipeline", *UNIT, "role", *keys, target, padded.alias("x"), "n_generated", F.size("picks").alias("n_retained"))
    if path:
        done = committed(spark, path, SET)
        before = done.select(*SET, F.lit(True).alias("hit")) if done is not None else spark.createDataFrame([], T.StructType([sets.schema[c] for c in SET]).add("hit", "boolean"))
        before = written(before, "hits")
        parts = max(1, df.count() // SET_ROWS)
        sets = materialise(sets.repartition(*SET, F.pmod(F.xxhash64(*keys), F.lit(parts))), path, SET).where((F.col("dataset") == dataset) & (F.col("seed") == seed))
        asked = picks.select(*UNIT, "pipeline")
        sets = sets.join(F.broadcast(asked), [*UNIT, "pipeline"], "left_semi")
    else:
        sets = written(sets, "sets")
    synthesis = time.time() - began
    cols = [f"f{i}" for i in range(wide)]
    rows = sets.select(*SET, "role", *keys, target, *[F.col("x")[i].alias(c) for i, c in enumerate(cols)])
    about = sets.groupBy(*SET).agg(F.count("*").alias("__n"), F.max("n_generated").alias("n_generated"), F.max("n_retained").alias("n_retained"))
    about = about.join(F.broadcast(before), SET, "left") if path else about.withColumn("hit", F.lit(False))
    about = about.join(F.broadcast(shift_distances(shifted, [c for c in numeric_columns(shifted) if c not in (*keys, target, *UNIT, "severity")])), UNIT, "left")  # one row a unit
    about = written(about, "units")
    total = max(1, about.agg(F.sum("__n")).first()[0] or 0)
    out, labels = None, class_names(df, target)
    for name in models:
        began = time.time()
        pred = batched(rows, SET, keys, cols, target, name, seed, labels=labels)
        if pred is None:
            raise ValueError(f"{name} doesn't fit all units in one plan")
        train = time.time() - began
        began = time.time()
        pred = written(pred, "predictions")
        infer = time.time() - began
        measured = written(all_metrics(pred.where("y_true is not null"), [*SET, "role"], positive), "metrics")
        test = measured.where("role = 'test'").drop("role", "n")
        auc = measured.where("role = 'train'").select(*SET, F.col("roc_auc").alias("train_auc"))
        share = lambda s: F.lit(s) * F.col("__n") / total
        one = about.join(test, SET, "left").join(auc, SET, "left").withColumns({
            "fold": F.col("unit_fold"), "model": F.lit(name), "status": F.when(F.col("accuracy").isNotNull(), "success").otherwise("failed"), "train_time_s": share(train), "infer_time_s": share(infer),
            "autofe_gen_time_s": share(synthesis), "autofe_cache_hit": F.coalesce("hit", F.lit(False)), "ram_used_mb": F.lit(None), "test_auc": F.col("roc_auc"),
        }).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA.fields])
        out = one if out is None else out.unionByName(one)
    return out
