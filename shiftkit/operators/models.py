"""T. Classifiers: naive Bayes, logistic regression and trees over all units at once, nearest neighbours, the others by MLlib."""

from __future__ import annotations

import math
import time

from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import u
from ..functions.shared import written
from .neighbours import all_pairs, nearest_rows, pivots_for
from .trees import tree_units
from .unit_models import class_names, logistic_units

#: Tree models by the grid's names.
TREES = {"random_forest": "random_forest", "extra_trees": "extra_trees", "gradient_boosting": "gradient_boosting", "xgboost": "gradient_boosting", "lightgbm": "gradient_boosting", "catboost": "gradient_boosting"}


def naive_bayes(df: DataFrame, keys: list[str], cols: list[str], target: str, unit: list[str], role: str = "role", smoothing: float = 1e-9, labels: list[str] | None = None) -> DataFrame:
    """T6, T10. (unit..., keys..., role, y_true, y_pred, proba): fitted on each unit's training rows, in one plan.

    A unit's class statistics are one wide row (its size is classes x columns), so likelihoods are plain arithmetic on
    each row and no row is multiplied. Ties go to the smaller label; a class absent from a unit can't win there.
    """
    labels = labels or class_names(df, target) or ["0"]
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    y = F.col(target).cast("string")
    train = df.where((F.col(role) == "train") & F.col(target).isNotNull())
    stats = [F.count("*").alias("__n"), F.greatest(F.lit(0.0), *[F.var_pop(x[c]) for c in cols]).alias("__eps")]
    for k, label in enumerate(labels):
        stats.append(F.count_if(y == label).alias(f"__n{k}"))
        for i, c in enumerate(cols):
            own = F.when(y == label, x[c])
            stats += [F.avg(own).alias(f"__m{k}_{i}"), F.var_pop(own).alias(f"__v{k}_{i}")]
    models = written(train.groupBy(*unit).agg(*stats), "bayes")  # one row a unit, asked for with each use of the predictions
    joined = df.join(F.broadcast(models), unit)  # one row a unit
    eps = F.greatest(F.lit(1e-300), F.lit(smoothing) * F.col("__eps"))
    likely = []
    for k in range(len(labels)):
        ll = F.log(F.when(F.col(f"__n{k}") > 0, F.col(f"__n{k}") / F.col("__n")))
        for i, c in enumerate(cols):
            v, d = F.col(f"__v{k}_{i}") + eps, x[c] - F.col(f"__m{k}_{i}")
            ll = ll - F.coalesce(F.log(v * (2 * math.pi)) / 2 + d * d / (2 * v), F.lit(0.0))
        likely.append(F.coalesce(ll, F.lit(-1e300)).alias(f"__l{k}"))
    scored = joined.select(*unit, *keys, role, y.alias("y_true"), *likely)
    names = [f"__l{k}" for k in range(len(labels))]
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    scored = scored.withColumn("__best", best)
    total = sum((F.exp(F.col(n) - F.col("__best")) for n in names), F.lit(0.0))
    label = F.coalesce(*[F.when(F.col(n) == F.col("__best"), F.lit(v)) for n, v in zip(names, labels, strict=True)])
    proba = F.create_map(*[e for n, v in zip(names, labels, strict=True) for e in (F.lit(v), F.exp(F.col(n) - F.col("__best")) / F.col("__total"))])
    return scored.withColumn("__total", total).select(*unit, *keys, role, "y_true", label.alias("y_pred"), proba.alias("proba"))


def knn(df: DataFrame, keys: list[str], cols: list[str], target: str, k: int = 5, role: str = "role", most: int = 200_000, counts: bool = False) -> DataFrame:
    """T5. Exact k nearest training rows by squared distance, ties by key; majority vote, ties to the smaller label.

    Of a training side of at most ``most`` rows every block is compared; of a larger one cells that lie too far are left out.
    ``counts`` adds how many training rows each test row was compared with.
    """
    vec = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cols])
    train = df.where(F.col(role) == "train").select(*[F.col(c).alias(f"t_{c}") for c in keys], F.col(target).cast("string").alias("t_y"), vec.alias("t_x"))
    test = df.where(F.col(role) == "test").select(*[F.col(c).alias(f"q_{c}") for c in keys], F.col(target).cast("string").alias("y_true"), vec.alias("q_x"))
    n, asks = train.count(), [f"q_{c}" for c in keys]
    if n > most:
        top = nearest_rows(train, test, keys, k, pivots_for(n))
    else:
        near = all_pairs(train, test, keys, k).withColumns({"d": F.round("d", 9), "compared": F.lit(n)})
        top = near.withColumn("r", F.row_number().over(W.partitionBy(*asks).orderBy("d", *[f"t_{c}" for c in keys]))).where(F.col("r") <= k)
    votes = top.groupBy(*asks, "y_true", "t_y").agg(F.count("*").alias("n"), F.max("compared").alias("compared"))
    ranked = votes.withColumn("r", F.row_number().over(W.partitionBy(*asks).orderBy(F.desc("n"), "t_y"))).where("r = 1")
    return ranked.select(*[F.col(f"q_{c}").alias(c) for c in keys], "y_true", F.col("t_y").alias("y_pred"), (F.col("n") / k).alias("share"), *(["compared"] if counts else []))


def build_model(name: str, d: int, classes: int, seed: int = 42):
    """T4, T7. An MLlib estimator by name."""
    cols = {"featuresCol": "features", "labelCol": "label"}
    if name == "linear_svm":
        return LinearSVC(**cols, maxIter=100)  # of two classes; fit_score sees to more
    if name == "mlp":
        return MultilayerPerceptronClassifier(**cols, layers=[d, 100, classes], seed=seed, maxIter=100)
    raise ValueError(f"unknown model {name}")


def points(df: DataFrame, keys: list[str], cols: list[str], target: str) -> tuple[DataFrame, list]:
    """Rows as (keys..., role, features, label); classes are numbered in sort order."""
    classes = [r[0] for r in df.where(F.col(target).isNotNull()).select(target).distinct().orderBy(target).collect()]
    code = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    kept = [*keys, *[c for c in ("role",) if c in df.columns]]
    return df.select(*kept, array_to_vector(F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cols])).alias("features"), code[F.col(target)].alias("label")), classes


def batched(df: DataFrame, unit: list[str], keys: list[str], cols: list[str], target: str, name: str, seed: int = 42, rounds: int = 100, labels: list[str] | None = None) -> DataFrame | None:
    """T1 to T3, T6, T10. Predictions of a model that fits all units in one plan; None for the others."""
    if name == "logistic_regression":
        return logistic_units(df, keys, cols, target, unit, labels=labels)
    if name in TREES:
        return tree_units(df, keys, cols, target, unit, TREES[name], trees=rounds, seed=seed, labels=labels)
    if name in ("gaussian_nb", "naive_bayes"):
        one = df if unit else df.withColumn("__one", F.lit(1))
        got = naive_bayes(one, keys, cols, target, unit or ["__one"], labels=labels)
        return got if unit else got.drop("__one")
    return None


def fit_score(df: DataFrame, keys: list[str], cols: list[str], target: str, name: str, seed: int = 42, rounds: int = 100) -> tuple[DataFrame, dict[str, float]]:
    """T8, T9. Fit on role = train, predict both roles: (keys..., role, y_true, y_pred, proba), and the seconds it took.

    ``rounds``: trees of a forest or boosting model. Any name of the grid will do; "knn" predicts test rows only.
    """
    began = time.time()
    if name == "knn":
        got = knn(df, keys, cols, target)
        names = class_names(df, target)
        proba = F.map_from_arrays(F.array(*[F.lit(v) for v in names]), F.array(*[F.when(F.col("y_pred") == v, F.col("share")).otherwise((1 - F.col("share")) / max(1, len(names) - 1)) for v in names]))
        return got.select(*keys, F.lit("test").alias("role"), "y_true", "y_pred", proba.alias("proba")), {"train_time_s": time.time() - began}
    together = batched(df, [], keys, cols, target, name, seed, rounds)
    if together is not None:
        return together, {"train_time_s": time.time() - began}
    rows, classes = points(df, keys, cols, target)
    train = rows.where((F.col("role") == "train") & F.col("label").isNotNull())
    if name == "linear_svm" and len(classes) == 2:
        model, extra = _calibrated_svm(train, keys, seed)
        got = extra(model.transform(rows))
    elif name == "linear_svm" and len(classes) > 2:
        got = _one_against_rest(train, rows, keys, len(classes), seed)
    else:
        model = build_model(name, len(cols), len(classes), seed).fit(train)
        got = model.transform(rows)
    seconds = {"train_time_s": time.time() - began}
    names = F.array(*[F.lit(str(c)) for c in classes])
    at = lambda c: F.element_at(names, F.col(c).cast("int") + 1)
    proba = F.col("__proba") if "__proba" in got.columns else vector_to_array("probability") if "probability" in got.columns else F.array(*[F.lit(0.0) for _ in classes])
    return got.select(*keys, "role", F.when(F.col("label").isNotNull(), at("label")).alias("y_true"), at("prediction").alias("y_pred"), F.map_from_arrays(names, proba).alias("proba")), seconds


def _one_against_rest(train: DataFrame, rows: DataFrame, keys: list[str], classes: int, seed: int) -> DataFrame:
    """T4 for more than two classes: each class' probability against the rest, together 1; ties go to the smaller class."""
    got = rows
    for k in range(classes):
        side = train.withColumn("label", (F.col("label") == k).cast("double"))
        model, extra = _calibrated_svm(side, keys, seed)
        scored = extra(model.transform(got))
        got = scored.select(*got.columns, vector_to_array("probability")[1].alias(f"__c{k}"))
    total = sum((F.col(f"__c{k}") for k in range(classes)), F.lit(0.0))
    each = [F.when(total > 0, F.col(f"__c{k}") / total).otherwise(1.0 / classes) for k in range(classes)]
    got = got.withColumn("__proba", F.array(*each)).drop(*[f"__c{k}" for k in range(classes)])
    return got.withColumn("prediction", (F.array_position("__proba", F.array_max("__proba")) - 1).cast("double"))


def _calibrated_svm(train: DataFrame, keys: list[str], seed: int, cv: int = 3):
    """T4. A linear SVM, and a sigmoid of its margin fitted on margins of folds that weren't trained on."""
    folded = train.withColumn("__f", F.floor(u("svm", *keys, seed=seed) * cv))
    margins = None
    make = lambda: LinearSVC(featuresCol="features", labelCol="label", maxIter=100)
    for i in range(cv):
        side = make().fit(folded.where(F.col("__f") != i)).transform(folded.where(F.col("__f") == i))
        one = side.select(F.array(vector_to_array("rawPrediction")[1]).alias("m"), "label")
        margins = one if margins is None else margins.unionByName(one)
    sigmoid = LogisticRegression(featuresCol="m", labelCol="label", predictionCol="p2", probabilityCol="probability", rawPredictionCol="r2").fit(margins.withColumn("m", array_to_vector("m")))
    model = make().fit(train)
    return model, lambda got: sigmoid.transform(got.withColumn("m", array_to_vector(F.array(vector_to_array("rawPrediction")[1])))).withColumn("prediction", F.col("p2"))


def over_units(df: DataFrame, unit: list[str], keys: list[str], cols: list[str], target: str, name: str) -> DataFrame:
    """T10. Predictions of every unit: one plan for all units where the model has one, else a fit for each."""
    together = batched(df, unit, keys, cols, target, name)
    if together is not None:
        return together
    out = None
    for r in df.select(*unit).distinct().orderBy(*unit).collect():
        one = df.where(" and ".join(f"`{c}` <=> {r[c]!r}" for c in unit))
        got = fit_score(one, keys, cols, target, name)[0].select(*[F.lit(r[c]).alias(c) for c in unit], "*")
        out = got if out is None else out.unionByName(got)
    return out
