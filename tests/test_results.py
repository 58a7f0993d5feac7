"""The experiment from labelled rows to result rows, against one unit in one place."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from shiftkit.functions.shared import folder, written
from shiftkit.operators import compare, splits
from shiftkit.operators.shifts import conditions
from shiftkit.plans import results
from shiftkit.sources.tables import RESULT_SCHEMA


def table(spark, n=240):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        y = int(rng.integers(2))
        rows.append((i, float(rng.normal(y, 1)), float(rng.normal()), float(rng.normal(-y, 2)) if i % 20 else None, "ab"[int(rng.random() < 0.3 + 0.4 * y)] if i % 15 else None, str(y)))
    return spark.createDataFrame(rows, "k long, x double, w double, v double, s string, target string")


def bayes(train, test, classes):
    eps = 1e-9 * train[0].var(0).max()
    out = np.stack([np.log((train[1] == c).mean()) - (np.log(2 * np.pi * (train[0][train[1] == c].var(0) + eps)) / 2 + (test - train[0][train[1] == c].mean(0)) ** 2 / (2 * (train[0][train[1] == c].var(0) + eps))).sum(1) for c in classes])
    return np.array(classes)[out.argmax(0)]


def test_rows_of_all_units_and_their_cache(spark):
    df, path = table(spark), f"{folder(spark)}/sets-{uuid.uuid4().hex}"
    chosen = conditions(spark).where("family in ('clean', 'covariate_shift', 'population_shift', 'class_prior_shift') or condition in ('gaussian_noise_0.1', 'label_noise_0.2')")
    names = ["Raw", "Raw_Variance", "AutoFE_MI", "AutoFE_Random"]
    run = lambda: written(results.experiment(df, "made", ["k"], "target", chosen, names, k=3, most=6, path=path), "rows")
    rows = run()
    assert rows.schema.fieldNames() == RESULT_SCHEMA.fieldNames()
    got = {(r.condition, r.fold, r.pipeline, r.model): r for r in rows.collect()}
    assert len(got) == 6 * 3 * 4 * 2 and all(r.status == "success" and not r.autofe_cache_hit for r in got.values())
    assert all(0 < r.train_time_s and 0 < r.infer_time_s and 0 < r.autofe_gen_time_s for r in got.values())
    assert {(r.pipeline, r.n_generated, r.n_retained) for r in got.values()} == {("Raw", 5, 5), ("Raw_Variance", 5, 5), ("AutoFE_MI", 55, 6), ("AutoFE_Random", 55, 6)}
    for r in got.values():
        moved = r.condition.startswith("gaussian")  # labels aren't features
        assert (r.wasserstein > 0) == moved and (r.ks_stat > 0) == moved
        assert abs(r.test_auc - r.roc_auc) < 1e-12 and 0.5 < r.train_auc <= 1
    # One unit in one place.
    folded = splits.stratified_folds(df, ["k"], "target", 3).toPandas().sort_values("k")
    numbers = folded[["x", "w", "v"]].to_numpy()
    for fold in (1, 2, 3):
        tr, te = (folded.fold != fold).to_numpy(), (folded.fold == fold).to_numpy()
        mean = np.nanmean(numbers[tr], 0)
        filled = np.where(np.isnan(numbers), mean, numbers)
        filled = (filled - mean) / filled[tr].std(0)
        texts = folded.s.fillna(folded.s[tr].mode()[0])
        x = np.column_stack([filled, texts == "a", texts == "b"]).astype(float)
        y = folded.target.to_numpy()
        pred = bayes((x[tr], y[tr]), x[te], ["0", "1"])
        r = got["clean", fold, "Raw", "gaussian_nb"]
        tp = ((pred == "1") & (y[te] == "1")).sum()
        assert abs(r.accuracy - (pred == y[te]).mean()) < 1e-9 and abs(r.f1 - 2 * tp / ((pred == "1").sum() + (y[te] == "1").sum())) < 1e-9
    again = {(r.condition, r.fold, r.pipeline, r.model): r for r in run().collect()}
    assert all(r.autofe_cache_hit for r in again.values()) and {k: round(r.f1, 9) for k, r in again.items()} == {k: round(r.f1, 9) for k, r in got.items()}
    assert compare.robustness(rows, b="AutoFE_MI").count() == 2


def test_rows_without_a_class_and_empty_tables(spark):
    df = table(spark, 60).withColumn("target", F.when(F.col("k") % 10 != 0, F.col("target")))
    chosen = conditions(spark).where("family = 'clean'")
    rows = results.experiment(df, "made", ["k"], "target", chosen, ["Raw"], ("gaussian_nb", "logistic_regression", "random_forest"), k=2).collect()
    assert len(rows) == 6 and all(r.accuracy is not None for r in rows)
