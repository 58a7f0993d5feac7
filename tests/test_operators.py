"""Hand-made tables, properties, and independence of partitions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shiftkit.functions import keys as K
from shiftkit.functions import numeric as N
from shiftkit.operators import compare as C
from shiftkit.operators import features as X
from shiftkit.operators import metrics as M
from shiftkit.operators import prepare as P
from shiftkit.operators import profile as R
from shiftkit.operators import shifts as H
from shiftkit.operators import splits as S
from shiftkit.sources import tables as T


def numbers(spark, n=500):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 7919 % 101).cast("double").alias("x"), (F.col("id") % 3).cast("int").alias("target"))


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_rank_is_that_of_one_window(spark, parts):
    got = {r.k: r.rank for r in K.dist_rank(numbers(spark).repartition(parts), F.col("x"), ["k"]).collect()}
    rows = sorted(numbers(spark).collect(), key=lambda r: (r.x, r.k))
    assert got == {r.k: i + 1 for i, r in enumerate(rows)}


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_perturbations_do_not_depend_on_partitions(spark, parts):
    noisy = lambda df: sorted((r.k, round(r.x, 9)) for r in H.gaussian_noise(df, ["k"], 0.1, ["x"]).collect())
    assert noisy(numbers(spark).repartition(parts)) == noisy(numbers(spark).coalesce(1))


def test_uniform_mean_and_range(spark):
    r = spark.range(20_000).agg(F.avg(K.u("t", "id")), F.min(K.u("t", "id")), F.max(K.u("t", "id")), F.avg(K.z("t", "id")), F.stddev(K.z("t", "id"))).first()
    assert abs(r[0] - 0.5) < 0.01 and r[1] >= 0 and r[2] < 1 and abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.03


def test_folds_partition_the_rows(spark):
    counts = {r.fold: r["count"] for r in S.stratified_folds(numbers(spark, 503), ["k"], "target").groupBy("fold").count().collect()}
    assert sum(counts.values()) == 503 and max(counts.values()) - min(counts.values()) <= 1
    blocks = [r["count"] for r in S.covariate_folds(numbers(spark, 23), ["k"], "target").groupBy("fold").count().orderBy("fold").collect()]
    assert blocks == [5, 5, 5, 4, 4]
    rare = numbers(spark, 13).withColumn("target", F.when(F.col("k") < 3, "b").otherwise("a"))
    assert S.stratified_folds(rare, ["k"], "target").count() == 13


def test_label_shifts(spark):
    df = numbers(spark, 900)
    before = {r.k: r.target for r in df.collect()}
    after = {r.k: r.target for r in H.label_noise(df, ["k"], "target", 1.0).collect()}
    assert all(after[k] != before[k] for k in before)
    moved = {r.k: r.target for r in H.class_prior_shift(df.withColumn("target", F.when(F.col("k") < 500, 0).otherwise(1)), ["k"], "target").collect()}
    assert sum(moved[k] == 1 for k in range(500)) == 250 and all(moved[k] == 1 for k in range(500, 900))
    one = df.withColumn("target", F.lit(1))
    assert H.label_noise(one, ["k"], "target", 0.5).agg(F.min("target")).first()[0] == 1
    assert H.class_prior_shift(one, ["k"], "target").agg(F.min("target")).first()[0] == 1
    lost = H.missing_values(df, ["k"], 0.2, ["x"]).agg(F.count_if(F.col("x").isNull())).first()[0] / 900
    assert abs(lost - 0.2) < 4 * math.sqrt(0.2 * 0.8 / 900)
    with pytest.raises(ValueError):
        H.apply_shift(df, ["k"], "target", "none")


def test_unseen_and_missing_levels(spark):
    train = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "a", 3.0)], "k int, c string, x double").withColumn("target", F.col("k") % 2)
    test = spark.createDataFrame([(4, "a", 5.0), (5, "c", None), (6, None, 1.0)], "k int, c string, x double").withColumn("target", F.col("k") % 2)
    got = {r.k: (r.c_a, r.c_b, round(r.x, 4)) for r in P.prepare(train, test, ["k"], "target")[1].collect()}
    assert got == {4: (1.0, 0.0, 3.6742), 5: (0.0, 0.0, 0.0), 6: (1.0, 0.0, -1.2247)}
    assert {r.k: r.c for r in P.prepare(train, test, ["k"], "target", "label")[1].collect()} == {4: 0.0, 5: -1.0, 6: 0.0}
    with pytest.raises(ValueError):
        P.prepare(train, test, ["k"], "target", "none")
    empty = spark.createDataFrame([(1, None, None)], "k int, x double, c string").withColumn("target", F.lit(0))
    with pytest.raises(ValueError):
        P.prepare(empty, empty, ["k"], "target")


def test_constant_columns_and_empty_tables(spark):
    df = numbers(spark, 100).withColumn("one", F.lit(1.0))
    p = R.profile(df, "target", ["k"]).first()
    assert p.number_of_samples == 100 and p.average_correlation == 0 and p.intrinsic_dimension == 1 and p.number_of_classes == 3
    none = R.profile(df.limit(0), "target", ["k"]).first()
    assert none.number_of_samples == 0 and none.missing_percent is None


def test_intrinsic_dimension_counts_components(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((400, 2))
    wide = np.column_stack([base, base @ [1.0, 1.0], base @ [1.0, -1.0]])
    df = spark.createDataFrame(wide.tolist(), "a double, b double, c double, d double")
    assert R.intrinsic_dimension(df, ["a", "b", "c", "d"]) == 2.0


def test_ranking_metrics_on_ties_and_known_values(spark):
    tie = spark.createDataFrame([(0.1, 0), (0.1, 1), (0.4, 0), (0.4, 1), (0.9, 1)], "score double, y int").withColumn("u", F.lit(1))
    r = M.ranking_metrics(tie, ["u"]).first()
    assert abs(r.auc - 4 / 6) < 1e-9
    ap = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0), (0.55, 1), (0.3, 0)], "score double, y int").withColumn("u", F.lit(1))
    r = M.ranking_metrics(ap, ["u"]).first()
    assert round(r.ap, 4) == 0.7556 and round(r.auc, 4) == 0.6667


def test_distances_and_delta_properties(spark):
    x = numbers(spark, 300).select("x")
    both = x.withColumn("f", F.lit(True)).unionByName(x.select(F.col("x") + 2.5).toDF("x").withColumn("f", F.lit(False)))
    d = M.distances(both, F.col("x"), F.col("f")).first()
    assert abs(d.wasserstein - 2.5) < 1e-9 and 0 <= d.ks <= 1
    a, b = (C.cliffs_delta(both, F.col("x"), g).first().delta for g in (F.col("f"), ~F.col("f")))
    assert abs(a + b) < 1e-12
    assert M.distances(both.where("f"), F.col("x"), F.col("f")).first().ks is None


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None), (5, 0.20)], "k int, p double")
    got = {r.k: r.p_corrected and round(r.p_corrected, 4) for r in C.benjamini_hochberg(df, "p").collect()}
    assert got == {1: 0.04, 2: 0.0533, 3: 0.0533, 4: None, 5: 0.2}


def test_tails_against_tables():
    assert abs(N.chi2_tail(5.991, 2) - 0.05) < 1e-4 and abs(N.chi2_tail(18.307, 10) - 0.05) < 1e-4
    assert abs(N.studentized_range_tail(3.314, 3) - 0.05) < 1e-3 and abs(N.studentized_range_tail(4.474, 10) - 0.05) < 1e-3
    assert abs(N.signed_rank_exact(8, 10) - 0.0488) < 1e-4 and abs(N.normal_two_sided(1.96) - 0.05) < 1e-4


def test_jaccard_of_lists(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), ([], ["a"])], "x array<string>, y array<string>")
    assert [round(r[0], 4) for r in rows.select(X.jaccard(F.col("x"), F.col("y"))).collect()] == [0.3333, 1.0, 0.0]


def test_generated_counts():
    assert len(X.generated([f"c{i}" for i in range(20)])) == 190 * 3 + 380 + 20


def test_csv_missing_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,target\n1,x,0\nNA,?,1\n3.5,nan,1\n")
    df = T.read_labelled_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes)["a"] == "double" and df.where("a is null").count() == 1 and df.where("b is null").count() == 1
    assert T.read_labelled_csv(spark, str(tmp_path / "t.csv"), True).where("b is null").count() == 2
    assert T.resolve_target(df) == "target"
    with pytest.raises(KeyError):
        T.resolve_target(df.drop("target"))


def test_results_lenient_and_strict(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"dataset": "a", "seed": 1, "f1": 0.5}\n\nbroken\n{"dataset": "b", "f1": NaN}\n')
    got = {r.dataset: r.f1 for r in T.read_results(spark, str(tmp_path / "r.jsonl")).collect()}
    assert got == {"a": 0.5, "b": None}
    with pytest.raises(Exception):  # noqa: B017
        T.read_results(spark, str(tmp_path / "r.jsonl"), strict=True).collect()


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(0.001, 1), min_size=1, max_size=30))
def test_corrected_p_is_monotone(ps):
    order = np.argsort(ps)
    q = np.array(ps)[order] * len(ps) / np.arange(1, len(ps) + 1)
    q = np.minimum.accumulate(q[::-1])[::-1].clip(max=1)
    assert (np.diff(q) >= -1e-12).all() and (q >= np.array(ps)[order] - 1e-12).all()


def test_entry_without_the_training_data_operations():
    import __spark_entry__ as e

    assert "flagship_accuracy_drops" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_ties_are_dealt_out(spark):
    """One value for all rows: ranks follow the tie column, in many buckets."""
    from shiftkit.functions import keys

    df = spark.range(5000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("k"), F.col("id").alias("i"), F.lit(1.0).alias("v"))
    for tie in ("k", "i"):
        got = keys.dist_rank(df, F.col("v"), [tie]).collect()
        assert [r.rank for r in sorted(got, key=lambda r: r.i)] == list(range(1, 5001))
    assert keys._bucketed(df, [], F.col("v"), 32, tie="i").select("__b").distinct().count() > 16
