"""What a reviewer's runs on larger tables found."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shiftkit.fixtures import view
from shiftkit.functions.keys import u
from shiftkit.functions.shared import written
from shiftkit.operators import clusters as K
from shiftkit.operators import compare as C
from shiftkit.operators import features as X
from shiftkit.operators import neighbours as N
from shiftkit.operators import profile as P
from shiftkit.operators import shifts as H
from shiftkit.operators.attribution import background

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_results_view_is_dealt_out_before_the_grid(spark):
    plan = plan_of(view(spark, SF, "v_res"))
    assert "REPARTITION_BY_NUM" in plan and "BroadcastNestedLoopJoin" not in plan
    per_task = view(spark, SF, "v_res").groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 1


@pytest.mark.parametrize("test", [C.friedman, C.nemenyi])
def test_rank_tests_read_their_rows_once(spark, test):
    """Results of one pass are kept: the driver holds no plan that repeats the view and broadcasts its pieces each time."""
    rows = [(f"b{b}", g, float((b * 7 + i * 3) % 4)) for b in range(6) for i, g in enumerate("wxyz") if (b, g) != (5, "w")] + [("b6", "v", 1.0)]
    df = spark.createDataFrame(rows, "block string, g string, v double")
    assert plan_of(test(df, "v", "g", ["block"])).count("LogicalRDD") == 0


def test_rank_sums_of_incomplete_and_tied_blocks(spark):
    rows = [(f"b{b}", g, float((b * 7 + i * 3) % 3)) for b in range(9) for i, g in enumerate("wxyz")]
    frame = pd.DataFrame(rows, columns=["block", "g", "v"]).pivot(index="block", columns="g", values="v")
    more = [("b9", "w", 1.0), ("b9", "x", None), ("b9", "y", 0.0), ("b9", "z", float("nan"))]
    got = {r.g: r for r in C.rank_sums(spark.createDataFrame([*rows, *more], "block string, g string, v double"), "v", "g", ["block"]).collect()}
    want = frame.rank(axis=1, ascending=False).sum()
    assert {g: (r.r, r.n) for g, r in got.items()} == {g: (x, 9) for g, x in want.items()}
    ties = sum(n**3 - n for _, x in frame.iterrows() for n in x.value_counts())
    assert sum(r.ties for r in got.values()) == ties
    assert C.friedman(spark.createDataFrame([], "block string, g string, v double"), "v", "g", ["block"]).first().blocks == 0


def test_nearest_centres_round_only_near_ties(spark):
    rng = np.random.default_rng(3)
    at = rng.integers(0, 4, (7, 3)) + np.where(rng.random((7, 3)) < 0.5, 4e-10, 0.0)
    x = np.concatenate([rng.integers(0, 4, (300, 3)).astype(float), rng.normal(0, 1e6, (50, 3))])
    want = []
    for v in x:
        d = [K._rounded(sum((float(a) - float(b)) ** 2 for a, b in zip(v, c, strict=True))) for c in at]
        want.append(d.index(min(d)))
    assert K.nearest_of(x, at).tolist() == want
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(3)
    for r in df.select("x", K.nearest_centre("x", at.tolist()).alias("c")).collect():
        assert r.c == want[x.tolist().index(r.x)]


def test_background_writes_its_points_once(spark, monkeypatch):
    """Rounds read narrow points, not the labelled view."""
    seen = []
    monkeypatch.setattr(K, "written", lambda df, label: seen.append(label) or written(df, label))
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    assert background(df, ["k"], ["a", "b"], 5).count() == 5 and seen == ["points"]


@pytest.mark.parametrize("draws", [64, 2])
def test_prior_shift_moves_the_first_half_by_draw(spark, monkeypatch, draws):
    """The half of the largest class that moves ends at an edge; rows aren't joined with their ranks. Equal draws go by key."""
    coarse = lambda tag, *keys, seed=42: F.floor(u(tag, *keys, seed=seed) * draws) / draws
    monkeypatch.setattr(H, "u", coarse)
    rows = spark.range(301).select(F.col("id").alias("k"), F.lit(1.0).alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"), (F.col("id") * 7 % 5 + 1).cast("int").alias("fold"))
    chosen = H.conditions(spark).where("family = 'class_prior_shift'")
    out = H.all_conditions(rows, ["k"], "y", chosen)
    assert "LeftOuter" not in plan_of(out)
    order = sorted(((r.d, r.k, r.y, r.fold) for r in rows.withColumn("d", coarse("prior", "k")).collect()))
    want = {}
    for i in range(1, 6):
        major = [k for _, k, y, f in order if f != i and y == "b"]
        want[i] = set(major[: len(major) // 2])
    got = {i: set() for i in want}
    for r in out.where("role = 'train'").collect():
        if r.y == "a" and r.k % 3:
            got[r.unit_fold].add(r.k)
    assert got == want and out.count() == 5 * 301


def test_scores_make_no_row_a_cell(spark, monkeypatch):
    """Against the long form, with ties, missing labels, one class of values and values that divide by zero."""
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.integers(0, 5)), float(rng.normal()), 0.0, str(int(rng.integers(3))) if i % 9 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, target string").repartition(5)
    features = X.generated(["a", "b", "c"])
    cell = lambda f: F.struct(F.lit(f[0]).alias("feature"), X.expression(f).alias("value"))
    long = df.select(F.col("target").alias("label"), F.explode(F.array(*[cell(f) for f in features])).alias("c")).select("c.feature", "c.value", F.lit(None).cast("string").alias("level"), "label")
    mi = {r.feature: r.mi for r in P.binned_information(long, []).collect()}
    variance = {r.feature: r.v for r in long.groupBy("feature").agg(F.var_samp("value").alias("v")).collect()}
    monkeypatch.setattr(P, "order_statistics", lambda *a, **k: pytest.fail("values are moved by feature"))
    got = {r.feature: r for r in X.scores(df, ["k"], "target", features).collect()}
    assert set(got) == set(mi)
    for name, r in got.items():
        assert abs(r.mi - mi[name]) < 1e-12 and abs(r.variance - variance[name]) < 1e-9 * max(1, variance[name])
    none = X.scores(df.where("k < 0"), ["k"], "target", features).collect()
    assert len(none) == len(features) and all(r.variance is None and r.mi is None for r in none)


def test_selection_does_not_join_the_rows_with_themselves(spark, monkeypatch):
    """Rows with one key twice stay two rows, as nothing is joined by key; passes read numbers without keys."""
    seen = []
    monkeypatch.setattr(X, "written", lambda df, label: seen.append((label, df.columns)) or written(df, label))
    rows = spark.range(120).select((F.col("id") % 60).alias("k"), (F.col("id") % 5).cast("double").alias("a"), F.when(F.col("id") % 3 == 0, "u").otherwise("v").alias("b"), (F.col("id") % 2).cast("int").alias("y"))
    train, _, table = X.select_top(rows, rows, ["k"], "y", k=2)
    assert ("coded", ["y", "a", "b"]) in seen and train.count() == 120
    coded = P.long_form(X.encode_for_scoring(rows.select("y", "a", "b"), ["y"]), ["a", "b"], [], "y")
    want = {r.feature: r.mi for r in P.binned_information(coded, []).collect()}
    top, low = max(want.values()), min(want.values())
    for r in table.collect():
        assert abs(r.mi - ((want[r.feature] - low) / (top - low) if top > low else 0.0)) < 1e-9


def test_neighbours_of_blocks_with_ties(spark):
    """Any cut into blocks gives the neighbours of all pairs, ties by key; no row a pair is made."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (160, 4)).astype(float)
    rows = [(i, v.tolist(), str(i % 3)) for i, v in enumerate(x)]
    train = spark.createDataFrame(rows[:120], "t_k int, t_x array<double>, t_y string")
    test = spark.createDataFrame(rows[120:], "q_k int, q_x array<double>, y_true string")
    for parts in (None, 4):
        got = {}
        pairs = N.all_pairs(train, test, ["k"], 5, parts).collect()
        for r in pairs:
            got.setdefault(r.q_k, []).append((round(r.d, 9), r.t_k))
        for i in range(120, 160):
            want = sorted((round(float(((x[i] - x[j]) ** 2).sum()), 9), j) for j in range(120))[:5]
            assert sorted(got[i])[:5] == want
    assert len(N.all_pairs(train, test.where("q_k < 0"), ["k"], 5).collect()) == 0
