"""Registered queries over all rows, methods, conditions and seeds of their views, against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftkit import catalog
from shiftkit.fixtures import view
from shiftkit.functions.keys import u
from shiftkit.operators import compare as C
from shiftkit.operators import shifts as H

SF = "/root/testdata/sf0.001"


def corrected(p):
    """Benjamini and Hochberg's correction, by definition: the least p * m / rank over all ranks from the last of the same p."""
    up = sorted(p)
    return {x: min(1.0, min(up[j] * len(up) / (j + 1) for j in range(len(up)) if up[j] >= x)) for x in set(up)}


def test_correction_takes_every_row(spark):
    rows = {r.k: r.p if r.k % 7 else None for r in view(spark, SF, "v_pred").collect()}
    want = corrected([p for p in rows.values() if p is not None])
    got = {r.k: r.p_corrected for r in catalog.QUERIES["c5_benjamini_hochberg"](spark, SF).collect()}
    assert len(rows) > 500 and set(got) == set(rows)
    for k, p in rows.items():
        assert got[k] is None if p is None else abs(got[k] - want[p]) < 1e-6


@pytest.mark.parametrize("few", [True, False])
def test_correction_of_many_values(spark, few):
    p = [(i * 7919 % 1009 / 1009) ** 3 for i in range(1009)] + [0.25, 0.25, 1.0, 0.0]
    df = spark.createDataFrame(list(enumerate([*p, None])), "k int, p double")
    want, got = corrected(p), C.benjamini_hochberg(df, "p", few=few).collect()
    assert len(got) == len(p) + 1
    for r in got:
        assert r.p_corrected is None and not r.significant if r.p is None else abs(r.p_corrected - want[r.p]) < 1e-12


def test_stability_takes_every_event(spark):
    seen = {}
    for r in view(spark, SF, "v_ev").collect():
        seen.setdefault(r.target, set()).add(r.user_id % 13)
    got = {(r.a, r.b): r.jaccard for r in catalog.QUERIES["f20_stability"](spark, SF).collect()}
    assert got == {(a, b): round(len(seen[a] & seen[b]) / len(seen[a] | seen[b]), 6) for a in seen for b in seen if a < b}


def test_grid_of_all_conditions(spark):
    v = view(spark, SF, "v_li").collect()
    rows = catalog.QUERIES["h10_all_conditions"](spark, SF).collect()
    wanted = {(f, float(s or 0)) for f, ss in H.FAMILIES.items() for s in ss}
    assert len(wanted) == 14 and {(r.unit_fold, r.family, r.severity, r.role) for r in rows} == {(i, *c, role) for i in range(1, 6) for c in wanted for role in ("train", "test")}
    clean = {(r.unit_fold, r.role): r for r in rows if r.family == "clean"}
    assert all(clean[i, "train"].n + clean[i, "test"].n == len(v) for i in range(1, 6))
    gone = H.removed_features(["qty", "price", "disc", "tax", "flag"], 0.2)
    for r in rows:
        c = clean[r.unit_fold, r.role]
        same = r.role == "test" or r.family in H.PASSING
        assert r.n == c.n
        for x in ("qty", "price", "disc", "tax", "flag"):
            lost = 1.0 if r.family == "feature_removal" and x in gone else r.severity if r.family == "missing_values" and not same else 0.0
            assert abs(r[f"there_{x}"] / r.n - (1 - lost)) < 0.02 * (0 < lost < 1) + 1e-12
            if same and not lost and x != "flag":
                assert abs(r[x] - c[x]) < 1e-5
        if r.family == "gaussian_noise" and not same:
            assert r.qty != c.qty and r.price != c.price
        if r.family == "class_prior_shift" and not same:
            top = max(c.positive, c.n - c.positive)
            assert abs(r.positive - c.positive) == top // 2
        elif r.family == "label_noise" and not same:
            assert abs(r.positive - (c.positive + r.severity * (c.n - 2 * c.positive))) < 0.03 * c.n
        else:
            assert r.positive == c.positive


def test_neighbours_by_every_component(spark):
    rows = view(spark, SF, "v_emb").withColumn("role", F.when(u("role", "k") < 0.25, "test").otherwise("train")).orderBy("k").collect()
    train, want = [r for r in rows if r.role == "train"], {}
    x = np.array([r.e for r in train], float)
    for q in rows:
        if q.role == "test":
            d = ((x - np.array(q.e, float)) ** 2).sum(1).round(9)
            votes = Counter(str(train[i].target) for i in np.argsort(d, kind="stable")[:5])
            label, n = min(votes.items(), key=lambda v: (-v[1], v[0]))
            want[q.k] = (str(q.target), label, n / 5)
    assert x.shape[1] == 64
    assert {r.k: (r.y_true, r.y_pred, r.share) for r in catalog.QUERIES["t5_knn"](spark, SF).collect()} == want


def test_units_keep_every_event_type(spark):
    want = Counter((r.user_id % 2, r.target) for r in view(spark, SF, "v_ev").collect())
    got = Counter()
    for r in catalog.QUERIES["t10_over_units"](spark, SF).collect():
        got[r.unit, r.y_true] += r.n
    assert got == want


def test_ranks_of_every_method(spark):
    v = view(spark, SF, "v_res").where("status = 'success'").toPandas()
    v["method"] = v.model + "_" + v.pipeline
    wide = v.pivot(index=C.BLOCK, columns="method", values="f1").dropna()
    ranks = wide.rank(axis=1, ascending=False).mean()
    n, k = wide.shape
    assert k == 70
    got = {r.method: (r.mean_rank, r.n) for r in catalog.QUERIES["c9_mean_ranks"](spark, SF).collect()}
    assert set(got) == set(ranks.index) and all(m == n and abs(x - ranks[g]) < 1e-5 for g, (x, m) in got.items())
    one = catalog.QUERIES["c6_c8_friedman"](spark, SF).first()
    assert (one.groups, one.blocks) == (k, n)
    pairs = {(r.a, r.b): r.q for r in catalog.QUERIES["c7_nemenyi"](spark, SF).collect()}
    assert len(pairs) == k * (k - 1) // 2
    assert all(abs(q - abs(ranks[a] - ranks[b]) / (k * (k + 1) / (6 * n)) ** 0.5 * 2**0.5) < 1e-4 for (a, b), q in pairs.items())
    cd = catalog.QUERIES["c10_critical_difference"](spark, SF).first()
    assert (cd.groups, cd.blocks) == (k, n)


def test_results_of_every_seed(spark):
    v = view(spark, SF, "v_res")
    n = v.count()
    drops = catalog.QUERIES["c17_drop_from_clean"](spark, SF).groupBy("seed").count().collect()
    assert {r.seed: r["count"] for r in drops} == dict.fromkeys((42, 123, 456, 789, 2025), n // 14 * 13 // 5)
    assert catalog.QUERIES["s9_s10_results_round_trip"](spark, SF).agg(F.sum("n")).first()[0] == n
    want = {r.status: r["count"] for r in v.groupBy("status").count().collect()}
    assert {r.status: r.n for r in catalog.QUERIES["s19_streaming_ingest"](spark, SF).collect()} == want
