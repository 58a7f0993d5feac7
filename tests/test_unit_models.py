"""Models of all units at once, L1, neighbours by cells and keyed k-means, against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftkit.functions.keys import u
from shiftkit.operators import attribution, clusters, features, models, neighbours, splits, trees, unit_models


def labelled(spark, classes=3, n=900, d=4, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((classes, d))
    rows = []
    for i in range(n):
        y = int(rng.integers(classes))
        x = (centre[y] + rng.standard_normal(d)).round(6).tolist()
        rows.append((i, i % 3, "train" if rng.random() < 0.7 else "test", f"c{y}" if i % 50 else None, *[None if rng.random() < 0.02 else v for v in x]))
    return spark.createDataFrame(rows, f"k long, unit long, role string, target string, {', '.join(f'x{j} double' for j in range(d))}"), [f"x{j}" for j in range(d)]


def arrays(df, cols, labels, unit):
    rows = [r for r in df.where(f"role = 'train' and target is not null and unit = {unit}").orderBy("k").collect()]
    return np.array([[r[c] or 0.0 for c in cols] + [1.0] for r in rows]), np.array([labels.index(r.target) for r in rows]), [r.k for r in rows]


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_coefficients_are_the_optimum_of_each_unit(spark, classes):
    df, cols = labelled(spark, classes)
    odd = spark.createDataFrame([(10_000, 7, "train", "c0", 1.0, 2.0, 3.0, 4.0), (10_001, 7, "test", "c1", 0.0, 0.0, 0.0, 0.0), (10_002, 8, "test", "c1", 0.0, 0.0, 0.0, 0.0)], df.schema)
    df = df.unionByName(odd)
    labels = unit_models.class_names(df, "target")
    fitted = unit_models.fit_units(df.where("role = 'train'"), cols, "target", ["unit"], labels)
    assert set(fitted) == {(0,), (1,), (2,), (7,)}
    for unit in range(3):
        x, y, _ = arrays(df, cols, labels, unit)
        present, w = fitted[unit,]
        free = np.array([1.0] * len(cols) + [0.0])
        v = np.zeros_like(w)
        for _ in range(200):  # plain gradient steps with the exact Hessian, in one place
            _, g, h = unit_models.moments(x, y, present, v)
            step = np.linalg.lstsq(h + np.diag(np.tile(free, len(w))) + 1e-10 * np.eye(h.shape[0]), g + (v * free).reshape(-1), rcond=None)[0].reshape(w.shape)
            v -= step
            if abs(step).max() < 1e-12:
                break
        assert np.allclose(w[:, :-1], v[:, :-1], atol=1e-6) and np.allclose(w - w[:1], v - v[:1], atol=1e-6)
    got = models.over_units(df, ["unit"], ["k"], cols, "target", "logistic_regression").collect()
    by = {r.k: r for r in got}
    assert len(got) == df.count() - 1 and by[10_001].y_pred == "c0" and 10_002 not in by
    for r in df.where("unit = 1").collect():
        x = np.array([r[c] or 0.0 for c in cols] + [1.0])
        z = fitted[1,][1] @ x
        p = np.array([1 / (1 + np.exp(z[0])), 1 / (1 + np.exp(-z[0]))]) if classes == 2 else np.exp(z) / np.exp(z).sum()
        assert np.allclose([by[r.k].proba[v] for v in labels], p, atol=1e-9) and by[r.k].y_pred == labels[int(p.argmax())]


def test_logistic_of_no_rows(spark):
    df, cols = labelled(spark, n=30)
    assert models.over_units(df.limit(0), ["unit"], ["k"], cols, "target", "logistic_regression").count() == 0


@pytest.mark.parametrize("classes", [2, 3])
def test_l1_meets_the_conditions_of_its_optimum(spark, classes):
    df, cols = labelled(spark, classes, d=6)
    df, labels = df.where("role = 'train'"), unit_models.class_names(df, "target")
    strength = 0.02
    present, w = unit_models.fit_units(df, cols, "target", [], labels, strength, l1=True)[()]
    parts = [arrays(df, cols, labels, i)[:2] for i in range(3)]
    x, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    g = strength * unit_models.moments(x, y, present, w)[1].reshape(w.shape)
    assert (w[:, :-1] == 0).any() and (w[:, :-1] != 0).any()
    assert np.abs(g[:, -1]).max() < 1e-6
    for a, b in zip(w[:, :-1].reshape(-1), g[:, :-1].reshape(-1), strict=True):
        assert abs(b + np.sign(a)) < 1e-6 if a else abs(b) <= 1 + 1e-6
    task = features.l1_importance(df, cols, "target", "classification", strength)
    assert {r.feature: round(r.l1, 9) for r in task.collect()} == {c: round(float(abs(w[:, j]).mean()), 9) for j, c in enumerate(cols)}


def test_lasso_meets_the_conditions_of_its_optimum(spark):
    df, cols = labelled(spark, d=6)
    df = df.withColumn("y", 3 * F.coalesce("x0", F.lit(0.0)) - F.coalesce("x3", F.lit(0.0)) + 1e4)
    for alpha in (0.01, 0.5, 100.0):
        w, b = unit_models.lasso(df, cols, "y", alpha)
        rows = df.collect()
        x, y = np.array([[r[c] or 0.0 for c in cols] for r in rows]), np.array([r.y for r in rows])
        g = x.T @ (x @ w + b - y) / len(y)
        assert abs((x @ w + b - y).mean()) < 1e-8
        for a, s in zip(w, g, strict=True):
            assert abs(s + alpha * np.sign(a)) < 1e-8 if a else abs(s) <= alpha + 1e-8
    assert not w.any()


def grown_by_hand(x, y, weights, edges, seed, tree, take, depth, classes):
    """Leaves of one tree: (node, class) -> rows, by recursion over rows."""
    bins = np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)])
    leaves = Counter()

    def grow(rows, node, level):
        count = lambda r: np.bincount(y[r], weights[r], classes)
        value = lambda c: (c * c).sum() / c.sum()
        best = None
        if level < depth and len(rows):
            order = sorted(range(len(edges)), key=lambda f: hashlib.md5(f"{seed}|features|{tree}|{node}|{f}".encode()).hexdigest())[:take]
            for f in sorted(order):
                for b in range(len(edges[f])):
                    left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                    if len(left) and len(right):
                        s = value(count(left)) + value(count(right))
                        if best is None or s > best[0]:
                            best = (s, left, right)
        if best is None or best[0] <= value(count(rows)) * (1 + 1e-12):
            for c, n in enumerate(count(rows)):
                if n:
                    leaves[node, c] += int(n)
            return
        grow(best[1], 2 * node + 1, level + 1)
        grow(best[2], 2 * node + 2, level + 1)

    grow(np.flatnonzero(weights > 0), 0, 0)
    return leaves


def test_forest_leaves_against_recursion(spark):
    df, cols = labelled(spark, n=400)
    labels = unit_models.class_names(df, "target")
    got = Counter()
    for r in trees.leaf_counts(df.repartition(3), ["k"], cols, "target", ["unit"], trees=5, depth=3).collect():
        got[r.unit, r.tree, r.node, labels.index(r.label)] += r.n
    edges = [np.array(e) for e in trees.bin_edges(df.where("role = 'train'"), cols)]
    h = {r.k: r.h for r in df.select("k", (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("42"), F.lit("bootstrap"), F.col("k").cast("string"))), 1, 13), 16, 10).cast("long") % trees.P).alias("h")).collect()}
    want = Counter()
    for unit in range(3):
        x, y, keys = arrays(df, cols, labels, unit)
        for t in range(5):
            w = trees.poisson_weights(np.array([h[k] for k in keys]), t, 42)
            for (node, c), n in grown_by_hand(x[:, :-1], y, w, edges, 42, t, 2, 3, 3).items():
                want[unit, t, node, c] += n
    assert got == want and max(n for _, _, n, _ in want) > 2


@pytest.mark.parametrize("classes", [2, 3])
def test_boosting_against_rounds_in_one_place(spark, classes):
    df, cols = labelled(spark, classes, n=300)
    df, labels = df.where("unit = 0"), unit_models.class_names(df, "target")
    rounds, depth, outputs = 7, 2, 1 if classes == 2 else classes
    rows, _, edges = trees._prepared(df, ["k"], cols, "target", ["unit"], "role", labels, 42)
    model = trees.boosting(rows.where("role = 'train' and y is not null").select("__u", "y", "x", "h"), edges, classes, rounds, depth, keep=3)
    x, y, _ = arrays(df, cols, labels, 0)
    bins, f = trees._cut(x[:, :-1], edges), np.zeros((len(y), outputs))
    for r in range(rounds):
        g, h = trees._slopes(f, y)
        new = np.zeros_like(f)
        for o in range(outputs):

            def grow(at, level, o=o, g=g, h=h, new=new):
                value = lambda r: g[r, o].sum() ** 2 / (h[r, o].sum() + 1)
                best = (1e-9, None, None)
                for j in range(len(cols)) if level < depth else ():
                    for b in range(len(edges[j])):
                        left, right = at[bins[at, j] <= b], at[bins[at, j] > b]
                        if h[left, o].sum() > 1e-3 and h[right, o].sum() > 1e-3:
                            gain = round(value(left) + value(right) - value(at), 9)
                            if gain > best[0]:
                                best = (gain, left, right)
                if best[1] is None:
                    new[at, o] = -0.3 * g[at, o].sum() / (h[at, o].sum() + 1)
                else:
                    grow(best[1], level + 1)
                    grow(best[2], level + 1)

            grow(np.arange(len(y)), 0)
        f += new
    assert np.allclose(trees._scores(bins, model, 0, range(rounds), outputs, depth), f, atol=1e-9)


@pytest.mark.parametrize("name", ["random_forest", "extra_trees", "gradient_boosting"])
def test_tree_predictions_are_sensible_and_whole(spark, name):
    df, cols = labelled(spark, 3, n=600)
    got = trees.tree_units(df, ["k"], cols, "target", ["unit"], name, trees=20).collect()
    assert len(got) == 600 and all(abs(sum(r.proba.values()) - 1) < 1e-9 and r.proba[r.y_pred] >= max(r.proba.values()) - 1e-9 for r in got)
    hit = [r.y_pred == r.y_true for r in got if r.role == "test" and r.y_true]
    assert np.mean(hit) > 0.45  # a third by chance
    again = trees.tree_units(df.repartition(7), ["k"], cols, "target", ["unit"], name, trees=20)
    assert {(r.k, r.y_pred) for r in got} == {(r.k, r.y_pred) for r in again.collect()}
    assert trees.tree_units(df.limit(0), ["k"], cols, "target", ["unit"], name, trees=3, labels=["c0", "c1"]).count() == 0


def test_neighbours_by_cells_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "ASKED", 32)
    rng = np.random.default_rng(2)
    centre = 30 * rng.standard_normal((40, 3))
    x = (centre[rng.integers(40, size=3000)] + rng.standard_normal((3000, 3))).round(3)
    rows = [(i, f"s{i % 7}", "train" if i % 10 else "test", f"c{i % 4}", *v) for i, v in enumerate(x.tolist())]
    rows += [(3000 + i, "s", "train", "c1", *rows[10][4:]) for i in range(200)]  # copies of a test row: ties by key
    df = spark.createDataFrame(rows, "k long, s string, role string, target string, a double, b double, c double")
    plain = models.knn(df, ["k", "s"], ["a", "b", "c"], "target").collect()
    cells = models.knn(df, ["k", "s"], ["a", "b", "c"], "target", most=0, counts=True).collect()
    assert {tuple(r) for r in plain} == {tuple(r)[:-1] for r in cells} and len(plain) == 300
    assert sum(r.compared for r in cells) < 0.1 * 300 * 2900
    few = df.where("k < 4 or k = 10")
    assert {tuple(r) for r in models.knn(few, ["k", "s"], ["a", "b", "c"], "target", most=0).collect()} == {tuple(r) for r in models.knn(few, ["k", "s"], ["a", "b", "c"], "target").collect()}


def kmeans_by_hand(points, k, rounds, draw):
    keys = sorted(points)
    x = {i: np.round(points[i], 9) for i in keys}
    far = lambda a, b: round(float(((x[a] - np.array(b)) ** 2).sum()), 9)
    centres = [x[min(keys, key=lambda i: (draw(0, i), i))].tolist()]
    each = max(1, -(-(k - 1) // 8))
    turn = 0
    while len(centres) < k:
        turn += 1
        d = {i: min(far(i, c) for c in centres) for i in keys}
        some = sorted((i for i in keys if d[i] > 0), key=lambda i: (-np.log(1 - draw(turn, i)) / d[i], i))[: min(each, k - len(centres))]
        if not some:
            break
        for i in some:
            if x[i].tolist() not in centres:
                centres.append(x[i].tolist())
    for _ in range(rounds):
        of = {i: min(range(len(centres)), key=lambda j: (far(i, centres[j]), j)) for i in keys}
        centres = [np.round(np.mean([x[i] for i in keys if of[i] == j], axis=0), 9).tolist() if j in of.values() else c for j, c in enumerate(centres)]
    return centres


@pytest.mark.parametrize("k", [1, 4, 20])
def test_kmeans_is_a_function_of_keys(spark, k):
    rng = np.random.default_rng(3)
    points = {i: rng.standard_normal(2).round(4) + 4 * (i % 3) for i in range(200)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in points.items()], "k long, x array<double>")
    draws = {t: {r.k: r.d for r in df.select("k", u(f"centre{t}", "k").alias("d")).collect()} for t in range(12)}
    want = kmeans_by_hand(points, k, 6, lambda t, i: draws[t][i])
    assert np.allclose(clusters.kmeans(df, ["k"], k, 6), want, atol=1e-8)
    assert np.allclose(clusters.kmeans(df.repartition(5), ["k"], k, 6), want, atol=1e-8)
    assert clusters.kmeans(df.limit(0), ["k"], k) == []


def test_empty_clusters_take_a_fifth(spark):
    df = spark.createDataFrame([(i, float(i % 2), "a") for i in range(2000)], "k long, v double, target string")  # two different points, five clusters
    n = {r.fold: r["count"] for r in splits.population_folds(df, ["k"], "target").groupBy("fold").count().collect()}
    assert set(n) == {1, 2, 3, 4, 5} and all(300 < n[i] < 500 for i in (5,)) and sum(n.values()) == 2000
    assert attribution.background(df, ["k"], ["v"], 100).count() == 2 and attribution.background(df.limit(3), ["k"], ["v"], 100).count() == 3
