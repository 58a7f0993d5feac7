"""T2, T3. Trees of all units at once, grown level by level from counts of (unit, tree, node, feature, bin, class).

Values are cut into at most BINS bins at exact quantiles. A level of a forest is one job, whatever the number of units and
trees: tasks walk their rows down each tree, count bins in that level's nodes and hand on sums; each (unit, tree) finds its
splits in a task of its own. A boosting round grows one tree a class the same way, from sums of gradients and Hessians;
every KEEP rounds the rows' scores are written down, so that a pass walks few trees. Bootstrap weights, feature subsets and random cuts
are functions of row keys and node numbers: a tree doesn't depend on partitions.

Missing cells count as 0; rows without a class are predicted but not learned from; ties go to the column that comes first,
then to the smaller bin, and among classes to the smaller label.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import digest, running_sums
from ..functions.numeric import finite
from ..functions.shared import written
from .unit_models import by_unit, class_names, coded

BINS, KEEP = 32, 10
P = (1 << 31) - 1  # a prime: bootstrap weights are Carter-Wegman hashes of a row's number modulo it
#: P(Poisson(1) <= k) for k = 0 to 11.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def bin_edges(df: DataFrame, cols: list[str], bins: int = BINS) -> list[list[float]]:
    """Ascending edges for each column; a value's bin is the number of edges below it. Exact: from counts of values."""
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(finite(F.col(f"`{c}`")), F.lit(0.0)).alias("v")) for i, c in enumerate(cols)]))
    counts = df.select(cell.alias("c")).select("c.*").groupBy("i", "v").agg(F.count("*").alias("n"))
    totals = counts.groupBy("i").agg(F.sum("n").alias("all"), F.count("*").alias("values"))  # one row a column
    run = running_sums(counts, F.col("v"), {"upto": "n"}, ["i"]).join(F.broadcast(totals), "i")
    place = F.when(F.col("values") <= bins, F.col("v")).otherwise(F.floor((F.col("upto") - F.col("n")) * bins / F.col("all")))
    top = run.groupBy("i", place.alias("b")).agg(F.max("v").alias("v")).groupBy("i").agg(F.sort_array(F.collect_list("v")).alias("e"))
    got = {r.i: r.e[:-1] for r in top.collect()}  # columns x bins
    return [got.get(i, []) for i in range(len(cols))]


def tree_hash(seed: int, tree: int) -> tuple[int, int]:
    """Factor and offset of a tree's bootstrap hash."""
    h = hashlib.md5(f"{seed}|tree|{tree}".encode()).hexdigest()
    return 1 + int(h[:15], 16) % (P - 1), int(h[15:30], 16) % P


def poisson_weights(number: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's sample; ``number``: the row's hash modulo P."""
    a, b = tree_hash(seed, tree)
    u = ((number * a + b) % P) / P
    return np.searchsorted(POISSON, u, "right")


def subset(seed: int, tree: int, node: int, d: int, take: int) -> list[int]:
    """The features that a node may be split by, in the order of columns."""
    if take >= d:
        return list(range(d))
    order = sorted(range(d), key=lambda f: hashlib.md5(f"{seed}|features|{tree}|{node}|{f}".encode()).hexdigest())
    return sorted(order[:take])


def walk(bins: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """Each row's node after ``depth`` levels, root 0, children 2 i + 1 and 2 i + 2; rows stop at leaves (feature -1)."""
    feature, cut = tree
    at = np.zeros(len(bins), np.int64)
    for _ in range(depth):
        f = feature[at]
        go = f >= 0
        right = bins[np.arange(len(bins)), np.maximum(f, 0)] > cut[at]
        at = np.where(go, 2 * at + 1 + right, at)
    return at


def gini_splits(counts: np.ndarray, allowed: list[list[int]], cuts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(feature, bin) for each node of counts(node, feature, bin, class); (-1, 0) for a leaf. ``cuts``: the only bin tried for (node, feature)."""
    left = np.cumsum(counts, 2)[:, :, :-1]
    total = counts[:, :1].sum(2, keepdims=True)
    right = total - left
    nl, nr = left.sum(3), right.sum(3)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((nl > 0) & (nr > 0), (left * left).sum(3) / nl + (right * right).sum(3) / nr, -1.0)
    if cuts is not None:
        score = np.where(np.arange(score.shape[2]) == cuts[:, :, None], score, -1.0)
    out = []
    for i, fs in enumerate(allowed):
        n = total[i, 0, 0]
        some = score[i, fs]
        if not some.size or n.sum() == 0 or some.max() <= (n * n).sum() / n.sum() * (1 + 1e-12):
            out.append((-1, 0))
            continue
        f, b = np.unravel_index(int(some.argmax()), some.shape)
        out.append((fs[f], int(b)))
    return out


def gain_splits(sums: np.ndarray, l2: float) -> list[tuple[int, int]]:
    """(feature, bin) for each node of sums(node, feature, bin, (gradient, Hessian)), by the gain of second order."""
    left = np.cumsum(sums, 2)[:, :, :-1]
    total = sums[:, :1].sum(2, keepdims=True)
    right = total - left
    value = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    # A side needs a thousandth of a row's Hessian, as gains of nothing are noise.
    ok = (left[..., 1] > 1e-3) & (right[..., 1] > 1e-3)
    gain = np.where(ok, value(left) + value(right) - value(total), 0.0)
    out = []
    for g in gain:
        best = int(np.round(g, 9).argmax()) if g.size else 0  # sums come in any order: what differs less ties
        f, b = np.unravel_index(best, g.shape) if g.size else (0, 0)
        out.append((int(f), int(b)) if g.size and g[f, b] > 1e-9 else (-1, 0))
    return out


Tree = tuple[np.ndarray, np.ndarray, np.ndarray]  # by node: feature (-1: leaf), cut, what the node holds (class counts or a value)


def _cut(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    return np.column_stack([np.searchsorted(np.array(e), x[:, i], "left") for i, e in enumerate(edges)]).astype(np.int64)


def _columns(b: pa.RecordBatch, edges: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, class and bins of a batch that begins with __u, y and x."""
    x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    return b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), _cut(x, edges)


class _Sums:
    """Dense sums by (unit, tree), handed on as rows of their cells once they take CELLS places."""

    CELLS = 1 << 22

    def __init__(self, size: int, wide: int):
        self.size, self.wide, self.by = size, wide, {}

    def add(self, u: int, t: int, cell: np.ndarray, values: list[np.ndarray]) -> None:
        if (u, t) not in self.by:
            self.by[u, t] = np.zeros((self.wide, self.size))
        for i, v in enumerate(values):
            self.by[u, t][i] += np.bincount(cell, v, self.size)

    def full(self) -> bool:
        return len(self.by) * self.size * self.wide > self.CELLS

    def rows(self) -> pa.RecordBatch:
        u, t, cell, v = [], [], [], []
        for (a, b), x in self.by.items():
            at = np.flatnonzero(x.any(0))
            u.append(np.full(len(at), a))
            t.append(np.full(len(at), b))
            cell.append(at)
            v.append(x[:, at])
        self.by = {}
        joined = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        values = np.concatenate(v, 1) if v else np.zeros((self.wide, 0))
        return pa.RecordBatch.from_arrays([joined(u, pa.int32()), joined(t, pa.int32()), joined(cell, pa.int64()), *(pa.array(x) for x in values)], ["u", "t", "cell", *[f"v{i}" for i in range(self.wide)]])


def _level(rows: DataFrame, counted, split, wide: int) -> list:
    """Sums of the cells that ``counted`` finds, and the splits that ``split`` makes of each (unit, tree)."""
    names = [f"v{i}" for i in range(wide)]
    cells = rows.mapInArrow(counted, "u int, t int, cell long, " + ", ".join(f"{n} double" for n in names))
    summed = cells.groupBy("u", "t", "cell").agg(*[F.sum(n).alias(n) for n in names])
    return summed.groupBy("u", "t").applyInPandas(split, "u int, t int, node int, feature int, cut int, own array<double>, left array<double>, right array<double>").collect()  # nodes


def _grown(trees: dict, got: list, nodes: int, wide: int) -> None:
    for r in got:
        if (r.u, r.t) not in trees:
            trees[r.u, r.t] = (np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros((nodes, wide)))
        feature, cut, held = trees[r.u, r.t]
        feature[r.node], cut[r.node], held[r.node] = r.feature, r.cut, r.own
        if r.feature >= 0:
            held[2 * r.node + 1], held[2 * r.node + 2] = r.left, r.right


def _split_rows(u: int, t: int, first: int, dense: np.ndarray, chosen: list[tuple[int, int]]) -> pd.DataFrame:
    out = []
    for i, (f, b) in enumerate(chosen):
        own = dense[i, 0].sum(0)
        if own.any():
            left = dense[i, f, : b + 1].sum(0) if f >= 0 else own * 0
            out.append((u, t, first + i, f, b, own.tolist(), left.tolist(), (own - left).tolist()))
    return pd.DataFrame(out, columns=["u", "t", "node", "feature", "cut", "own", "left", "right"])


def forest(rows: DataFrame, edges: list[list[float]], classes: int, trees: int = 100, depth: int = 5, seed: int = 42, take: int | None = None, extra: bool = False) -> dict[tuple[int, int], Tree]:
    """T2. Trees by (unit, number) of rows (__u, y, x, h). Each node is split by the best of ``take`` features (the root of their number).

    ``extra``: all rows once in every tree, and one random cut a feature.
    """
    d, bins, grown = len(edges), max(len(e) for e in edges) + 1, {}
    take = take or max(1, int(math.sqrt(d)))
    spark = rows.sparkSession
    for level in range(depth):
        first, nodes = 2**level - 1, 2**level
        now = spark.sparkContext.broadcast(grown)

        def counted(batches, level=level, first=first, nodes=nodes, now=now):
            sums = _Sums(nodes * d * bins * classes, 1)
            for b in batches:
                u, y, x = _columns(b, edges)
                h = b.column(3).to_numpy(zero_copy_only=False)
                for k, at in by_unit(u):
                    bx, by, bh = x[at], y[at].astype(np.int64), h[at]
                    for t in range(trees):
                        w = np.ones(len(at), np.int64) if extra else poisson_weights(bh, t, seed)
                        node = walk(bx, now.value[k, t][:2], level) if level and (k, t) in now.value else np.zeros(len(at), np.int64)
                        r = np.flatnonzero((w > 0) & (node >= first))
                        if level and (k, t) in now.value:
                            r = r[now.value[k, t][0][(node[r] - 1) // 2] >= 0]
                        cell = ((node[r, None] - first) * d + np.arange(d)) * bins + bx[r]
                        sums.add(k, t, (cell * classes + by[r, None]).reshape(-1), [np.repeat(w[r], d).astype(float)])
                    if sums.full():
                        yield sums.rows()
            yield sums.rows()

        def split(first, nodes, pdf):
            u, t = int(pdf.u.iloc[0]), int(pdf.t.iloc[0])
            dense = np.zeros(nodes * d * bins * classes)
            dense[pdf.cell] = pdf.v0
            dense = dense.reshape(nodes, d, bins, classes)
            cuts = None
            if extra:
                there = dense.any(3)
                lo, hi = there.argmax(2), bins - 1 - there[:, :, ::-1].argmax(2)
                draw = np.array([[int(hashlib.md5(f"{seed}|cut|{t}|{first + i}|{f}".encode()).hexdigest()[:12], 16) for f in range(d)] for i in range(nodes)])
                cuts = np.where(hi > lo, lo + draw % np.maximum(hi - lo, 1), -1)
            return _split_rows(u, t, first, dense, gini_splits(dense, [subset(seed, t, first + i, d, take) for i in range(nodes)], cuts))

        got = _level(rows, counted, partial(split, first, nodes), 1)
        _grown(grown, got, 2 ** (depth + 1) - 1, classes)
        if not any(r.feature >= 0 for r in got):
            break
    return grown


def _scores(bins: np.ndarray, trees: dict, unit: int, rounds: range, outputs: int, depth: int) -> np.ndarray:
    out = np.zeros((len(bins), outputs))
    for r in rounds:
        for k in range(outputs):
            t = trees.get((unit, r * outputs + k))
            if t:
                out[:, k] += t[2][walk(bins, t[:2], depth), 0]
    return out


def _slopes(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log-loss by the scores."""
    if f.shape[1] == 1:
        p = 1 / (1 + np.exp(-f))
        return p - (y[:, None] == 1), p * (1 - p)
    e = np.exp(f - f.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    return p - (y[:, None] == np.arange(f.shape[1])), p * (1 - p)


def boosting(rows: DataFrame, edges: list[list[float]], classes: int, rounds: int = 100, depth: int = 3, rate: float = 0.3, l2: float = 1.0, keep: int = KEEP) -> dict[tuple[int, int], Tree]:
    """T3. Trees by (unit, round x outputs + output): one output for two classes, else one each; a node holds its step."""
    d, bins, outputs = len(edges), max(len(e) for e in edges) + 1, 1 if classes == 2 else classes
    spark, trees = rows.sparkSession, {}
    rows = rows.select("__u", "y", "x", F.array_repeat(F.lit(0.0), outputs).alias("f"))
    known = 0  # rounds that the rows' scores hold
    for r in range(rounds):
        if r and r - known == keep:
            now = spark.sparkContext.broadcast(trees)

            def moved(batches, now=now, since=range(known, r)):
                for b in batches:
                    u, _, x = _columns(b, edges)
                    f = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, outputs).copy()
                    for k, at in by_unit(u):
                        f[at] += _scores(x[at], now.value, k, since, outputs, depth)
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(f.tolist(), pa.list_(pa.float64()))], b.schema.names)

            rows, known = written(rows.mapInArrow(moved, rows.schema), "boosted"), r
        new: dict = {}
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            now = spark.sparkContext.broadcast((trees, new))

            def counted(batches, level=level, first=first, nodes=nodes, now=now, since=range(known, r), r=r):
                sums = _Sums(nodes * d * bins, 2)
                for b in batches:
                    u, y, x = _columns(b, edges)
                    f = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, outputs)
                    for k, at in by_unit(u):
                        bx = x[at]
                        g, h = _slopes(f[at] + _scores(bx, now.value[0], k, since, outputs, depth), y[at])
                        for o in range(outputs):
                            t = now.value[1].get((k, r * outputs + o))
                            node = walk(bx, t[:2], level) if t else np.zeros(len(at), np.int64)
                            on = np.flatnonzero((node >= first) & (t[0][(node - 1) // 2] >= 0)) if t else np.arange(0 if level else len(at))
                            cell = ((node[on, None] - first) * d + np.arange(d)) * bins + bx[on]
                            sums.add(k, r * outputs + o, cell.reshape(-1), [np.repeat(g[on, o], d), np.repeat(h[on, o], d)])
                        if sums.full():
                            yield sums.rows()
                yield sums.rows()

            def split(first, nodes, pdf):
                dense = np.zeros((nodes * d * bins, 2))
                dense[pdf.cell, 0], dense[pdf.cell, 1] = pdf.v0, pdf.v1
                dense = dense.reshape(nodes, d, bins, 2)
                return _split_rows(int(pdf.u.iloc[0]), int(pdf.t.iloc[0]), first, dense, gain_splits(dense, l2))

            got = _level(rows, counted, partial(split, first, nodes), 2)
            _grown(new, got, 2 ** (depth + 1) - 1, 2)
            if not any(x.feature >= 0 for x in got):
                break
        for key, (feature, cut, held) in new.items():
            trees[key] = (feature, cut, (-rate * held[:, :1] / (held[:, 1:] + l2)))
    return trees


def _prepared(df: DataFrame, keys: list[str], cols: list[str], target: str, unit: list[str], role: str, labels: list[str], seed: int) -> tuple[DataFrame, list[tuple], list[list[float]]]:
    """Rows as (__u, y, x, h, unit..., keys..., role, y_true), the units by number, and the bins' edges."""
    h = (F.conv(F.substring(digest("bootstrap", *keys, seed=seed), 1, 13), 16, 10).cast("long") % P).alias("h")
    kept = [F.col(c) for c in (*unit, *keys, role)] + [F.col(target).cast("string").alias("y_true")]
    rows, units = coded(df, cols, target, unit, labels, [h, *kept])
    return rows, units, bin_edges(df.where(F.col(role) == "train"), cols)


def leaf_counts(df: DataFrame, keys: list[str], cols: list[str], target: str, unit: list[str], role: str = "role", trees: int = 100, depth: int = 5, seed: int = 42, extra: bool = False) -> DataFrame:
    """T2. (unit..., tree, node, label, n): how many sampled rows of each class each leaf holds."""
    labels = class_names(df, target) or ["0"]
    rows, units, edges = _prepared(df, keys, cols, target, unit, role, labels, seed)
    grown = forest(rows.where((F.col(role) == "train") & F.col("y").isNotNull()).select("__u", "y", "x", "h"), edges, len(labels), trees, depth, seed, extra=extra)
    out = [(*units[u], t, int(node), labels[c], int(held[node, c])) for (u, t), (feature, _, held) in grown.items() for node in np.flatnonzero((feature < 0) & held.any(1)) for c in np.flatnonzero(held[node])]
    schema = T.StructType([df.schema[c] for c in unit]).add("tree", "integer").add("node", "integer").add("label", "string").add("n", "long")
    return df.sparkSession.createDataFrame(out, schema)


def tree_units(df: DataFrame, keys: list[str], cols: list[str], target: str, unit: list[str], name: str = "random_forest", role: str = "role", trees: int = 100, depth: int | None = None, seed: int = 42, labels: list[str] | None = None) -> DataFrame:
    """T2, T3, T10. (unit..., keys..., role, y_true, y_pred, proba) of "random_forest", "extra_trees" or "gradient_boosting" for every unit.

    A forest's probability is the mean of its leaves' shares, a boosting model's the softmax (or sigmoid) of its scores.
    """
    labels = labels or class_names(df, target) or ["0"]
    boosted = name == "gradient_boosting"
    depth, classes = depth or (3 if boosted else 5), len(labels)
    rows, _, edges = _prepared(df, keys, cols, target, unit, role, labels, seed)
    train = rows.where((F.col(role) == "train") & F.col("y").isNotNull()).select("__u", "y", "x", "h").persist(StorageLevel.DISK_ONLY)
    try:
        model = boosting(train, edges, classes, trees, depth) if boosted else forest(train, edges, classes, trees, depth, seed, extra=name == "extra_trees")
    finally:
        train.unpersist()
    now = df.sparkSession.sparkContext.broadcast(model)
    outputs = 1 if classes == 2 else classes

    def predict(batches):
        for b in batches:
            u, _, x = _columns(b, edges)
            p = np.full((b.num_rows, classes), 1 / classes)
            for k, at in by_unit(u):
                if boosted:
                    f = _scores(x[at], now.value, k, range(trees), outputs, depth)
                    f = np.column_stack([f * 0, f]) if outputs == 1 else f
                    e = np.exp(f - f.max(1, keepdims=True))
                    p[at] = e / e.sum(1, keepdims=True)
                else:
                    total, n = np.zeros((len(at), classes)), 0
                    for t in range(trees):
                        if (k, t) in now.value:
                            feature, cut, held = now.value[k, t]
                            own = held[walk(x[at], (feature, cut), depth)]
                            total += own / np.maximum(own.sum(1, keepdims=True), 1)
                            n += 1
                    p[at] = total / n if n else p[at]
            pred = [labels[i] for i in np.round(p, 12).argmax(1)]
            out = [b.column(i) for i in range(4, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(pred, pa.string()), pa.array(p.tolist(), pa.list_(pa.float64()))], [*b.schema.names[4:], "y_pred", "__p"])

    schema = T.StructType(rows.schema.fields[4:]).add("y_pred", "string").add("__p", T.ArrayType(T.DoubleType()))
    names = F.array(*[F.lit(v) for v in labels])
    got = rows.mapInArrow(predict, schema)
    return got.select(*got.columns[:-1], F.map_from_arrays(names, "__p").alias("proba"))
