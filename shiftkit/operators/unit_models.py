"""T1, T10, F14, F15. Linear models of all units at once: Newton steps from grouped moments, and L1 by coordinate descent.

A unit is a (fold, condition, variant) or whatever columns say so. A step is one job over the training rows of all units
that haven't converged: tasks add up loss, gradient and Hessian for each unit, sums combine map-side by (unit, place), and each
unit's small system is solved in a task of its own. Only coefficients (one row a unit) come to the driver and go out again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite

STEPS, TOLERANCE, FLAT = 60, 1e-9, 1e-10


def class_names(df: DataFrame, target: str) -> list[str]:
    return sorted(str(r[0]) for r in df.where(F.col(target).isNotNull()).select(target).distinct().collect())


def coded(df: DataFrame, cols: list[str], target: str, unit: list[str], labels: list[str] | None, more: list[Column] | None = None) -> tuple[DataFrame, list[tuple]]:
    """(__u, y, x, more...): the unit's number, the class' number (or the value, without labels) and the columns, missing as 0; and the units in order."""
    units = sorted((tuple(r) for r in df.select(*unit).distinct().collect()), key=repr) if unit else [()]  # one row a unit
    x = F.array(*[F.coalesce(finite(F.col(f"`{c}`")), F.lit(0.0)) for c in cols])
    y = F.col(target).cast("double") if labels is None else (F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(target).cast("string")) - 1).cast("double")
    chosen = [y.alias("y"), x.alias("x"), *(more or [])]
    if not unit:
        return df.select(F.lit(0).alias("__u"), *chosen), units
    numbers = df.sparkSession.createDataFrame([(i, *v) for i, v in enumerate(units)], T.StructType([T.StructField("__u", T.IntegerType()), *[T.StructField(f"__n{i}", df.schema[c].dataType) for i, c in enumerate(unit)]]))
    on = [F.col(c).eqNullSafe(F.col(f"__n{i}")) for i, c in enumerate(unit)]
    return df.join(F.broadcast(numbers), on).select("__u", *chosen), units


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    return b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), np.column_stack([x, np.ones(len(x))])


def by_unit(u: np.ndarray):
    order = np.argsort(u, kind="stable")
    edges = np.flatnonzero(np.diff(u[order], prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield int(u[order[lo]]), order[lo:hi]


def moments(x: np.ndarray, y: np.ndarray, present: list[int], w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the log-loss at w(classes or 1, columns and intercept); rows of two classes have one vector."""
    if len(present) == 2:
        t = (y == present[1]).astype(float)
        z = x @ w[0]
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        loss = float((np.logaddexp(0, z) - t * z).sum())
        return loss, x.T @ (p - t), (x * (p * (1 - p))[:, None]).T @ x
    t = (y[:, None] == np.array(present)[None, :]).astype(float)
    z = x @ w.T
    top = z.max(1, keepdims=True)
    e = np.exp(z - top)
    p = e / e.sum(1, keepdims=True)
    loss = float((np.log(e.sum(1)) + top[:, 0] - (t * z).sum(1)).sum())
    k, d = w.shape
    h = np.empty((k, d, k, d))
    for a in range(k):
        for b in range(a, k):
            v = p[:, a] * ((a == b) - p[:, b])
            h[a, :, b, :] = (x * v[:, None]).T @ x
            h[b, :, a, :] = h[a, :, b, :].T
    return loss, ((p - t).T @ x).reshape(-1), h.reshape(k * d, k * d)


def soft_sweeps(h: np.ndarray, g: np.ndarray, w: np.ndarray, strength: np.ndarray, sweeps: int = 2000, tol: float = 1e-13) -> np.ndarray:
    """The v that minimises g (v - w) + (v - w) h (v - w) / 2 + sum(strength |v|): soft-threshold sweeps over coordinates."""
    v, r = w.copy(), g.copy()  # r: gradient of the smooth part at v
    size = np.diag(h)
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(v)):
            if size[j] <= 0:
                continue
            u = v[j] - r[j] / size[j]
            new = np.sign(u) * max(abs(u) - strength[j] / size[j], 0.0)
            if new != v[j]:
                r += h[:, j] * (new - v[j])
                most = max(most, abs(new - v[j]))
                v[j] = new
        if most <= tol * max(1.0, float(abs(v).max(initial=0))):
            break
    return v


def _summed(parts: DataFrame) -> DataFrame:
    """(__u, v): arrays of (__u, v) added up place by place; sums combine map-side."""
    places = parts.select("__u", F.posexplode("v").alias("i", "x")).groupBy("__u", "i").agg(F.sum("x").alias("x"))
    return places.groupBy("__u").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def fit_units(df: DataFrame, cols: list[str], target: str, unit: list[str], labels: list[str], c: float = 1.0, l1: bool = False, steps: int = STEPS, tol: float = TOLERANCE) -> dict[tuple, tuple[list[int], np.ndarray]]:
    """Each unit's classes and coefficients (intercept last), from rows of all units with a class.

    Minimises c times the log-loss plus half the squared (or, with ``l1``, the absolute) coefficients without intercepts.
    Two classes have one vector, more have one each; a unit of one class has none.
    """
    rows, units = coded(df.where(F.col(target).isNotNull()), cols, target, unit, labels)
    rows = rows.where("y is not null").persist(StorageLevel.DISK_ONLY)
    try:
        there = rows.groupBy("__u").agg(F.sort_array(F.collect_set(F.col("y").cast("int"))).alias("p")).collect()
        d = len(cols) + 1
        state = {r["__u"]: (list(r.p), np.zeros((1 if len(r.p) == 2 else len(r.p), d))) for r in there}
        active = {k for k, (p, _) in state.items() if len(p) > 1}
        before: dict[int, tuple[float, np.ndarray]] = {}
        spark = df.sparkSession
        for _ in range(steps):
            if not active:
                break
            now = spark.sparkContext.broadcast({k: state[k] for k in active})

            def add(batches, now=now):
                total: dict[int, np.ndarray] = {}
                for b in batches:
                    u, y, x = _batch(b)
                    for k, at in by_unit(u):
                        if k in now.value:
                            loss, g, h = moments(x[at], y[at], *now.value[k])
                            v = np.concatenate([[loss], g, h.reshape(-1)])
                            total[k] = total[k] + v if k in total else v
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["__u", "v"])

            def solve(pdfs, now=now):
                for pdf in pdfs:
                    out = []
                    for k, v in zip(pdf["__u"], pdf["v"], strict=True):
                        w = now.value[k][1].reshape(-1)
                        v, m = np.asarray(v), len(w)
                        free = np.ones(m)
                        free[d - 1 :: d] = 0.0  # intercepts aren't penalised
                        loss, g, h = c * v[0], c * v[1 : m + 1], c * v[m + 1 :].reshape(m, m)
                        if l1:
                            loss += float(np.abs(w * free).sum())
                            new = soft_sweeps(h + np.eye(m) * FLAT, g, w, free)
                        else:
                            loss += 0.5 * float((w * w * free).sum())
                            new = w - np.linalg.lstsq(h + np.diag(free) + np.diag(1 - free) * FLAT, g + w * free, rcond=None)[0]
                        out.append((k, loss, new.tolist()))
                    yield pd.DataFrame(out, columns=["__u", "loss", "w"])

            wanted = rows.where(F.col("__u").isin(sorted(active))) if len(active) < len(state) else rows
            for r in _summed(wanted.mapInArrow(add, "__u int, v array<double>")).mapInPandas(solve, "__u int, loss double, w array<double>").collect():
                k, (p, w) = r["__u"], state[r["__u"]]
                new = np.array(r.w).reshape(w.shape)
                if k in before and r.loss > before[k][0] + 1e-9 * abs(before[k][0]):
                    state[k] = (p, (before[k][1] + w) / 2)  # the step was too long: half of it
                    continue
                before[k] = (r.loss, w)
                state[k] = (p, new)
                if np.abs(new - w).max() <= tol * max(1.0, float(np.abs(new).max())):
                    active.discard(k)
        return {units[k]: v for k, v in state.items()}
    finally:
        rows.unpersist()


def coefficient_rows(fitted: dict[tuple, tuple[list[int], np.ndarray]], labels: list[str], cols: list[str], df: DataFrame, unit: list[str]) -> DataFrame:
    """(unit..., w): a vector for each label, null for a class that the unit doesn't have; one row a unit."""
    rows = []
    for u, (present, w) in fitted.items():
        each: list[list[float] | None] = [None] * len(labels)
        for i, k in enumerate(present):
            each[k] = [0.0] * (len(cols) + 1) if len(present) == 1 or (len(present) == 2 and i == 0) else w[0 if len(present) == 2 else i].tolist()
        rows.append((*u, each))
    schema = T.StructType([df.schema[c] for c in unit]).add("w", T.ArrayType(T.ArrayType(T.DoubleType())))
    return df.sparkSession.createDataFrame(rows, schema)


def softmax(scored: DataFrame, logits: list[Column], labels: list[str], keep: list[str]) -> DataFrame:
    """The columns ``keep``, y_pred and proba of rows by their classes' logits (null: cannot win); ties go to the smaller label."""
    names = [f"__l{k}" for k in range(len(labels))]
    scored = scored.withColumns({n: F.coalesce(x, F.lit(-1e300)) for n, x in zip(names, logits, strict=True)})
    scored = scored.withColumn("__best", F.greatest(*names) if len(names) > 1 else F.col(names[0]))
    scored = scored.withColumn("__total", sum((F.exp(F.col(n) - F.col("__best")) for n in names), F.lit(0.0)))
    label = F.coalesce(*[F.when(F.col(n) == F.col("__best"), F.lit(v)) for n, v in zip(names, labels, strict=True)])
    proba = F.create_map(*[e for n, v in zip(names, labels, strict=True) for e in (F.lit(v), F.exp(F.col(n) - F.col("__best")) / F.col("__total"))])
    return scored.select(*keep, label.alias("y_pred"), proba.alias("proba"))


def logistic_units(df: DataFrame, keys: list[str], cols: list[str], target: str, unit: list[str], role: str = "role", c: float = 1.0, labels: list[str] | None = None) -> DataFrame:
    """T1, T10. (unit..., keys..., role, y_true, y_pred, proba): logistic regression fitted on each unit's training rows.

    Missing cells count as 0, rows without a class are predicted but not learned from; a unit without training rows gives no rows.
    """
    labels = labels or class_names(df, target) or ["0"]
    fitted = fit_units(df.where(F.col(role) == "train"), cols, target, unit, labels, c)
    models = coefficient_rows(fitted, labels, cols, df, unit).withColumnsRenamed({u: f"__m{i}" for i, u in enumerate(unit)})
    on = [F.col(u).eqNullSafe(F.col(f"__m{i}")) for i, u in enumerate(unit)]
    joined = df.join(F.broadcast(models), on) if unit else df.crossJoin(F.broadcast(models))  # one row a unit
    x = [F.coalesce(finite(F.col(f"`{c}`")), F.lit(0.0)) for c in cols] + [F.lit(1.0)]
    logits = [sum((v * F.col("w")[k][i] for i, v in enumerate(x)), F.lit(0.0)) for k in range(len(labels))]
    scored = joined.select(*unit, *keys, role, F.col(target).cast("string").alias("y_true"), *[z.alias(f"__z{k}") for k, z in enumerate(logits)])
    return softmax(scored, [F.col(f"__z{k}") for k in range(len(labels))], labels, [*unit, *keys, role, "y_true"])


def lasso(df: DataFrame, cols: list[str], target: str, alpha: float) -> tuple[np.ndarray, float]:
    """F15. Coefficients and intercept that minimise half the mean squared error plus alpha times the absolute coefficients.

    One pass over the rows gives the Gram matrix; the sweeps run on that.
    """
    rows, _ = coded(df.where(F.col(target).isNotNull()), cols, target, [], None)
    means = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.array(*[F.avg(F.col("x")[i]) for i in range(len(cols))]).alias("x")).first()
    if not means.n:
        return np.zeros(len(cols)), 0.0
    centre = np.array([*means.x, means.y])

    def gram(batches):
        total = np.zeros((len(centre), len(centre)))
        for b in batches:
            _, y, x = _batch(b)
            m = np.column_stack([x[:, :-1], y]) - centre  # about the mean, so that squares don't cancel
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], ["__u", "v"])

    s = np.array(_summed(rows.mapInArrow(gram, "__u int, v array<double>")).first().v).reshape(len(centre), -1) / means.n
    w = soft_sweeps(s[:-1, :-1], -s[:-1, -1], np.zeros(len(cols)), np.full(len(cols), float(alpha)))
    return w, float(centre[-1] - w @ centre[:-1])
