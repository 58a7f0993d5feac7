"""M. Fifteen numbers that describe a labelled table."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.keys import order_statistics, place_among
from ..functions.numeric import finite, ratio
from ..functions.shared import written

#: Up to so many columns pairs are expressions of one aggregate; beyond, blocks of cross products.
PAIRS_AS_SQL, BINS = 16, 10
KEYS = (
    "number_of_samples number_of_features numerical_percent categorical_percent missing_percent number_of_classes class_imbalance_ratio average_correlation "
    "feature_redundancy average_skewness average_kurtosis sparsity average_entropy average_mutual_information intrinsic_dimension"
).split()


def _numeric(df: DataFrame, features: list[str]) -> list[str]:
    return [c for c in features if isinstance(df.schema[c].dataType, T.NumericType)]


def pair_moments(df: DataFrame, cols: list[str], shift: dict[str, float] | None = None) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of every pair i < j over the rows where both are there.

    Values are shifted by about their mean first, so that squares don't cancel. The shuffle is tasks x pairs.
    """
    shift = shift or {}
    shifted = df.select(*[(finite(F.col(f"`{c}`")) - F.lit(shift.get(c, 0.0))).alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if len(cols) <= PAIRS_AS_SQL:
        def sums(i: int, j: int) -> Column:
            x, y = F.col(f"c{i}"), F.col(f"c{j}")
            both = x.isNotNull() & y.isNotNull()
            s = lambda v: F.sum(F.when(both, v))
            return F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.count_if(both).alias("n"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(y * y).alias("syy"), s(x * y).alias("sxy"))

        one = shifted.agg(F.array(*[sums(i, j) for i, j in pairs]).alias("p"))
        return one.select(F.explode("p").alias("p")).select("p.*")
    upper = np.array(pairs).T

    def run(batches):
        total = None
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns])
            m = ~np.isnan(x)
            x, m = np.where(m, x, 0), m.astype(float)
            now = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), *(pa.array(t[upper[0], upper[1]]) for t in total)], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    blocks = shifted.mapInArrow(run, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    return blocks.groupBy("i", "j").agg(F.sum("n").cast("long").alias("n"), *[F.sum(c).alias(c) for c in ("sx", "sy", "sxx", "syy", "sxy")])


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, n, r) of every pair of columns; r is null where one of them is constant."""
    means = df.agg(*[F.avg(finite(F.col(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    m = pair_moments(df, cols, {c: means[i] or 0.0 for i, c in enumerate(cols)})
    n = F.col("n").cast("double")
    vx, vy = (F.col(a) / n - (F.col(b) / n) * (F.col(b) / n) for a, b in (("sxx", "sx"), ("syy", "sy")))
    cov = F.col("sxy") / n - (F.col("sx") / n) * (F.col("sy") / n)
    tiny = 1e-12
    scale_x, scale_y = F.col("sxx") / n, F.col("syy") / n
    ok = (n > 1) & (vx > tiny * scale_x) & (vy > tiny * scale_y) & (vx > 0) & (vy > 0)
    return m.where("n > 0").select("i", "j", "n", F.when(ok, ratio(cov, F.sqrt(vx * vy))).alias("r"))


def medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact medians of the finite values."""
    if not cols:
        return {}
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), finite(F.col(f"`{c}`")).alias("v")) for i, c in enumerate(cols)]))
    long = df.select(cell.alias("c")).select("c.*")
    middle = order_statistics(long, ["i"], "v", [(0.5, lambda n: F.floor((n - 1) / 2) + 1), (0.5, lambda n: F.floor(n / 2) + 1)])
    got = {r.i: (r.u[0] + r.u[1]) / 2 for r in middle.collect()}
    return {c: got.get(i) for i, c in enumerate(cols)}


def binned_information(long: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """Mutual information, in nats, of long(by..., feature, value, level, label) for each (by..., feature).

    Numeric values fall into ``bins`` classes of like frequency, equal values together; text features (level) are their
    own classes. An estimate from counts: it says nothing about the nearest-neighbour estimate of other tools.
    """
    group = [*by, "feature"]
    known = long.where("label is not null and (value is not null or level is not null)")
    numbers = known.where("level is null")
    # A value's class is the number of order statistics at j / bins of the rows below it; only (feature, class, label) counts are shuffled.
    edges = order_statistics(numbers, group, "value", [(j / bins, lambda n, j=j: F.ceil(n * j / bins)) for j in range(1, bins)])
    edges = written(edges.select(*[F.col(c).alias(f"__q{i}") for i, c in enumerate(group)], "u"), "edges")  # one row a feature
    classed = numbers.join(edges, [F.col(c).eqNullSafe(F.col(f"__q{i}")) for i, c in enumerate(group)])
    of_number = classed.groupBy(*group, place_among("u", F.col("value"), bins).cast("string").alias("bin"), "label").agg(F.count("*").alias("n"))
    of_text = known.where("level is not null").groupBy(*group, F.col("level").alias("bin"), "label").agg(F.count("*").alias("n"))
    cells = written(of_number.unionByName(of_text), "cells")  # features x classes x labels, asked for three times
    return _information(cells, group)


def _information(cells: DataFrame, group: list[str]) -> DataFrame:
    """(group..., mi) from counts (group..., bin, label, n)."""
    xlogx = lambda c: F.col(c) * F.log(F.col(c).cast("double"))
    sums = [cells.groupBy(*group).agg(F.sum(xlogx("n")).alias("xy"), F.sum("n").alias("m"))]
    for c, name in (("bin", "x"), ("label", "y")):
        side = cells.groupBy(*group, c).agg(F.sum("n").alias("n"))
        sums.append(side.groupBy(*group).agg(F.sum(xlogx("n")).alias(name)))
    joined = reduce(lambda a, b: a.join(b, group), sums)
    m = F.col("m").cast("double")
    return joined.select(*group, F.greatest(F.lit(0.0), (F.col("xy") - F.col("x") - F.col("y")) / m + F.log(m)).alias("mi"))


def wide_information(wide: DataFrame, names: list[str], bins: int = BINS) -> DataFrame:
    """(feature, variance, mi) of wide(label, x: array of finite numbers, one a name): as binned_information, without a row a cell.

    Approximate quantiles enclose the classes' edges; one pass adds moments, counts what lies below, and hands on the values in between, the
    next counts (feature, class, label). Rows stay where they are; what is shuffled doesn't grow with them but for those values.
    Rows without a label count in the variance only.
    """
    m, accuracy = len(names), 10_000
    known = wide.where("label is not null")
    ends = [min(1.0, max(0.0, j / bins + d)) for j in range(1, bins) for d in (-2 / accuracy, 2 / accuracy)]
    one = known.agg(F.count("*").alias("n"), *[F.percentile_approx(F.col("x")[i], ends, accuracy).alias(f"e{i}") for i in range(m)]).first()  # features x classes
    n, brackets = one.n, [one[f"e{i}"] for i in range(m)] if one.n else []
    rank = [-(-n * j // bins) for j in range(1, bins)]  # of the edges, from 1
    low, high = np.array(brackets).reshape(m if n else 0, bins - 1, 2).transpose(2, 0, 1) if n else (None, None)

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, m)

    def enclosed(batches):
        """Rows (i, j, v, n): values of feature i in bracket j; j = -1 - bracket: how many lie below it; j = bins: count, mean and squares."""
        count, mean, squares = 0, np.zeros(m), np.zeros(m)
        below = np.zeros((m, bins - 1), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b)
            own = x.mean(0)
            apart, both = own - mean, count + len(x)
            squares += ((x - own) ** 2).sum(0) + apart * apart * (count * len(x) / both)
            mean, count = mean + apart * (len(x) / both), both
            out = []
            if n:
                x = x[~b.column(0).is_null().to_numpy(zero_copy_only=False)]
                for i in range(m):
                    v = np.sort(x[:, i])
                    first, last = np.searchsorted(v, low[i], "left"), np.searchsorted(v, high[i], "right")
                    below[i] += first
                    for j in range(bins - 1):
                        some, times = np.unique(v[first[j] : last[j]], return_counts=True)
                        out.append((np.full(len(some), i), np.full(len(some), j), some, times))
            if out:
                yield rows(*(np.concatenate(c) for c in zip(*out, strict=True)))
        if count:
            i, j = np.indices(below.shape)
            yield rows(i.ravel(), -1 - j.ravel(), np.zeros(below.size), below.ravel())
            yield rows(np.arange(m), np.full(m, bins), mean, np.full(m, count), squares)

    def rows(i, j, v, n, s=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.float64()), pa.array(n, pa.int64()), pa.array(np.zeros(len(i)) if s is None else s)], ["i", "j", "v", "n", "s"])

    found = written(wide.select("label", "x").mapInArrow(enclosed, "i int, j int, v double, n long, s double"), "enclosed")
    variance = {}
    for r in found.where(F.col("j") == bins).orderBy("i", "v", "s").collect():  # features x tasks
        a, mean, squares = variance.get(r.i, (0, 0.0, 0.0))
        apart, both = r.v - mean, a + r.n
        variance[r.i] = (both, mean + apart * r.n / both, squares + r.s + apart * apart * (a * r.n / both))
    below = {(r.i, -1 - r.j): r.n for r in found.where("j < 0").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()}  # features x classes
    start = wide.sparkSession.createDataFrame([(i, j, below.get((i, j), 0), rank[j]) for i in range(m if n else 0) for j in range(bins - 1)], "i int, j int, below long, rank long")
    values = found.where((F.col("j") >= 0) & (F.col("j") < bins)).groupBy("i", "j", "v").agg(F.sum("n").alias("n"))
    upto = F.col("below") + F.sum("n").over(W.partitionBy("i", "j").orderBy("v"))
    edges = values.join(F.broadcast(start), ["i", "j"]).withColumn("upto", upto).where("upto >= rank").groupBy("i", "j").agg(F.min("v").alias("v"))
    cut = np.zeros((m, bins - 1))
    for r in edges.collect():  # features x classes
        cut[r.i, r.j] = r.v

    def classed(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            x, label = matrix(b), b.column(0).dictionary_encode()
            code, texts = label.indices.to_numpy(), label.dictionary.to_pylist()
            for k, text in enumerate(texts):
                own = x[code == k]
                here = total.setdefault(text, np.zeros((m, bins), np.int64))
                for i in range(m):
                    here[i] += np.bincount(np.searchsorted(cut[i], own[:, i], "left"), minlength=bins)
        for text, counts in total.items():
            i, j = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([text] * len(i), pa.string()), pa.array(counts[i, j])], ["i", "bin", "label", "n"])

    cells = known.select("label", "x").mapInArrow(classed, "i int, bin int, label string, n long").groupBy("i", "bin", "label").agg(F.sum("n").alias("n"))
    mi = {r.i: r.mi for r in _information(written(cells, "cells"), ["i"]).collect()}  # one row a feature
    out = [(name, variance[i][2] / (variance[i][0] - 1) if i in variance and variance[i][0] > 1 else None, mi.get(i)) for i, name in enumerate(names)]
    return wide.sparkSession.createDataFrame(out, "feature string, variance double, mi double")


def long_form(df: DataFrame, numeric: list[str], text: list[str], label: str, by: list[str] | None = None) -> DataFrame:
    """(by..., feature, value, level, label): one row a cell."""
    cell = lambda c, v, t: F.struct(F.lit(c).alias("feature"), v.alias("value"), t.alias("level"))
    cells = [cell(c, finite(F.col(f"`{c}`")), F.lit(None).cast("string")) for c in numeric] + [cell(c, F.lit(None).cast("double"), F.col(f"`{c}`").cast("string")) for c in text]
    return df.select(*(by or []), F.col(label).cast("string").alias("label"), F.explode(F.array(*cells)).alias("c")).select(*(by or []), "c.*", "label")


def intrinsic_dimension(df: DataFrame, numeric: list[str], share: float = 0.95, middle: dict[str, float | None] | None = None) -> float:
    """M15. Principal components that explain ``share`` of the standardised, median-filled columns."""
    if len(numeric) < 2:
        return 1.0
    middle = middle or medians(df, numeric)
    filled = df.select(*[F.coalesce(finite(F.col(f"`{c}`")), F.lit(middle[c] if middle[c] is not None else 0.0)).alias(c) for c in numeric])
    r = np.eye(len(numeric))
    constant = np.ones(len(numeric), bool)
    for x in correlations(filled, numeric).collect():  # columns squared, not rows
        if x.r is not None:
            r[x.i, x.j] = r[x.j, x.i] = x.r
            constant[[x.i, x.j]] = False
    keep = ~constant
    if not keep.any():
        return 1.0
    values = np.sort(np.linalg.eigvalsh(r[np.ix_(keep, keep)]))[::-1].clip(0)
    return float(np.searchsorted(np.cumsum(values) / values.sum(), share - 1e-12) + 1)


def profile(df: DataFrame, target: str, keys: list[str] | None = None) -> DataFrame:
    """M1 to M15 as one row of doubles; an empty table has only the first two."""
    spark = df.sparkSession
    features = [c for c in df.columns if c != target and c not in (keys or [])]
    numeric = _numeric(df, features)
    text = [c for c in features if c not in numeric]
    zero = [F.coalesce(F.count_if(F.col(f"`{c}`") == (F.lit(False) if isinstance(df.schema[c].dataType, T.BooleanType) else 0)), F.lit(0)) for c in features if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
    missing = [F.count_if(finite(F.col(f"`{c}`")).isNull() if c in numeric else F.col(f"`{c}`").isNull()) for c in features]
    add = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0))
    # One job for all counts and moments; skewness and kurtosis are those of the rows in which every number is there.
    whole = reduce(lambda a, b: a & b, [finite(F.col(f"`{c}`")).isNotNull() for c in numeric], F.lit(True))
    shape = [f(F.when(whole, finite(F.col(f"`{c}`")))).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("s", F.skewness), ("k", F.kurtosis))]
    base = df.agg(F.count("*").alias("n"), add(missing).alias("missing"), add(zero).alias("zeros"), *shape).first()
    n, d = base.n, len(features)
    out: dict[str, float | None] = dict.fromkeys(KEYS)
    out["number_of_samples"], out["number_of_features"] = float(n), float(d)
    if n and d:
        out["numerical_percent"], out["categorical_percent"] = 100.0 * len(numeric) / d, 100.0 * len(text) / d
        out["missing_percent"], out["sparsity"] = 100.0 * base.missing / (n * d), 100.0 * base.zeros / (n * d)
        classes = df.groupBy(target).count().agg(F.count("*").alias("k"), F.max("count").alias("a"), F.min("count").alias("b")).first()
        out["number_of_classes"], out["class_imbalance_ratio"] = float(classes.k), classes.a / classes.b if classes.k > 1 else 1.0
        out["average_correlation"], out["feature_redundancy"] = 0.0, 0.0
        if len(numeric) > 1:
            r = correlations(df, numeric).agg(F.avg(F.abs("r")).alias("a"), F.count_if(F.abs("r") > 0.8).alias("k")).first()
            out["average_correlation"], out["feature_redundancy"] = r.a or 0.0, r.k / (len(numeric) * (len(numeric) - 1) / 2)
        for k, name in (("s", "average_skewness"), ("k", "average_kurtosis")):
            got = [base[f"{k}{i}"] for i in range(len(numeric)) if base[f"{k}{i}"] is not None and not math.isnan(base[f"{k}{i}"])]
            out[name] = sum(got) / len(got) if got else 0.0
        cells = long_form(df.withColumn("__y", F.lit("")), numeric, text, "__y").where("value is not null or level is not null")
        counts = cells.groupBy("feature", "value", "level").agg(F.count("*").alias("c"))
        entropy = counts.groupBy("feature").agg((F.log(F.sum("c").cast("double")) - F.sum(F.col("c") * F.log(F.col("c").cast("double"))) / F.sum("c")).alias("h"))
        out["average_entropy"] = entropy.agg(F.avg("h")).first()[0] or 0.0
        middle = medians(df, numeric)
        filled = df.select(target, *[F.coalesce(finite(F.col(f"`{c}`")), F.lit(middle[c]).cast("double")).alias(c) for c in numeric], *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("missing")).alias(c) for c in text])
        out["average_mutual_information"] = binned_information(long_form(filled, numeric, text, target), []).agg(F.sum("mi")).first()[0]
        out["average_mutual_information"] = (out["average_mutual_information"] or 0.0) / d
        out["intrinsic_dimension"] = intrinsic_dimension(df, numeric, middle=middle)
    return spark.createDataFrame([tuple(out[k] for k in KEYS)], ", ".join(f"{k} double" for k in KEYS))


def dataset_summary(names: DataFrame, profiles: DataFrame) -> DataFrame:
    """M16. One row a name: task and formatted sizes, "Missing" where there is no profile."""
    got = names.join(profiles, "dataset", "left")
    k = F.col("number_of_classes")
    task = F.when(F.col("number_of_samples").isNull(), "Missing").when(k.isNull(), "Unknown").when(k == 2, "Binary").when(k > 2, "Multiclass").otherwise("Unknown")
    text = lambda c, form: F.when(F.col(c).isNull(), "Missing").otherwise(F.format_string(form, F.col(c)))
    whole = lambda c: F.when(F.col(c).isNull(), "Missing").otherwise(F.col(c).cast("long").cast("string"))
    return got.select("dataset", task.alias("task"), whole("number_of_samples").alias("rows"), whole("number_of_features").alias("features"), text("missing_percent", "%.2f%%").alias("missing"), text("class_imbalance_ratio", "%.2f").alias("imbalance"))
