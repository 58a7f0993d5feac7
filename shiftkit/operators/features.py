"""F. Pairwise arithmetic features, scores in long form, and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.keys import digest, running_sums
from ..functions.numeric import finite, numeric_columns
from ..functions.shared import written
from .prepare import encode_for_scoring, fill_selected
from .profile import BINS, binned_information, long_form, wide_information
from .unit_models import class_names, fit_units, lasso

PRIMITIVES = ("add", "subtract", "multiply", "divide")
MAX_BASE, MAX_FEATURES, SHUFFLES = 20, 100, 10
# The seven named variants: synthesised or not, selection, primitives (fixed values).
VARIANTS = {
    "Raw": (False, "none", PRIMITIVES),
    "Raw_Variance": (False, "variance", PRIMITIVES),
    "Raw_MI": (False, "mi", PRIMITIVES),
    "AutoFE_Baseline": (True, "variance", PRIMITIVES),
    "AutoFE_MI": (True, "mi", PRIMITIVES),
    "AutoFE_Random": (True, "random", PRIMITIVES),
    "AutoFE_NoMultiply": (True, "variance", ("add", "subtract")),
}
FEATURE_SCHEMA = "name string, primitive string, parents array<string>, depth int"


def base_columns(df: DataFrame, cols: list[str], k: int | None = MAX_BASE) -> list[str]:
    """F1. The k columns of largest sample variance, ties by name; all of them without k."""
    if k is None or len(cols) <= k:
        return cols
    v = df.agg(*[F.var_samp(finite(F.col(f"`{c}`"))).alias(c) for c in cols]).first()
    return sorted(cols, key=lambda c: (-(v[c] if v[c] is not None else -1.0), c))[:k]


def generated(cols: list[str], primitives=PRIMITIVES, depth: int = 1) -> list[tuple[str, str, list[str], int]]:
    """F2, F4, F11. (name, primitive, parents, depth) of the originals and of every derived feature."""
    out, cols = [(c, "identity", [c], 0) for c in cols], sorted(cols)
    marks = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}
    for p in primitives:
        if p not in marks:
            raise ValueError(f"unknown primitive {p}")
        pairs = [(a, b) for i, a in enumerate(cols) for j, b in enumerate(cols) if (i != j if p == "divide" else i < j)]
        out += [(f"{a} {marks[p]} {b}", p, [a, b], depth) for a, b in pairs]
    return out


def expression(feature: tuple[str, str, list[str], int]) -> Column:
    """F2, F5. A feature's value; missing or infinite results are 0."""
    _, p, parents, _ = feature
    x = [finite(F.col(f"`{c}`")) for c in parents]
    value = {"identity": lambda: x[0], "add": lambda: x[0] + x[1], "subtract": lambda: x[0] - x[1], "multiply": lambda: x[0] * x[1], "divide": lambda: F.try_divide(x[0], x[1])}[p]()
    return F.coalesce(finite(value), F.lit(0.0))


def synthesise(df: DataFrame, keys: list[str], features: list[tuple[str, str, list[str], int]]) -> DataFrame:
    """Wide table of the given features."""
    return df.select(*keys, *[expression(f).alias(f[0]) for f in features])


def deepen(df: DataFrame, keys: list[str], retained: list[tuple[str, str, list[str], int]], depth: int = 2, primitives=PRIMITIVES) -> tuple[DataFrame, list]:
    """F3. The retained features as columns, and what their pairs generate."""
    wide = synthesise(df, keys, retained)
    return wide, generated([f[0] for f in retained], primitives, depth)


def lineage(spark, features: list[tuple[str, str, list[str], int]]) -> DataFrame:
    """F11."""
    return spark.createDataFrame(features, FEATURE_SCHEMA)


def scores(df: DataFrame, keys: list[str], target: str, features: list[tuple[str, str, list[str], int]], seed: int = 42, bins: int = BINS) -> DataFrame:
    """F6, F7, F8. One row a feature: sample variance, mutual information with the label, mean rank of random orders.

    A row's features are an array: no row a cell is made.
    """
    names = [f[0] for f in features]
    wide = df.select(F.col(target).cast("string").alias("label"), F.array(*[expression(f) for f in features]).alias("x"))
    return wide_information(wide, names, bins).join(random_ranks(df.sparkSession, names, seed), "feature")


def random_ranks(spark, names: list[str], seed: int = 42, shuffles: int = SHUFFLES) -> DataFrame:
    """F8. Mean rank of each name over ``shuffles`` hash orders; a table of names, not rows."""
    t = spark.createDataFrame([(n,) for n in names], "feature string")
    each = t.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1)))).withColumn("h", digest("shuffle", "s", "feature", seed=seed))
    ranked = each.withColumn("r", F.row_number().over(W.partitionBy("s").orderBy("h", "feature")))
    return ranked.groupBy("feature").agg(F.avg("r").alias("random_rank"))


def chosen(score_table: DataFrame, method: str, k: int = MAX_FEATURES) -> list[str]:
    """F6 to F9. Names of the k best by "variance", "mi" or "random", ties by name; "none" keeps all."""
    order = {"variance": F.desc_nulls_last("variance"), "mi": F.desc_nulls_last("mi"), "random": F.asc("random_rank")}
    if method == "none":
        return [r.feature for r in score_table.select("feature").orderBy("feature").collect()]
    if method not in order:
        raise ValueError(f"unknown selection {method}")
    return [r.feature for r in score_table.orderBy(order[method], "feature").limit(k).select("feature").collect()]


def variants(df: DataFrame, keys: list[str], target: str, max_base: int | None = MAX_BASE, k: int = MAX_FEATURES, names: list[str] | None = None, seed: int = 42) -> dict[str, list]:
    """F10, F12. Each variant's features, from one scoring pass over all of them."""
    cols = base_columns(df, [c for c in numeric_columns(df) if c not in (*keys, target)], max_base)
    every = generated(cols)
    by_name = {f[0]: f for f in every}
    table = scores(df, keys, target, every, seed).collect()  # one row a feature
    rows = {r.feature: r for r in table}
    out = {}
    for name in names or VARIANTS:
        derived, method, primitives = VARIANTS[name]
        pool = [f[0] for f in every if f[1] == "identity" or (derived and f[1] in primitives)]
        if method != "none" and len(pool) > k:
            key = {"variance": lambda n: -(rows[n].variance or 0.0), "mi": lambda n: -(rows[n].mi or 0.0), "random": lambda n: rows[n].random_rank}[method]
            pool = sorted(pool, key=lambda n: (key(n), n))[:k]
        out[name] = [by_name[n] for n in pool]
    return out


def infer_task(df: DataFrame, target: str) -> str:
    """F13. Text or boolean, or few distinct values: classification; else regression."""
    if isinstance(df.schema[target].dataType, (T.StringType, T.BooleanType)):
        return "classification"
    r = df.agg(F.count("*").alias("n"), (F.countDistinct(target) + F.max(F.col(target).isNull().cast("int"))).alias("k")).first()
    return "classification" if (r.k or 0) <= max(20, 0.1 * r.n) else "regression"


def l1_importance(df: DataFrame, cols: list[str], target: str, task: str, strength: float = 1.0) -> DataFrame:
    """F14, F15. (feature, l1): absolute coefficients, over classes their mean."""
    if task == "classification":
        labels = class_names(df, target)
        fitted = fit_units(df, cols, target, [], labels, strength, l1=True)
        w = abs(fitted[()][1]).mean(0)[:-1] if fitted and fitted[()][1].size else [0.0] * len(cols)
    else:
        w = abs(lasso(df, cols, target, max(1e-4, 1 / max(strength, 1e-4)))[0])
    return df.sparkSession.createDataFrame([(c, float(x)) for c, x in zip(cols, w, strict=True)], "feature string, l1 double")


def mi_importance(df: DataFrame, cols: list[str], target: str, task: str, bins: int = BINS) -> DataFrame:
    """F16. (feature, mi); a regression target is cut into classes of like frequency first."""
    if task == "regression":
        values = df.groupBy(F.col(target).cast("double").alias("__v")).agg(F.count("*").alias("__n")).where("__v is not null")
        run = running_sums(values, F.col("__v"), {"__upto": "__n"}).crossJoin(F.broadcast(values.agg(F.sum("__n").alias("__all"))))
        classes = run.select("__v", F.floor((F.col("__upto") - F.col("__n")) * bins / F.col("__all")).alias("__class"))
        df = df.join(classes, F.col(target).cast("double") == F.col("__v")).withColumn(target, F.col("__class")).drop("__v", "__class")
    return binned_information(long_form(df, cols, [], target), [], bins)


def normalised(df: DataFrame, c: str) -> DataFrame:
    """F17. Between 0 and 1; all alike gives 0. The table has one row a feature."""
    edges = df.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"))
    return df.crossJoin(F.broadcast(edges)).withColumn(c, F.coalesce(F.try_divide(F.col(c) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))).drop("__lo", "__hi")


def select_top(train: DataFrame, test: DataFrame, keys: list[str], target: str, k: int = 50, weights: tuple[float, float] = (0.5, 0.5)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """F18. Both sides with the k best by weighted L1 and MI scores, and the table of scores."""
    cols = [c for c in train.columns if c not in (*keys, target)]
    if not cols:
        raise ValueError("no feature to select from")
    task = infer_task(train, target)
    # The label goes along as a key: no join by key, and passes read numbers only.
    coded = written(encode_for_scoring(train.select(target, *cols), [target]), "coded")
    if task == "classification":
        mi = wide_information(coded.select(F.col(target).cast("string").alias("label"), F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x")), cols).select("feature", "mi")
    else:
        mi = mi_importance(coded, cols, target, task)
    both = normalised(l1_importance(coded, cols, target, task), "l1").join(normalised(mi, "mi"), "feature", "left").fillna(0.0)
    table = both.withColumn("score", weights[0] * F.col("l1") + weights[1] * F.col("mi"))
    names = [r.feature for r in table.orderBy(F.desc("score"), "feature").limit(k).collect()]
    numeric = [c for c in names if c in numeric_columns(train)]
    a, b = fill_selected(train.select(*keys, target, *names), test.select(*keys, target, *names), numeric)
    return a, b, table


def matrices(payload: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """F19. Engineered sides of a payload where there are any, else the plain ones."""
    return tuple(payload.get(f"{side}_engineered", payload.get(side)) for side in ("train", "test"))


def jaccard(a: Column, b: Column) -> Column:
    """F20. Overlap of two lists of names; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def stability(lists: DataFrame, name: str, features: str) -> DataFrame:
    """F20 over every pair of named lists."""
    x, y = lists.alias("x"), lists.alias("y")
    return x.join(F.broadcast(y), F.col(f"x.{name}") < F.col(f"y.{name}")).select(F.col(f"x.{name}").alias("a"), F.col(f"y.{name}").alias("b"), jaccard(F.col(f"x.{features}"), F.col(f"y.{features}")).alias("jaccard"))


