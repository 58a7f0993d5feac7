"""H. Reproducible perturbations: each random number is a function of (seed, tag, row key)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import dist_rank, u, z
from ..functions.numeric import finite, numeric_columns
from ..functions.shared import written

# Families and severities of the fourteen conditions (fixed values); None: the family has no severity.
FAMILIES = {
    "clean": [None],
    "gaussian_noise": [0.01, 0.05, 0.1],
    "missing_values": [0.05, 0.1, 0.2],
    "label_noise": [0.05, 0.1, 0.2],
    "covariate_shift": [None],
    "feature_removal": [0.2],
    "population_shift": [None],
    "class_prior_shift": [None],
}
DEFAULTS = {"gaussian_noise": 0.05, "missing_values": 0.10, "label_noise": 0.10, "feature_removal": 0.20}
PASSING = ("clean", "covariate_shift", "population_shift")


def condition_name(family: str, severity: float | None) -> str:
    return f"{family}_{severity:g}" if severity else family


def conditions(spark) -> DataFrame:
    """H9. (family, severity, condition)."""
    rows = [(f, float(s or 0.0), condition_name(f, s)) for f, ss in FAMILIES.items() for s in ss]
    return spark.createDataFrame(rows, "family string, severity double, condition string")


def noise_scale(df: DataFrame, cols: list[str], unit: list[str] | None = None) -> DataFrame:
    """(unit..., <c>__sd) of the rows that noise is for: population sd, 1 where it is 0 or undefined."""
    sd = lambda c: F.stddev_pop(finite(F.col(f"`{c}`")))
    return df.groupBy(*(unit or [])).agg(*[F.when(sd(c) > 0, sd(c)).otherwise(1.0).alias(f"{c}__sd") for c in cols])


def gaussian_noise(df: DataFrame, keys: list[str], sigma: float, cols: list[str] | None = None, seed: int = 42) -> DataFrame:
    """H2. Adds normal noise of sigma times the column's sd to numbers; missing stays missing."""
    cols = cols or [c for c in numeric_columns(df) if c not in keys]
    s = noise_scale(df, cols).first()
    return df.withColumns({c: finite(F.col(f"`{c}`")) + z(f"noise|{c}", *keys, seed=seed) * sigma * s[f"{c}__sd"] for c in cols})


def missing_values(df: DataFrame, keys: list[str], fraction: float, cols: list[str] | None = None, seed: int = 42) -> DataFrame:
    """H3. Each cell is lost with probability ``fraction``."""
    cols = cols or [c for c in df.columns if c not in keys]
    return df.withColumns({c: F.when(u(f"lost|{c}", *keys, seed=seed) >= fraction, F.col(f"`{c}`")) for c in cols})


def _classes(df: DataFrame, target: str) -> list:
    return [r[0] for r in df.where(F.col(target).isNotNull()).select(target).distinct().orderBy(target).collect()]


def other_class(y: Column, classes: list, draw: Column) -> Column:
    """A class other than y, uniformly by ``draw``."""
    a = F.array(*[F.lit(c) for c in classes])
    i = F.array_position(a, y)
    step = F.floor(draw * (len(classes) - 1)).cast("int") + 1
    return F.element_at(a, ((i.cast("int") - 1 + step) % len(classes) + 1).cast("int"))


def label_noise(df: DataFrame, keys: list[str], target: str, fraction: float, seed: int = 42) -> DataFrame:
    """H4. With probability ``fraction`` another class; missing labels stay, fewer than two classes change nothing."""
    classes = _classes(df, target)
    if len(classes) < 2:
        return df
    flip = (u("flip", *keys, seed=seed) < fraction) & F.col(target).isNotNull()
    return df.withColumn(target, F.when(flip, other_class(F.col(target), classes, u("to", *keys, seed=seed))).otherwise(F.col(target)))


def class_prior_shift(df: DataFrame, keys: list[str], target: str, share: float = 0.5, seed: int = 42) -> DataFrame:
    """H5. Exactly int(share * n) rows of the largest class (ties: the smallest label) become a minority class."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).count().orderBy(F.desc("count"), target).collect()
    if len(counts) < 2:
        return df
    top, n, rest = counts[0][0], counts[0][1], sorted(r[0] for r in counts[1:])
    ranked = dist_rank(df.where(F.col(target) == F.lit(top)), u("prior", *keys, seed=seed), keys, None, "__rank", uniform=True)
    to = F.element_at(F.array(*[F.lit(c) for c in rest]), (F.floor(u("minor", *keys, seed=seed) * len(rest)) + 1).cast("int"))
    moved = ranked.withColumn(target, F.when(F.col("__rank") <= int(share * n), to).otherwise(F.col(target))).drop("__rank")
    return moved.select(*df.columns).unionByName(df.where(F.col(target).isNull() | (F.col(target) != F.lit(top))))


def structured_label_drift(df: DataFrame, keys: list[str], target: str, fraction: float, seed: int = 42) -> DataFrame:
    """H6. Flips by a probability that grows with the distance from the mean of the widest column, ``fraction`` on average."""
    cols, classes = [c for c in numeric_columns(df, False) if c not in (*keys, target)], _classes(df, target)
    if len(classes) < 2:
        return df
    if not cols:
        return label_noise(df, keys, target, fraction, seed)
    x = {c: finite(F.col(f"`{c}`")) for c in cols}
    s = df.agg(*[f(x[c]).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    i = max(range(len(cols)), key=lambda i: ((s[f"s{i}"] or 0.0) / ((s[f"s{i}"] or 0.0) + 1e-9), -i))
    c, mean, sd = cols[i], s[f"m{i}"], s[f"s{i}"] or 1.0
    p = 1 / (1 + F.exp(-F.abs(x[c] - F.lit(mean)) / F.lit(sd)))
    average = df.agg(F.avg(p)).first()[0] or 1.0
    chance = F.least(F.lit(1.0), p * (fraction / average))
    flip = F.coalesce(u("flip", *keys, seed=seed) < chance, F.lit(False)) & F.col(target).isNotNull()
    return df.withColumn(target, F.when(flip, other_class(F.col(target), classes, u("to", *keys, seed=seed))).otherwise(F.col(target)))


def removed_features(features: list[str], fraction: float, seed: int = 42) -> list[str]:
    """H7. max(1, int(d * fraction)) names by hash, one at least stays."""
    import hashlib

    order = sorted(features, key=lambda c: (hashlib.md5(f"{seed}|remove|{c}".encode()).hexdigest(), c))
    return order[: min(max(1, int(len(features) * fraction)), len(features) - 1)]


def feature_removal(df: DataFrame, keys: list[str], target: str, fraction: float, seed: int = 42) -> DataFrame:
    return df.drop(*removed_features([c for c in df.columns if c not in (*keys, target)], fraction, seed))


def apply_shift(df: DataFrame, keys: list[str], target: str, family: str, severity: float | None = None, seed: int = 42) -> DataFrame:
    """H1, H8. One family at a severity (its default, if none)."""
    features = [c for c in df.columns if c not in (*keys, target)]
    s = severity or DEFAULTS.get(family, 0.0)
    if family in PASSING:
        return df
    if family == "gaussian_noise":
        return gaussian_noise(df, keys, s, [c for c in numeric_columns(df) if c in features], seed)
    if family == "missing_values":
        return missing_values(df, keys, s, features, seed)
    if family == "label_noise":
        return label_noise(df, keys, target, s, seed)
    if family == "class_prior_shift":
        return class_prior_shift(df, keys, target, 0.5, seed)
    if family == "structured_label_drift":
        return structured_label_drift(df, keys, target, s or 0.1, seed)
    if family == "feature_removal":
        return feature_removal(df, keys, target, s, seed)
    raise ValueError(f"unknown shift family {family}")


def _prior_edges(df: DataFrame, keys: list[str], target: str, classes: list, fold: str, k: int, seed: int) -> DataFrame:
    """(unit_fold, __top, __edge): the largest class of a fold's training rows, and the last (draw, keys...) of the half of it that moves.

    Counts by slices of the uniform draw tell the slice where the half ends; only its rows are put in order.
    """
    spark, names = df.sparkSession, F.array(*[F.lit(c) for c in classes])
    drawn = df.where(F.col(target).isNotNull()).select(fold, F.array_position(names, F.col(target)).cast("int").alias("c"), u("prior", *keys, seed=seed).alias("__d"), *keys)
    slices = 2048
    cut = drawn.withColumn("s", F.floor(F.col("__d") * slices).cast("int"))
    counts = np.zeros((k + 1, len(classes), slices), np.int64)  # 0: rows of no unit's test side
    for r in cut.groupBy(fold, "c", "s").agg(F.count("*").alias("n")).collect():  # folds x classes x slices
        counts[r[fold] if r[fold] is not None and 1 <= r[fold] <= k else 0, r.c - 1, r.s] += r.n
    found = []
    for i in range(1, k + 1):
        train = counts.sum(0) - counts[i]
        n = train.sum(1)
        top = int(n.argmax())  # ties: the first class
        upto, move = train[top].cumsum(), int(n[top]) // 2
        if not n[top]:
            continue
        s = int(np.searchsorted(upto, move)) if move else -1
        found.append((i, top + 1, s, move - int(upto[s] - train[top, s]) if move else 0))
    wanted = spark.createDataFrame(found, "unit_fold int, c int, s int, __m int")
    place = F.row_number().over(W.partitionBy("unit_fold").orderBy("__d", *keys))  # about a slice of a class
    inside = cut.join(F.broadcast(wanted), ["c", "s"]).where(~F.col(fold).eqNullSafe(F.col("unit_fold")))
    edges = inside.withColumn("__r", place).where("__r = __m").select(F.col("unit_fold").alias("__f"), F.struct(F.col("__d").alias("__prior"), *keys).alias("__edge"))
    top = F.element_at(names, F.col("c")).alias("__top")
    return written(wanted.join(edges, F.col("unit_fold") == F.col("__f"), "left").select("unit_fold", top, "__edge"), "prior")  # one row a fold


def all_conditions(df: DataFrame, keys: list[str], target: str, chosen: DataFrame, fold: str = "fold", k: int = 5, seed: int = 42) -> DataFrame:
    """H10. Every (fold, condition) in one plan: rows with unit_fold, condition, family, severity, role.

    Only training rows are perturbed. Noise takes its sd from the fold's training rows; the prior shift ranks the largest
    class of the fold's training rows; removed features become missing. The small tables are units, not rows.
    """
    spark = df.sparkSession
    features = [c for c in df.columns if c not in (*keys, target, fold)]
    numeric = [c for c in numeric_columns(df) if c in features]
    wanted = {r.family for r in chosen.select("family").distinct().collect()}
    folds = spark.range(1, k + 1).select(F.col("id").cast("int").alias("unit_fold"))
    classes = _classes(df, target)
    some = len(classes) > 1
    scale = None
    if "gaussian_noise" in wanted:
        held = df.crossJoin(F.broadcast(folds)).where(~F.col(fold).eqNullSafe(F.col("unit_fold")))
        scale = written(noise_scale(held.select("unit_fold", *numeric), numeric, ["unit_fold"]), "scale")  # one row a fold
    prior = _prior_edges(df, keys, target, classes, fold, k, seed) if "class_prior_shift" in wanted and some else None
    # Folds without training rows have neither.
    folds = folds.join(scale.select("unit_fold"), "unit_fold", "left_semi") if scale is not None else folds
    folds = folds.join(prior.select("unit_fold"), "unit_fold", "left_semi") if prior is not None else folds
    plain = df.select(*keys, *[finite(F.col(f"`{c}`")).alias(c) if c in numeric else F.col(f"`{c}`") for c in features], target, fold)
    gone = {s: set(removed_features(features, s, seed)) for s in FAMILIES["feature_removal"]}
    train = F.col("role") == "train"
    out = None
    # Each family is a plan of its own with few expressions a row; draws depend on key and column only and are made before rows are copied.
    for family in sorted(wanted):
        units, draws, new = folds.crossJoin(chosen.where(F.col("family") == family)), {}, {}
        if family == "missing_values":
            draws = {f"__u{i}": u(f"lost|{c}", *keys, seed=seed) for i, c in enumerate(features)}
            new = {c: F.when(train & (F.col(f"__u{i}") < F.col("severity")), F.lit(None)).otherwise(F.col(f"`{c}`")) for i, c in enumerate(features)}
        elif family == "gaussian_noise":
            units = units.join(scale, "unit_fold")
            draws = {f"__z{i}": z(f"noise|{c}", *keys, seed=seed) for i, c in enumerate(features) if c in numeric}
            new = {c: F.when(train, F.col(f"`{c}`") + F.col(f"__z{i}") * F.col("severity") * F.col(f"`{c}__sd`")).otherwise(F.col(f"`{c}`")) for i, c in enumerate(features) if c in numeric}
        elif family == "feature_removal":
            for c in features:
                lost = [s for s, names in gone.items() if c in names]
                if lost:
                    new[c] = F.when(F.col("severity").isin(lost), F.lit(None)).otherwise(F.col(f"`{c}`"))
        elif family == "label_noise" and some:
            draws = {"__flip": F.when(F.col(target).isNotNull(), u("flip", *keys, seed=seed)), "__other": other_class(F.col(target), classes, u("to", *keys, seed=seed))}
            new = {target: F.when(train & (F.col("__flip") < F.col("severity")), F.col("__other")).otherwise(F.col(target))}
        elif family == "class_prior_shift" and some:
            units = units.join(prior, "unit_fold")
            draws = {"__prior": F.struct(u("prior", *keys, seed=seed).alias("__prior"), *keys), "__minor": u("minor", *keys, seed=seed)}
            rest = F.array_remove(F.array(*[F.lit(c) for c in classes]), F.col("__top"))
            to = F.element_at(rest, (F.floor(F.col("__minor") * (len(classes) - 1)) + 1).cast("int"))
            new = {target: F.when(train & (F.col(target) == F.col("__top")) & (F.col("__prior") <= F.col("__edge")), to).otherwise(F.col(target))}
        rows = plain.withColumns(draws).crossJoin(F.broadcast(units))  # folds x severities of the family
        one = rows.withColumn("role", F.when(F.col(fold) == F.col("unit_fold"), "test").otherwise("train")).withColumns(new)
        one = one.select(*keys, *features, target, "unit_fold", "role", "family", "severity", "condition")
        out = one if out is None else out.unionByName(one)
    return out
