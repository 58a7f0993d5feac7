"""P. Parameters fitted on the training rows, for each unit (fold, condition) in one plan, and applied to any rows."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import check_plain, clip, finite, numeric_columns
from ..functions.shared import written
from .relational import factorize, levels

ENCODINGS = ("onehot", "label")


def fit_numeric(train: DataFrame, cols: list[str], unit: list[str] | None = None) -> DataFrame:
    """P1, P2, P7. (unit..., <c>__mean, <c>__sd): population sd, 1 where it is 0; the mean of an all-missing column is null."""
    out = []
    for c in cols:
        x = finite(F.col(f"`{c}`"))
        # The sd is that of the mean-filled column: missing cells add nothing but their number.
        filled = F.stddev_pop(x) * F.sqrt(F.count(x) / F.count(F.lit(1)))
        out += [F.avg(x).alias(f"{c}__mean"), F.when(filled > 0, filled).otherwise(1.0).alias(f"{c}__sd")]
    return train.groupBy(*(unit or [])).agg(*out)


def apply_numeric(df: DataFrame, params: DataFrame, cols: list[str], unit: list[str] | None = None, scale: bool = True) -> DataFrame:
    """Mean-filled and, with ``scale``, standardised columns; all-missing ones give 0 (scaled) for the unit."""
    small = F.broadcast(params)  # one row a unit
    joined = df.join(small, unit) if unit else df.crossJoin(small)
    keep = [c for c in df.columns if c not in cols]

    def one(c: str) -> Column:
        x, mean = F.coalesce(finite(F.col(f"`{c}`")), F.col(f"`{c}__mean`")), F.col(f"`{c}__mean`")
        return F.coalesce((x - mean) / F.col(f"`{c}__sd`") if scale else x, F.lit(0.0)).alias(c)

    return joined.select(*keep, *[one(c) for c in cols])


def fit_modes(train: DataFrame, cols: list[str], unit: list[str] | None = None) -> DataFrame:
    """P3. Most frequent level of each column, the smallest on ties."""
    unit = unit or []
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("l")) for i, c in enumerate(cols)]))
    counts = train.select(*unit, cell.alias("__c")).groupBy(*unit, "__c.i", "__c.l").agg(F.count("*").alias("n"))  # levels, counted map-side
    rank = lambda i: F.when((F.col("i") == i) & F.col("l").isNotNull(), F.struct(-F.col("n"), "l"))
    return counts.groupBy(*unit).agg(*[F.min_by("l", rank(i)).alias(f"{c}__mode") for i, c in enumerate(cols)])


def one_hot(df: DataFrame, c: str, known: list[str]) -> DataFrame:
    """P4. One column a known level; unknown and missing cells are 0 in all of them."""
    return df.select(*[x for x in df.columns if x != c], *[F.when(F.col(f"`{c}`").cast("string") == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for v in known])


def sparse_prepare(train: DataFrame, test: DataFrame, keys: list[str], target: str, scale: bool = True, most: int = 500_000) -> tuple[DataFrame, DataFrame, list[str]]:
    """P4, P6. (keys..., target, features) of both sides, one sparse vector a row, and the names of its first places (the numbers).

    Each text column has a place for each of its training levels, in their order, however many there are: levels are ranked in many
    tasks and joined to the rows by key beyond ``most`` of them, broadcast below; none comes to the driver. Missing cells
    take the training mode, unknown levels are 0 in all their places.
    """
    check_plain(train.drop(*keys))
    features = [c for c in train.columns if c not in (*keys, target)]
    numeric = [c for c in numeric_columns(train) if c in features]
    text = [c for c in features if c not in numeric]
    seen = train.agg(*[F.count(finite(F.col(f"`{c}`")) if c in numeric else F.col(f"`{c}`")).alias(c) for c in features]).first() if features else {}
    numeric, text = [c for c in numeric if seen[c]], [c for c in text if seen[c]]
    if not numeric + text:
        raise ValueError("no column is left")
    params, modes = fit_numeric(train, numeric) if numeric else None, fit_modes(train, text).first() if text else None
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(modes[f"{c}__mode"]))
    sides = [apply_numeric(s.select(*keys, target, *numeric, *text), params, numeric, scale=scale) if numeric else s.select(*keys, target, *text) for s in (train, test)]
    spark, parts = train.sparkSession, [f"__n{i}" for i in range(len(numeric))]
    sides = [s.select(*keys, target, *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(numeric, parts, strict=True)], *[filled(c).alias(f"__t{i}") for i, c in enumerate(text)]) for s in sides]
    for i, c in enumerate(text):
        table = levels(train.select(filled(c).alias("__l")), "__l").select(F.col("level").alias(f"__t{i}"), F.col("index").cast("double").alias(f"__i{i}")).transform(lambda t: written(t, "levels"))
        n = table.count()
        known = F.broadcast(table) if n <= most else table
        # The place after the last level stands for unknown ones, and is dropped.
        encoder = OneHotEncoder(inputCol=f"__i{i}", outputCol=f"__v{i}", handleInvalid="keep", dropLast=True).fit(spark.createDataFrame([(float(n - 1),)], f"__i{i} double"))
        sides = [encoder.transform(s.join(known, f"__t{i}", "left").fillna(float(n), [f"__i{i}"])).drop(f"__t{i}", f"__i{i}") for s in sides]
        parts.append(f"__v{i}")
    assembler = VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")
    a, b = (assembler.transform(s).select(*keys, target, "features") for s in sides)
    return a, b, numeric


def ordinal(df: DataFrame, c: str, level_table: DataFrame) -> DataFrame:
    """P5. Number of the level, -1 for unknown and missing ones."""
    known = level_table.select(F.col("level").alias("__l"), F.col("index").alias("__i"))
    got = df.withColumn("__l", F.col(f"`{c}`").cast("string")).join(known, "__l", "left")
    return got.withColumn(c, F.coalesce("__i", F.lit(-1)).cast("double")).drop("__l", "__i")


def prepare(train: DataFrame, test: DataFrame, keys: list[str], target: str, encoding: str = "onehot", scale: bool = True) -> tuple[DataFrame, DataFrame]:
    """P6. The numeric block, then the text block, fitted on ``train``; all-missing training columns are dropped."""
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding}")
    check_plain(train.drop(*keys))
    features = [c for c in train.columns if c not in (*keys, target)]
    numeric = [c for c in numeric_columns(train) if c in features]
    text = [c for c in features if c not in numeric]
    seen = train.agg(*[F.count(finite(F.col(f"`{c}`")) if c in numeric else F.col(f"`{c}`")).alias(c) for c in features]).first() if features else {}
    numeric, text = [c for c in numeric if seen[c]], [c for c in text if seen[c]]
    if not numeric + text:
        raise ValueError("no column is left")
    sides = []
    params = fit_numeric(train, numeric) if numeric else None
    modes = fit_modes(train, text).first() if text else None
    tables = {c: levels(train.fillna(modes[f"{c}__mode"], [c]), c) for c in text}
    for side in (train, test):
        out = apply_numeric(side.select(*keys, target, *numeric, *text), params, numeric, scale=scale) if numeric else side.select(*keys, target, *text)
        out = out.select(*keys, target, *numeric, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(modes[f"{c}__mode"])).alias(c) for c in text])
        for c in text:
            out = one_hot(out, c, [r.level for r in tables[c].orderBy("index").collect()]) if encoding == "onehot" else ordinal(out, c, tables[c])
        sides.append(out)
    return sides[0], sides[1]


def quick_prepare(df: DataFrame) -> DataFrame:
    """P8. Distinct rows, numbers filled with the mean, texts with the mode ("missing" if there is none)."""
    d = df.dropDuplicates()
    numeric = numeric_columns(d)
    text = [c for c in d.columns if c not in numeric]
    p = d.agg(*[F.avg(finite(F.col(f"`{c}`"))).alias(c) for c in numeric]).first().asDict() if numeric else {}
    modes = fit_modes(d, text).first() if text else {}
    p |= {c: modes[f"{c}__mode"] for c in text}
    return d.select(*[F.coalesce(finite(F.col(f"`{c}`")), F.lit(p[c])).alias(c) if c in numeric else F.coalesce(F.col(f"`{c}`"), F.lit(p[c] if p[c] is not None else "missing")).alias(c) for c in d.columns])


def encode_for_scoring(df: DataFrame, keys: list[str], limit: float = 1e12) -> DataFrame:
    """P9. Numbers finite, mean-filled (0 if all missing) and clipped; texts as level numbers."""
    numeric = [c for c in numeric_columns(df) if c not in keys]
    text = [c for c in df.columns if c not in (*keys, *numeric)]
    means = df.agg(*[F.avg(finite(F.col(f"`{c}`"))).alias(c) for c in numeric]).first() if numeric else {}
    out = df.select(*keys, *[clip(F.coalesce(finite(F.col(f"`{c}`")), F.lit(means[c] if means[c] is not None else 0.0)), -limit, limit).alias(c) for c in numeric], *text)
    for c in text:
        out = factorize(out, c, "__i").withColumn(c, F.col("__i").cast("double")).drop("__i")
    return out.select(*df.columns)


def fill_selected(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """P10. Finite values, then the training mean, then 0."""
    means = train.agg(*[F.avg(finite(F.col(f"`{c}`"))).alias(c) for c in cols]).first()
    fill = lambda df: df.select(*[x for x in df.columns if x not in cols], *[F.coalesce(finite(F.col(f"`{c}`")), F.lit(means[c]), F.lit(0.0)).alias(c) for c in cols])
    return fill(train), fill(test)
