"""R. The relational pieces that the other operators are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.keys import dist_rank, text_order
from ..functions.shared import written


def columns_by_kind(df: DataFrame) -> tuple[list[str], list[str]]:
    """R2. Numeric (with boolean) and other columns."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    return numeric, [c for c in df.columns if c not in numeric]


def family_of(condition: Column, family: str) -> Column:
    """R4. Conditions of a family, and the clean one."""
    return condition.startswith(f"{family}_") | (condition == "clean")


def severity(condition: Column) -> Column:
    """R5. The number after the last underscore; clean is 0."""
    return F.when(condition == "clean", 0.0).otherwise(F.element_at(F.split(condition, "_"), -1).try_cast("double"))


def strict_pivot(df: DataFrame, index: list[str], pivot: str, values: list[str], value: str) -> DataFrame:
    """R17. One row an index with a column for each value; a cell given twice raises."""
    cells = df.where(F.col(pivot).isin(values)).groupBy(*index, pivot).agg(F.count("*").alias("__n"), F.max(value).alias("__v"))
    checked = cells.withColumn("__v", F.when(F.col("__n") > 1, F.raise_error(F.lit("a cell of the pivot is given twice")).cast("double")).otherwise(F.col("__v")))
    return checked.groupBy(*index).pivot(pivot, values).agg(F.max("__v"))


def mean_pivot(df: DataFrame, index: list[str], pivot: str, values: list[str], value: str) -> DataFrame:
    """R18. As strict_pivot, with the mean of each cell."""
    return df.groupBy(*index).pivot(pivot, values).agg(F.avg(value))


def mean_std(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """R19."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def value_counts(df: DataFrame, c: str, missing: bool = False) -> DataFrame:
    """R20. Counts and shares of a column's values; with ``missing``, null is one of them."""
    counts = (df if missing else df.where(F.col(c).isNotNull())).groupBy(F.col(c).alias("value")).count()
    total = counts.agg(F.sum("count").alias("__n"))
    return counts.crossJoin(F.broadcast(total)).select("value", "count", (F.col("count") / F.col("__n")).alias("share"))


def distinct_count(df: DataFrame, c: str) -> Column:
    """R21. Distinct values; null is one."""
    return F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))


def average_rank(df: DataFrame, block: list[str], value: str, descending: bool = True) -> DataFrame:
    """R22. Rank within the block, ties sharing their mean rank; a block holds one row a method."""
    w = W.partitionBy(*block).orderBy(F.desc(value) if descending else F.asc(value))
    return df.withColumn("rank", F.rank().over(w) + (F.count("*").over(w.rangeBetween(0, 0)) - 1) / 2)


def missing_report(df: DataFrame, k: int = 10) -> DataFrame:
    """R23. The k columns with the most missing cells."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "missing").orderBy(F.desc("missing"), "column").limit(k)


def labelled(c: Column, labels: dict[str, str]) -> Column:
    """R24. The value's label, itself where it has none."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[c], c)


def levels(df: DataFrame, c: str) -> DataFrame:
    """R25, R26. Sorted distinct texts with their number from 0; a column's levels, not its rows, are ranked, in many tasks."""
    found = df.select(F.col(c).cast("string").alias("level")).where("level is not null").distinct()
    return dist_rank(found, text_order(F.col("level")), ["level"], out="index").withColumn("index", (F.col("index") - 1).cast("int"))


def factorize(df: DataFrame, c: str, out: str) -> DataFrame:
    """R25. Level numbers, missing as a level "missing"."""
    filled = df.withColumn("__l", F.coalesce(F.col(c).cast("string"), F.lit("missing")))
    known = written(levels(filled, "__l").select(F.col("level").alias("__l"), F.col("index").alias(out)), "levels")  # of known size: few are broadcast
    return filled.join(known, "__l").drop("__l")


def encode_labels(df: DataFrame, level_table: DataFrame, c: str, out: str, strict: bool = False) -> DataFrame:
    """R26. Numbers of known labels; others are null, or raise."""
    known = level_table.select(F.col("level").alias("__l"), F.col("index").alias(out))
    got = df.withColumn("__l", F.col(c).cast("string")).join(known, "__l", "left").drop("__l")
    if strict:
        got = got.withColumn(out, F.when(F.col(out).isNull() & F.col(c).isNotNull(), F.raise_error(F.lit("a label was not seen in training")).cast("int")).otherwise(F.col(out)))
    return got


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """R12, G2. Tasks that aren't done."""
    return grid.join(done.select(*keys), keys, "left_anti")


def top_k(df: DataFrame, by: str, name: str, k: int) -> DataFrame:
    """R16. The k largest, ties by name."""
    return df.orderBy(F.desc(by), name).limit(k)
