"""Randomness that depends only on row keys, and exact ranks and running sums without a one-task window."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .shared import written

SEED, BUCKETS = 42, 32  # buckets at least; more where the session has more shuffle partitions


def bucket_count(df: DataFrame, buckets: int | None = None) -> int:
    return buckets or max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def digest(tag: str, *keys: str, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[F.col(k).cast("string") for k in keys]))


def _unit(h: Column, at: int) -> Column:
    """13 hexadecimal digits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(h, at, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def u(tag: str, *keys: str, seed: int = SEED) -> Column:
    """Uniform in [0, 1)."""
    return _unit(digest(tag, *keys, seed=seed), 1)


def z(tag: str, *keys: str, seed: int = SEED) -> Column:
    """Standard normal; both uniforms come from one digest."""
    h = digest(tag, *keys, seed=seed)
    return F.sqrt(-2 * F.log(1 - _unit(h, 1))) * F.cos(2 * math.pi * _unit(h, 14))


def text_order(c: Column) -> Column:
    """A number in the order of a text's first six bytes."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def place_among(edges: str | Column, v: Column, most: int) -> Column:
    """How many of the ascending edges, ``most`` at most, are below v: found by halves, 11 steps for 2,000 edges."""
    e = F.col(edges) if isinstance(edges, str) else edges
    steps = [1 << i for i in range(max(1, most).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda p, s: F.when(F.get(e, p + s - 1) < v, p + s).otherwise(p))


def _accuracy(buckets: int) -> int:
    return max(1000, 10 * buckets)


def _split_ties(joined: DataFrame, part: list[str], tie: str, buckets: int) -> DataFrame:
    """Adds __s: within a value that fills two buckets or more, the place among quantiles of the tie column; else -1."""
    of = F.col(tie).cast("double") if not isinstance(joined.schema[tie].dataType, T.StringType) else text_order(F.col(tie))
    tied = joined.withColumn("__t", of).withColumn("__k", F.size(F.filter("__e", lambda e: e == F.col("__v"))) > 1)
    edges = tied.where("__k").groupBy(*[F.col(p).alias(f"__q{i}") for i, p in enumerate(part)], F.col("__v").alias("__qv")).agg(F.percentile_approx("__t", [(i + 1) / buckets for i in range(buckets - 1)], _accuracy(buckets)).alias("__te"))
    on = [F.col(p).eqNullSafe(F.col(f"__q{i}")) for i, p in enumerate(part)] + [F.col("__v") == F.col("__qv")]
    cut = tied.join(edges if part else F.broadcast(edges), on, "left")  # without parts there are fewer such values than buckets
    return cut.withColumn("__s", F.when(F.col("__k") & F.col("__te").isNotNull(), place_among("__te", F.col("__t"), buckets)).otherwise(-1)).drop("__t", "__k", "__te", "__qv", *[f"__q{i}" for i in range(len(part))])


def _bucketed(df: DataFrame, part: list[str], by: Column, buckets: int, uniform: bool = False, tie: str | None = None) -> DataFrame:
    """Adds __v (the sort value) and __b: its place among approximate quantiles, for each part; known for uniform values.

    With ``tie`` __b is (place, place among the ties of one value).
    """
    valued = df.withColumn("__v", by.cast("double"))
    if uniform:
        return valued.withColumn("__b", F.floor(F.col("__v") * buckets).cast("int"))
    at = [(i + 1) / buckets for i in range(buckets - 1)]
    edges = valued.groupBy(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(part)]).agg(F.percentile_approx("__v", at, _accuracy(buckets)).alias("__e"))
    if part:  # one row a part: written, so that its size is known, and small ones are broadcast instead of dealing rows by part
        edges = written(edges, "edges")
    on = [F.col(p).eqNullSafe(F.col(f"__p{i}")) for i, p in enumerate(part)]
    joined = valued.join(edges, on) if part else valued.crossJoin(F.broadcast(edges))  # without parts the edges are one row
    placed = joined.withColumn("__b", place_among("__e", F.col("__v"), buckets)).drop(*[f"__p{i}" for i in range(len(part))])
    if tie:
        placed = _split_ties(placed, part, tie, buckets).withColumn("__b", F.struct("__b", "__s")).drop("__s")
    return placed.drop("__e")


def _offsets(df: DataFrame, part: list[str], sums: dict[str, Column]) -> DataFrame:
    """For each part and bucket, the sums over the buckets before: a table of parts x buckets rows."""
    totals = df.groupBy(*part, "__b").agg(*[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()])
    before = W.partitionBy(*part).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(part)], F.col("__b").alias("__ob"), *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums])


def _with_offsets(df: DataFrame, part: list[str], offsets: DataFrame) -> DataFrame:
    on = [F.col(p).eqNullSafe(F.col(f"__p{i}")) for i, p in enumerate(part)] + [F.col("__b") == F.col("__ob")]
    return df.join(offsets, on)


def _clean(df: DataFrame, keep: list[str], new: list[str]) -> DataFrame:
    return df.select(*keep, *new)


def dist_rank(df: DataFrame, by: Column, tie: list[str], part: list[str] | None = None, out: str = "rank", buckets: int | None = None, uniform: bool = False) -> DataFrame:
    """row_number() over (partition by part order by by, tie), dealt to ``buckets`` tasks a part.

    A value that many rows have is dealt out as well, by its first tie column. ``uniform``: ``by`` is uniform in [0, 1),
    so no quantiles are needed.
    """
    part, columns, buckets = part or [], df.columns, bucket_count(df, buckets)
    b = _bucketed(df, part, by, buckets, uniform, tie[0] if tie and not uniform else None)
    inner = F.row_number().over(W.partitionBy(*part, "__b").orderBy("__v", *tie))
    # Offsets are written: their size is known, and rows aren't dealt again to meet few of them.
    ranked = _with_offsets(b.withColumn("__r", inner), part, written(_offsets(b, part, {"n": F.lit(1)}), "offsets"))
    return _clean(ranked.withColumn(out, (F.col("__r") + F.col("__o_n")).cast("long")), columns, [out])


def running_sums(df: DataFrame, by: Column, sums: dict[str, str], part: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Adds for each name the sum of its column over all rows of the part up to and with this value (values are distinct in a part)."""
    part, columns, buckets = part or [], df.columns, bucket_count(df, buckets)
    b = _bucketed(df, part, by, buckets)
    inner = W.partitionBy(*part, "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    run = b.select("*", *[F.sum(c).over(inner).alias(f"__s_{k}") for k, c in sums.items()])
    joined = _with_offsets(run, part, _offsets(b, part, {k: F.col(c) for k, c in sums.items()}))
    return _clean(joined.select("*", *[(F.col(f"__s_{k}") + F.col(f"__o_{k}")).alias(k) for k in sums]), columns, list(sums))


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: list[tuple[float, Callable[[Column], Column]]], accuracy: int = 1000) -> DataFrame:
    """(by..., n, u: array) of each group's values: exactly those of the given ranks (from 1), without sorting or moving all rows.

    ``ranks``: about which share of the rows lies before, and the rank as an expression of n. Approximate quantiles enclose each
    rank, as their error is bounded; counts of what lies below, and the few values in between, tell the exact one.
    The tables in the middle have one row a group.
    """
    x, m = F.col(value), len(ranks)
    rows = df.where(x.isNotNull()).select(*by, x.cast("double").alias("__x"))
    ends = [min(1.0, max(0.0, p + d)) for p, _ in ranks for d in (-2 / accuracy, 2 / accuracy)]
    bounds = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("__x", ends, accuracy).alias("__e"))
    wanted = F.array(*[f(F.col("n")).cast("long") for _, f in ranks])
    bounds = written(bounds.withColumn("__w", wanted), "bounds")
    on = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)]
    named = bounds.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], "n", "__e", "__w")
    joined = rows.join(named, on) if by else rows.crossJoin(F.broadcast(named))
    low, high = (lambda j: F.col("__e")[2 * j]), (lambda j: F.col("__e")[2 * j + 1])
    below = joined.groupBy(*by).agg(F.array(*[F.count_if(F.col("__x") < low(j)) for j in range(m)]).alias("__l"))
    inside = F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: (F.get("__e", 2 * j) <= F.col("__x")) & (F.col("__x") <= F.get("__e", 2 * j + 1)))
    some = joined.select(*by, "__w", F.explode(inside).alias("__j"), "__x").groupBy(*by, "__w", "__j", "__x").agg(F.count("*").alias("__c"))
    on_below = [F.col(c).eqNullSafe(F.col(f"__h{i}")) for i, c in enumerate(by)]
    less = below.select(*[F.col(c).alias(f"__h{i}") for i, c in enumerate(by)], "__l")
    met = some.join(less, on_below) if by else some.crossJoin(F.broadcast(less))
    upto = F.col("__l")[F.col("__j")] + F.sum("__c").over(W.partitionBy(*by, "__j").orderBy("__x"))
    found = met.withColumn("__upto", upto).where(F.col("__upto") >= F.col("__w")[F.col("__j")]).groupBy(*by, "__j").agg(F.min("__x").alias("__x"))
    got = found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__j", "__x"))), lambda s: s["__x"]).alias("u"))
    if not by:
        return got.crossJoin(F.broadcast(bounds.select("n")))
    back = got.join(named, on).select(*by, "n", "u")
    return back


def least_from(df: DataFrame, by: Column, value: str, out: str, buckets: int | None = None) -> DataFrame:
    """Adds the least ``value`` over all rows from this one's ``by`` upwards (``by`` is distinct)."""
    columns, b = df.columns, _bucketed(df, [], by, bucket_count(df, buckets))
    inner = W.partitionBy("__b").orderBy(F.desc("__v")).rowsBetween(W.unboundedPreceding, 0)
    above = W.orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, -1)  # one row a bucket
    rest = b.groupBy("__b").agg(F.min(value).alias("__t")).select(F.col("__b").alias("__ob"), F.min("__t").over(above).alias("__o"))
    joined = _with_offsets(b.withColumn("__r", F.min(value).over(inner)), [], rest)
    return _clean(joined.withColumn(out, F.least("__r", "__o")), columns, [out])
