"""What the operators of this folder share: tables, the shared scratch folder, salted ranks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_LOCAL: dict[str, str] = {}
BUCKET_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one only where that is unset on a local master (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet, read back. Survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand so many rows at a time to Python workers: of long texts the default is much memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id written as text, modulo m (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % m


def salted_prefix(df: DataFrame, group: list[str], order: list[str], value: str, out: str, buckets: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group that come before.

    The order is (hash bucket of the order columns, order columns), so a group that holds a third of
    all rows is summed by ``buckets`` tasks: bucket totals (map-side combined) give offsets and each
    task only runs over its own bucket. Rows alike in all order columns are interchangeable. Without ``buckets`` there
    is one for BUCKET_ROWS rows of the table, 64 at least.
    """
    buckets = buckets or max(64, -(-df.count() // BUCKET_ROWS))
    salted = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    totals = salted.groupBy(*group, "__b").agg(F.sum(value).alias("__n"))
    before = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__b").alias("__ob"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    on = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)] + [F.col("__b") == F.col("__ob")]
    run = W.partitionBy(*group, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = salted.withColumn("__r", F.coalesce(F.sum(value).over(run), F.lit(0)))
    return ranked.join(offsets, on).withColumn(out, F.col("__o") + F.col("__r")).drop("__b", "__r", "__o", "__ob", *[f"__g{i}" for i in range(len(group))])
