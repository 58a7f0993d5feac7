"""Labelled tables, profiles and results: readers, writers, targets and row caps."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import digest, u
from ..functions.numeric import finite

# Texts that mean a missing cell (fixed values); "?" only on demand.
MISSING = ["", "NA", "N/A", "n/a", "nan", "NaN", "-nan", "-NaN", "NULL", "null", "None", "<NA>", "#N/A", "#NA"]

_TEXT, _WHOLE, _REAL = T.StringType(), T.IntegerType(), T.DoubleType()
#: A result row, in the order of use (fixed names).
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("dataset", _TEXT), T.StructField("seed", _WHOLE), T.StructField("fold", _WHOLE), T.StructField("condition", _TEXT), T.StructField("pipeline", _TEXT), T.StructField("model", _TEXT), T.StructField("status", _TEXT),
        T.StructField("train_time_s", _REAL), T.StructField("infer_time_s", _REAL), T.StructField("autofe_gen_time_s", _REAL), T.StructField("autofe_cache_hit", T.BooleanType()),
        T.StructField("n_generated", _WHOLE), T.StructField("n_retained", _WHOLE), T.StructField("ram_used_mb", _REAL), T.StructField("wasserstein", _REAL), T.StructField("ks_stat", _REAL),
        T.StructField("train_auc", _REAL), T.StructField("test_auc", _REAL), T.StructField("accuracy", _REAL), T.StructField("balanced_accuracy", _REAL), T.StructField("mcc", _REAL), T.StructField("precision", _REAL),
        T.StructField("recall", _REAL), T.StructField("f1", _REAL), T.StructField("log_loss", _REAL), T.StructField("brier_score", _REAL), T.StructField("roc_auc", _REAL), T.StructField("pr_auc", _REAL),
    ]
)
TASK_KEY = ["dataset", "seed", "fold", "condition", "pipeline", "model"]


def normalise_missing(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Missing tokens of text columns and NaN of floating columns become null."""
    tokens, out = MISSING if tokens is None else tokens, []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(~F.trim(c).isin(tokens), c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def read_labelled_csv(spark: SparkSession, path: str, question_mark: bool = False, samples: float = 1.0) -> DataFrame:
    """S1. A CSV with a header; missing tokens go before types are inferred, so they don't turn numbers into text."""
    text = normalise_missing(spark.read.option("header", True).csv(path), MISSING + ["?"] * question_mark)
    flags = text.sample(samples, 1) if samples < 1 else text
    tests = []
    for c in text.columns:
        x = F.col(f"`{c}`")
        tests += [F.min((x.try_cast("bigint").isNotNull() | x.isNull()).cast("int")), F.min((x.try_cast("double").isNotNull() | x.isNull()).cast("int")), F.min((F.lower(x).isin("true", "false") | x.isNull()).cast("int")), F.count(x)]
    row = flags.agg(*[t.alias(f"t{i}") for i, t in enumerate(tests)]).first()
    kinds = []
    for i in range(len(text.columns)):
        whole, real, boolean, n = row[4 * i : 4 * i + 4]
        kinds.append("double" if not n else "boolean" if boolean else "bigint" if whole else "double" if real else "string")
    typed = text.select(*[F.col(f"`{c}`").try_cast(k).alias(c) for c, k in zip(text.columns, kinds, strict=True)])
    return normalise_missing(typed, [])


def resolve_target(df: DataFrame, target: str | None = None) -> str:
    """S2. The named column, else "target", else "target_label"."""
    for name in [target] if target else ["target", "target_label"]:
        if name in df.columns:
            return name
    raise KeyError(f"no target column among {df.columns}")


def attach_target(features: DataFrame, labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """S3. Labels joined by key as "target", or "target_label" where a feature has that name."""
    name = "target_label" if "target" in features.columns else "target"
    return features.join(labels.select(*keys, F.col(label).alias(name)), keys)


def default_target(df: DataFrame, dataset: str | None = None, overrides: dict[str, str] | None = None) -> str:
    """S4. The last column, unless the dataset has one of its own."""
    return (overrides or {}).get(dataset, df.columns[-1])


def cap_rows(df: DataFrame, keys: list[str], max_rows: int = 100_000, seed: int = 42) -> DataFrame:
    """S5. Exactly ``max_rows`` rows (all, if fewer), the same whatever the partitions."""
    marked, n = df.withColumn("__h", digest("cap", *keys, seed=seed)), df.count()
    if n > max_rows:  # a little more than the share is kept by the hash alone, so that hardly more rows than wanted are ranked
        share = (max_rows + 10 * max_rows**0.5 + 100) / n
        near = marked.where(u("cap", *keys, seed=seed) < share)
        marked = near if share >= 1 or near.count() >= max_rows else marked
    return marked.orderBy("__h", *keys).limit(max_rows).drop("__h")


def write_csv(df: DataFrame, path: str, small: bool = False) -> None:
    """S6, S13."""
    (df.coalesce(1) if small else df).write.mode("overwrite").option("header", True).csv(path)


def write_profile(profile: DataFrame, path: str, dataset: str) -> None:
    """S7. One JSON row for a dataset, under its name."""
    profile.coalesce(1).write.mode("overwrite").json(f"{path}/dataset={dataset}")


def read_profiles(spark: SparkSession, path: str, domains: dict[str, str] | None = None) -> DataFrame:
    """S8. All profiles with their dataset (from the place) and domain ("Other" by default)."""
    profiles = spark.read.json(path)
    if not domains:
        return profiles.withColumn("domain", F.lit("Other"))
    known = spark.createDataFrame(list(domains.items()), "dataset string, domain string")
    return with_domain(profiles, known)


def with_domain(profiles: DataFrame, domains: DataFrame) -> DataFrame:
    return profiles.join(F.broadcast(domains), "dataset", "left").withColumn("domain", F.coalesce("domain", F.lit("Other")))


def append_results(df: DataFrame, path: str) -> None:
    """S9. Rows of the result schema, appended as JSON lines."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in RESULT_SCHEMA.fields if f.name in df.columns]).write.mode("append").json(path)


def read_results(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """S10, S11. Results as JSON lines: blank and malformed lines are skipped, or, if strict, raise."""
    got = spark.read.schema(RESULT_SCHEMA).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return got.select(*[finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in RESULT_SCHEMA.fields])


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """S12."""
    return read_labelled_csv(spark, path)


def _there(e: Exception) -> bool:
    """Whether a read failed for another reason than that nothing is there yet."""
    return "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e)


def committed(spark: SparkSession, path: str, by: list[str]) -> DataFrame | None:
    """(by..., attempt, rows) of the units that are whole: the first attempt that was marked; None if there is none yet."""
    try:
        marks = spark.read.parquet(f"{path}/manifest")
    except Exception as e:  # noqa: BLE001
        if _there(e):
            raise
        return None
    first = marks.groupBy(*by).agg(F.min_by(F.struct("attempt", "rows"), F.struct("at", "attempt")).alias("__m"))
    return first.select(*by, "__m.attempt", "__m.rows")


def _mark(units: DataFrame, path: str) -> None:
    """One small file: a unit counts as written from here on."""
    units.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def read_units(spark: SparkSession, path: str, by: list[str], schema: T.StructType) -> DataFrame:
    """Rows of committed units only; filters on ``by`` prune folders, and so does the join with the manifest."""
    done = committed(spark, path, by)
    if done is None:
        return spark.createDataFrame([], schema)
    data = spark.read.schema(T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])).option("basePath", f"{path}/data").parquet(f"{path}/data")
    units = done.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("attempt").alias("__attempt"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("attempt") == F.col("__attempt")]
    return data.join(F.broadcast(units), on, "left_semi").select(*schema.fieldNames())  # one row a unit


def materialise(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """S14, S15. Write the units (by...) that aren't there yet, then read all of them.

    A call writes its units to a folder of its own and then marks them, with their number of rows, in the manifest. What was
    written but not marked doesn't count: it is never read, and the next call writes just those units again. Of two
    calls that write one unit at the same time the first to mark it counts.
    """
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    done = committed(spark, path, by)
    if done is not None:
        done = done.select(*[F.col(c).alias(f"__{c}") for c in by])
        df = df.join(F.broadcast(done), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left_anti")  # one row a unit
    folder = f"{path}/data/attempt={attempt}"
    df.write.partitionBy(*by).parquet(folder)
    written = spark.read.schema(df.schema).parquet(folder).groupBy(*by).agg(F.count("*").alias("rows"))
    _mark(written.withColumn("attempt", F.lit(attempt)), path)
    return read_units(spark, path, by, df.schema)


def write_prepared(train: DataFrame, test: DataFrame, params: DataFrame, path: str) -> None:
    """S16. Both sides and the fitted parameters, as one version that counts once all three are written."""
    attempt = uuid.uuid4().hex
    for name, df in (("train", train), ("test", test), ("params", params)):
        df.write.parquet(f"{path}/version={attempt}/{name}")
    _mark(train.sparkSession.createDataFrame([(attempt,)], "attempt string"), path)


def read_prepared(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S16. The latest whole version. Raises where there is none, or the two sides don't have the same columns."""
    version = spark.read.parquet(f"{path}/manifest").agg(F.max_by("attempt", F.struct("at", "attempt"))).first()[0]
    train, test, params = (spark.read.parquet(f"{path}/version={version}/{n}") for n in ("train", "test", "params"))
    if train.columns != test.columns:
        raise ValueError("train and test have other columns")
    return train, test, params


def over_datasets(tables: dict[str, DataFrame], operator) -> DataFrame:
    """S17. An operator over named tables, its rows tagged with the dataset."""
    out = None
    for name, df in tables.items():
        one = operator(df).withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def dataset_names(spark: SparkSession, text: str) -> DataFrame:
    """S18. Names of a list in YAML's block style: plain strings or ``name:`` items."""
    found = re.findall(r"^\s*-\s*(?:name:\s*)?[\"']?([^\"'#\n]+?)[\"']?\s*(?:#.*)?$", text, re.M)
    return spark.createDataFrame([(x,) for x in found], "dataset string")
