"""Labelled views of the star-schema and event tables, in SQL that both engines read.

``{table}`` stands for a table and ``u(tag, key)`` for the uniform number of a key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LI_KEY = "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(cast(l_quantity as int) as string))"
LI_Y = "case when l_extendedprice * (1 - l_discount) > 50000 then 1 else 0 end"
PIPELINES = "'Raw', 'Raw_Variance', 'Raw_MI', 'AutoFE_Baseline', 'AutoFE_MI', 'AutoFE_Random', 'AutoFE_NoMultiply'"
CONDITIONS = (
    "'clean', 'gaussian_noise_0.01', 'gaussian_noise_0.05', 'gaussian_noise_0.1', 'missing_values_0.05', 'missing_values_0.1', 'missing_values_0.2', "
    "'label_noise_0.05', 'label_noise_0.1', 'label_noise_0.2', 'covariate_shift', 'feature_removal_0.2', 'population_shift', 'class_prior_shift'"
)
MODELS = "'logistic_regression', 'random_forest', 'extra_trees', 'xgboost', 'lightgbm', 'catboost', 'linear_svm', 'knn', 'gaussian_nb', 'mlp'"

VIEWS = {
    "v_li": f"select {LI_KEY} as k, l_quantity as qty, l_extendedprice as price, l_discount as disc, l_tax as tax, l_returnflag as flag, {LI_Y} as target from {{lineitem}}",
    "v_li_na": f"select {LI_KEY} as k, l_quantity as qty, l_extendedprice as price, nullif(l_discount, 0.0) as disc, nullif(l_tax, 0.0) as tax, nullif(l_returnflag, 'N') as flag, cast(null as double) as dead, {LI_Y} as target from {{lineitem}}",
    "v_cust": "select c_custkey as k, c_acctbal as bal, c_nationkey as nat, c_mktsegment as target from {customer}",
    "v_ev": "select event_id as k, value, user_id, event_type as target from {events}",
    "v_doc": "select doc_id as k, n_chars, lang, source, quality as target from {documents} join {labels} using (doc_id)",
    "v_pred": "select event_id as k, user_id % 5 as unit, case when event_type in ('click', 'view') then 1 else 0 end as y_true, case when round(u('p', event_id), 2) >= 0.5 then 1 else 0 end as y_pred, round(u('p', event_id), 2) as p from {events}",
    "v_pair": "select value as v, event_type = 'click' as f from {events} where event_type in ('click', 'view')",
    "v_emb": "select vec_id as k, embedding as e, label as target from {embeddings}",
    # A result for each cell of the grid over datasets: an event type's events by twenty thousands, whose number counts in the scores.
    "v_res": f"""
select dataset, seed, fold, condition, pipeline, model, case when u('s', key) < 0.02 then 'failed' else 'success' end as status,
       round(0.5 + 0.5 * u('score', key), 3) as f1, round(u('t', key), 4) as infer_time_s
from (select *, concat_ws('_', dataset, cast(seed as string), cast(fold as string), condition, pipeline, model, cast(size as string)) as key
      from (select case when event_id < 20000 then event_type else concat_ws('_', event_type, cast(cast(floor(event_id / 20000) as bigint) as string)) end as dataset, count(*) as size from {{events}} group by 1)
      cross join (select explode(array(42, 123, 456, 789, 2025)) as seed)
      cross join (select explode(array(1, 2, 3, 4, 5)) as fold)
      cross join (select explode(array({CONDITIONS})) as condition)
      cross join (select explode(array({PIPELINES})) as pipeline)
      cross join (select explode(array({MODELS})) as model))""",
}


def _spelled(sql: str, duck: bool) -> str:
    if duck:
        sql = re.sub(r"explode\(array\((.*?)\)\)", r"unnest([\1])", sql)
    else:  # the same rows without a broadcast an axis
        sql = re.sub(r"cross join \(select (explode\(array\(.*?\)\)) as (\w+)\)", r"lateral view \1 of_\2 as \2", sql)
    u = "cast(('0x' || substr(md5(concat_ws('|', '42', '\\1', \\2)), 1, 13)) as bigint) / 4503599627370496.0" if duck else "cast(conv(substr(md5(concat_ws('|', '42', '\\1', \\2)), 1, 13), 16, 10) as double) / 4503599627370496.0"
    return re.sub(r"\bu\('(\w+)', ([\w ]+)\)", lambda m: "(" + u.replace("\\1", m[1]).replace("\\2", m[2]) + ")", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _spelled(VIEWS[name], False)
    # Few datasets stand for many rows: they are dealt out before the grid multiplies them.
    sql = sql.replace("(select case when event_id", f"(select /*+ repartition({4 * spark.sparkContext.defaultParallelism}) */ case when event_id")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"\{(\w+)\}", sql)}
    return spark.sql(sql, **tables)


def duck(name: str) -> str:
    """The view as a common table expression for the other engine."""
    return f"{name} as ({re.sub(r'\{(\w+)\}', r'\1', _spelled(VIEWS[name], True))})"


def duck_u(tag: str, key: str = "k") -> str:
    return f"(cast(('0x' || substr(md5(concat_ws('|', '42', '{tag}', {key})), 1, 13)) as bigint) / 4503599627370496.0)"


def duck_z(tag: str, key: str = "k") -> str:
    second = f"(cast(('0x' || substr(md5(concat_ws('|', '42', '{tag}', {key})), 14, 13)) as bigint) / 4503599627370496.0)"
    return f"(sqrt(-2 * ln(1 - {duck_u(tag, key)})) * cos(2 * pi() * {second}))"
