"""Queries: sources, relational pieces and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import duck, duck_u, view
from ..functions.keys import dist_rank, u
from ..functions.numeric import r6
from ..operators import profile as P
from ..operators import relational as R
from ..sources import tables as S

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


LI = ["qty", "price", "disc", "tax"]


@query("keys_uniform", f"with {duck('v_li')} select k, round({duck_u('a')}, 9) as u from v_li")
def _(spark, d):
    return view(spark, d, "v_li").select("k", F.round(u("a", "k"), 9).alias("u"))


@query("keys_dist_rank", f"with {duck('v_li')} select k, flag, row_number() over (partition by flag order by price, k) as rank from v_li")
def _(spark, d):
    return dist_rank(view(spark, d, "v_li"), F.col("price"), ["k"], ["flag"]).select("k", "flag", "rank")


@query("s5_cap_rows", f"with {duck('v_li')} select k, price from v_li order by md5(concat_ws('|', '42', 'cap', k)), k limit 1000")
def _(spark, d):
    return S.cap_rows(view(spark, d, "v_li"), ["k"], 1000).select("k", "price")


@query("s2_s3_attach_target", f"with {duck('v_cust')} select k, bal, target from v_cust")
def _(spark, d):
    v = view(spark, d, "v_cust")
    got = S.attach_target(v.select("k", "bal"), v.select("k", F.col("target").alias("segment")), ["k"], "segment")
    return got.select("k", "bal", F.col(S.resolve_target(got)).alias("target"))


@query("s4_default_target", f"with {duck('v_doc')} select target as value, count(*) as n from v_doc group by 1")
def _(spark, d):
    v = view(spark, d, "v_doc")
    return v.groupBy(F.col(S.default_target(v)).alias("value")).agg(F.count("*").alias("n"))


@query("s1_missing_tokens", f"with {duck('v_li')} select k, case when flag not in ('N') then flag end as flag, tax from v_li")
def _(spark, d):
    return S.normalise_missing(view(spark, d, "v_li"), ["N"]).select("k", "flag", "tax")


@query("s8_profiles_with_domain", "select event_type as dataset, case event_type when 'click' then 'Web' when 'view' then 'Web' else 'Other' end as domain, count(*) as n from events group by 1, 2")
def _(spark, d):
    n = view(spark, d, "v_ev").groupBy(F.col("target").alias("dataset")).agg(F.count("*").alias("n"))
    return S.with_domain(n, spark.createDataFrame([("click", "Web"), ("view", "Web")], "dataset string, domain string")).select("dataset", "domain", "n")


@query("s17_over_datasets", f"with {duck('v_li')}, {duck('v_cust')} select 'li' as dataset, count(*) as n, count(distinct target) as classes from v_li union all select 'cust', count(*), count(distinct target) from v_cust")
def _(spark, d):
    return S.over_datasets({"li": view(spark, d, "v_li"), "cust": view(spark, d, "v_cust")}, lambda t: t.agg(F.count("*").alias("n"), F.countDistinct("target").alias("classes")))


@query("r2_columns_by_kind", f"with {duck('v_doc')} select sum(n_chars)::bigint as numeric_sum, count(lang) + count(source) as text_cells from v_doc")
def _(spark, d):
    v = view(spark, d, "v_doc").drop("k", "target")
    numeric, text = R.columns_by_kind(v)
    return v.agg(sum((F.sum(c) for c in numeric), F.lit(0)).alias("numeric_sum"), sum((F.count(c) for c in text), F.lit(0)).alias("text_cells"))


@query("r4_r5_family_severity", f"with {duck('v_res')} select condition, case when condition = 'clean' then 0.0 else cast(split_part(condition, '_', -1) as double) end as severity, count(*) as n from v_res where starts_with(condition, 'gaussian_noise_') or condition = 'clean' group by 1, 2")
def _(spark, d):
    v = view(spark, d, "v_res").where(R.family_of(F.col("condition"), "gaussian_noise"))
    return v.groupBy("condition", R.severity(F.col("condition")).alias("severity")).agg(F.count("*").alias("n"))


@query("r6_r8_fill_and_drop", f"with {duck('v_li_na')} select count(*) as n, round(sum(coalesce(tax, -1.0)), 4) as tax_filled, count(*) filter (where disc is not null and tax is not null) as complete from v_li_na")
def _(spark, d):
    v = view(spark, d, "v_li_na")
    whole = v.dropna(subset=["disc", "tax"]).agg(F.count("*").alias("complete"))
    return v.fillna({"tax": -1.0}).agg(F.count("*").alias("n"), F.round(F.sum("tax"), 4).alias("tax_filled")).crossJoin(F.broadcast(whole))


@query("r7_distinct", "select distinct l_returnflag as flag, l_linestatus as status, l_linenumber as line from lineitem")
def _(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line")).dropDuplicates()


@query("r9_r10_finite_clip", f"with {duck('v_li')} select k, round(case when tax <> 0 then least(greatest(price / tax, -1000000.0), 1000000.0) end, 6) + 0.0 as x from v_li")
def _(spark, d):
    from ..functions.numeric import clip, finite

    raw = F.when(F.col("tax") == 0, float("inf")).otherwise(F.try_divide("price", "tax"))
    return view(spark, d, "v_li").select("k", r6(clip(finite(raw), -1e6, 1e6)).alias("x"))


@query("r17_strict_pivot", f"with {duck('v_res')} select dataset, seed, fold, condition, model, max(f1) filter (where pipeline = 'Raw') as \"Raw\", max(f1) filter (where pipeline = 'AutoFE_MI') as \"AutoFE_MI\" from v_res group by all")
def _(spark, d):
    return R.strict_pivot(view(spark, d, "v_res"), ["dataset", "seed", "fold", "condition", "model"], "pipeline", ["Raw", "AutoFE_MI"], "f1")


@query("r18_mean_pivot", f"with {duck('v_res')} select dataset, model, round(avg(f1) filter (where pipeline = 'Raw'), 6) as raw, round(avg(f1) filter (where pipeline = 'AutoFE_MI'), 6) as mi from v_res group by all")
def _(spark, d):
    p = R.mean_pivot(view(spark, d, "v_res"), ["dataset", "model"], "pipeline", ["Raw", "AutoFE_MI"], "f1")
    return p.select("dataset", "model", r6(F.col("Raw")).alias("raw"), r6(F.col("AutoFE_MI")).alias("mi"))


@query("r19_mean_std", f"with {duck('v_ev')} select target, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, count(value) as n from v_ev group by 1")
def _(spark, d):
    return R.mean_std(view(spark, d, "v_ev"), ["target"], "value").select("target", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "n")


@query("r20_value_counts", f"with {duck('v_li_na')} select flag as value, count(*) as count, round(count(*) / sum(count(*)) over (), 6) as share from v_li_na group by 1")
def _(spark, d):
    return R.value_counts(view(spark, d, "v_li_na"), "flag", missing=True).select("value", "count", r6(F.col("share")).alias("share"))


@query("r21_distinct_count", f"with {duck('v_li_na')} select count(distinct flag) + max(case when flag is null then 1 else 0 end) as k, count(distinct qty) + max(case when qty is null then 1 else 0 end) as q from v_li_na")
def _(spark, d):
    v = view(spark, d, "v_li_na")
    return v.agg(R.distinct_count(v, "flag").alias("k"), R.distinct_count(v, "qty").alias("q"))


@query("r22_average_rank", f"""with {duck('v_res')}, m as (select dataset, seed, fold, condition, pipeline, model, round(f1, 1) as f1 from v_res)
select *, rank() over (partition by dataset, seed, fold, condition, pipeline order by f1 desc) + (count(*) over (partition by dataset, seed, fold, condition, pipeline, f1) - 1) / 2 as rank from m""")
def _(spark, d):
    v = view(spark, d, "v_res").select("dataset", "seed", "fold", "condition", "pipeline", "model", F.round("f1", 1).alias("f1"))
    return R.average_rank(v, ["dataset", "seed", "fold", "condition", "pipeline"], "f1")


@query("r23_missing_report", f"with {duck('v_li_na')}, m as (select 'disc' as \"column\", count(*) - count(disc) as missing from v_li_na union all select 'tax', count(*) - count(tax) from v_li_na union all select 'flag', count(*) - count(flag) from v_li_na union all select 'dead', count(*) from v_li_na union all select 'qty', count(*) - count(qty) from v_li_na) select * from m order by missing desc, \"column\" limit 4")
def _(spark, d):
    return R.missing_report(view(spark, d, "v_li_na"), 4)


@query("r24_labelled", f"with {duck('v_res')} select case pipeline when 'Raw' then 'Original' else pipeline end as label, count(*) as n from v_res group by 1")
def _(spark, d):
    return view(spark, d, "v_res").groupBy(R.labelled(F.col("pipeline"), {"Raw": "Original"}).alias("label")).agg(F.count("*").alias("n"))


@query("r25_factorize", f"with {duck('v_li_na')}, f as (select k, coalesce(flag, 'missing') as l from v_li_na) select k, dense_rank() over (order by l) - 1 as i from f")
def _(spark, d):
    return R.factorize(view(spark, d, "v_li_na"), "flag", "i").select("k", "i")


@query("r26_encode_labels", f"with {duck('v_cust')}, t as (select distinct target from v_cust where k % 2 = 0 and target <> 'BUILDING'), l as (select target, row_number() over (order by target) - 1 as i from t) select v_cust.k, l.i::double as y from v_cust left join l using (target)")
def _(spark, d):
    v = view(spark, d, "v_cust")
    return R.encode_labels(v, R.levels(v.where("k % 2 = 0 and target != 'BUILDING'"), "target"), "target", "y").select("k", F.col("y").cast("double").alias("y"))


def _profile_sql(v: str, numeric: list[str], text: list[str], target: str = "target") -> str:
    """M1 to M13 in SQL; M14 by counts of classes of like frequency. (M15 needs eigenvalues: see the tests.)"""
    d, cells = len(numeric) + len(text), numeric + text
    missing = " + ".join(f"count(*) - count({c})" for c in cells)
    zeros = " + ".join(f"count(*) filter (where {c} = 0)" for c in numeric)
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
    r = ", ".join(f"case when count({a}) filter (where {b} is not null) > 1 then nullif(corr({a}, {b}), 'nan'::double) end" for a, b in pairs)
    skew = ", ".join(f"sum(pow({c} - m_{c}, 3)) / count(*) / pow(nullif(max(s_{c}), 0), 3)" for c in numeric)
    kurt = ", ".join(f"case when max(s_{c}) > 0 then kurtosis_pop({c}) end" for c in numeric)
    stats = ", ".join(f"avg({c}) over () as m_{c}, stddev_pop({c}) over () as s_{c}" for c in numeric)
    h = ", ".join(f"entropy({c}) * ln(2)" for c in cells)
    whole = " and ".join(f"{c} is not null" for c in numeric)
    med = ", ".join(f"coalesce({c}, median({c}) over ()) as {c}" for c in numeric)
    long = " union all ".join([f"select '{c}' as f, {c} as v, cast(null as varchar) as l, {target} as y from filled" for c in numeric] + [f"select '{c}', null, coalesce({c}, 'missing'), {target} from filled" for c in text])
    return f"""
base as (select count(*) as n, {missing} as missing, {zeros} as zeros, [{r}] as r, [{h}] as h from {v}),
cls as (select count(*) as k, max(c) as a, min(c) as b from (select {target}, count(*) as c from {v} group by 1)),
comp as (select *, {stats} from {v} where {whole}),
mom as (select [{skew}] as s, [{kurt}] as ku from comp),
filled as (select {target}, {med}{''.join(', ' + c for c in text)} from {v}),
long as ({long}),
ranked as (select f, y, coalesce(l, cast(floor((rank() over (partition by f order by v) - 1) * 10 / count(*) over (partition by f)) as varchar)) as b from long where v is not null or l is not null),
cell as (select f, b, y, count(*)::double as n from ranked group by all),
mi as (select f, sum(n / t * ln(n * t / (nx * ny))) as mi from (select *, sum(n) over (partition by f, b) as nx, sum(n) over (partition by f, y) as ny, sum(n) over (partition by f) as t from cell) group by f)
select n::double as number_of_samples, {d}::double as number_of_features, {100.0 * len(numeric) / d} as numerical_percent, {100.0 * len(text) / d} as categorical_percent,
  round(100.0 * missing / (n * {d}), 6) as missing_percent, k::double as number_of_classes, round(case when k > 1 then a / b else 1.0 end, 6) as class_imbalance_ratio,
  round(coalesce(list_avg(list_transform(r, lambda x: abs(x))), 0), 6) as average_correlation, round(len(list_filter(r, lambda x: abs(x) > 0.8)) / {len(pairs)}.0, 6) as feature_redundancy,
  round(coalesce(list_avg(s), 0), 6) + 0.0 as average_skewness, round(coalesce(list_avg(ku), 0), 6) + 0.0 as average_kurtosis, round(100.0 * zeros / (n * {d}), 6) as sparsity,
  round(list_avg(h), 6) as average_entropy, round((select sum(greatest(mi, 0)) from mi) / {d}, 6) as average_mutual_information
from base, cls, mom"""


def _rounded(p):
    return p.select(*[r6(F.col(c)).alias(c) for c in P.KEYS if c != "intrinsic_dimension"])


@query("m_profile_lineitem", f"with {duck('v_li')}, " + _profile_sql("v_li", LI, ["flag"]).strip())
def _(spark, d):
    return _rounded(P.profile(view(spark, d, "v_li"), "target", ["k"]))


@query("m_profile_missing_cells", f"with {duck('v_li_na')}, v as (select k, qty, price, disc, tax, flag, target from v_li_na), " + _profile_sql("v", LI, ["flag"]).strip())
def _(spark, d):
    return _rounded(P.profile(view(spark, d, "v_li_na").drop("dead"), "target", ["k"]))


@query("m_profile_documents", f"with {duck('v_doc')}, v as (select k, n_chars, n_chars % 7 as m, lang, source, target from v_doc), " + _profile_sql("v", ["n_chars", "m"], ["lang", "source"]).strip())
def _(spark, d):
    v = view(spark, d, "v_doc").select("k", "n_chars", (F.col("n_chars") % 7).alias("m"), "lang", "source", "target")
    return _rounded(P.profile(v, "target", ["k"]))


@query("m8_correlations_wide", f"""with {duck('v_emb')}, l as (select k, unnest(range(64)) as i, unnest(e)::double as v from v_emb)
select a.i::int as i, b.i::int as j, count(*) as n, round(corr(a.v, b.v), 6) + 0.0 as r from l a join l b on a.k = b.k and a.i < b.i group by all""")
def _(spark, d):
    v = view(spark, d, "v_emb").select("k", *[F.col("e")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return P.correlations(v, [f"e{i}" for i in range(64)]).select("i", "j", "n", r6(F.col("r")).alias("r"))


@query("m15_intrinsic_dimension")
def _(spark, d):
    v = view(spark, d, "v_emb").select(*[F.col("e")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return spark.createDataFrame([(P.intrinsic_dimension(v, v.columns), P.intrinsic_dimension(view(spark, d, "v_li"), LI))], "embeddings double, lineitem double")


@query("m16_dataset_summary", "with p as (select event_type as dataset, count(*) as n, count(distinct user_id % 2) as k from events group by 1), names as (select * from p union all select 'absent', null, null) select dataset, case when n is null then 'Missing' when k = 2 then 'Binary' when k > 2 then 'Multiclass' else 'Unknown' end as task, coalesce(n::varchar, 'Missing') as rows from names")
def _(spark, d):
    ev = view(spark, d, "v_ev")
    prof = ev.groupBy(F.col("target").alias("dataset")).agg(F.count("*").cast("double").alias("number_of_samples"), F.lit(2.0).alias("number_of_features"), F.countDistinct(F.col("user_id") % 2).cast("double").alias("number_of_classes"), F.lit(0.0).alias("missing_percent"), F.lit(1.0).alias("class_imbalance_ratio"))
    names = prof.select("dataset").unionByName(spark.createDataFrame([("absent",)], "dataset string"))
    return P.dataset_summary(names, prof).select("dataset", "task", "rows")
