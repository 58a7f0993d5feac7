"""Queries: preparation, splits and shifts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import duck, duck_u, duck_z, view
from .unrolled import kmeans_sql
from ..functions.numeric import r6
from ..functions.shared import written
from ..operators import prepare as P
from ..operators import relational as R
from ..operators import shifts as H
from ..operators import splits as X

QUERIES, SQL = {}, {}
LI = ["qty", "price", "disc", "tax"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _scaled(c: str) -> str:
    return f"round((coalesce({c}, avg({c}) over ()) - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over () * sqrt(count({c}) over () / count(*) over ()), 0), 1), 6) + 0.0 as {c}"


@query("p1_p2_mean_fill_scale", f"with {duck('v_li_na')} select k, {', '.join(_scaled(c) for c in LI)} from v_li_na")
def _(spark, d):
    v = view(spark, d, "v_li_na").select("k", *LI)
    return P.apply_numeric(v, P.fit_numeric(v, LI), LI).select("k", *[r6(F.col(c)).alias(c) for c in LI])


_FOLD = f"row_number() over (order by target, {duck_u('fold')}, k)"


@query("p7_fit_per_unit", f"with {duck('v_li_na')}, f as (select *, ({_FOLD} - 1) % 5 + 1 as fold from v_li_na), t as (select u.i::int as unit_fold, f.* from f, range(1, 6) u(i) where f.fold <> u.i) select unit_fold, round(avg(tax), 6) as tax_mean, round(coalesce(nullif(stddev_pop(tax) * sqrt(count(tax) / count(*)), 0), 1), 6) as tax_sd from t group by 1")
def _(spark, d):
    folded = X.all_folds(X.stratified_folds(view(spark, d, "v_li_na"), ["k"], "target"), 5)
    p = P.fit_numeric(folded.where("role = 'train'"), LI, ["unit_fold"])
    return p.select("unit_fold", r6(F.col("tax__mean")).alias("tax_mean"), r6(F.col("tax__sd")).alias("tax_sd"))


@query("p3_p4_mode_one_hot", f"with {duck('v_li_na')}, m as (select flag as m from v_li_na where flag is not null group by 1 order by count(*) desc, flag limit 1) select k, case when coalesce(flag, m) = 'A' then 1.0 else 0.0 end as \"flag_A\", case when coalesce(flag, m) = 'R' then 1.0 else 0.0 end as \"flag_R\" from v_li_na, m")
def _(spark, d):
    v = view(spark, d, "v_li_na").select("k", "flag")
    mode = P.fit_modes(v, ["flag"]).first()["flag__mode"]
    filled = v.fillna(mode, ["flag"])
    return P.one_hot(filled, "flag", [r.level for r in R.levels(filled, "flag").orderBy("index").collect()])


@query("p5_ordinal", f"with {duck('v_li_na')}, l as (select distinct flag from v_li_na where flag is not null and flag <> 'R'), n as (select flag, row_number() over (order by flag) - 1 as i from l) select k, coalesce(i, -1)::double as flag from v_li_na left join n using (flag)")
def _(spark, d):
    v = view(spark, d, "v_li_na").select("k", "flag")
    return P.ordinal(v, "flag", R.levels(v.where("flag != 'R'"), "flag"))


@query("p6_prepare", f"""with {duck('v_li_na')}, f as (select *, ({_FOLD} - 1) % 5 + 1 as fold from v_li_na), t as (select * from f where fold <> 1),
p as (select {', '.join(f'avg({c}) as m_{c}, coalesce(nullif(stddev_pop({c}) * sqrt(count({c}) / count(*)), 0), 1) as s_{c}' for c in LI)} from t), m as (select flag as m from t where flag is not null group by 1 order by count(*) desc, flag limit 1)
select k, target, {', '.join(f'round((coalesce({c}, m_{c}) - m_{c}) / s_{c}, 6) + 0.0 as {c}' for c in LI)}, case when coalesce(flag, m) = 'A' then 1.0 else 0.0 end as "flag_A", case when coalesce(flag, m) = 'R' then 1.0 else 0.0 end as "flag_R" from f, p, m where fold = 1""")
def _(spark, d):
    train, test = X.fold_views(X.stratified_folds(view(spark, d, "v_li_na"), ["k"], "target"), 1)
    out = P.prepare(train.drop("fold"), test.drop("fold"), ["k"], "target")[1]
    return out.select("k", "target", *[r6(F.col(c)).alias(c) for c in LI], "flag_A", "flag_R")


@query("p8_quick_prepare", f"with {duck('v_li_na')}, m as (select flag as m from v_li_na where flag is not null group by 1 order by count(*) desc, flag limit 1) select k, round(coalesce(tax, avg(tax) over ()), 6) as tax, coalesce(flag, m) as flag from v_li_na, m")
def _(spark, d):
    v = view(spark, d, "v_li_na").select("k", "tax", "flag")
    return P.quick_prepare(v.unionByName(v.limit(10))).select("k", F.round("tax", 6).alias("tax"), "flag")


@query("p9_encode_for_scoring", f"with {duck('v_li_na')} select k, round(coalesce(disc, avg(disc) over ()), 6) as disc, 0.0 as dead, (dense_rank() over (order by coalesce(flag, 'missing')) - 1)::double as flag from v_li_na")
def _(spark, d):
    v = P.encode_for_scoring(view(spark, d, "v_li_na").select("k", "disc", "dead", "flag"), ["k"])
    return v.select("k", F.round("disc", 6).alias("disc"), "dead", "flag")


@query("p10_fill_selected", f"with {duck('v_li_na')} select k, round(coalesce(tax, (select avg(tax) from v_li_na where target = 0)), 6) as tax, 0.0 as dead from v_li_na where target = 1")
def _(spark, d):
    v = view(spark, d, "v_li_na").select("k", "tax", "dead", "target")
    return P.fill_selected(v.where("target = 0"), v.where("target = 1"), ["tax", "dead"])[1].select("k", F.round("tax", 6).alias("tax"), "dead")


@query("x1_holdout", f"with {duck('v_cust')}, r as (select *, row_number() over (partition by target order by {duck_u('holdout')}, k) as r, count(*) over (partition by target) as n from v_cust) select k, target, case when r <= ceil(0.2 * n) then 'test' else 'train' end as side from r")
def _(spark, d):
    return X.holdout(view(spark, d, "v_cust"), ["k"], "target").select("k", "target", "side")


@query("x2_stratified_folds", f"with {duck('v_li')} select k, (({_FOLD} - 1) % 5 + 1)::int as fold from v_li")
def _(spark, d):
    return X.stratified_folds(view(spark, d, "v_li"), ["k"], "target").select("k", "fold")


@query("x3_plain_folds", f"with {duck('v_li')} select k, ((row_number() over (order by {duck_u('fold')}, k) - 1) % 5 + 1)::int as fold from v_li")
def _(spark, d):
    return X.plain_folds(view(spark, d, "v_li"), ["k"]).select("k", "fold")


@query("x3_rare_class_fallback", f"with {duck('v_doc')}, v as (select k, n_chars, case when k < 3 then 1 else 0 end as target from v_doc) select k, ((row_number() over (order by {duck_u('fold')}, k) - 1) % 5 + 1)::int as fold from v")
def _(spark, d):
    v = view(spark, d, "v_doc").select("k", "n_chars", F.when(F.col("k") < 3, 1).otherwise(0).alias("target"))
    return X.stratified_folds(v, ["k"], "target").select("k", "fold")


@query("x4_covariate_folds", f"with {duck('v_ev')}, v as (select k, value from v_ev) select k, ntile(5) over (order by round((value - (select avg(value) from v)) / (select stddev_pop(value) from v), 9), k)::int as fold from v")
def _(spark, d):
    v = view(spark, d, "v_ev").select("k", "value", "target")
    return X.covariate_folds(v, ["k"], "target").select("k", "fold")


@query("x4_covariate_folds_many_columns")
def _(spark, d):
    v = view(spark, d, "v_emb").select("k", "target", *[F.col("e")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return X.covariate_folds(v, ["k"], "target").groupBy("fold").agg(F.count("*").alias("n"))


@query("x5_population_folds", kmeans_sql(f"{duck('v_li')}, src as (select k, qty::double as x0, price::double as x1, disc::double as x2, tax::double as x3 from v_li)", 4, 5, 6))
def _(spark, d):
    return X.population_folds(view(spark, d, "v_li"), ["k"], "target", rounds=6).select("k", "fold")


@query("x5_population_folds_settled", kmeans_sql(f"{duck('v_cust')}, src as (select k, bal::double as x0, nat::double as x1 from v_cust)", 2, 5, 20))
def _(spark, d):
    return X.population_folds(view(spark, d, "v_cust"), ["k"], "target").select("k", "fold")


@query("x6_all_folds", f"with {duck('v_li')}, f as (select target, ({_FOLD} - 1) % 5 + 1 as fold from v_li) select i::int as unit_fold, case when i = fold then 'test' else 'train' end as role, target, count(*) as n from f, range(1, 6) u(i) group by all")
def _(spark, d):
    return X.all_folds(X.stratified_folds(view(spark, d, "v_li"), ["k"], "target"), 5).groupBy("unit_fold", "role", "target").agg(F.count("*").alias("n"))


def _noise(c: str, s: str = "0.05") -> str:
    return f"round({c} + {duck_z('noise|' + c)} * {s} * stddev_pop({c}) over (), 6) + 0.0 as {c}"


@query("h2_gaussian_noise", f"with {duck('v_li_na')} select k, {_noise('qty')}, {_noise('tax')} from v_li_na")
def _(spark, d):
    return H.gaussian_noise(view(spark, d, "v_li_na").select("k", "qty", "tax"), ["k"], 0.05).select("k", r6(F.col("qty")).alias("qty"), r6(F.col("tax")).alias("tax"))


@query("h3_missing_values", f"with {duck('v_li')} select k, case when {duck_u('lost|qty')} >= 0.1 then qty end as qty, case when {duck_u('lost|flag')} >= 0.1 then flag end as flag from v_li")
def _(spark, d):
    return H.missing_values(view(spark, d, "v_li").select("k", "qty", "flag"), ["k"], 0.1)


_OTHER = "classes[((list_position(classes, target) - 1 + floor({u} * (len(classes) - 1))::int + 1) % len(classes)) + 1]"


@query("h4_label_noise", f"with {duck('v_cust')}, c as (select list(distinct target order by target) as classes from v_cust) select k, case when {duck_u('flip')} < 0.2 then {_OTHER.format(u=duck_u('to'))} else target end as target from v_cust, c")
def _(spark, d):
    return H.label_noise(view(spark, d, "v_cust"), ["k"], "target", 0.2).select("k", "target")


@query("h5_class_prior_shift", f"""with {duck('v_cust')}, t as (select target as top, count(*) as n from v_cust group by 1 order by n desc, top limit 1), c as (select list(distinct target order by target) as rest from v_cust, t where target <> top),
r as (select *, row_number() over (partition by target order by {duck_u('prior')}, k) as r from v_cust)
select k, case when target = top and r <= floor(0.5 * n) then rest[floor({duck_u('minor')} * len(rest))::int + 1] else target end as target from r, t, c""")
def _(spark, d):
    return H.class_prior_shift(view(spark, d, "v_cust"), ["k"], "target").select("k", "target")


@query("h6_structured_label_drift", f"""with {duck('v_li')}, s as (select avg(price) as m, stddev_pop(price) as sd, list(distinct target order by target) as classes from v_li),
p as (select k, target, classes, 1 / (1 + exp(-abs(price - m) / sd)) as p from v_li, s), a as (select avg(p) as a from p)
select k, case when {duck_u('flip')} < least(1.0, p * (0.1 / a)) then {_OTHER.format(u=duck_u('to'))} else target end as target from p, a""")
def _(spark, d):
    return H.structured_label_drift(view(spark, d, "v_li").select("k", "price", "target"), ["k"], "target", 0.1).select("k", "target")


@query("h7_feature_removal", f"with {duck('v_li')}, n as (select unnest(['qty', 'price', 'disc', 'tax', 'flag']) as f, unnest([count(qty), count(price), count(disc), count(tax), count(flag)]) as n, unnest([count(distinct qty), count(distinct price), count(distinct disc), count(distinct tax), count(distinct flag)]) as k from v_li) select f, n, k from n order by md5(concat('42|remove|', f)), f offset 2")
def _(spark, d):
    kept = H.feature_removal(view(spark, d, "v_li"), ["k"], "target", 0.4)
    names = [c for c in kept.columns if c not in ("k", "target")]
    return kept.agg(F.array(*[F.struct(F.lit(c).alias("f"), F.count(c).alias("n"), F.countDistinct(c).alias("k")) for c in names]).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query("h8_dispatcher", f"with {duck('v_cust')} select k, case when {duck_u('lost|bal')} >= 0.1 then bal end as bal, case when {duck_u('lost|nat')} >= 0.1 then nat::double end as nat, target from v_cust")
def _(spark, d):
    v = H.apply_shift(H.apply_shift(view(spark, d, "v_cust"), ["k"], "target", "clean"), ["k"], "target", "missing_values")
    return v.select("k", "bal", F.col("nat").cast("double").alias("nat"), "target")


@query("h9_conditions", f"with {duck('v_res')} select condition, count(*) as n from v_res group by 1")
def _(spark, d):
    return view(spark, d, "v_res").join(F.broadcast(H.conditions(spark)), "condition").groupBy("condition").agg(F.count("*").alias("n"))


@query("h10_all_conditions")
def _(spark, d):
    folded = written(X.stratified_folds(view(spark, d, "v_li"), ["k"], "target"), "folds")
    got = H.all_conditions(folded, ["k"], "target", H.conditions(spark))
    cells = [f for c in LI for f in (F.count(c).alias(f"there_{c}"), r6(F.avg(c)).alias(c))]
    return got.groupBy("unit_fold", "family", "severity", "role").agg(F.count("*").alias("n"), *cells, F.count("flag").alias("there_flag"), F.sum("target").alias("positive"))
