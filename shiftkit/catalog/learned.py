"""Queries: feature synthesis and selection, models, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import duck, duck_u, view
from ..functions.keys import u
from ..functions.numeric import r6
from ..functions.shared import written
from ..operators import attribution as A
from ..operators import features as X
from ..operators import metrics as M
from ..operators import models as T
from ..operators import splits as S
from ..operators.compare import robustness
from ..operators.shifts import conditions
from ..operators.trees import leaf_counts
from ..plans.results import experiment
from .unrolled import experiment_sql, forest_sql, lasso_sql, newton_sql

QUERIES, SQL = {}, {}
LI = ["qty", "price", "disc", "tax"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _pairs(a: str, b: str) -> list[tuple[str, str]]:
    x, y = sorted((a, b))
    return [(f"{x} + {y}", f"{x} + {y}"), (f"{x} - {y}", f"{x} - {y}"), (f"{x} * {y}", f"{x} * {y}"), (f"{x} / {y}", f"coalesce({x} / nullif({y}, 0), 0)"), (f"{y} / {x}", f"coalesce({y} / nullif({x}, 0), 0)")]


def _all(cols: list[str]) -> list[tuple[str, str]]:
    cols = sorted(cols)
    return [(c, c) for c in cols] + [p for i, a in enumerate(cols) for b in cols[i + 1 :] for p in _pairs(a, b)]


_ROLE = f"case when {duck_u('role')} < 0.25 then 'test' else 'train' end"


def _with_role(v):
    return v.withColumn("role", F.when(u("role", "k") < 0.25, "test").otherwise("train"))


@query("f1_base_columns", f"with {duck('v_li')}, v as (select unnest(['qty', 'price', 'disc', 'tax']) as feature, unnest([var_samp(qty), var_samp(price), var_samp(disc), var_samp(tax)]) as v from v_li) select feature from v order by v desc, feature limit 2")
def _(spark, d):
    names = X.base_columns(view(spark, d, "v_li"), LI, 2)
    return view(spark, d, "v_li").limit(1).select(F.explode(F.array(*[F.lit(c) for c in names])).alias("feature"))


@query("f2_f5_synthesis", f"with {duck('v_li')} select k, " + ", ".join(f'round({e}, 8) + 0.0 as "{n}"' for n, e in _all(["qty", "price", "tax"])) + " from v_li")
def _(spark, d):
    made = X.generated(["qty", "price", "tax"])
    w = X.synthesise(view(spark, d, "v_li"), ["k"], made)
    return w.select("k", *[(F.round(F.col(f"`{f[0]}`"), 8) + F.lit(0.0)).alias(f[0]) for f in made])


@query("f3_depth_two", f"with {duck('v_li')} select k, round((disc + tax) * (disc - tax), 6) + 0.0 as x from v_li")
def _(spark, d):
    one = [f for f in X.generated(["disc", "tax"], ("add", "subtract")) if f[3] == 1]
    wide, two = X.deepen(view(spark, d, "v_li"), ["k"], one, primitives=("multiply",))
    last = [f for f in two if f[3] == 2]
    return wide.select("k", r6(X.expression(last[0])).alias("x"))


@query("f4_primitive_subset", f"with {duck('v_li')} select count(*) as n, round(sum(disc + tax), 4) as plus, round(sum(disc - tax), 4) + 0.0 as minus from v_li")
def _(spark, d):
    w = X.synthesise(view(spark, d, "v_li"), ["k"], X.generated(["disc", "tax"], ("add", "subtract")))
    return w.agg(F.count("*").alias("n"), F.round(F.sum("`disc + tax`"), 4).alias("plus"), (F.round(F.sum("`disc - tax`"), 4) + F.lit(0.0)).alias("minus"))


_LONG = " union all ".join(f"select '{n}' as feature, ({e})::double as v, target from v_li" for n, e in _all(LI))
_MI = """r as (select feature, target, floor((rank() over (partition by feature order by v) - 1) * 10 / count(*) over (partition by feature)) as b from l),
c as (select feature, b, target, count(*)::double as n from r group by all),
m as (select feature, sum(n / t * ln(n * t / (x * y))) as mi from (select *, sum(n) over (partition by feature, b) as x, sum(n) over (partition by feature, target) as y, sum(n) over (partition by feature) as t from c) group by 1)"""


@query("f6_f7_scores", f"with {duck('v_li')}, l as ({_LONG}), {_MI} select feature, case when var_samp(v) > 1 then round(ln(var_samp(v)), 5) else round(var_samp(v), 5) end as variance, round(max(greatest(mi, 0)), 5) + 0.0 as mi from l join m using (feature) where feature not like '%/%' group by 1")
def _(spark, d):
    s = X.scores(view(spark, d, "v_li"), ["k"], "target", [f for f in X.generated(LI) if f[1] != "divide"])
    v = F.col("variance")
    return s.select("feature", F.when(v > 1, F.round(F.log(v), 5)).otherwise(F.round(v, 5)).alias("variance"), (F.round("mi", 5) + F.lit(0.0)).alias("mi"))


@query("f8_random_ranks", f"with {duck('v_li')}, n as (select distinct flag as feature from v_li), s as (select unnest(range(10)) as s), r as (select feature, row_number() over (partition by s order by md5(concat_ws('|', '42', 'shuffle', s::varchar, feature)), feature) as r from n, s) select feature, avg(r) as random_rank from r group by 1")
def _(spark, d):
    names = [r.flag for r in view(spark, d, "v_li").select("flag").distinct().collect()]
    return X.random_ranks(spark, names)


_RANKED = """va as (select feature, var_samp(v) as variance from l group by 1),
rr as (select feature, avg(r) as random_rank from (select feature, row_number() over (partition by s order by md5(concat_ws('|', '42', 'shuffle', s::varchar, feature)), feature) as r from va, (select unnest(range(10)) as s)) group by 1),
f as (select feature as name, case when feature like '% + %' then 'add' when feature like '% - %' then 'subtract' when feature like '% * %' then 'multiply' when feature like '% / %' then 'divide' else 'identity' end as primitive, coalesce(variance, 0) as variance, coalesce(mi, 0) as mi, random_rank from va left join m using (feature) join rr using (feature)),
w(variant, made, method, few) as (values ('Raw', false, 'none', false), ('Raw_Variance', false, 'variance', false), ('Raw_MI', false, 'mi', false), ('AutoFE_Baseline', true, 'variance', false), ('AutoFE_MI', true, 'mi', false), ('AutoFE_Random', true, 'random', false), ('AutoFE_NoMultiply', true, 'variance', true)),
p as (select *, case method when 'variance' then -variance when 'mi' then -mi else random_rank end as place from w, f where primitive = 'identity' or (made and (not few or primitive in ('add', 'subtract'))))"""


@query("f9_f12_variants", f"with {duck('v_li')}, l as ({_LONG}), {_MI}, {_RANKED} select variant, name, primitive, case when primitive = 'identity' then 0 else 1 end as depth from p qualify method = 'none' or row_number() over (partition by variant order by place, name) <= 10")
def _(spark, d):
    got = X.variants(view(spark, d, "v_li").select("k", *LI, "target"), ["k"], "target", k=10)
    return spark.createDataFrame([(v, n, p, d_) for v, fs in sorted(got.items()) for n, p, _, d_ in fs], "variant string, name string, primitive string, depth int")


@query("f11_lineage", f"with {duck('v_li')}, l as ({_LONG}) select feature as name, case when feature like '% + %' then 'add' when feature like '% - %' then 'subtract' when feature like '% * %' then 'multiply' when feature like '% / %' then 'divide' else 'identity' end as primitive, case when feature like '% % %' then 2 else 1 end as n_parents, count(*) as n, count(*) filter (where v = 0) as zeros from l group by 1")
def _(spark, d):
    made = X.generated(LI)
    wide = X.synthesise(view(spark, d, "v_li"), ["k"], made)
    seen = wide.agg(F.array(*[F.struct(F.lit(f[0]).alias("name"), F.count("*").alias("n"), F.count_if(F.col(f"`{f[0]}`") == 0).alias("zeros")) for f in made]).alias("s"))
    return X.lineage(spark, made).join(seen.select(F.explode("s").alias("s")).select("s.*"), "name").select("name", "primitive", F.size("parents").alias("n_parents"), "n", "zeros")


@query("f13_infer_task", f"with {duck('v_li')} select case when count(distinct target) <= 20 then 'classification' else 'regression' end as of_target, case when count(distinct price) <= 0.1 * count(*) then 'classification' else 'regression' end as of_price from v_li")
def _(spark, d):
    v = view(spark, d, "v_li")
    return v.limit(1).select(F.lit(X.infer_task(v, "target")).alias("of_target"), F.lit(X.infer_task(v, "price")).alias("of_price"))


@query("f14_f18_select_top")
def _(spark, d):
    v = written(S.stratified_folds(view(spark, d, "v_li"), ["k"], "target"), "folds")
    train, test = S.fold_views(v, 1)
    return X.select_top(train.drop("fold"), test.drop("fold"), ["k"], "target", k=3)[2]


_OF_PRICE = " union all ".join(f"select '{c}' as feature, {c} as v, floor((rank() over (order by price) - 1) * 10 / count(*) over ()) as target from v_li" for c in ("qty", "disc", "tax"))


@query("f15_l1_regression", lasso_sql(f"{duck('v_li')}, src as (select qty::double as qty, disc::double * 1000 as disc, tax::double * 1000 as tax, price::double as price from v_li)", ["qty", "disc", "tax"], "price", 1.0, 60))
def _(spark, d):
    v = view(spark, d, "v_li").select("k", "qty", (F.col("disc") * 1000).alias("disc"), (F.col("tax") * 1000).alias("tax"), "price")
    return X.l1_importance(v, ["qty", "disc", "tax"], "price", "regression").select("feature", (F.round("l1", 4) + F.lit(0.0)).alias("l1"))


@query("f16_regression_mi", f"with {duck('v_li')}, l as ({_OF_PRICE}), {_MI} select feature, round(greatest(mi, 0), 5) + 0.0 as mi from m")
def _(spark, d):
    return X.mi_importance(view(spark, d, "v_li"), ["qty", "disc", "tax"], "price", "regression").select("feature", (F.round("mi", 5) + F.lit(0.0)).alias("mi"))


@query("f19_matrices", f"with {duck('v_li')} select 'train' as side, count(*) as n, round(sum(disc + tax), 3) as total from v_li where {duck_u('role')} >= 0.25 union all select 'test', count(*), round(sum(disc), 3) from v_li where {duck_u('role')} < 0.25")
def _(spark, d):
    v = _with_role(view(spark, d, "v_li"))
    plain = {r: v.where(F.col("role") == r).select("k", F.col("disc").alias("x")) for r in ("train", "test")}
    made = X.synthesise(v.where("role = 'train'"), ["k"], [f for f in X.generated(["disc", "tax"], ("add",)) if f[3]])
    train, test = X.matrices(plain | {"train_engineered": made.toDF("k", "x")})
    total = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("total")).select("side", "n", "total")
    return total(train, "train").unionByName(total(test, "test"))


@query("f17_normalised", f"with {duck('v_ev')}, m as (select target as feature, avg(value) as s from v_ev group by 1) select feature, round((s - min(s) over ()) / (max(s) over () - min(s) over ()), 6) as s from m")
def _(spark, d):
    m = view(spark, d, "v_ev").groupBy(F.col("target").alias("feature")).agg(F.avg("value").alias("s"))
    return X.normalised(m, "s").select("feature", r6(F.col("s")).alias("s"))


@query("f20_stability", f"with {duck('v_ev')}, l as (select target as name, list(distinct user_id % 13) as f from v_ev group by 1) select x.name as a, y.name as b, round(len(list_intersect(x.f, y.f)) / len(list_distinct(list_concat(x.f, y.f))), 6) as jaccard from l x, l y where x.name < y.name")
def _(spark, d):
    lists = view(spark, d, "v_ev").groupBy(F.col("target").alias("name")).agg(F.collect_set(F.col("user_id") % 13).alias("f"))
    return X.stability(lists, "name", "f").select("a", "b", r6(F.col("jaccard")).alias("jaccard"))


def _ll(c: str) -> str:
    return f"ln(2 * pi() * (v_{c} + eps)) / 2 + ({c} - m_{c}) ** 2 / (2 * (v_{c} + eps))"


@query("t6_naive_bayes", f"""with {duck('v_ev')}, x as (select k, value, user_id::double as user_id, target, {_ROLE} as role from v_ev),
e as (select 1e-9 * greatest(var_pop(value), var_pop(user_id)) as eps, count(*) as n from x where role = 'train'),
s as (select target as c, count(*) as nc, avg(value) as m_value, var_pop(value) as v_value, avg(user_id) as m_user_id, var_pop(user_id) as v_user_id from x where role = 'train' group by 1),
l as (select k, role, target, c, ln(nc / n) - ({_ll('value')}) - ({_ll('user_id')}) as ll from x, s, e)
select role, target as y_true, p as y_pred, count(*) as n from (select k, role, target, arg_max(c, ll) as p from l group by all) group by all""")
def _(spark, d):
    v = _with_role(view(spark, d, "v_ev")).withColumn("one", F.lit(1))
    return T.naive_bayes(v, ["k"], ["value", "user_id"], "target", ["one"]).groupBy("role", "y_true", "y_pred").agg(F.count("*").alias("n"))


@query("t5_knn", f"""with {duck('v_emb')}, x as (select k, e, target, {_ROLE} as role from v_emb),
d as (select q.k as k, q.target as y, t.target as c, t.k as tk, round(list_sum(list_transform(range(1, 1 + len(q.e)), lambda i: (q.e[i]::double - t.e[i]::double) ** 2)), 9) as d from x q, x t where q.role = 'test' and t.role = 'train'),
r as (select *, row_number() over (partition by k order by d, tk) as r from d), v as (select k, y, c::varchar as c, count(*) as n from r where r <= 5 group by all)
select k, y::varchar as y_true, c as y_pred, n / 5 as share from (select *, row_number() over (partition by k order by n desc, c) as r from v) where r = 1""")
def _(spark, d):
    v = view(spark, d, "v_emb")
    cols = [f"e{i}" for i in range(v.agg(F.max(F.size("e"))).first()[0] or 0)]
    return T.knn(_with_role(v.select("k", "target", *[F.col("e")[i].cast("double").alias(c) for i, c in enumerate(cols)])), ["k"], cols, "target")


@query("t5_knn_cells", SQL["t5_knn"])
def _(spark, d):
    v = view(spark, d, "v_emb")
    cols = [f"e{i}" for i in range(v.agg(F.max(F.size("e"))).first()[0] or 0)]
    return T.knn(_with_role(v.select("k", "target", *[F.col("e")[i].cast("double").alias(c) for i, c in enumerate(cols)])), ["k"], cols, "target", most=0)


def _fitted(name: str):
    def f(spark, d):
        v = _with_role(view(spark, d, "v_doc").select("k", "n_chars", F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("en"), F.length("source").alias("len"), "target"))
        pred, _ = T.fit_score(v, ["k"], ["n_chars", "en", "len"], "target", name)
        return M.all_metrics(pred, ["role"]).select("role", "n", "accuracy", "roc_auc")

    return f


for _name in ("logistic_regression", "random_forest", "extra_trees", "gradient_boosting", "linear_svm", "mlp"):
    QUERIES[f"t_{_name}"] = _fitted(_name)


@query("t8_probabilities_add_up", f"""with {duck('v_doc')}, c as (select {_ROLE} as role, count(*) as n from v_doc group by 1)
select model, role, n, n::double as total from c, (select unnest(['logistic_regression', 'random_forest', 'linear_svm', 'mlp']) as model)""")
def _(spark, d):
    v = _with_role(view(spark, d, "v_doc").select("k", "n_chars", F.length("source").alias("len"), "target"))
    out = None
    for name in ("logistic_regression", "random_forest", "linear_svm", "mlp"):
        pred, _ = T.fit_score(v, ["k"], ["n_chars", "len"], "target", name)
        one = pred.groupBy("role").agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.round(F.sum(F.aggregate(F.map_values("proba"), F.lit(0.0), lambda a, x: a + x)), 3).alias("total")).select("model", "role", "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("t1_logistic_units", newton_sql(f"{duck('v_li')}, src as (select k, flag as unit, {_ROLE} as role, qty::double / 50 as a, disc::double * 10 as b, target as y from v_li)", 14))
def _(spark, d):
    v = _with_role(view(spark, d, "v_li")).select("k", F.col("flag").alias("unit"), "role", (F.col("qty") / 50).alias("a"), (F.col("disc") * 10).alias("b"), "target")
    got = T.over_units(v, ["unit"], ["k"], ["a", "b"], "target", "logistic_regression")
    return got.groupBy("unit", "role", "y_true", "y_pred").agg(F.count("*").alias("n"), F.round(F.avg(F.col("proba")["1"]), 5).alias("p"))


@query("t2_forest_leaves", forest_sql(f"{duck('v_ev')}, src as (select k, (user_id % 2)::bigint as unit, target as y, value::double as value, user_id::double as user_id from v_ev where {duck_u('role')} >= 0.25)", ["value", "user_id"], 100, 3, 1))
def _(spark, d):
    v = _with_role(view(spark, d, "v_ev")).withColumn("unit", F.col("user_id") % 2)
    return leaf_counts(v, ["k"], ["value", "user_id"], "target", ["unit"], depth=3)


@query("t3_several_classes", f"with {duck('v_ev')}, c as (select {_ROLE} as role, count(*) as n from v_ev group by 1) select model, role, n, n::double as total from c, (select unnest(['gradient_boosting', 'linear_svm']) as model)")
def _(spark, d):
    v, out = _with_role(view(spark, d, "v_ev")).select("k", "value", "user_id", "target", "role"), None
    for name in ("gradient_boosting", "linear_svm"):
        pred, _ = T.fit_score(v, ["k"], ["value", "user_id"], "target", name)
        one = pred.groupBy("role").agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.round(F.sum(F.aggregate(F.map_values("proba"), F.lit(0.0), lambda a, x: a + x)), 3).alias("total")).select("model", "role", "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("t10_over_units", f"with {duck('v_ev')} select user_id % 2 as unit, {_ROLE} as role, target as y_true, count(*) as n from v_ev group by all")
def _(spark, d):
    v = _with_role(view(spark, d, "v_ev")).withColumn("unit", F.col("user_id") % 2)
    return T.over_units(v, ["unit"], ["k"], ["value", "user_id"], "target", "logistic_regression").groupBy("unit", "role", "y_true").agg(F.count("*").alias("n"))


@query("g6_experiment_accuracy", experiment_sql(f"{duck('v_cust')}, src as (select k, bal::double as a, nat::double as b, target from v_cust)", ("covariate_shift", "population_shift", "class_prior_shift")))
def _(spark, d):
    v = view(spark, d, "v_cust").select("k", F.col("bal").cast("double").alias("a"), F.col("nat").cast("double").alias("b"), "target")
    chosen = conditions(spark).where(~F.col("family").isin("covariate_shift", "population_shift", "class_prior_shift"))
    got = experiment(v, "customers", ["k"], "target", chosen, models=("gaussian_nb",))
    return got.groupBy("condition", "pipeline").agg(F.round(F.avg("accuracy"), 6).alias("accuracy"), F.max("n_retained").alias("n_retained"), F.count("*").alias("folds"))


@query("g7_experiment_rows")
def _(spark, d):
    """Every condition, fold, pipeline and both models, compared as the comparison operators compare them."""
    v = view(spark, d, "v_cust").select("k", F.col("bal").cast("double").alias("bal"), F.col("nat").cast("double").alias("nat"), "target")
    rows = experiment(v, "customers", ["k"], "target")
    return robustness(rows, metric="accuracy").join(rows.groupBy("model").agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "success").alias("done"), F.avg("wasserstein").alias("wasserstein")), "model")


@query("a3_linear_importance", f"with {duck('v_li')}, m as (select avg(qty) as a, avg(price) as b from v_li), r as (select round(avg(abs(2.0 * (qty - a))), 6) as q, round(avg(abs(-0.001 * (price - b))), 6) as p from v_li, m) select 'qty' as feature, q as importance from r union all select 'price', p from r")
def _(spark, d):
    return A.linear_importance(view(spark, d, "v_li"), {"qty": 2.0, "price": -0.001}).select("feature", r6(F.col("importance")).alias("importance"))


@query("a1_a2_a3_sampled_importance")
def _(spark, d):
    v = view(spark, d, "v_li")
    sample, reference = A.evaluation_sample(v, ["k"], 200), A.background(v, ["k"], LI, 20)
    return A.sampled_importance(sample, reference, ["k"], LI, lambda t: t.withColumn("score", 2 * F.col("qty") + F.col("price") / 1000 + F.col("disc") * F.col("tax")))


@query("a5_meta_importance")
def _(spark, d):
    m = view(spark, d, "v_doc").groupBy(F.col("source").alias("dataset")).agg(F.avg("n_chars").alias("chars"), F.avg("target").alias("quality"), F.countDistinct("lang").cast("double").alias("langs"), (F.avg("n_chars") / 1000).alias("delta"))
    return A.meta_importance(m, ["chars", "quality", "langs"], "delta")
