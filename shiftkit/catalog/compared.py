"""Queries: comparison statistics, the grid, and results that arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import duck, view
from ..functions.numeric import r6
from ..functions.shared import folder
from ..operators import compare as C
from ..operators import sketches as K
from ..operators.prepare import fit_numeric
from ..plans import grid as G
from ..sources import tables as S
from ..streaming import ingest as I

QUERIES, SQL = {}, {}
B = "AutoFE_Baseline"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _six(df, *cols):
    return df.select(*[c for c in df.columns if c not in cols], *[r6(F.col(c)).alias(c) for c in cols])


@query("c1_cliffs_delta", f"with {duck('v_pair')}, c as (select v, sum(f::int)::double as a, sum((not f)::int)::double as b from v_pair group by 1), r as (select *, sum(b) over (order by v) as cb, sum(b) over () as nb, sum(a) over () as na from c) select round(sum(a * (cb - b - (nb - cb))) / max(na * nb), 6) + 0.0 as delta from r")
def _(spark, d):
    return _six(C.cliffs_delta(view(spark, d, "v_pair"), F.col("v"), F.col("f")), "delta")


_PAIRS = f"{duck('v_res')}, pairs as (select dataset, seed, fold, condition, model, max(f1) filter (where pipeline = 'Raw') as x, max(f1) filter (where pipeline = '{B}') as y from v_res group by all having x is not null and y is not null)"


@query("c3_paired", f"with {_PAIRS} select * from pairs")
def _(spark, d):
    return C.paired(view(spark, d, "v_res"), "Raw", B, "f1")


_RANKED = "d as (select dataset, round(y - x, 12) as d from pairs where y <> x), r as (select dataset, d, rank() over (partition by dataset order by abs(d)) + (count(*) over (partition by dataset, abs(d)) - 1) / 2 as r from d), w as (select dataset, sum(r) filter (where d > 0) as w_plus, sum(r) filter (where d < 0) as w_minus from r group by 1)"


@query("c2_c4_compare", f"with {_PAIRS}, {_RANKED}, m as (select dataset, count(*) as n_pairs, avg(x) as a, avg(y) as b from pairs group by 1) select dataset, n_pairs, round(a, 6) as mean_a, round(b, 6) as mean_b, round(b - a, 6) as mean_diff, w_plus, w_minus, case when abs(b - a) < 1e-12 then 'tie' when b > a then '{B}' else 'Raw' end as winner from m join w using (dataset)")
def _(spark, d):
    return _six(C.compare(view(spark, d, "v_res"), "Raw", B).drop("delta", "p_value", "p_corrected", "significant"), "mean_a", "mean_b", "mean_diff")


@query("c2_signed_rank_p")
def _(spark, d):
    return C.compare(view(spark, d, "v_res"), "Raw", B).select("dataset", "delta", "p_value", "p_corrected", "significant")


@query("c5_benjamini_hochberg", f"with {duck('v_pred')}, t as (select k, case when k % 7 = 0 then null else p end as p from v_pred), r as (select k, p, p * count(p) over () / row_number() over (order by p, k) as q from t where p is not null), c as (select k, p, min(q) over (order by p desc, q desc rows between unbounded preceding and current row) as q from r) select t.k, case when t.p is not null then round(least(1.0, min(q) over (partition by t.p)), 6) end as p_corrected from t left join c using (k)")
def _(spark, d):
    t = view(spark, d, "v_pred").select("k", F.when(F.col("k") % 7 != 0, F.col("p")).alias("p"))
    return C.benjamini_hochberg(t, "p").select("k", r6(F.col("p_corrected")).alias("p_corrected"))


_BLOCKS = f"{duck('v_res')}, m as (select dataset, seed, fold, condition, model || '_' || pipeline as g, avg(f1) as v from v_res where status = 'success' group by all), f as (select dataset, seed, fold, condition from m group by all having count(*) = (select count(distinct g) from m)), r as (select m.*, rank() over (partition by dataset, seed, fold, condition order by v desc) + (count(*) over (partition by dataset, seed, fold, condition, v) - 1) / 2 as r from m join f using (dataset, seed, fold, condition))"


def _methods(spark, d):
    return view(spark, d, "v_res").where("status = 'success'").withColumn("method", F.concat_ws("_", "model", "pipeline"))


@query("c9_mean_ranks", f"with {_BLOCKS} select g as method, round(avg(r), 6) as mean_rank, count(*) as n from r group by 1")
def _(spark, d):
    return _six(C.friedman_ranks(_methods(spark, d), "f1", "method", C.BLOCK), "mean_rank")


@query("c6_c8_friedman", f"with {_BLOCKS}, t as (select sum(c * c * c - c)::double as t from (select count(*) as c from r group by dataset, seed, fold, condition, r)), s as (select count(*)::double as k, max(n)::double as n, sum(q * q) as rr from (select g, sum(r) as q, count(*) as n from r group by 1)) select k::bigint as groups, n::bigint as blocks, round((12 / (n * k * (k + 1)) * rr - 3 * n * (k + 1)) / (1 - t / (n * (k * k * k - k))), 4) as statistic from s, t")
def _(spark, d):
    return C.friedman(_methods(spark, d), "f1", "method", C.BLOCK).select("groups", "blocks", F.round("statistic", 4).alias("statistic"))


@query("c7_nemenyi", f"with {_BLOCKS}, a as (select g, avg(r) as m, count(*)::double as n from r group by 1), k as (select count(*)::double as k from a) select x.g as a, y.g as b, round(abs(x.m - y.m) / sqrt(k * (k + 1) / (6 * x.n)) * sqrt(2), 5) as q from a x, a y, k where x.g < y.g")
def _(spark, d):
    return C.nemenyi(_methods(spark, d), "f1", "method", C.BLOCK).select("a", "b", F.round("q", 5).alias("q"))


@query("c7_nemenyi_p")
def _(spark, d):
    return C.nemenyi(_methods(spark, d), "f1", "method", C.BLOCK).select("a", "b", "p_value")


@query("c10_critical_difference", f"with {_BLOCKS}, a as (select g, count(*)::double as n from r group by 1) select count(*) as groups, max(n)::bigint as blocks, round(3.2 * sqrt(count(*) * (count(*) + 1) / (6.0 * max(n))), 6) as cd from a")
def _(spark, d):
    return _six(C.critical_difference(C.friedman_ranks(_methods(spark, d), "f1", "method", C.BLOCK)), "cd")


_ROB = f"{duck('v_res')}, m as (select dataset, model, avg(f1) filter (where pipeline = 'Raw') as a, avg(f1) filter (where pipeline = '{B}') as b from v_res where status = 'success' group by all)"


@query("c11_robustness", f"with {_ROB} select dataset, model, round(b - a, 6) + 0.0 as delta from m")
def _(spark, d):
    return _six(C.robustness(view(spark, d, "v_res")).select("dataset", "model", "delta"), "delta")


@query("c11_robustness_by_model", f"with {_ROB} select model, round(avg(b - a), 6) + 0.0 as mean_delta from m group by 1")
def _(spark, d):
    return _six(C.robustness_by_model(view(spark, d, "v_res")), "mean_delta")


@query("c12_win_tie_loss", f"with {_ROB} select count(*) filter (where b - a > 0.001) as win, count(*) filter (where abs(b - a) <= 0.001) as tie, count(*) filter (where b - a < -0.001) as loss from m")
def _(spark, d):
    return C.win_tie_loss(view(spark, d, "v_res"))


@query("c13_domain_gain", f"with {_ROB} select case when dataset in ('click', 'view') then 'Web' else 'Other' end as domain, round(avg(b - a), 6) + 0.0 as mean_delta, count(b - a) as n from m group by 1")
def _(spark, d):
    v = view(spark, d, "v_res")
    domains = v.select("dataset").distinct().withColumn("domain", F.when(F.col("dataset").isin("click", "view"), "Web").otherwise("Other"))
    return _six(C.domain_gain(v, domains), "mean_delta")


@query("c14_degradation", f"with {duck('v_res')} select case when condition = 'clean' then 0.0 else cast(split_part(condition, '_', -1) as double) end as severity, pipeline, round(avg(f1), 6) as mean, round(stddev_samp(f1), 6) as std, count(f1) as n, round(avg(f1) - 1.96 * stddev_samp(f1) / sqrt(count(f1)), 6) as low, round(avg(f1) + 1.96 * stddev_samp(f1) / sqrt(count(f1)), 6) as high from v_res where status = 'success' and (condition = 'clean' or starts_with(condition, 'label_noise_')) group by 1, 2")
def _(spark, d):
    return _six(C.degradation(view(spark, d, "v_res"), "label_noise"), "mean", "std", "low", "high")


@query("c15_runtime", f"with {duck('v_res')} select model, pipeline, round(quantile_cont(infer_time_s, 0.25), 6) as q25, round(median(infer_time_s), 6) as median, round(quantile_cont(infer_time_s, 0.75), 6) as q75 from v_res group by all")
def _(spark, d):
    return _six(C.runtime_summary(view(spark, d, "v_res")), "q25", "median", "q75")


@query("c15_runtime_sketched", f"with {duck('v_res')} select model, count(*) as n, true as within, count(distinct infer_time_s) > 0 as some from v_res group by 1")
def _(spark, d):
    """Sketches of each dataset, seed and fold, stored and merged by model: the ranks of their quartiles against the rows."""
    v, path = view(spark, d, "v_res"), f"{folder(spark)}/sketches-{uuid.uuid4().hex}"
    K.unit_sketches(v, ["model", "dataset", "seed", "fold"], ["infer_time_s"]).write.parquet(path)
    whole = K.merged(spark.read.parquet(path), ["model"])
    q = K.quantiles(whole, ["model"], "infer_time_s", {"q25": 0.25, "median": 0.5, "q75": 0.75}).join(K.distinct_counts(whole, ["model"], ["infer_time_s"]).withColumnRenamed("infer_time_s", "k"), "model")
    ranks = v.join(F.broadcast(q), "model").groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("infer_time_s").alias("exact"), F.max("k").alias("k"), *[F.avg((F.col("infer_time_s") < F.col(c)).cast("double")).alias(f"lo_{c}") for c in ("q25", "median", "q75")], *[F.avg((F.col("infer_time_s") <= F.col(c)).cast("double")).alias(f"hi_{c}") for c in ("q25", "median", "q75")])
    near = [(F.col(f"lo_{c}") <= p + K.RANK_ERROR) & (F.col(f"hi_{c}") >= p - K.RANK_ERROR) for c, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))]
    close = F.abs(F.col("k") / F.col("exact") - 1) <= 4 * K.DISTINCT_ERROR
    return ranks.select("model", "n", (near[0] & near[1] & near[2] & close).alias("within"), (F.col("exact") > 0).alias("some"))


@query("c16_mean_by_pipeline", f"with {duck('v_res')} select case pipeline when 'Raw' then 'Original' else pipeline end as label, round(avg(f1), 6) as mean, round(stddev_samp(f1), 6) as std from v_res group by 1")
def _(spark, d):
    from ..operators.relational import labelled, mean_std

    m = mean_std(view(spark, d, "v_res"), ["pipeline"], "f1").withColumn("label", labelled(F.col("pipeline"), {"Raw": "Original"}))
    return _six(m.select("label", "mean", "std"), "mean", "std")


@query("c17_drop_from_clean", f"with {duck('v_res')} select dataset, seed, fold, pipeline, model, r.condition, round(c.f1 - r.f1, 6) + 0.0 as drop from v_res r join (select dataset, seed, fold, pipeline, model, f1 from v_res where condition = 'clean') c using (dataset, seed, fold, pipeline, model) where r.condition <> 'clean'")
def _(spark, d):
    return _six(C.drop_from_clean(view(spark, d, "v_res"), "f1", ["dataset", "seed", "fold", "pipeline", "model"]), "drop")


@query("c17_mean_drop", f"with {duck('v_res')}, d as (select r.condition, pipeline, model, c.f1 - r.f1 as drop from v_res r join (select dataset, seed, fold, pipeline, model, f1 from v_res where condition = 'clean') c using (dataset, seed, fold, pipeline, model) where r.condition <> 'clean') select condition, pipeline, model, round(avg(drop), 6) + 0.0 as drop, count(*) as n from d group by all")
def _(spark, d):
    drops = C.drop_from_clean(view(spark, d, "v_res"), "f1", ["dataset", "seed", "fold", "pipeline", "model"])
    return _six(drops.groupBy("condition", "pipeline", "model").agg(F.avg("drop").alias("drop"), F.count("*").alias("n")), "drop")


@query("g1_grid", f"with {duck('v_res')} select dataset, count(*) as n from v_res where seed in (42, 123) group by 1")
def _(spark, d):
    names = view(spark, d, "v_res").select("dataset").distinct()
    return G.grid(names, {"seeds": 2}).groupBy("dataset").agg(F.count("*").alias("n"))


@query("g2_g3_pending", f"with {duck('v_res')} select concat_ws('_', dataset, seed::varchar, fold::varchar, condition, pipeline, model) as task from v_res where status = 'failed'")
def _(spark, d):
    v = view(spark, d, "v_res")
    return G.pending_tasks(G.grid(v.select("dataset").distinct()), v.where("status = 'success'")).select(G.task_key().alias("task"))


@query("g4_progress", f"with {duck('v_res')} select dataset, count(*) filter (where status = 'success') as done, count(*) as expected, round(100.0 * count(*) filter (where status = 'success') / count(*), 6) as percent from v_res group by rollup (dataset)")
def _(spark, d):
    v = view(spark, d, "v_res")
    return _six(G.progress(G.grid(v.select("dataset").distinct()), v.where("status = 'success'")), "percent")


@query("g5_smallest_first", f"with {duck('v_ev')} select target as dataset, count(*) as n_rows from v_ev group by 1 order by 2, 1")
def _(spark, d):
    sizes = view(spark, d, "v_ev").groupBy(F.col("target").alias("dataset")).agg(F.count("*").alias("n_rows"))
    return G.smallest_first(sizes.select("dataset"), sizes)


@query("s9_s10_results_round_trip", f"with {duck('v_res')} select dataset, model, count(*) as n, round(avg(f1), 6) as f1 from v_res group by all")
def _(spark, d):
    path = f"{folder(spark)}/results-{uuid.uuid4().hex}"
    S.append_results(view(spark, d, "v_res"), path)
    return S.read_results(spark, path).groupBy("dataset", "model").agg(F.count("*").alias("n"), r6(F.avg("f1")).alias("f1"))


@query("s11_strict_results", f"with {duck('v_res')} select pipeline, count(*) as n, round(avg(infer_time_s), 6) as infer_time_s from v_res group by 1")
def _(spark, d):
    path = f"{folder(spark)}/results-{uuid.uuid4().hex}"
    S.append_results(view(spark, d, "v_res"), path)
    return _six(S.read_results(spark, path, strict=True).groupBy("pipeline").agg(F.count("*").alias("n"), F.avg("infer_time_s").alias("infer_time_s")), "infer_time_s")


@query("s1_s6_s12_s13_csv", f"with {duck('v_li')}, v as (select k, qty, price, nullif(flag, 'N') as flag from v_li) select small, count(*) as n, sum(qty)::bigint as qty, round(sum(price), 2) as price, count(flag) as flags from v, (select unnest([true, false]) as small) group by 1")
def _(spark, d):
    v, out = view(spark, d, "v_li").select("k", F.col("qty").cast("long").alias("qty"), "price", F.when(F.col("flag") == "N", " NA ").otherwise(F.col("flag")).alias("flag")), None
    for small, read in ((True, S.read_labelled_csv), (False, S.read_results_csv)):
        path = f"{folder(spark)}/csv-{uuid.uuid4().hex}"
        S.write_csv(v, path, small)
        one = read(spark, path).agg(F.lit(small).alias("small"), F.count("*").alias("n"), F.sum("qty").alias("qty"), F.round(F.sum("price"), 2).alias("price"), F.count("flag").alias("flags"))
        out = one if out is None else out.unionByName(one)
    return out


@query("s7_s8_profiles", f"with {duck('v_ev')} select target as dataset, case when target in ('click', 'view') then 'Web' else 'Other' end as domain, count(*)::double as number_of_samples from v_ev group by 1, 2")
def _(spark, d):
    path, v = f"{folder(spark)}/profiles-{uuid.uuid4().hex}", view(spark, d, "v_ev")
    counts = v.groupBy(F.col("target").alias("dataset")).agg(F.count("*").cast("double").alias("number_of_samples"))
    for r in counts.collect():  # one row a dataset
        S.write_profile(spark.createDataFrame([(r.number_of_samples,)], "number_of_samples double"), path, r.dataset)
    return S.read_profiles(spark, path, {"click": "Web", "view": "Web"}).select("dataset", "domain", "number_of_samples")


@query("s15_materialise_splits", f"with {duck('v_ev')} select k % 5 + 1 as fold, count(*) as n, round(sum(value), 2) as value from v_ev group by 1")
def _(spark, d):
    path, v = f"{folder(spark)}/splits-{uuid.uuid4().hex}", view(spark, d, "v_ev").withColumn("fold", F.col("k") % 5 + 1)
    for part in (v.where("fold <= 2"), v, v):  # what is there already isn't written again
        got = S.materialise(part, path, ["fold"])
    return got.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("s16_prepared", f"with {duck('v_ev')} select case when k % 5 <> 0 then 'train' else 'test' end as side, count(*) as n, round(sum(value), 2) as total, min(k) as low, max(k) as high, round((select avg(value) from v_ev where k % 5 <> 0), 6) as mean, round((select stddev_pop(value) from v_ev where k % 5 <> 0), 6) as sd from v_ev group by 1")
def _(spark, d):
    path, v = f"{folder(spark)}/prepared-{uuid.uuid4().hex}", view(spark, d, "v_ev").select("k", "value")
    train, test = v.where("k % 5 != 0"), v.where("k % 5 = 0")
    S.write_prepared(train, test, fit_numeric(train, ["value"]), path)
    a, b, p = S.read_prepared(spark, path)
    both = a.withColumn("side", F.lit("train")).unionByName(b.withColumn("side", F.lit("test"))).groupBy("side").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("k").alias("low"), F.max("k").alias("high"))
    return both.crossJoin(F.broadcast(p.select(r6(F.col("value__mean")).alias("mean"), r6(F.col("value__sd")).alias("sd"))))  # one row of parameters


@query("s18_dataset_names", f"with {duck('v_ev')} select distinct target as dataset from v_ev")
def _(spark, d):
    names = [r.target for r in view(spark, d, "v_ev").select("target").distinct().orderBy("target").collect()]  # classes
    text = "datasets:\n" + "".join(f"  - name: '{n}'  # events\n" if i % 2 else f"  - {n}\n" for i, n in enumerate(names))
    return S.dataset_names(spark, text)


@query("s14_materialise", f"with {duck('v_li')} select flag, count(*) as n, round(sum(price), 2) as price from v_li group by 1")
def _(spark, d):
    path, v = f"{folder(spark)}/sets-{uuid.uuid4().hex}", view(spark, d, "v_li")
    S.materialise(v.where("flag = 'A'"), path, ["flag"])
    return S.materialise(v, path, ["flag"]).groupBy("flag").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@query("s19_streaming_ingest", f"with {duck('v_res')} select status, count(*) as n, round(sum(f1), 3) as f1 from v_res group by 1")
def _(spark, d):
    base, v = f"{folder(spark)}/stream-{uuid.uuid4().hex}", view(spark, d, "v_res")
    S.append_results(v.where("fold <= 3").withColumn("status", F.lit("old")), f"{base}/in")
    I.ingest(spark, f"{base}/in", f"{base}/out", f"{base}/at").awaitTermination()
    S.append_results(v, f"{base}/in")  # the first rows of some tasks are written again, with their final state
    I.ingest(spark, f"{base}/in", f"{base}/out", f"{base}/at").awaitTermination()
    return I.done_tasks(spark, f"{base}/out").groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("f1"), 3).alias("f1"))


