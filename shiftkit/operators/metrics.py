"""E, V. Metrics of predictions by unit, and distances of distributions."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import place_among, running_sums
from ..functions.numeric import finite, ratio
from ..functions.shared import written

EPS = 1e-15


def confusion(pred: DataFrame, unit: list[str]) -> DataFrame:
    """E1. (unit..., y_true, y_pred, n)."""
    return pred.groupBy(*unit, "y_true", "y_pred").agg(F.count("*").alias("n"))


def label_metrics(pred: DataFrame, unit: list[str], positive: str = "1") -> DataFrame:
    """E2 to E6. accuracy, balanced_accuracy, mcc, precision, recall, f1 of each unit, all from the confusion counts.

    Precision, recall and F1 are those of ``positive`` where a unit has exactly two true classes, else means over all
    classes seen; empty denominators give 0.
    """
    m = confusion(pred.select(*unit, F.col("y_true").cast("string"), F.col("y_pred").cast("string")), unit)
    side = F.explode(F.array(F.struct(F.col("y_true").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("y_pred").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp"))))
    by_class = m.select(*unit, side.alias("s")).groupBy(*unit, "s.c").agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum("s.tp").alias("tp"))
    pr, re = F.coalesce(ratio(F.col("tp"), F.col("p")), F.lit(0.0)), F.coalesce(ratio(F.col("tp"), F.col("t")), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("t") + F.col("p")), F.lit(0.0))
    pos = F.col("c") == positive
    d = lambda c: F.col(c).cast("double")
    a = by_class.withColumns({"pr": pr, "re": re, "f": f1}).groupBy(*unit).agg(
        F.sum("t").alias("n"), F.sum("tp").alias("c"), F.sum(d("t") * d("p")).alias("tp_"), F.sum(d("t") * d("t")).alias("tt"), F.sum(d("p") * d("p")).alias("pp"), F.count_if(F.col("t") > 0).alias("k"),
        F.avg(F.when(F.col("t") > 0, F.col("re"))).alias("balanced_accuracy"), *[F.avg(x).alias(f"{x}_macro") for x in ("pr", "re", "f")], *[F.coalesce(F.max(F.when(pos, F.col(x))), F.lit(0.0)).alias(f"{x}_pos") for x in ("pr", "re", "f")],
    )
    n, c = d("n"), d("c")
    mcc = F.coalesce(ratio(c * n - F.col("tp_"), F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))), F.lit(0.0))
    pick = lambda x: F.when(F.col("k") == 2, F.col(f"{x}_pos")).otherwise(F.col(f"{x}_macro"))
    return a.select(*unit, F.col("n"), (c / n).alias("accuracy"), "balanced_accuracy", mcc.alias("mcc"), pick("pr").alias("precision"), pick("re").alias("recall"), pick("f").alias("f1"))


def by_class_scores(pred: DataFrame, unit: list[str]) -> DataFrame:
    """(unit..., c, score, y): one row a prediction and class of proba (a map from class to probability), joined by label."""
    return pred.select(*unit, F.col("y_true").cast("string").alias("__y"), F.explode("proba").alias("c", "score")).select(*unit, "c", "score", (F.col("c") == F.col("__y")).cast("int").alias("y"))


def ranking_metrics(scores: DataFrame, unit: list[str]) -> DataFrame:
    """E9, E10. (unit..., auc, ap) from (unit..., score, y in 0/1); tied scores count as one step, null where a class is missing."""
    steps = scores.groupBy(*unit, "score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    run = running_sums(steps.withColumn("__neg", -F.col("score")), F.col("__neg"), {"tp": "pos", "all": "n"}, unit)
    totals = steps.groupBy(*unit).agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    j = run.join(totals, unit) if unit else run.crossJoin(F.broadcast(totals))
    neg_step, neg_total = F.col("n") - F.col("pos"), F.col("all_n") - F.col("all_pos")
    # A negative at this step is beaten by the positives before it, and half by those tied with it.
    beaten = neg_step * (F.col("tp") - F.col("pos") / 2)
    area = j.groupBy(*unit, "all_pos", "all_n").agg(F.sum(beaten).alias("b"), F.sum(F.col("pos") * F.col("tp") / F.col("all")).alias("a"))
    return area.select(*unit, ratio(F.col("b"), F.col("all_pos") * neg_total).alias("auc"), F.when(neg_total > 0, ratio(F.col("a"), F.col("all_pos"))).alias("ap"))


def probability_metrics(pred: DataFrame, unit: list[str], positive: str = "1") -> DataFrame:
    """E7 to E11. log_loss, brier_score, roc_auc, pr_auc of each unit from proba; all null where only one class is true.

    Two true classes: those of ``positive``; more: means over the true classes (one against the rest).
    """
    rows = pred.select(*unit, F.col("y_true").cast("string").alias("y_true"), "proba")
    classes = rows.groupBy(*unit).agg(F.countDistinct("y_true").alias("k"), F.collect_set("y_true").alias("seen"))
    joined = rows.join(classes, unit) if unit else rows.crossJoin(F.broadcast(classes))
    p = F.coalesce(F.col("proba")[F.col("y_true")], F.lit(0.0))
    loss = joined.groupBy(*unit, "k").agg(F.avg(-F.log(F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS)))).alias("log_loss"))
    long = joined.select(*unit, "k", "y_true", "proba", F.explode("seen").alias("c")).where((F.col("k") > 2) | (F.col("c") == positive))
    long = long.select(*unit, "c", F.coalesce(F.col("proba")[F.col("c")], F.lit(0.0)).alias("score"), (F.col("c") == F.col("y_true")).cast("int").alias("y"))
    brier = long.groupBy(*unit, "c").agg(F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))).alias("b"))
    ranked = ranking_metrics(long, [*unit, "c"])
    per = brier.join(ranked, [*unit, "c"]).groupBy(*unit).agg(F.avg("b").alias("brier_score"), F.avg("auc").alias("roc_auc"), F.avg("ap").alias("pr_auc"))
    out = loss.join(per, unit, "left") if unit else loss.crossJoin(F.broadcast(per))
    ok = lambda c: F.when(F.col("k") >= 2, F.col(c)).alias(c)
    return out.select(*unit, *[ok(c) for c in ("log_loss", "brier_score", "roc_auc", "pr_auc")])


def all_metrics(pred: DataFrame, unit: list[str], positive: str = "1") -> DataFrame:
    """E2 to E12. All ten; with the role in ``unit`` also those of the training side."""
    return label_metrics(pred, unit, positive).join(probability_metrics(pred, unit, positive), unit, "left")


def two_samples(df: DataFrame, value: Column, is_first: Column, by: list[str] | None = None) -> DataFrame:
    """Distinct values with the counts of both samples (a, b) and their running counts (ca, cb), totals (na, nb)."""
    by = by or []
    counts = df.select(*by, finite(value).alias("v"), is_first.alias("f")).where("v is not null").groupBy(*by, "v").agg(F.count_if("f").alias("a"), F.count_if(~F.col("f")).alias("b"))
    run = running_sums(counts, F.col("v"), {"ca": "a", "cb": "b"}, by)
    totals = counts.groupBy(*by).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count("*").alias("nv"))
    return run.join(totals, by) if by else run.crossJoin(F.broadcast(totals))


def distances(df: DataFrame, value: Column, is_first: Column, by: list[str] | None = None, blocks: int = 32) -> DataFrame:
    """V1, V2. (by..., wasserstein, ks); null where one sample is empty."""
    by = by or []
    t = two_samples(df, value, is_first, by)
    gap = F.abs(ratio(F.col("ca"), F.col("na")) - ratio(F.col("cb"), F.col("nb")))
    # The next value: in the block by lead, across blocks from the blocks' first values.
    t = written(t, "counts")  # asked for three times
    edges = written(t.groupBy(*by).agg(F.percentile_approx("v", [(i + 1) / blocks for i in range(blocks - 1)], 1000).alias("__e")), "edges")  # one row a group
    t = (t.join(edges, by) if by else t.crossJoin(F.broadcast(edges))).withColumn("__b", place_among("__e", F.col("v"), blocks)).drop("__e")
    firsts = t.groupBy(*by, "__b").agg(F.min("v").alias("__f"))
    after = firsts.select(*by, "__b", F.lead("__f").over(W.partitionBy(*by).orderBy("__b")).alias("__after"))
    t = t.join(after, [*by, "__b"])
    following = F.coalesce(F.lead("v").over(W.partitionBy(*by, "__b").orderBy("v")), F.col("__after"))
    t = t.withColumn("__w", gap * (following - F.col("v"))).withColumn("__g", gap)
    some = (F.max("na") > 0) & (F.max("nb") > 0)
    return t.groupBy(*by).agg(F.when(some, F.coalesce(F.sum("__w"), F.lit(0.0))).alias("wasserstein"), F.when(some, F.max("__g")).alias("ks"))


def distribution_distance(clean: DataFrame, shifted: DataFrame, cols: list[str]) -> DataFrame:
    """E13. (wasserstein, ks): means over the common numeric columns."""
    cell = lambda df, f: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])).alias("s")).select("s.c", "s.x", F.lit(f).alias("f"))
    both = cell(clean, True).unionByName(cell(shifted, False))
    return distances(both, F.col("x"), F.col("f"), ["c"]).agg(F.avg("wasserstein").alias("wasserstein"), F.avg("ks").alias("ks"))


