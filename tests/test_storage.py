"""Units with commit markers, keyed upserts, sketches, exact quantiles and sparse encoding."""

import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shiftkit.functions.shared import folder
from shiftkit.operators import compare, prepare, sketches
from shiftkit.sources import tables
from shiftkit.streaming import ingest


def units(spark):
    return spark.createDataFrame([(f"0{i % 4}", i % 3 if i % 5 else None, float(i)) for i in range(60)], "u string, f int, x double")


def rows_of(df):
    return Counter((r.u, r.f, r.x) for r in df.collect())


def test_a_write_that_dies_before_its_mark_is_repaired(spark, monkeypatch):
    df, path = units(spark), f"{folder(spark)}/units-{uuid.uuid4().hex}"
    assert tables.read_units(spark, path, ["u", "f"], df.schema).count() == 0
    tables.materialise(df.where("u = '00'"), path, ["u", "f"])

    def dies(units, path):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(tables, "_mark", dies)
        with pytest.raises(RuntimeError):
            tables.materialise(df.where("u in ('00', '01')"), path, ["u", "f"])  # the files of 01 are there, the mark isn't
    assert rows_of(tables.read_units(spark, path, ["u", "f"], df.schema)) == rows_of(df.where("u = '00'"))
    asked = []
    mark = tables._mark
    monkeypatch.setattr(tables, "_mark", lambda u, p: (asked.extend((r.u, r.f, r.rows) for r in u.collect()), mark(u, p)))
    assert rows_of(tables.materialise(df, path, ["u", "f"])) == rows_of(df)
    assert {u for u, _, _ in asked} == {"01", "02", "03"} and sum(n for _, _, n in asked) == 45
    asked.clear()
    assert rows_of(tables.materialise(df.withColumn("x", F.lit(0.0)), path, ["u", "f"])) == rows_of(df) and not asked  # all is there
    tables._mark(spark.createDataFrame([("00", 0, 5, "other")], "u string, f int, rows long, attempt string"), path)  # a later mark of a unit that is there
    assert rows_of(tables.read_units(spark, path, ["u", "f"], df.schema)) == rows_of(df)


def test_prepared_versions_count_once_they_are_whole(spark, monkeypatch):
    df, path = units(spark), f"{folder(spark)}/prepared-{uuid.uuid4().hex}"
    params = prepare.fit_numeric(df, ["x"])
    tables.write_prepared(df.where("x < 40"), df.where("x >= 40"), params, path)
    with monkeypatch.context() as m:
        m.setattr(tables, "_mark", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            tables.write_prepared(df, df, params, path)
    train, test, p = tables.read_prepared(spark, path)
    assert (train.count(), test.count(), p.count()) == (40, 20, 1)
    tables.write_prepared(df, df, params, path)
    assert tables.read_prepared(spark, path)[0].count() == 60
    tables.write_prepared(df, df.drop("f"), params, path)
    with pytest.raises(ValueError):
        tables.read_prepared(spark, path)


def arrived(spark, rows):
    """Rows (task, f1, order) as they arrive."""
    df = spark.createDataFrame(rows, "dataset string, f1 double, at long")
    cols = [F.col(f.name) if f.name in ("dataset", "f1") else F.lit(None).cast(f.dataType).alias(f.name) for f in tables.RESULT_SCHEMA.fields]
    return df.select(*cols, F.timestamp_seconds("at").alias("__at"), F.lit("file").alias("__file"), F.lit(0).cast("long").alias("__row"))


def test_upserts_touch_few_buckets_and_survive_replays(spark, monkeypatch):
    target, want = f"{folder(spark)}/upsert-{uuid.uuid4().hex}", {}
    rng = np.random.default_rng(1)
    for batch in range(12):
        rows = [(f"d{i}", float(rng.random()), int(rng.integers(1000))) for i in rng.integers(0, 40, 5).tolist()]
        for d, f1, at in rows:
            if d not in want or at > want[d][1]:
                want[d] = (f1, at)
            elif at == want[d][1]:
                want[d] = None
        if batch == 5:  # dies between files and mark, then the batch comes again
            with monkeypatch.context() as m:
                m.setattr(ingest, "_mark", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
                with pytest.raises(RuntimeError):
                    ingest.upsert(arrived(spark, rows), batch, target, 8)
        ingest.upsert(arrived(spark, rows), batch, target, 8)
        if batch % 4 == 0:
            ingest.upsert(arrived(spark, [("d0", -1.0, 10**6)]), batch, target, 8)  # a replay of what is marked changes nothing
    got = {r.dataset: r.f1 for r in ingest.done_tasks(spark, target).collect()}
    assert set(got) == set(want) and all(v is None or got[d] == v[0] for d, v in want.items())
    state = ingest._state(spark, target)
    assert state.count() == len(want) and len(state.inputFiles()) <= 8 * 4  # what is read doesn't grow with the batches
    assert ingest.done_tasks(spark, f"{target}-none").count() == 0


def test_exact_quantiles_and_merged_sketches(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal(4000).round(2), np.full(1500, 0.5)])
    rows = [(i % 3, i % 7, float(v), f"t{i % 900}") for i, v in enumerate(x)] + [(9, 0, None, None), (9, 1, float("nan"), "a")]
    df = spark.createDataFrame(rows, "g long, part long, x double, t string")
    at = {"q0": 0.0, "q1": 0.13, "q5": 0.5, "q10": 1.0}
    exact = {r.g: r for r in sketches.exact_quantiles(df, ["g"], "x", at).collect()}
    assert set(exact) == {0, 1, 2}
    for g in range(3):
        own = np.array([r[2] for r in rows if r[0] == g])
        assert np.allclose([exact[g][n] for n in at], [np.quantile(own, p) for p in at.values()])
    assert abs(sketches.exact_quantiles(df, [], "x", {"m": 0.5}).first().m - np.median(x)) < 1e-12
    parts = sketches.unit_sketches(df, ["g", "part"], ["x", "t"])
    whole, direct = sketches.merged(parts, ["g"]), sketches.unit_sketches(df, ["g"], ["x", "t"])
    for made in (whole, direct):
        got = {r.g: r for r in sketches.quantiles(made, ["g"], "x", {"m": 0.5, "q": 0.9}).join(sketches.distinct_counts(made, ["g"], ["x", "t"]), "g").collect()}
        for g in range(3):
            own, texts = np.array([r[2] for r in rows if r[0] == g]), {r[3] for r in rows if r[0] == g}
            for n, p in (("m", 0.5), ("q", 0.9)):
                assert (own < got[g][n]).mean() - sketches.RANK_ERROR <= p <= (own <= got[g][n]).mean() + sketches.RANK_ERROR
            assert abs(got[g].t / len(texts) - 1) < 4 * sketches.DISTINCT_ERROR and abs(got[g].x / len(set(own.tolist())) - 1) < 4 * sketches.DISTINCT_ERROR
        assert got[9].m is None and got[9].t == 1
    r = df.select(F.lit("m").alias("model"), F.col("g").cast("string").alias("pipeline"), F.col("x").alias("infer_time_s"))
    near, far = ({x.pipeline: x for x in compare.runtime_summary(r, exact=e).collect()} for e in (True, False))
    assert all(abs(near[str(g)].median - far[str(g)].median) < 0.1 for g in range(3))


def test_sparse_and_dense_encoding_agree(spark):
    rows = [(i, float(i % 4) if i % 6 else None, f"v{i % 5}" if i % 7 else None, f"w{i % 3}", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, x double, s string, t string, target long")
    train, test = df.where("k < 60"), df.where("k >= 60").withColumn("s", F.when(F.col("k") == 65, "new").otherwise(F.col("s")))
    dense = prepare.prepare(train, test, ["k"], "target")
    for most in (500_000, 0):
        sparse = prepare.sparse_prepare(train, test, ["k"], "target", most=most)
        assert sparse[2] == ["x"]
        for d, s in zip(dense, sparse[:2], strict=True):
            names = [c for c in d.columns if c not in ("k", "target")]
            want = {r.k: [round(r[c], 9) for c in names] for r in d.collect()}
            assert {r.k: [round(v, 9) for v in r.v] for r in s.select("k", vector_to_array("features").alias("v")).collect()} == want
        assert sum({r.k: r.v for r in sparse[1].select("k", vector_to_array("features").alias("v")).collect()}[65][1:6]) == 0


def test_a_hundred_thousand_levels_fit_and_predict(spark):
    n = 100_000
    df = spark.range(2 * n).select(F.col("id").alias("k"), F.concat(F.lit("level"), F.col("id") % n).alias("s"), ((F.col("id") % n) % 2).alias("target"))
    train, test, _ = prepare.sparse_prepare(df.where(f"k < {n} + 5"), df.where(f"k >= {n} + 5").withColumn("s", F.when(F.col("k") % 1000 == 0, "unknown").otherwise(F.col("s"))), ["k"], "target", most=1000)
    model = LogisticRegression(featuresCol="features", labelCol="target", maxIter=5).fit(train)
    assert model.numFeatures == n
    got = model.transform(test).agg(F.avg((F.col("prediction") == F.col("target")).cast("double"))).first()[0]
    assert got > 0.99 and test.count() == n - 5
