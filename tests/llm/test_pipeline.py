"""The pipeline's stages against brute force on the smallest table and on odd rows."""

import re
from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from shiftkit.llm.common import materialize
from tests.llm.test_llm import brute, empty, odd  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    known = materialize(P.known_language(spark, docs, SF), "t")
    assert known.columns == columns
    lost = {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()}
    assert len(lost) <= 0.01 * n
    one = materialize(P.one_of_each_group(spark, known, SF), "t")
    want = brute([(r.doc_id, r.text) for r in known.collect()], 5, 80, 100)
    assert one.columns == columns and Counter(r.doc_id for r in one.collect()) == Counter({d for d, _, c in want if d == c})
    mixed = materialize(P.mixed_sources(spark, one, SF), "t")
    assert mixed.columns == columns and mixed.select("doc_id").distinct().count() == one.count()
    packed = P.packed_sequences(spark, mixed, SF)
    assert packed.select("doc_id").distinct().count() == one.count()
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert per.where("n > 2048 or n != e").count() == 0


def test_odd_documents_pass_every_stage(spark, odd, empty):  # noqa: F811
    for docs in (odd, empty):
        got = docs
        for i, (_, stage) in enumerate(P.STAGES):
            got = materialize(stage(spark, got, SF), "t")
            assert i == len(P.STAGES) - 1 or got.columns == docs.columns
    left = Counter(r.doc_id for r in P.one_of_each_group(spark, odd, SF).collect())
    assert left[0] == 1 and left[1] == left[2] == 0 and left[3] == left[4] == left[5] == 1


def test_operators_do_not_swallow_import_errors():
    from pathlib import Path

    root = Path(P.__file__).resolve().parent
    for f in [root / "corpus_pipeline.py", *(root / "shiftkit/llm").glob("*.py")]:
        assert not re.search(r"except\s+(ImportError|ModuleNotFoundError)", f.read_text())
