"""The training-data operations where tables grow, copies abound, or vectors tie."""

from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftkit.llm import html_tree, queries
from shiftkit.llm.common import scratch

SF = "/root/testdata/sf0.001"


def told(spark, pages):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_tree.main_text(df).orderBy("page_id").collect()]


def test_copied_articles_stay(spark):
    page = "<html><body><div class='a'><div class='b'><{0}><h1>Title</h1><div class='c'><p>the same words</p></div></{1}></div></div></body></html>"
    for start, end in (("article", "article"), ("main", "main"), ("div role='main'", "div")):
        assert told(spark, [(f"http://h.com/{i}", page.format(start, end)) for i in range(30)]) == ["Title the same words"] * 30


def test_shared_boilerplate_goes_whatever_the_number_of_pages(spark):
    page = "<body><div class='zone'><p>bought by everyone</p></div><div class='story'><p>{}</p></div></body>"
    few = [(f"http://h{i}.com/", page.format(f"story {i} tells {i * 7}")) for i in range(25)]
    rest = [(f"http://o{i}.com/", f"<body><div class='x'><p>other {i}</p></div></body>") for i in range(40_000)]
    for more in (0, len(rest)):
        assert told(spark, few + rest[:more]) == [f"story {i} tells {i * 7}" for i in range(25)] + [f"other {i}" for i in range(more)]


def test_noise_names_are_whole_classes_and_not_for_the_main_part(spark):
    pages = [
        ("http://a/", "<body class='search'><article class='share'><p>kept</p></article></body>"),
        ("http://b/", "<body><div class='post-comment-free'><p>kept</p></div><div class='big comment'>gone</div></body>"),
        ("http://c/", "<body id='nav'><main id='banner'><p>kept</p></main><div id='banner'>gone</div></body>"),
    ]
    assert told(spark, pages) == ["kept"] * 3


@pytest.mark.parametrize("langs", [("de", "en", "es", "fr"), ("de", "en", "fr"), ("en", "es")])
def test_junk_goes_and_clean_documents_stay(spark, langs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang").isin(*langs))
    rng = np.random.default_rng(3)
    run = lambda letters, n: " ".join("".join(rng.choice(list(letters), rng.integers(3, 14))) for _ in range(n))
    junk = [run("0123456789#%&/()=+*", 60) + " ab" for _ in range(10)] + [run("0123456789ABCDEFxyz", 60) for _ in range(10)] + [run("的一是不了人我在有他这", 60) for _ in range(10)]
    planted = spark.createDataFrame([(10**6 + i, t, None, "junk", len(t)) for i, t in enumerate(junk)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs.unionByName(planted), SF).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.select("doc_id").collect()}
    stays = sum(d >= 10**6 for d in kept)  # bytes that no language taught may look like one, the more so the fewer there are
    assert len(clean - kept) <= 0.01 * len(clean) and stays <= {4: 0, 3: 5, 2: 15}[len(langs)]


def test_media_are_read_back_from_what_is_stored(spark):
    before = set(Path(scratch(spark)).glob("media-*"))
    got = queries.op5_media(spark, SF)
    (stored,) = set(Path(scratch(spark)).glob("media-*")) - before
    assert all(str(stored) in f for f in got.inputFiles()) and got.inputFiles()
    assert got.count() == spark.read.parquet(str(stored)).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
