"""From documents to packed training sequences: language, near copies, mixture, packing.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet and read again for the next. All but
the last return the columns of documents. Null and empty texts, repeated rows and empty tables are handled as the
operators' docstrings say; a stage carries columns that it doesn't know along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shiftkit.llm import jaccard, langid, mixing, packing
from shiftkit.llm.common import batches_of, crc_mod, materialize, table
from shiftkit.llm.tokens import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, and those that look like none of the learned languages, go."""
    train = crc_mod("doc_id", 4) != 2
    keyed = docs.withColumn("__text_hash", F.xxhash64(F.col("text").cast("string")))  # texts alike have one verdict
    with batches_of(spark, jaccard.TEXTS):
        found = materialize(langid.predict(keyed, train, carry=["__text_hash"], names=("__lang", "__score"), rejects=True), "languages")
    gone = materialize(found.where(F.col("__lang") == langid.UND).select("__text_hash").distinct(), "rejected")
    few = gone.count() <= jaccard.BROADCAST_IDS
    return keyed.join(F.broadcast(gone) if few else gone, "__text_hash", "left_anti").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more, the one with the smallest doc_id."""
    found = jaccard.join_components(docs, k=5, num=80, den=100, firsts=True)
    keep = materialize(found.where("__first").groupBy(F.col("doc_id").alias("__id"), "__hash").agg(F.count("*").alias("__times")), "keep")
    few = keep.count() <= jaccard.BROADCAST_IDS
    keyed = docs.withColumn("__h", F.xxhash64(F.col("text").cast("string")))
    kept = keyed.join(F.broadcast(keep) if few else keep, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")))
    copies = kept.where("__times > 1")
    first = W.partitionBy("doc_id", "__h").orderBy(F.xxhash64(*docs.columns))
    once = copies.withColumn("__r", F.row_number().over(first)).where("__r = 1")
    return kept.where("__times = 1").select(*docs.columns).unionByName(once.select(*docs.columns))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources again up to their source's budget."""
    return mixing.mix(docs, mixing.words("text")).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and their place in it."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mixed_sources),
    ("best-fit packing", packed_sequences),
]

#: SQL can't express a trained network, so there is none; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
