"""The queries of this folder, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, hard_negatives, html_tree, jaccard, langid, lm, media_ts, mixing, packing, prefix_trie, token_store, url_filter
from .common import crc_mod, materialize, scratch, table
from .tokens import tokenizer_path

QUERIES, SQL = {}, {}
FLATTER = 0.999  # of the largest entropy: more than the sources of the given tables have as they are

URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packing.pack(pieces)


@query
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/store-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_store(spark, path)


@query
def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(media_ts.mux(table(spark, sf_dir, "documents").select("doc_id", "text")), "media")
    return media_ts.demux(stored).drop("units", "errors")


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), rules)


SQL["op8_url_filter"] = """
with u as (
  select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path, row_number() over () as i
  from pages),
r(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
f as (
  select u.i, r.h || r.p as rule, r.v, row_number() over (partition by u.i order by length(r.h) + length(r.p) desc, length(r.h) desc) as k
  from u join r on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p))
select u.page_id, u.host, u.path, f.rule, coalesce(f.v, 'allow') as verdict
from u left join f on u.i = f.i and f.k = 1
"""


@query
def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.main_text(table(spark, sf_dir, "pages"))


@query
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    found = langid.predict(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words("text").alias("n"))
    return mixing.placements(materialize(rows, "mix-rows"), entropy=FLATTER)


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


@query
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, m = table(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod("doc_id", 10)
    part = F.when(m == 0, lm.TEST).when(m == 1, lm.HELD).otherwise(lm.EST)
    scored = lm.score(docs, part)
    return scored.select("doc_id", (F.col("part") == lm.TEST).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = materialize(prefix_trie.turns_by_conversation(table(spark, sf_dir, "conversations")), "conversations")
    return prefix_trie.trie(prefix_trie.rebuilt(convs))


@query
def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items, digest = F.size("items").cast("long").alias("n_items"), decontaminate.digest_of("items").alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", n_items, digest, (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op12_decontaminate"] = f"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
g as (select distinct cast(item_id as varchar) as item, least(10, len(w)) as m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as s
      from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
lens as (select distinct m from g),
dw as (select r, m, i, array_to_string(w[i:i + m - 1], ' ') as s
       from (select r, w, m, unnest(generate_series(1, cast(len(w) as int) - m + 1)) as i from d join lens on len(w) >= m)),
h as (select distinct r, i, dw.m, item from dw join g on dw.m = g.m and dw.s = g.s),
hit as (select r, count(distinct k) as n from (select r, unnest(generate_series(i, i + m - 1)) as k from (select distinct r, i, m from h)) group by r),
it as (select r, count(*) as n, sha256(string_agg(item, ',' order by item)) as x from (select distinct r, item from h where item is not null) group by r)
select doc_id, len(w) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(it.n, 0) as n_items, coalesce(it.x, sha256('')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit using (r) left join it using (r)
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL["op13_hard_negatives"] = """
with r as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.id as anchor_id, b.id, a.label = b.label as same, cast(list_sum([x[1] * x[2] for x in list_zip(a.v, b.v)]) as bigint) as score
      from r a join r b on a.id <> b.id where a.id % 100 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over w as integer) as rank, s.id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by s.score desc, s.id)
qualify row_number() over w <= 5
"""
