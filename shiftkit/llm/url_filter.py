"""URL rules: a blocked Bloom filter passes possible hits on to an exact hash join.

All of it is DataFrame expressions. A rule is (host, path): it fits its host and every subdomain where
the url's path starts with the rule's path; the longest rule wins, a longer host before a longer path.

Defined results: a null url, or one without "://", has an empty host and path and no rule; repeated rows
each get their row; no rules: everything gets the default verdict; empty tables give empty results; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The filter has this many 64-bit blocks at most (2 MB); with more rules more false hits reach the join.
MAX_BLOCKS = 1 << 18
#: A rule table up to this many rows is broadcast to the exact join; a larger one is shuffled by key.
BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def _mask(key: Column) -> Column:
    """Six bits of one 64-bit block, taken from a second hash."""
    h, out = F.xxhash64(key, F.lit(2)), None
    for i in range(6):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 9 * i), F.lit(64)).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Verdict of every row of ``pages`` under ``rules(host, path, verdict)``.

    Returns id_col, host, path, rule (host and path, null if none fits), verdict.
    """
    listed = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host is not null and r_path is not null")
    listed = listed.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict")).withColumn("r_key", F.concat_ws("\x00", "r_host", "r_path"))
    shape = listed.agg(F.count("*"), F.max(F.size(F.split("r_host", r"\."))), F.collect_set(F.length("r_path"))).first()
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not shape[0]:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    n, labels, lengths = shape[0], shape[1], sorted(shape[2])
    blocks = min(MAX_BLOCKS, max(16, n // 4))
    bits = listed.groupBy(_block(F.col("r_key"), blocks).alias("b")).agg(F.bit_or(_mask(F.col("r_key"))).alias("w"))
    # Copies of a url are judged once: what is probed is the distinct (host, path), combined map-side.
    distinct = urls.groupBy("host", "path").agg(F.lit(1).alias("one")).drop("one")
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    heads = F.array_compact(F.array(*[F.when(F.length("path") >= m, F.substring("path", 1, m)) for m in lengths]))
    probes = distinct.withColumn("tail", F.explode(tails)).withColumn("head", F.explode(heads))
    probes = probes.select("host", "path", F.concat_ws("\x00", "tail", "head").alias("key")).withColumn("b", _block(F.col("key"), blocks)).withColumn("m", _mask(F.col("key")))
    possible = probes.join(F.broadcast(bits), "b").where(F.col("w").bitwiseAND(F.col("m")) == F.col("m"))
    exact = possible.join(F.broadcast(listed) if n <= BROADCAST_RULES else listed, possible.key == listed.r_key)
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"))
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("hit"))
    judged = urls.join(best, ["host", "path"], "left")
    return judged.select(id_col, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
