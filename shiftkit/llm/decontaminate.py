"""Benchmark passages in training documents: a broadcast hash set of test n-grams, and a scan that verifies its hits.

Words are runs of a-z, 0-9 and letters beyond ASCII after A-Z are lower-cased; a window is n words of a benchmark item in
a row, and an item of fewer words is one window. The distinct (window, item) pairs are cut by a hash into sets of at most
SET_BYTES, one as a rule. A set is broadcast, documents are scanned once a set: each window of a text has a rolling hash,
a bit table leaves out most, a search in the sorted hashes the rest, and what is left is compared with the window's words
byte by byte. Nothing is shuffled but, with several sets, the hits.

Defined results: a null text has no words, neither has an item without them; an item whose id is null marks words but is
not among the items; repeated rows each get their row, repeated items count once; empty tables give empty results, an
empty benchmark marks nothing; other columns are ignored by ``scan`` and carried by the removers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .tokens import lean, text_slices

N, SET_BYTES, WORDS_AT_ONCE, SEED = 10, 32 << 20, 1 << 17, 29
_RUNS = T.ArrayType(T.StructType().add("first", "long").add("words", "long"))
ROLL = np.uint64(0x9E3779B97F4A7C15 | 1)


def _unroll() -> np.uint64:
    return np.uint64(pow(int(ROLL), -1, 1 << 64))


def _is_word() -> np.ndarray:
    b = np.arange(256)
    return ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)


_WORD = _is_word()
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.where(_WORD, np.arange(256), 32)).astype(np.uint8)
_VALUE = np.random.default_rng(SEED).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """The words of some texts: lower-cased bytes with one blank between words, where words begin and end there and in the raw bytes, and whose they are."""

    def __init__(self, raw: np.ndarray, edges: np.ndarray):
        word = _WORD[raw]
        before = np.concatenate([[False], word[:-1]])
        first = np.zeros(len(raw) + 1, bool)
        first[edges] = True  # a text's first byte goes on with no word of the text before
        starts = word & (~before | first[:-1])
        self.raw_start = np.flatnonzero(starts)
        self.raw_end = np.flatnonzero(word & (~np.concatenate([word[1:], [False]]) | first[1:])) + 1
        size = self.raw_end - self.raw_start
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.text = np.full(int(self.end[-1]) + 1 if len(size) else 0, 32, np.uint8)
        inner = np.ones(len(self.text), bool)
        inner[self.end] = False
        self.text[inner] = _LOWER[raw[word]]
        self.of = np.searchsorted(edges, self.raw_start, "right") - 1
        self.per = np.bincount(self.of, minlength=len(edges) - 1)

    def hashes(self, lo: int, hi: int, m: int) -> np.ndarray:
        """Of the windows of m words that begin at words lo to hi - 1 (all of which have m words)."""
        a, b = int(self.start[lo]), int(self.end[hi + m - 2])
        power = np.full(b - a + 1, ROLL)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        run = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_VALUE[self.text[a:b]] * power[:-1], out=run[1:])
        inverse = np.full(b - a + 1, _unroll())
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        s = self.start[lo:hi] - a
        x = (run[self.end[lo + m - 1 : hi + m - 1] - a] - run[s]) * inverse[s]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text begins."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[edges[0] : edges[-1]], edges - edges[0]


class GramSet:
    """Windows by number of words: sorted hashes, a bit table of them, their words and their items."""

    def __init__(self, windows: list[tuple[int, bytes, list]]):
        self.by: dict[int, tuple[np.ndarray, np.ndarray, list[bytes], list[list]]] = {}
        for m in sorted({w[0] for w in windows}):
            some = [w for w in windows if w[0] == m]
            texts = [w[1] for w in some]
            joined = Words(*_raw(pa.array([t.decode() for t in texts], pa.large_string())))
            at = np.concatenate([[0], np.cumsum(joined.per)])[:-1]
            h = np.concatenate([joined.hashes(int(i), int(i) + 1, m) for i in at])
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << max(12, int(len(h) - 1).bit_length() + 5), bool)
            bits[(h >> np.uint64(64 - int(len(bits)).bit_length() + 1)).astype(np.int64)] = True
            self.by[m] = (h[order], bits, [texts[i] for i in order], [some[i][2] for i in order])

    def hits(self, w: Words) -> Iterator[tuple[np.ndarray, int, list[list]]]:
        """For each number of words m: the words where an occurrence begins, m, and its items."""
        total, blob = len(w.start), w.text.tobytes()
        for m, (keys, bits, texts, items) in self.by.items():
            shift = np.uint64(64 - int(len(bits)).bit_length() + 1)
            at, got = [], []
            for lo in range(0, total - m + 1, WORDS_AT_ONCE):
                hi = min(lo + WORDS_AT_ONCE, total - m + 1)
                h = w.hashes(lo, hi, m)
                maybe = np.flatnonzero(bits[(h >> shift).astype(np.int64)] & (w.of[lo:hi] == w.of[lo + m - 1 : hi + m - 1]))
                k = np.searchsorted(keys, h[maybe])
                for i, j in zip((maybe + lo).tolist(), k.tolist(), strict=True):
                    x = int(h[i - lo])
                    while j < len(keys) and int(keys[j]) == x:
                        if blob[w.start[i] : w.end[i + m - 1]] == texts[j]:
                            at.append(i)
                            got.append(items[j])
                            break
                        j += 1
            yield np.array(at, np.int64), m, got


def _windows(bench: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct (m, window, item) of all items."""

    def cut(batches):
        for b in batches:
            for part in text_slices(b, 1):
                w = Words(*_raw(part.column(1)))
                blob, first = w.text.tobytes(), np.cumsum(w.per) - w.per
                ms, texts, ids = [], [], []
                for item, at, k in zip(part.column(0).to_pylist(), first.tolist(), w.per.tolist(), strict=True):
                    m = min(n, k)
                    for i in range(at, at + k - m + 1 if k else at):
                        ms.append(m)
                        texts.append(blob[w.start[i] : w.end[i + m - 1]])
                        ids.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(ms, pa.int32()), pa.array(texts, pa.binary()), pa.array(ids, pa.string())], ["m", "w", "item"])

    rows = bench.select(F.col(item_col).cast("string"), F.col(text_col).cast("string"))
    return rows.mapInArrow(lean(cut), "m int, w binary, item string").distinct()


def _hits(docs: DataFrame, bench: DataFrame, n: int, text_col: str, item_col: str, item_text: str, set_bytes: int, carry: list[str], spans: bool) -> DataFrame:
    """The columns ``carry``, n_words, ``runs`` (hit runs as first word, words) or, with ``spans``, their places in bytes, and ``items``, of every document."""
    spark = docs.sparkSession
    grams = materialize(_windows(bench, n, item_col, item_text), "test-grams")
    size = F.length("w") + F.coalesce(F.length("item"), F.lit(0)) + 64
    sets = max(1, -(-int(grams.agg(F.sum(size)).first()[0] or 0) // set_bytes))
    numbered = F.pmod(F.xxhash64("w", "item"), F.lit(sets))
    rows = docs.select(*carry, F.col(text_col).cast("string").alias("__text"))
    if sets > 1:
        rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "scanned")
        carry = [*carry, "__row"]
    schema = T.StructType([rows.schema[c] for c in carry]).add("n_words", "long").add("runs", _RUNS).add("items", T.ArrayType(T.StringType()))
    place = rows.columns.index("__text")

    def scan_with(chosen: DataFrame) -> DataFrame:
        got = chosen.groupBy("m", "w").agg(F.collect_set("item").alias("items")).toArrow().to_pydict()  # SET_BYTES at most
        known = spark.sparkContext.broadcast(list(zip(got["m"], got["w"], got["items"], strict=True)))

        def run(batches):
            grams = GramSet(known.value)
            for b in batches:
                for part in text_slices(b, place):
                    w = Words(*_raw(part.column(place)))
                    mark, found = np.zeros(len(w.start) + 1, np.int64), {}
                    for at, m, items in grams.hits(w):
                        np.add.at(mark, at, 1)
                        np.add.at(mark, at + m, -1)
                        for d, x in zip(w.of[at].tolist(), items, strict=True):
                            found.setdefault(d, set()).update(x)
                    hit = np.cumsum(mark)[:-1] > 0
                    head = hit & (~np.concatenate([[False], hit[:-1]]) | np.concatenate([[True], w.of[1:] != w.of[:-1]])[: len(hit)])
                    tail = hit & (~np.concatenate([hit[1:], [False]]) | np.concatenate([w.of[1:] != w.of[:-1], [True]])[: len(hit)])
                    lo, hi = np.flatnonzero(head), np.flatnonzero(tail)
                    per = np.bincount(w.of[lo], minlength=part.num_rows)
                    if spans:
                        begin = _raw(part.column(place))[1][w.of[lo]]
                        first, length = w.raw_start[lo] - begin, w.raw_end[hi] - w.raw_start[lo]
                    else:
                        first, length = lo - (np.cumsum(w.per) - w.per)[w.of[lo]], hi - lo + 1
                    runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(length, pa.int64())], ["first", "words"]))
                    items = pa.array([sorted(found.get(i, ())) for i in range(part.num_rows)], pa.list_(pa.string()))
                    kept = [part.column(part.schema.names.index(c)) for c in carry]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(w.per, pa.int64()), runs, items], [*carry, "n_words", "runs", "items"])

        return rows.mapInArrow(lean(run), schema)

    if sets == 1:
        return scan_with(grams)
    scans = [materialize(scan_with(grams.where(numbered == i)), "scan") for i in range(sets)]
    whole = scans[0]
    for s in scans[1:]:
        whole = whole.unionByName(s)
    own = [c for c in carry if c != "__row"]
    merged = whole.groupBy("__row").agg(*[F.first(c).alias(c) for c in own], F.first("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return merged.withColumn("runs", _union_of_runs("runs")).drop("__row")


def _union_of_runs(runs: str) -> F.Column:
    """Sorted runs that overlap or touch become one."""
    kind = "array<struct<first:bigint,words:bigint>>"
    return F.expr(
        f"aggregate({runs}, cast(array() as {kind}), (a, r) -> if(size(a) > 0 and r.first <= element_at(a, -1).first + element_at(a, -1).words,"
        " concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'words', greatest(element_at(a, -1).words, r.first + r.words - element_at(a, -1).first)))), concat(a, array(r))))"
    )


def scan(docs: DataFrame, bench: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """id_col, n_words, n_hit, runs (of hit words: first, words) and the ids of the items found, of every document."""
    found = _hits(docs, bench, n, text_col, item_col, item_text, set_bytes, [id_col], False)
    return found.withColumn("n_hit", F.expr("aggregate(runs, 0L, (a, r) -> a + r.words)"))


def digest_of(items: str) -> F.Column:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def remove_documents(docs: DataFrame, bench: DataFrame, most_share: float = 0.0, text_col: str = "text", **options) -> DataFrame:
    """The documents of whose words no more than ``most_share`` are hit, with all their columns."""
    columns = docs.columns
    named = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    found = _hits(named, bench, options.get("n", N), f"__c{columns.index(text_col)}", options.get("item_col", "item_id"), options.get("item_text", "text"), options.get("set_bytes", SET_BYTES), named.columns, False)
    share = F.expr("aggregate(runs, 0L, (a, r) -> a + r.words)") / F.greatest(F.col("n_words"), F.lit(1))
    return found.where(share <= most_share).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)])


def remove_spans(docs: DataFrame, bench: DataFrame, text_col: str = "text", put: str = " ", **options) -> DataFrame:
    """All documents with all their columns; each hit run of words, with what stands between them, becomes ``put``."""
    columns = docs.columns
    named = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    text = f"__c{columns.index(text_col)}"
    found = _hits(named, bench, options.get("n", N), text, options.get("item_col", "item_id"), options.get("item_text", "text"), options.get("set_bytes", SET_BYTES), named.columns, True)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, r in zip(texts, runs, strict=True):
            if t is not None and r is not None and len(r):
                raw, at, parts = t.encode(), 0, []
                for x in r:
                    parts.append(raw[at : x["first"]].decode())
                    at = x["first"] + x["words"]
                t = put.join([*parts, raw[at:].decode()])
            out.append(t)
        return pd.Series(out, dtype=object)

    changed = F.when(F.size("runs") > 0, cut(F.col(text).cast("string"), "runs")).otherwise(F.col(text))
    return found.withColumn(text, changed).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)])
