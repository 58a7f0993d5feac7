"""Scores of texts under an n-gram model by deleted interpolation.

P_k(w | context) = L_k[b] c(context, w) / c(context) + (1 - L_k[b]) P_k-1(w | shorter context), for k from 2 to ``order``,
P_1(w) = U c(w) / N + (1 - U) / (V + 1), where b is the bucket of the context's frequency (powers of two). The weights
L_k and U are learned by expectation-maximisation on a tenth of the training documents with the counts of the others;
then the counts of all training documents are used. A text begins in a start context and ends with an end token; its
first token has no context of two words, so that there P_2 stands for the longer ones.

Words are 64-bit hashes, and so are n-grams. A task's texts of one part are packed into batches of about BATCH_TOKENS
tokens. Each batch names every one of its words and n-grams once, with how often it has it (so no key is hot), sorted
and compressed, to the slots that the keys are dealt to by range; a slot sums up and answers each batch with the totals
of just the keys that it named, in their order. So a key goes through one shuffle and a number comes back, no table of
words or n-grams is broadcast or collected, and every occurrence in every text is counted and scored exactly. There are
never more rows than keys that batches name: what is shuffled stays in proportion to the input.

Held-out statistics for the weights are gathered in cells of (bucket, quarter octaves of both probabilities) with their
sums, a table whose size doesn't grow with the data.

Defined results: null or blank text is its end token alone; without training rows every base probability is that of an
unseen token and score equals the model's uniform part; repeated rows each get their row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .jaccard import _BASE, _mixed, word_hashes
from .tokens import lean, text_slices

ORDER, BATCH_TOKENS, SLOT_TOKENS, SLICE_BYTES = 2, 1_000_000, 1_000_000, 2 << 20
START, END = np.uint64(1), np.uint64(2)  # pseudo words
EST, HELD, TEST = 0, 1, 2
BUCKETS = 24
EXACT = 1024  # word counts up to so many stand for themselves in the unigram statistics, larger ones are cut to 10 bits


def _squeezed(x: np.ndarray) -> bytes:
    """64-bit numbers with their like bytes side by side, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _opened(raw: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs; 0 is none."""
    keys = np.sort(keys)
    keys = keys[np.searchsorted(keys, 1) :]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def bucket_of(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, BUCKETS - 1), 0)


def cells(context: np.ndarray, both: np.ndarray, below: np.ndarray) -> pd.DataFrame:
    """Held-out occurrences by bucket and quarter octaves of the estimate and of what is mixed with it, with their sums."""
    ok = context > 0
    context, both, below = context[ok], both[ok], below[ok]
    high = np.where(both > 0, np.log2(np.maximum(both, 1) / context), -99.0)
    low = np.log2(below)
    key = (bucket_of(context) * 1024 + np.floor(-high * 4).astype(np.int64).clip(0, 1023)) * 1024 + np.floor(-low * 4).astype(np.int64).clip(0, 1023)
    k, m, s2, s1 = _summed(key, np.ones(len(key)), high, low)
    return pd.DataFrame({"cell": k, "n": m, "s2": s2, "s1": s1})


def learn(table: pd.DataFrame) -> np.ndarray:
    """Weights of the buckets by expectation-maximisation; an empty bucket takes that of the next lower one."""
    out, b = np.zeros(BUCKETS), table.cell.to_numpy() >> 20
    p2, p1 = (np.exp2(table[c].to_numpy() / table.n.to_numpy()) for c in ("s2", "s1"))
    p2 = np.where(table.s2.to_numpy() / table.n.to_numpy() < -98, 0.0, p2)
    for k in range(1, BUCKETS):
        x = b == k
        w, n = (0.5 if k == 1 else out[k - 1]), table.n.to_numpy()[x]
        for _ in range(60 if n.sum() else 0):
            w = float((n * w * p2[x] / (w * p2[x] + (1 - w) * p1[x])).sum() / n.sum())
        out[k] = min(max(w, 1e-6), 1 - 1e-4)
    return out


def learn_unigram(counts: pd.DataFrame, n_est: int, v_est: int) -> float:
    """Weight of the unigram counts beside the uniform part, from counts(est, held): held tokens of words seen ``est`` times."""
    n, u = counts.held.sum(), 0.9
    p = counts.est.to_numpy() / max(n_est, 1)
    for _ in range(60 if n else 0):
        u = float((counts.held * u * p / (u * p + (1 - u) / (v_est + 1))).sum() / n)
    return min(max(u, 1e-4), 1 - 1e-4)


def pack(rows: DataFrame) -> DataFrame:
    """Batches of rows(id, part, text): their documents, their distinct words, and the texts as places in these."""

    def run(batches):
        task, turn, names = TaskContext.get().partitionId(), 0, ["batch", "part", "n", "docs", "words", "places"]
        kept: dict[int, list] = {EST: [], HELD: [], TEST: []}

        def flush(p):
            nonlocal turn
            ids, h, n = pa.concat_arrays([x[0] for x in kept[p]]), *(np.concatenate([x[i] for x in kept[p]]) for i in (1, 2))
            words, places = np.unique(h, return_inverse=True)
            sink = pa.BufferOutputStream()
            docs = pa.table({"id": ids, "n": pa.array(n)})
            with pa.ipc.new_stream(sink, docs.schema) as w:
                w.write_table(docs)
            turn, kept[p] = turn + 1, []
            row = [task << 32 | turn], [p], [len(h)], [sink.getvalue().to_pybytes()], [_squeezed(np.diff(words, prepend=np.uint64(0)))], [_squeezed(places)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

        for b in batches:
            for piece in text_slices(b, 2, SLICE_BYTES):
                words, edge = word_hashes(piece.column(2).to_pylist())
                h, n, of = np.insert(words, edge[1:], END), np.diff(edge) + 1, piece.column(1).to_numpy(zero_copy_only=False)
                each = np.repeat(of, n)
                for p, parts in kept.items():
                    x = of == p
                    if x.any():
                        parts.append((piece.column(0).filter(pa.array(x)), h[each == p], n[x]))
                        if sum(len(y[1]) for y in parts) >= BATCH_TOKENS:
                            yield flush(p)
        for p, parts in kept.items():
            if parts:
                yield flush(p)

    return rows.select("id", "part", "text").mapInArrow(lean(run), "batch long, part int, n long, docs binary, words binary, places binary")


class Batch:
    """A packed batch: its documents, and for each n-gram length the key that ends at each token (0: none)."""

    def __init__(self, docs: bytes, words: bytes, places: bytes, order: int):
        self.docs = pa.ipc.open_stream(docs).read_all()
        self.n = self.docs.column("n").to_numpy()
        self.first = np.cumsum(self.n) - self.n
        h = np.cumsum(_opened(words), dtype=np.uint64)[_opened(places).astype(np.int64)]
        self.keys = [h]
        for k in range(2, order + 1):
            before = np.empty_like(h)
            before[1:], before[self.first] = self.keys[-1][:-1], START if k == 2 else 0
            self.keys.append(np.where(before == 0, np.uint64(0), _mixed(before * _BASE + h) | np.uint64(1)))

    def counts(self, answers: list[np.ndarray]) -> list[np.ndarray]:
        """For each length how often each token's n-gram occurs, of the totals of the distinct keys."""
        out = []
        for keys, total in zip(self.keys, answers, strict=True):
            distinct, _ = _distinct(keys)
            at = np.minimum(np.searchsorted(distinct, keys), max(len(distinct) - 1, 0))
            out.append(np.where(keys == 0, 0, total[at]) if len(total) else np.zeros(len(keys), np.int64))
        return out

    def contexts(self, counts: list[np.ndarray]) -> list[np.ndarray]:
        """For each length from 2 on how often each token's context occurs; the start as often as the end."""
        out = []
        for k, c in enumerate(counts[:-1]):
            x = np.empty_like(c)
            x[1:], x[self.first] = c[:-1], c[self.first + self.n - 1] if k == 0 else 0
            out.append(x)
        return out


def _ask(batches: DataFrame, slots: int, order: int) -> DataFrame:
    """Each batch's distinct keys with their counts (none for TEST batches) by slot and length."""

    def run(parts):
        for b in parts:
            for batch, part, docs, words, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = []
                for k, keys in enumerate(Batch(docs, words, places, order).keys):
                    keys, n = _distinct(keys)
                    slot = ((keys >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
                    edge = np.flatnonzero(np.diff(slot, prepend=-1, append=-1))
                    for lo, hi in zip(edge, edge[1:], strict=False):
                        out.append((int(slot[lo]), k, batch, part, _squeezed(np.diff(keys[lo:hi], prepend=np.uint64(0))), b"" if part == TEST else _squeezed(n[lo:hi])))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["slot", "k", "batch", "part", "keys", "n"])

    return batches.select("batch", "part", "docs", "words", "places").mapInArrow(lean(run), "slot long, k int, batch long, part int, keys binary, n binary")


ANSWER = pa.schema([("slot", pa.int64()), ("k", pa.int32()), ("batch", pa.int64()), ("part", pa.int32()), ("est", pa.binary()), ("every", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("d", pa.int64())])
TOTALS, WORDS = -1, -2  # rows for the corpus instead of a batch: a to d are N and V of EST and of all; words seen a times are b of HELD


def _answer(asked: pa.Table) -> pa.Table:
    """One slot's totals for each batch that asks, and what its words add to the corpus' statistics."""
    out = []
    slot, lengths = asked.column("slot")[0].as_py(), asked.column("k").to_numpy()
    for k in np.unique(lengths):
        rows = asked.filter(pa.array(lengths == k)).sort_by("batch")
        keys = [np.cumsum(_opened(x.as_py()), dtype=np.uint64) for x in rows.column("keys")]
        part, batch = rows.column("part").to_pylist(), rows.column("batch").to_pylist()
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        size = int(at.max()) + 1
        total = {EST: np.zeros(size), HELD: np.zeros(size)}
        cut = np.split(at, np.cumsum([len(x) for x in keys])[:-1])
        for p, where, n in zip(part, cut, rows.column("n"), strict=True):
            if p != TEST:
                total[p][where] += _opened(n.as_py())  # a batch names a key once
        est, held = (total[p].astype(np.int64) for p in (EST, HELD))
        for p, b, where in zip(part, batch, cut, strict=True):
            out.append((slot, int(k), b, p, _squeezed(est[where]) if p == HELD else b"", _squeezed((est + held)[where]), 0, 0, 0, 0))
        if k == 0:
            out.append((slot, TOTALS, 0, 0, b"", b"", int(est.sum()), int((est > 0).sum()), int((est + held).sum()), int((est + held > 0).sum())))
            seen = np.where(est > EXACT, est >> (shift := np.maximum(bucket_of(est) - 10, 0)) << shift, est)
            for x, n in zip(*_summed(seen, held), strict=True):
                if n:
                    out.append((slot, WORDS, 0, 0, b"", b"", int(x), int(n), 0, 0))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ANSWER, strict=True)], schema=ANSWER)


def score(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text", order: int | None = None) -> DataFrame:
    """id_col, part, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``part``: EST and HELD rows are learned from, TEST rows aren't.
    """
    order, kind_of = order or ORDER, dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), part.cast("int").alias("part"), F.col(text_col).cast("string").alias("text"))
    batches = materialize(pack(rows), "lm-batches")
    tokens = batches.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    asked = _ask(batches, max(1, math.ceil(tokens / SLOT_TOKENS)), order)
    answers = materialize(asked.groupBy("slot").applyInArrow(_answer, "slot long, k int, batch long, part int, est binary, every binary, a long, b long, c long, d long"), "lm-answers")
    n_est, v_est, n_all, v_all = answers.where(F.col("k") == TOTALS).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in "abcd"]).first()
    unigram = learn_unigram(answers.where(F.col("k") == WORDS).groupBy(F.col("a").alias("est")).agg(F.sum("b").alias("held")).orderBy("est").toPandas(), n_est, v_est)
    weights: list[np.ndarray] = []

    def mixed(b: Batch, answers: pa.Table, column: str, n: int, v: int) -> tuple[list, list, np.ndarray]:
        """Counts, counts of contexts, and the probabilities that the weights found so far give each token."""
        answers = answers.sort_by([("k", "ascending"), ("slot", "ascending")])
        of = answers.column("k").to_numpy()
        totals = [np.concatenate([_opened(x.as_py()) for x in answers.filter(pa.array(of == k)).column(column)] or [np.empty(0, np.uint64)]).astype(np.int64) for k in range(order)]
        counts = b.counts(totals)
        contexts = b.contexts(counts)
        p = unigram * counts[0] / max(n, 1) + (1 - unigram) / (v + 1)
        for w, both, context in zip(weights, counts[1:], contexts, strict=False):
            share = w[bucket_of(context)]
            p = share * both / np.maximum(context, 1) + (1 - share) * p
        return counts, contexts, p

    def together(of: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
        return of.groupBy("batch").cogroup(answers.where("k >= 0").select("batch", "k", "slot", "est", "every").groupBy("batch")).applyInArrow(run, schema)

    def opened(left: pa.Table) -> Batch:
        return Batch(*(left.column(c)[0].as_py() for c in ("docs", "words", "places")), order)

    held, held_answers = (x.where(F.col("part") == HELD) for x in (batches, answers))
    for k in range(order - 1):

        def held_cells(left: pa.Table, right: pa.Table) -> pa.Table:
            counts, contexts, p = mixed(opened(left), right, "est", n_est, v_est)
            return pa.Table.from_pandas(cells(contexts[k], counts[k + 1], p), preserve_index=False)  # noqa: B023

        found = together(held, held_answers, held_cells, "cell long, n double, s2 double, s1 double")
        weights.append(learn(found.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "s2", "s1")]).orderBy("cell").toPandas()))

    names = [id_col, "part", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        b = opened(left)
        counts, _, p = mixed(b, right, "every", n_all, v_all)
        base = np.log10((counts[0] + 0.1) / (n_all + 0.1 * (v_all + 1)))
        sums = [np.add.reduceat(x, b.first) for x in ((counts[0] > 0).astype(np.int64), base, np.log10(p))]
        same = [pa.array(np.full(len(b.n), x, np.int64)) for x in (left.column("part")[0].as_py(), n_all)]
        return pa.Table.from_arrays([b.docs.column("id"), same[0], pa.array(b.n), pa.array(sums[0]), same[1], pa.array(sums[1]), pa.array(sums[2])], names)

    return together(batches, answers, scores, f"`{id_col}` {kind_of}, part long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
