"""Exact Jaccard join of documents' word shingles by partitioning the universe.

Two sets that link differ in few elements: of sizes a and b in at most H = (1-t)/(1+t) (a+b). Sizes are cut into
bands; within a band shingles are hashed into H + 1 segments, so two linked sets agree in one segment at least
(pigeonhole). Each set indexes, for its band and, where a partner may be there, the next one, the hash of its
subset in every segment, and for a few reserved segments also the subsets with one element deleted. Costs are
allocated set by set: segments with so few elements that they'd meet by chance are not probed, and for each of them
a well-filled reserved segment is probed with one difference allowed, which keeps the pigeonhole's sum.

Candidates that share a probed key are checked against parity bitmaps (their distance is never larger than the
sets'), then the whole sets are intersected. Keys with few members give all their pairs. A key with many gives the
pairs with its smallest member; only where verified links don't join all its members, the remaining pairs between
different components are looked at: first those of a spanning forest of the components, nearest by bitmap, and where
these turn out not to link, all of them. So no link between components is lost, and a group of copies costs a number of
pairs in proportion to its size.

Sets are compared by 64-bit hashes of shingles, and told apart by 64-bit sums of these.

Defined results: null or blank text has an empty set, linked with nothing; repeated rows and equal sets link; a text
of fewer than k words is one shingle; a null id takes no part in the minimum; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, materialize
from .components import components
from .tokens import lean

RATIO, RESERVE, THIN, FULL = 1.4, 24, 2, 4  # size bands; one reserved segment in so many; sizes not probed, and probed with one difference
FEW, BLOCK = 8, 2048
HEAVY, SHARE, SAMPLED = 4096, 1000, 64  # members of a heavy key: so many, and one in SHARE of all rows; found in one in SAMPLED sets
AT_ONCE = 1 << 18  # pairs of one key's members
TEXTS, PAIRS = 1000, 1000  # rows of texts, and of pairs of sets, that a worker gets at once
BROADCAST_IDS = 1_000_000
SEEN = 200_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A 64-bit number for each byte, A-Z as a-z; white space is 0."""
    v = _mixed(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)
    v[65:91] = v[97:123]
    v[[9, 10, 11, 12, 13, 32]] = 0
    return v


_BYTE = _byte_values()


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, and at which one each text begins (with the end).

    Words are runs of bytes between ASCII white space, A-Z in lower case; a hash is a polynomial of the bytes' numbers.
    """
    raw = [(t or "").encode() for t in texts]
    v = _BYTE[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    seen = v != 0
    first = np.flatnonzero(seen & ~np.concatenate([[False], seen[:-1]]))
    edge = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    size = np.flatnonzero(seen & ~np.concatenate([seen[1:], [False]])) - first + 1
    power = np.multiply.accumulate(np.concatenate([[1], np.full(int(size.max()) - 1, 0x2545F4914F6CDD1D)]).astype(np.uint64))
    start = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(start, size)
    total = np.add.reduceat(v[seen] * power[place], start)
    return _mixed(total + size.astype(np.uint64) * _BASE), np.searchsorted(first, edge)


def shingles_of(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles."""
    h, at = word_hashes(texts)
    part = np.full(len(h), k, np.uint64)
    for i in range(min(k, len(h))):  # a batch may have fewer words than k
        part[: len(h) - i] = _mixed(part[: len(h) - i] * _BASE + h[i:])
    out = []
    for a, b in zip(at, at[1:], strict=False):
        if b - a >= k:
            out.append(np.unique(part[a : b - k + 1]))
        elif a < b:  # fewer words than k: the whole sequence is one
            one = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                one = _mixed(one * _BASE + x)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingles(text: str | None, k: int) -> np.ndarray:
    return shingles_of([text], k)[0]


class Bands:
    """Size bands with their number of segments."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.lo, self.hi = num, den, [1], [1]

    def reach(self, total: int) -> int:
        """By how many elements two linked sets with so many together may differ."""
        return (self.den - self.num) * total // (self.den + self.num)

    def of(self, n: int) -> int:
        while self.hi[-1] < n:
            self.lo.append(self.hi[-1] + 1)
            self.hi.append(max(self.lo[-1], int(self.lo[-1] * RATIO)))
        return int(np.searchsorted(self.hi, n))

    def params(self, n: int) -> list[tuple[int, int]]:
        """(band, differences) under which a set of n elements is indexed."""
        b = self.of(n)
        self.of(self.hi[b] + 1)
        both = [b] + ([b + 1] if self.den * n >= self.num * self.lo[b + 1] else [])
        return [(x, h) for x in both if (h := self.reach(2 * self.hi[x])) > 0]

    def bitmap_bits(self, n: int) -> int:
        """Bits of the parity bitmap: a power of two, well over the differences that count."""
        return 1 << max(8, (4 * self.reach(int(2.4 * n) + 2)).bit_length())


def signatures(h: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set and their kinds: 4 for a deletion, plus 0, 1, 2 for not probed, probed exactly, with one difference."""
    keys, kinds = [], []
    for band, reach in bands.params(len(h)):
        m, salt = reach + 1, np.uint64((band + 1) * int(_BASE) % (1 << 64))
        g = _mixed(h ^ salt)
        seg = (g >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        seg = seg.astype(np.int64)
        total, size = np.zeros(m, np.uint64), np.bincount(seg, minlength=m)
        np.add.at(total, seg, g)
        place = _mixed(np.arange(m, dtype=np.uint64) + salt)
        reserved = max(1, m // RESERVE)
        kind = np.ones(m, np.uint8)
        spare = np.argsort(-size[:reserved], kind="stable")
        spare = spare[size[spare] >= FULL]
        thin = np.argsort(size, kind="stable")[: len(spare) + reserved]
        thin = [x for x in thin if size[x] <= THIN and x not in set(spare.tolist())][: len(spare)]
        kind[thin], kind[spare[: len(thin)]] = 0, 2
        keys.append(_mixed(total ^ place))
        kinds.append(kind)
        at = np.flatnonzero(seg < reserved)
        keys.append(_mixed((total[seg[at]] - g[at]) ^ place[seg[at]]))
        kinds.append(4 + kind[seg[at]])
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    return np.concatenate(keys), np.concatenate(kinds)


def bitmap(h: np.ndarray, bits: int) -> np.ndarray:
    """Parity of how many elements fall on each bit."""
    return np.packbits((np.bincount((_mixed(h ^ _BASE) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def _folded(raw: bytes, size: int) -> np.ndarray:
    """A larger bitmap folded to ``size`` bytes."""
    x = np.frombuffer(raw, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, size), 0) if len(x) > size else x


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint16)  # bits set in a byte


def _told_apart(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int | None], list[bool]]]:
    """Slices of 128 rows (second column: text), their sets, the sets' numbers (None: empty), and which of them this task has not lately seen."""
    seen: set[int] = set()
    for b in batches:
        for lo in range(0, b.num_rows, 128):
            part = b.slice(lo, 128)
            sets, nodes, new = shingles_of(part.column(1).to_pylist(), k), [], []
            for h in sets:
                f = int(_mixed(h).sum(dtype=np.uint64).astype(np.int64)) if len(h) else None
                nodes.append(f)
                new.append(f is not None and f not in seen)
                if new[-1]:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(f)
            yield part, sets, nodes, new


def _sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """id, h (hash of the text), n, node, map (where this task has not lately seen the same set), sample (keys, of one in SAMPLED of these)."""
    one_in = SAMPLED

    def run(batches):
        bands = Bands(num, den)
        for part, sets, nodes, new in _told_apart(batches, k):
            maps = [bitmap(h, bands.bitmap_bits(len(h))).tobytes() if fresh else None for h, fresh in zip(sets, new, strict=True)]
            sample = [signatures(h, bands)[0].view(np.int64) if fresh and f % one_in == 0 else None for h, f, fresh in zip(sets, nodes, new, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(h) for h in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(maps, pa.binary()), pa.array(sample, pa.list_(pa.int64()))], ["id", "h", "n", "node", "map", "sample"])

    return docs.select("id", "text", F.xxhash64("text").alias("h")).mapInArrow(lean(run), "id long, h long, n long, node long, map binary, sample array<long>")


def _entries(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """key, node, n, kind of every set, made from the texts again: stored beside the sets they would be most of the disk that is used."""

    def run(batches):
        bands = Bands(num, den)
        for _, sets, nodes, new in _told_apart(batches, k):
            kept = [(h, f) for h, f, fresh in zip(sets, nodes, new, strict=True) if fresh]
            if not kept:
                continue
            found = [signatures(h, bands) for h, _ in kept]
            size = [len(keys) for keys, _ in found]
            node, n = np.array([f for _, f in kept], np.int64), np.array([len(h) for h, _ in kept], np.int32)
            keys, kinds = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(node, size)), pa.array(np.repeat(n, size)), pa.array(kinds.astype(np.int8))], ["key", "node", "n", "kind"])

    return docs.select("id", "text").mapInArrow(lean(run), "key long, node long, n int, kind byte")


def _probed(x: str, y: str) -> F.Column:
    """Whether two entries of one key are a candidate: the larger set's allocation decides."""
    deletions = F.when(F.col(f"{x}.kind") >= 4, 1).otherwise(0) + F.when(F.col(f"{y}.kind") >= 4, 1).otherwise(0)
    x_larger = F.struct(f"{x}.n", f"{x}.node") > F.struct(f"{y}.n", f"{y}.node")
    allowed = F.when(x_larger, F.col(f"{x}.kind") % 4).otherwise(F.col(f"{y}.kind") % 4)
    return (deletions < 2) & (allowed >= 1 + deletions)


def _near(x: str, y: str, num: int, den: int) -> F.Column:
    return den * F.least(f"{x}.n", f"{y}.n") >= num * F.greatest(f"{x}.n", f"{y}.n")


def _pair(x: str, y: str) -> list[F.Column]:
    return [F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")]


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, num: int, den: int, label: str) -> DataFrame:
    """Of pairs(a, b) those that link: by bitmaps, then by whole sets."""
    bands = Bands(num, den)

    @F.pandas_udf("boolean")
    def may_link(ma: pd.Series, mb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        out = []
        for x, y, p, q in zip(ma, mb, na, nb, strict=True):
            size = min(len(x), len(y))
            out.append(int(_POP[_folded(x, size) ^ _folded(y, size)].sum()) <= bands.reach(p + q))
        return pd.Series(out, dtype=bool)

    maps = nodes.select("node", "map", "n")
    left, right = (maps.select(F.col("node").alias(c), F.col("map").alias(f"m{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    close = pairs.join(left, "a").join(right, "b").where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    close = materialize(close.where(may_link("ma", "mb", "na", "nb")).select("a", "b"), f"{label}-close")
    wanted = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "id"), "node")
    wanted = materialize(wanted.select("node", F.col("id").alias("w_id")), f"{label}-wanted")
    few = wanted.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(wanted) if few else wanted, F.col("id").eqNullSafe(F.col("w_id")))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                raw = shingles_of(part.column(1).to_pylist(), k)
                same = [bool(len(h)) and int(_mixed(h).sum(dtype=np.uint64).astype(np.int64)) == f for h, f in zip(raw, part.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h.tobytes() for h in raw], pa.binary()), pa.array(same)], ["node", "hs", "same"])

    sets = texts.select("node", "text").mapInArrow(lean(run), "node long, hs binary, same boolean").where("same").drop("same")
    with batches_of(docs.sparkSession, TEXTS):
        sets = materialize(sets if few else sets.dropDuplicates(["node"]), f"{label}-sets")
    sets = sets.groupBy("node").agg(F.first("hs").alias("hs"))

    @F.pandas_udf("boolean")
    def links(ha: pd.Series, hb: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(ha, hb, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(den * both >= num * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    with_b = close.join(sets.select(F.col("node").alias("b"), F.col("hs").alias("hb")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("hs").alias("ha")), "a")
    with batches_of(docs.sparkSession, PAIRS):
        return materialize(both.where(links("ha", "hb")).select("a", "b"), f"{label}-links")


def _apart(words: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bits in which the bitmaps of columns lo..hi of ``words`` (64 bits a row) differ from those of all columns from lo on."""
    out = np.zeros((hi - lo, words.shape[1] - lo), np.int32)
    for w in words:
        out += np.bitwise_count(w[lo:hi, None] ^ w[lo:])
    return out


def _forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, size: int) -> np.ndarray:
    """Which edges a-b between ``size`` labels make a spanning forest of the least distances (each label's nearest, merged in rounds)."""
    order = np.argsort(apart, kind="stable")
    a, b, label = a[order], b[order], np.arange(size)
    live, chosen = np.flatnonzero(a != b), [np.empty(0, np.int64)]
    while len(live):
        best = np.full(size, len(order))
        np.minimum.at(best, label[a[live]], live)
        np.minimum.at(best, label[b[live]], live)
        picks = np.unique(best[best < len(order)])
        chosen.append(picks)
        up = np.arange(size)
        for x, y in zip(label[a[picks]], label[b[picks]], strict=True):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
        live = live[label[a[live]] != label[b[live]]]
    return order[np.concatenate(chosen)]


def open_pairs(node: np.ndarray, n: np.ndarray, root: np.ndarray, kind: np.ndarray, own: np.ndarray, maps: np.ndarray, num: int, den: int, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(nodes, nodes, False) of a key's members that lie in different components and may link; pairs within a block only if there's one block.

    ``every``: all of them, as they are found; else those of a spanning forest, with whether there are more. AT_ONCE pairs
    are looked at at once, so that a large group needs no more memory than a small one.
    """
    n, gone, allow, code = n.astype(np.int64), kind >= 4, kind % 4, np.unique(root, return_inverse=True)[1]
    words, blocks = np.ascontiguousarray(np.ascontiguousarray(maps).view(np.uint64).T), own.min() != own.max()
    x, y, far, more, lo = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32), False, 0
    while lo < len(node) - 1:
        hi = min(len(node), lo + max(1, AT_ONCE // (len(node) - lo)))
        row, col = lambda v: v[lo:hi, None], lambda v: v[lo:]  # noqa: B023, E731
        ok = row(code) != col(code)
        if blocks:
            ok &= row(own) != col(own)
        ok &= np.arange(lo, len(node)) > np.arange(lo, hi)[:, None]  # each pair once
        ok &= den * np.minimum(row(n), col(n)) >= num * np.maximum(row(n), col(n))
        larger = (row(n) > col(n)) | ((row(n) == col(n)) & (row(node) > col(node)))
        ok &= ~(row(gone) & col(gone)) & (np.where(larger, row(allow), col(allow)) >= 1 + (row(gone) | col(gone)))
        if ok.any():
            apart = _apart(words, lo, hi)
            ok &= apart <= (den - num) * (row(n) + col(n)) // (den + num)
            p, q = np.nonzero(ok)
            if every and len(p):
                yield node[p + lo], node[q + lo], False
            elif len(p):
                x, y, far = np.concatenate([x, (p + lo).astype(np.int32)]), np.concatenate([y, (q + lo).astype(np.int32)]), np.concatenate([far, apart[p, q]])
                keep = _forest(code[x], code[y], far, int(code.max()) + 1)
                more |= len(keep) < len(x)
                x, y, far = x[keep], y[keep], far[keep]
        lo = hi
    if len(x):
        yield node[x], node[y], more


def _fold(maps: np.ndarray, size: int) -> np.ndarray:
    """Rows of larger bitmaps folded to ``size`` bytes."""
    return maps if maps.shape[1] == size else np.bitwise_xor.reduce(maps.reshape(len(maps), -1, size), 1)


def _cut(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bitmaps that begin at bytes ``at`` (with the end) of ``raw``, folded to the smallest one's size."""
    sizes = np.diff(at)
    least = int(sizes.min())
    out = np.empty((len(sizes), least), np.uint8)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        same = raw[at[0] : at[-1]].reshape(-1, size) if len(rows) == len(sizes) else raw[at[rows][:, None] + np.arange(size)]
        out[rows] = _fold(same, least)
    return out


def key_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each run of rows alike in the first three (key, i, j); the last column, bitmaps, as a matrix."""
    kept: list[list[np.ndarray]] = []
    last = None

    def whole() -> list[np.ndarray]:
        *cols, maps = zip(*kept, strict=True)
        least = min(m.shape[1] for m in maps)
        return [*(np.concatenate(c) for c in cols), np.concatenate([_fold(m, least) for m in maps])] if len(kept) > 1 else kept[0]

    for b in batches:
        if not b.num_rows:
            continue
        *cols, maps = b.columns
        cols = [c.to_numpy(zero_copy_only=False) for c in cols]
        maps = maps.cast(pa.large_binary())
        offsets = np.frombuffer(maps.buffers()[1], np.int64)[maps.offset : maps.offset + len(maps) + 1]
        raw = np.frombuffer(maps.buffers()[2], np.uint8)
        now = np.stack(cols[:3])
        at = [0, *(np.flatnonzero((now[:, 1:] != now[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(at, at[1:], strict=False):
            if kept and (lo or (now[:, 0] != last).any()):
                yield whole()
                kept = []
            kept.append([*(c[lo:hi] for c in cols), _cut(raw, offsets[lo : hi + 1])])
        last = now[:, -1]
    if kept:
        yield whole()


def _remaining(many: DataFrame, nodes: DataFrame, roots: DataFrame, num: int, den: int, every: bool) -> DataFrame:
    """(a, b, more): pairs of many-member keys that lie in different components and may link by their bitmaps.

    ``every``: all of them; else those of a spanning forest of the components, nearest by bitmap, and a row (key, 0, true)
    for a key that has more. Keys with more than BLOCK members are dealt out in pairs of blocks.
    """
    rooted = many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("c")).where("r0 != r1").select("key", "c")
    rows = rooted.join(open_, "key").join(nodes.select("node", "map"), "node")
    cut = F.ceil(F.col("c") / BLOCK)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), cut)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "root", F.col("kind").cast("int").alias("kind"), "map")

    def run(batches):
        fields = ["a", "b", "more"]
        for key, i, j, own, node, n, root, kind, maps in key_groups(batches):
            if i[0] != j[0] and own.min() == own.max():
                continue  # the other block is empty
            for x, y, more in open_pairs(node, n, root, kind, own, maps, num, den, every):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.zeros(len(x), bool))], fields)
                if more:
                    yield pa.RecordBatch.from_arrays([pa.array(key[:1]), pa.array(np.zeros(1, np.int64)), pa.array([True])], fields)

    alike = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")  # one task has all of a group, and groups follow each other
    return alike.mapInArrow(lean(run), "a long, b long, more boolean").distinct()


def _heavy_keys(sets: DataFrame) -> DataFrame | None:
    """Keys with about HEAVY members or more and one in SHARE of all rows, told from a sample of sets; None if there are none.

    Their number is at most SHARE times the keys of a set. A key that the sample misses is only slower.
    """
    least = max(HEAVY, sets.count() // SHARE) / SAMPLED
    found = sets.where("sample is not null").select("node", F.explode("sample").alias("key")).groupBy("key").agg(F.countDistinct("node").alias("c")).where(F.col("c") >= least).select("key")
    found = materialize(found, "jac-heavy")
    return found if found.limit(1).count() else None


def _counted(entries: DataFrame, heavy: bool) -> DataFrame:
    """Distinct entries of keys with two members or more, with how many there are and the smallest member that isn't a deletion."""
    shared = entries.dropDuplicates(["key", "node", "kind"])
    counts = shared.groupBy("key").agg(F.count("*").alias("c"), F.min(F.when(F.col("kind") < 4, F.struct("node", "n", "kind"))).alias("head")).where("c > 1")
    return shared.join(F.broadcast(counts) if heavy else counts, "key")  # of heavy keys there are few, and their rows stay where they are


def join_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", firsts: bool = False) -> DataFrame:
    """id_col, n_shingles, component_id of every row: documents link when den * intersection >= num * union.

    ``firsts``: also __hash (xxhash64 of the text) and __first, whether the row is its component's one with the smallest
    (id, hash), null ids last; rows alike in both are all first, and so is every row with an empty set.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with batches_of(docs.sparkSession, TEXTS):
        sets = materialize(_sets(rows, k, num, den), "jac-sets")
    place = F.struct(F.col("id").isNull().alias("z"), "id", "h")
    owner = sets.where("node is not null").groupBy("node").agg(F.min(place).alias("least"))
    nodes = sets.where("map is not null").groupBy("node").agg(F.first("n").alias("n"), F.min("id").alias("id"), F.first("map").alias("map"))
    entries = _entries(rows, k, num, den)
    # Keys of one entry end here; so the shuffle of all entries is the only one. Heavy keys (a bounded list) need no window.
    heavy = _heavy_keys(sets)
    light = entries.join(F.broadcast(heavy), "key", "left_anti") if heavy else entries
    alike = "partition by key order by node"
    shared = light.selectExpr("*", f"lag(node) over ({alike}) as p", f"lead(node) over ({alike}) as q").where("p is not null or q is not null").select("key", "node", "n", "kind")
    with batches_of(docs.sparkSession, TEXTS):
        shared = _counted(materialize(shared, "jac-shared"), False)
        if heavy:
            shared = shared.unionByName(_counted(materialize(entries.join(F.broadcast(heavy), "key", "left_semi"), "jac-many"), True))
    shared = materialize(shared, "jac-counted")
    few, many = shared.where(F.col("c") <= FEW), shared.where(F.col("c") > FEW)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node"))).where(_probed("x", "y") & _near("x", "y", num, den)).select(*_pair("x", "y"))
    stars = many.where("head is not null and node != head.node").select(F.struct("head.*").alias("x"), F.struct("node", "n", "kind").alias("y")).where(_probed("x", "y") & _near("x", "y", num, den)).select(*_pair("x", "y"))
    tried = materialize(pairs.unionByName(stars).distinct(), "jac-pairs")
    links = _verified(tried, nodes, rows, k, num, den, "jac0")
    roots = components(links)
    for turn in (1, 2) if many.limit(1).count() else ():
        found = materialize(_remaining(many.select("key", "node", "n", "kind"), nodes, roots, num, den, every=turn == 2), f"jac-pairs{turn}")
        new = materialize(found.where("not more").select("a", "b").join(tried, ["a", "b"], "left_anti"), f"jac-new{turn}")
        if new.limit(1).count():
            links = links.unionByName(_verified(new, nodes, rows, k, num, den, f"jac{turn}"))
            tried = tried.unionByName(new)
            roots = components(links)
        many = many.join(found.where("more").select(F.col("a").alias("key")).distinct(), "key", "left_semi")
        if not many.limit(1).count():
            break
    rooted = owner.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("head"))
    labels = rooted.join(lowest, "root").select("node", "head")
    out = sets.select("id", "h", "n", "node").join(labels, "node", "left")
    own = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("head.id", "id").alias("component_id")]
    return out.select(*own, F.col("h").alias("__hash"), (F.col("head").isNull() | (F.col("head") == place)).alias("__first")) if firsts else out.select(*own)
