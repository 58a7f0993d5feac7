"""Prefix trie of conversations: balanced parentheses a shard, shared spines merged.

A turn is a digest of its role and text and its text's bytes; a conversation is the string of its digests. Conversations
are sorted by that string over range partitions, so copies of one conversation, or a first turn that a third of them
share, are dealt to many shards. A shard writes its trie as balanced parentheses, an opening one a node in preorder.
The excess (opened less closed) is kept with its smallest value a block of BLOCK bits and a tree of block minima over
these: ``findclose`` delimits a node's subtree, ranks of "()" count its leaves, cumulative arrays in preorder give its
savings, and the sequences between its two parentheses are its members.

Only nodes on the path of a shard's first or last conversation, its spines, can be in other shards, too. They are merged by
the digest of their path: members add up, what several shards counted is taken off along the spines, and ids of members
that end in a node are hashed in the order of shards.

Defined results: rows without a conv_id take no part; turns are ordered by turn, null first, then by the digest of role and
text; null roles and texts are empty; repeated rows are turns of their own; an empty table gives no node, not even the
root; other columns are ignored. Two different turns, or paths, of one md5 digest would be taken for one. ``rebuilt``
takes % as SQL does, with the sign of the id. A conversation's turns (24 bytes each) are in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize
from .tokens import lean

BLOCK, WIDE, SHARD_TURNS, SHARD_CONVS = 64, 16, 400_000, 50_000
FEW = 200_000  # spine nodes up to which their table is broadcast; each takes about 50 bytes
NONE = hashlib.sha256(b"").hexdigest()


class Parens:
    """Balanced parentheses (True opens) with range min-max blocks over the excess."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.n = bits, len(bits)
        self.rank = np.cumsum(bits)  # opened up to and with each place
        blocks = -(-self.n // BLOCK)
        excess = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        excess[: self.n] = 2 * self.rank - np.arange(1, self.n + 1)
        self.excess = excess.reshape(blocks, BLOCK)
        self.least = [self.excess.min(1)]
        while len(self.least[-1]) > 1:
            x = self.least[-1]
            self.least.append(np.minimum(x[::2], np.append(x[1::2], np.iinfo(np.int64).max)[: len(x[::2])]))
        leaf = bits & np.append(~bits[1:], False)
        self.leaves = np.cumsum(leaf)

    def _in_block(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place of each block beyond offset ``after`` whose excess is at most the target; -1 if none."""
        out = np.empty(len(block), np.int64)
        for lo in range(0, len(block), 8192):
            s = slice(lo, lo + 8192)
            ok = (self.excess[block[s]] <= target[s, None]) & (np.arange(BLOCK) > after[s, None])
            out[s] = np.where(ok.any(1), block[s] * BLOCK + ok.argmax(1), -1)
        return out

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        target = self.excess.reshape(-1)[at] - 1
        out = self._in_block(at // BLOCK, at % BLOCK, target)
        left = np.flatnonzero(out < 0)
        node, level, t = at[left] // BLOCK, np.zeros(len(left), np.int64), target[left]
        up = np.ones(len(left), bool)
        while up.any():  # climb until a block to the right holds the target
            for lv in np.unique(level[up]).tolist():
                k = np.flatnonzero(up & (level == lv))
                x = self.least[lv]
                right = node[k] + 1
                found = (node[k] % 2 == 0) & (right < len(x)) & (x[np.minimum(right, len(x) - 1)] <= t[k])
                node[k] = np.where(found, right, node[k] // 2)
                level[k] += ~found
                up[k[found]] = False
        while (level > 0).any():  # and down to the first that does
            for lv in np.unique(level[level > 0]).tolist():
                k = np.flatnonzero(level == lv)
                node[k] = 2 * node[k] + (self.least[lv - 1][2 * node[k]] > t[k])
                level[k] -= 1
        out[left] = self._in_block(node, np.full(len(left), -1), t)
        return out


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest of x[lo:hi] for each pair."""
    table = [x]
    while 2 ** len(table) <= len(x):
        h = 2 ** (len(table) - 1)
        table.append(np.minimum(table[-1][:-h], table[-1][h:]))
    out = np.empty(len(lo), x.dtype)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    for v in np.unique(level).tolist():
        k = level == v
        out[k] = np.minimum(table[v][lo[k]], table[v][hi[k] - 2**v])
    return out


def shard_nodes(seqs: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray | list]:
    """The nodes in preorder of sorted sequences of WIDE-byte digests; ``sizes``: the text bytes of all their turns in a row."""
    n = len(seqs)
    length = np.array([len(s) // WIDE for s in seqs])
    shared = np.zeros(n, np.int64)
    for i in range(1, n):
        a, b = seqs[i - 1], seqs[i]
        if a == b:
            shared[i] = length[i]
            continue
        d, most = 0, min(len(a), len(b))
        while d < most and a[d : d + WIDE] == b[d : d + WIDE]:
            d += WIDE
        shared[i] = d // WIDE
    opens, closes = length - shared, np.zeros(n, np.int64)
    closes[1:] = length[:-1] - shared[1:]
    runs = np.empty(2 * n + 2, np.int64)
    runs[0], runs[1:-1:2], runs[2:-1:2], runs[-1] = 1, closes, opens, length[-1] + 1
    bits = np.repeat(np.append(np.tile([True, False], n), [True, False]), runs)
    tree = Parens(bits)
    at = np.flatnonzero(bits)
    close = tree.findclose(at)
    owner = np.concatenate([[0], np.repeat(np.arange(n), opens)])
    first = np.cumsum(opens) - opens + 1  # preorder number of the first node that each sequence opens
    depth = np.arange(len(at)) - first[owner] + shared[owner] + 1
    depth[0] = 0
    begin = np.cumsum(runs)[1::2][:n]  # where each sequence begins to open
    after = np.searchsorted(begin, close, "right")  # the first sequence beyond the node
    members = after - owner
    own = np.zeros(len(at), np.int64)
    starts = np.cumsum(length) - length
    own[1:] = sizes[starts[owner[1:]] + depth[1:] - 1]
    saved = np.append(0, np.cumsum((members - 1) * own))
    rank = tree.rank
    parent, path = np.full(len(at), -1), [0]
    for i in range(n):
        del path[shared[i] + 1 :]
        new = range(int(first[i]), int(first[i] + opens[i]))
        if opens[i]:
            parent[first[i]] = path[-1]
            parent[first[i] + 1 : first[i] + opens[i]] = np.arange(first[i], first[i] + opens[i] - 1)
            path += new
    same = np.zeros(n + 1, bool)
    same[1:n] = (shared[1:] == length[1:]) & (length[1:] == length[:-1])
    ends_at = np.flatnonzero(~same)
    run_end = ends_at[np.searchsorted(ends_at, np.arange(n), "right")]
    enders = np.where(depth == length[owner], run_end[owner] - owner, 0)
    return {
        "depth": depth, "parent": parent, "owner": owner, "n": members, "least": _range_min(ids, owner, after), "bytes": own, "children": np.bincount(parent[1:], minlength=len(at)),
        "leaf": tree.leaves[at] - np.append(0, tree.leaves)[at], "leaves": tree.leaves[close] - np.append(0, tree.leaves)[at], "saved": saved[rank[close]] - saved[rank[at] - 1], "enders": enders, "last": np.array(path), "first": np.arange(length[0] + 1),
    }


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SHARD = f"{_NODE}, node string, parent string, shard int, side int, counted boolean, leaf long, own long, ends string"


def _shard(batches):
    """Final nodes, and those on the spines with what has to be merged, of one sorted partition."""
    seqs, ids, sizes, number = [], [], [], 0
    for b in batches:
        if b.num_rows:
            seqs += b.column(0).to_pylist()
            ids.append(b.column(1).to_numpy(zero_copy_only=False))
            sizes.append(b.column(2).flatten().to_numpy(zero_copy_only=False))
            number = b.column(3)[0].as_py()
    if not seqs:
        return
    ids = np.concatenate(ids)
    t = shard_nodes(seqs, ids, np.concatenate(sizes))
    nodes = len(t["depth"])
    on_first, on_last = np.zeros(nodes, bool), np.zeros(nodes, bool)
    on_first[t["first"]] = on_last[t["last"]] = True
    spine = on_first | on_last
    name = lambda i: hashlib.md5(seqs[t["owner"][i]][: WIDE * int(t["depth"][i])]).hexdigest()
    names = {i: name(i) for i in np.flatnonzero(spine).tolist()}
    text = lambda i: ",".join(map(str, ids[t["owner"][i] : t["owner"][i] + t["enders"][i]].tolist()))

    def rows(which: np.ndarray, side: int | None, counted: np.ndarray) -> pa.RecordBatch:
        k = len(which)
        col = lambda x: pa.array(x[which], pa.int64())
        up = t["parent"][which]
        known = np.array([p >= 0 and not spine[p] for p in up], bool)
        if side is None:
            sha = [hashlib.sha256(text(i).encode()).hexdigest() if t["enders"][i] else NONE for i in which.tolist()]
            own_name, ends = [None] * k, [None] * k
        else:
            sha, own_name = [None] * k, [names[i] for i in which.tolist()]
            ends = [text(i) if c and t["enders"][i] else None for i, c in zip(which.tolist(), counted.tolist(), strict=True)]
        parents = [names[p] if p >= 0 and spine[p] else None for p in up.tolist()]
        return pa.RecordBatch.from_arrays(
            [
                col(t["least"]), col(t["depth"]), pa.array(np.where(known, t["least"][up], 0), pa.int64(), mask=~known), col(t["n"]), col(t["children"]), col(t["leaves"]), col(t["saved"]), pa.array(sha, pa.string()), pa.array(own_name, pa.string()), pa.array(parents, pa.string()),
                pa.array([number] * k, pa.int32()), pa.array([side] * k, pa.int32()), pa.array(counted, pa.bool_()), col(t["leaf"]), col(t["bytes"]), pa.array(ends, pa.string()),
            ],
            [f.split()[0] for f in _SHARD.split(", ")],
        )

    final = np.flatnonzero(~spine)
    for lo in range(0, len(final), 65536):
        part = final[lo : lo + 65536]
        yield rows(part, None, np.ones(len(part), bool))
    yield rows(t["first"], 0, np.ones(len(t["first"]), bool))
    yield rows(t["last"], 1, ~on_first[t["last"]])


def _hashed(batches):
    """SHA-256 of each node's pieces, in order, joined by commas; a node's rows follow each other."""
    now, h = None, None
    for b in batches:
        done, out = [], []
        for node, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    done.append(now)
                    out.append(h.hexdigest())
                now, h = node, hashlib.sha256(piece.encode())
            else:
                h.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array(out, pa.string())], ["node", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([h.hexdigest()])], ["node", "sha"])


def turns_by_conversation(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and its turns in order, each a digest of role and text, and its text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.struct(F.col(turn_col).isNotNull().alias("told"), F.col(turn_col).alias("turn"), digest.alias("key"), F.octet_length(text).cast("long").alias("own"))
    got = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return got.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["own"].alias("own"))).alias("turns"))


def rebuilt(convs: DataFrame, heads: int = 9, group: int = 5) -> DataFrame:
    """Every conversation with its first h turns taken from the first of its group, h = crc32 of its id modulo ``heads``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("g"), F.slice("turns", 1, heads - 1).alias("head"))
    own = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("g"), h.alias("h"), "turns")
    both = own.join(base, "g", "left")
    none = F.slice("turns", 1, 0)
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).otherwise(none)
    return both.select("conv_id", F.concat(head, rest).alias("turns"))


def trie(convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``convs``: conv_id, unique, and turns as ``turns_by_conversation`` gives them.
    """
    spark = convs.sparkSession
    flat = convs.select(F.unhex(F.array_join(F.col("turns.key"), "")).alias("seq"), "conv_id", F.col("turns.own").alias("sizes"))
    flat = materialize(flat, "sequences")
    size = flat.agg(F.count("*").alias("n"), F.sum(F.size("sizes")).alias("t")).first()
    if not size.n:
        return spark.createDataFrame([], _NODE)
    shards = max(-(-size.n // SHARD_CONVS), -(-size.t // SHARD_TURNS), spark.sparkContext.defaultParallelism)
    ordered = flat.repartitionByRange(shards, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").withColumn("shard", F.spark_partition_id())
    found = materialize(ordered.mapInArrow(lean(_shard), _SHARD), "shards")
    return _merged(found)


def _merged(found: DataFrame) -> DataFrame:
    spine = found.where(F.col("node").isNotNull())
    home = F.min(F.when(F.col("counted"), F.struct("shard", "side"))).alias("home")
    of = lambda c: F.when(F.col("counted"), F.col(c))
    sums = [F.count(of("n_convs")).alias("shards"), *[F.sum(of(c)).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.min(of("conv_id")).alias("conv_id")]
    each = materialize(spine.groupBy("node").agg(*sums, home, F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("own").alias("own"), F.sum(of("leaf")).alias("leaf"), F.min(of("leaf")).alias("childless")), "spine")
    # What more than one shard counted: bytes that are saved, leaves that have children elsewhere or are leaves elsewhere, too.
    extra = each.select(F.col("node").alias("of"), "home", ((F.col("shards") - 1) * F.col("own")).alias("more"), (F.col("leaf") - F.col("childless")).alias("fewer"))
    along = spine.select("node", "shard", "side", "depth").join(extra, F.col("node") == F.col("of"))
    here = F.col("home") == F.struct("shard", "side")
    below = W.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    run = along.select("node", *[F.sum(F.when(here, F.col(c)).otherwise(0)).over(below).alias(c) for c in ("more", "fewer")])
    fixed = run.groupBy("node").agg(F.sum("more").alias("more"), F.sum("fewer").alias("fewer"))
    twice = each.where(F.col("parent").isNotNull() & (F.col("shards") > 1)).groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("shards") - 1).alias("twice"))
    pieces = spine.where(F.col("ends").isNotNull()).select("node", "shard", "ends")
    ends = pieces.repartition("node").sortWithinPartitions("node", "shard").mapInArrow(lean(_hashed), "node string, sha string")
    ups = each.select(F.col("node").alias("up"), F.col("conv_id").alias("up_conv"))
    if each.count() <= FEW:  # else many children of one spine node, as of the root, would meet in one task
        ups = F.broadcast(ups)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    shared = each.join(fixed, "node", "left").join(twice, "node", "left").join(ends, "node", "left").join(ups, F.col("parent") == F.col("up"), "left")
    shared = shared.select(
        "conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", (F.col("n_children") - zero("twice")).alias("n_children"), (F.col("n_leaves") - zero("fewer")).alias("n_leaves"),
        (F.col("saved_tokens") + zero("more")).alias("saved_tokens"), F.coalesce("sha", F.lit(NONE)).alias("ends_sha256"),
    )
    final = found.where(F.col("node").isNull()).join(ups, F.col("parent") == F.col("up"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up_conv"))
    return final.select(*shared.columns).unionByName(shared)
