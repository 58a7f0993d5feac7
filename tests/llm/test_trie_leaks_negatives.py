"""Prefix trie, decontamination and hard negatives against brute force, on odd, empty, hot and clashing tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftkit.llm import decontaminate, hard_negatives, prefix_trie

SF = "/root/testdata/sf0.001"

# ---- prefix trie -----------------------------------------------------------------------------------------------------


def trie_by_hand(rows):
    """Nodes of rows (conv_id, turn, role, text) by dictionaries."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, key), (role, text)))
    convs = {c: [t for _, t in sorted(x, key=lambda y: y[0])] for c, x in convs.items()}
    members = defaultdict(list)
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(convs.get(c - int(math.fmod(c, 5)), [])[:h] + convs[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append((c, len(seq)))
    kids = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        own = (len(m) - 1) * len(s[-1][1].encode()) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += own
    low = {s: min(c for c, _ in m) for s, m in members.items()}
    return sorted((low[s], len(s), low[s[:-1]] if s else None, len(m), kids[s], leaves[s], saved[s], hashlib.sha256(",".join(map(str, sorted(c for c, n in m if n == len(s)))).encode()).hexdigest()) for s, m in members.items())


def nodes(spark, rows, more=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in more.split():
        df = df.withColumn(c, F.lit("x"))
    convs = prefix_trie.turns_by_conversation(df)
    cols = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(((tuple(r[c] for c in cols)) for r in prefix_trie.trie(prefix_trie.rebuilt(convs)).collect()), key=lambda r: [(x is not None, x) for x in r])


def odd_conversations():
    rng = np.random.default_rng(4)
    rows = []
    for c in range(160):
        for t in range(int(rng.integers(0, 14))):
            rows.append((c, t if rng.random() < 0.9 else None, ["user", "assistant", None][rng.integers(0, 3)], ["hi", "", None, "é" * 5, "longer text"][rng.integers(0, 5)]))
    for c in range(200, 320):  # copies: a third of all conversations
        rows += [(c, t, "user", f"same {t}") for t in range(9)]
    rows += [(c, 0, "user", "same 0") for c in range(400, 430)]  # a hot first turn
    rows += [(c, 1, "user", f"then {c}") for c in range(400, 430)]
    rows += [(500, t, "user", f"t{t}") for t in range(600)] + [(501, t, "user", f"t{t}") for t in range(600)]
    rows += [(None, 1, "user", "no one"), (-7, 1, "user", "below"), (-5, 1, "user", "zero"), (3, 1, "user", "again"), (3, 1, "user", "again"), (7000, None, None, None), (7001, 0, "user", "a" * 100_000)]
    return rows


@pytest.mark.parametrize("size", [50_000, 3])
def test_trie_against_dictionaries(spark, size, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_CONVS", size)  # 3: about a hundred shards, spines everywhere
    rows = odd_conversations()
    want = sorted(trie_by_hand(rows), key=lambda r: [(x is not None, x) for x in r])
    assert nodes(spark, rows, "node parent shard side own ends seq g h t") == want
    assert nodes(spark, rows + [r for r in rows if r[0] == 401]) == sorted(trie_by_hand(rows + [r for r in rows if r[0] == 401]), key=lambda r: [(x is not None, x) for x in r])


def test_trie_of_nothing_and_of_the_given_table(spark):
    assert nodes(spark, []) == [] and nodes(spark, [(None, 0, "user", "x")]) == []
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(spark, given) == sorted(trie_by_hand(given), key=lambda r: [(x is not None, x) for x in r])


def test_findclose_over_many_blocks():
    rng = np.random.default_rng(1)
    for n in (1, 2, 31, 32, 33, 500, 9000):
        bits, depth, left = [], 0, n
        while left or depth:
            up = left and (not depth or rng.random() < (0.9 if len(bits) < n // 2 else 0.5))
            bits.append(bool(up))
            depth, left = depth + (1 if up else -1), left - bool(up)
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        at = np.flatnonzero(bits)
        assert prefix_trie.Parens(np.array(bits)).findclose(at).tolist() == [want[i] for i in at.tolist()]


# ---- decontamination -------------------------------------------------------------------------------------------------


def hits_by_hand(docs, bench, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = defaultdict(set)
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            grams[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for m in {len(g) for g in grams}:
            for i in range(len(w) - m + 1):
                if (g := tuple(w[i : i + m])) in grams:
                    hit |= set(range(i, i + m))
                    items |= {str(x) for x in grams[g] if x is not None}
        out.append((doc, len(w), len(hit), sorted(items)))
    return out


def leaky(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abéZ9"), rng.integers(1, 4)))
    items = [(i, " ".join(word() for _ in range(int(rng.integers(0, 30))))) for i in range(40)]
    items += [(40, items[5][1]), (5, items[5][1]), (None, "nobody owns these words"), (41, None), (42, ""), (43, "..."), (44, "one"), (45, "Two-Words"), (46, "a" * 300_000 + " long")]
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(0, 60)))) + " " + (items[i % 46][1] or "").upper().replace(" ", [" ", "\n", "--", "\x00"][i % 4])) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "?!"), (203, "x one"), (204, "two words"), (205, "two"), (206, "words"), (207, "nobody\towns these words!"), (208, "a" * 300_000 + "/LONG"), (209, items[3][1] * 400), (None, items[7][1]), (210, items[7][1]), (210, items[7][1]), (211, "İ ı ß ÀÉ 日本語 ٣")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


@pytest.mark.parametrize("set_bytes", [decontaminate.SET_BYTES, 4000])
def test_scan_against_sets_of_tuples(spark, set_bytes):
    d, b, docs, items = leaky(spark)
    found = decontaminate.scan(d.withColumn("items", F.lit(1)).withColumn("w", F.lit(1)).withColumn("__text", F.lit("y")), b.withColumn("m", F.lit(1)), set_bytes=set_bytes)
    got = [(r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, hits_by_hand(docs, items)))
    nothing = b.limit(0)
    assert decontaminate.scan(d, nothing, set_bytes=set_bytes).where("n_hit > 0 or size(items) > 0").count() == 0
    assert decontaminate.scan(d.limit(0), b, set_bytes=set_bytes).count() == 0


def test_hash_hits_are_verified(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.Words, "hashes", lambda self, lo, hi, m: np.full(hi - lo, m, np.uint64))  # all windows fall together
    import pyarrow as pa

    grams = decontaminate.GramSet([(2, b"a b", ["x"]), (2, b"b c", ["y"]), (1, b"z", ["z"])])
    w = decontaminate.Words(*decontaminate._raw(pa.array(["a B c", "c a", "b", "z"])))
    assert [(a.tolist(), m, i) for a, m, i in grams.hits(w)] == [([6], 1, [["z"]]), ([0, 1], 2, [["x"], ["y"]])]


def test_spans_and_documents_go(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "é says: The QUICK, brown\nfox! ends", "k"), (2, "the quick brown", "k"), (3, None, "k"), (4, "the quick brown fox the quick brown fox", None)], "doc_id long, text string, runs string")
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut == {1: "é says:  ! ends", 2: "the quick brown", 3: None, 4: " "}
    assert {r.doc_id for r in decontaminate.remove_documents(docs, bench).collect()} == {2, 3}
    assert {r.doc_id for r in decontaminate.remove_documents(docs, bench, most_share=0.7).collect()} == {1, 2, 3}
    assert decontaminate.remove_spans(docs, bench).columns == docs.columns == decontaminate.remove_documents(docs, bench).columns


# ---- hard negatives --------------------------------------------------------------------------------------------------


def negatives_by_hand(rows, asks, k=5):
    fine = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, lab, v in {(i, lab, tuple(v)): (i, lab, v) for i, lab, v in fine if asks(i)}.values():
        every = sorted({(-dot(v, w), i, x == lab) for i, x, w in fine if i != a})
        for s, p, _ in [x for x in every if x[2]][:k]:
            near = [x for x in every if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(near, 1)]
    return sorted(out)


COLS = "anchor_id positive_id rank negative_id positive_score negative_score".split()


@pytest.mark.parametrize("at_once,wild", [(16_384, False), (3, False), (16_384, True)])
def test_negatives_against_all_pairs(spark, at_once, wild):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((4, 12))
    rows = [(i, int(rng.integers(0, 3)), (centre[rng.integers(0, 4)] + 0.3 * rng.standard_normal(12)).tolist()) for i in range(300)]
    rows += [(300 + i, i % 3, rows[0][2]) for i in range(150)]  # copies of an anchor: ties by id
    rows += [(500, None, [1.0] * 12), (501, 1, None), (502, 1, [float("nan")] * 12), (503, 1, [None] * 12), (504, 1, [float("inf")] * 12), (None, 1, [1.0] * 12), (505, 1, [0.0] * 12), (506, 2, []), (507, 0, [2.0, 1.0]), (508, 7, [1.0] * 12), rows[0], rows[20]]
    if wild:
        rows += [(600, 1, [3e6] * 12), (620, 0, [-2.5e6] * 12), (640, 1, [2e7] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("id", F.lit("x")).withColumn("v", F.lit("y")).withColumn("asks", F.lit(1))
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, anchors_at_once=at_once)
    want = negatives_by_hand(rows, lambda i: i % 20 == 0)
    assert got.columns == COLS and len(want) > 50 and sorted(tuple(r) for r in got.collect()) == want
    for none in (df.limit(0), df.where("vec_id = 500")):
        assert hard_negatives.hard_negatives(none, F.col("vec_id") % 20 == 0).count() == 0
