"""The training-data operations against brute force, on hand-made tables with nulls, ties, repeated rows and odd columns."""

import hashlib
import tracemalloc
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shiftkit.llm import ann, components, html_tree, jaccard, langid, lm, media_ts, mixing, packing, queries, token_store, tokens, url_filter
from shiftkit.llm.common import salted_prefix, scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, piece string, `start` string, node string, epoch string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a repeated row, near and exact copies, a very long text, columns that clash with internal names."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeéß"), rng.integers(1, 8)))
    base = [word() for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    texts = [" ".join(base), " ".join(near), " ".join(base), None, "", " \t\n ", "one two", "ONE  TWO", "12 34 !!", " ".join(word() for _ in range(30_000)), "a" * 5000, " ".join(base).upper(), "日本語 の 文章 です"]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", len(t or ""), "x", "y", "z", "w") for i, t in enumerate(texts)]
    rows.append(rows[0])
    rows.append((None, "no id here but words", "en", "s0", 1, "x", "y", "z", "w"))
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


# ---- tokens, packing, store ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_chunks_give_the_ids_of_whole_texts(name, drops):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokens.tokenizer_path(name)), tokens.Encoder(tokens.tokenizer_path(name), drops)
    rng = np.random.default_rng(1)
    letters = list("abcXYZ éßÀÿ×÷ªµ.,;'’\n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u200b12٣²中éİΣς_-\x00") + ["<|endoftext|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(500)] + ["it's we'LL x'd", "", "a" * 3000, None]
    for lo in (0, 100, 100, 480):  # the second time from what is kept
        part = texts[lo:]
        ids, at = e.encode(pa.array(part))
        assert len(at) == len(part) + 1
        for x, a, b in zip(part, at, at[1:], strict=False):
            assert ids[a:b].tolist() == t.encode(x or "", add_special_tokens=False).ids, repr(x)


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_twenty_thousand_odd_strings(name, drops):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokens.tokenizer_path(name)), tokens.Encoder(tokens.tokenizer_path(name), drops)
    rng = np.random.default_rng(7)
    letters = list("abcXYZ éßÀÿ×÷ªµ.,;'’\n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u200b12٣²中éİΣς_-\x00  \n\n") + ["<|endoftext|>", "<|startoftext|>", "<|ENDoftext|>", "  <|endoftext|>", "\n\n<|endoftext|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(20_000)]
    wrong = 0
    for lo in range(0, len(texts), 2000):
        part = texts[lo : lo + 2000]
        ids, at = e.encode(pa.array(part))
        wrong += sum(ids[a:b].tolist() != t.encode(x, add_special_tokens=False).ids for x, a, b in zip(part, at, at[1:], strict=False))
    assert wrong == 0


def test_a_batch_of_fewer_words_than_a_shingle():
    assert [len(x) for x in jaccard.shingles_of(["two words", None, "one"], 5)] == [1, 0, 1] and [len(x) for x in jaccard.shingles_of(["a"], 5)] == [1]


def test_packing_is_whole_gapless_and_tight(spark, odd, empty):
    pieces = packing.token_pieces(odd, tokens.tokenizer_path("word_bpe_49k.json"))
    rows = packing.pack(pieces).collect()
    assert len(rows) == pieces.count()
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 2048
    by_doc = Counter()
    for r in rows:
        by_doc[r.doc_id] += r.length
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for d in odd.collect():  # each piece against the whole text's ids
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 0]
        for i, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[d.doc_id, i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    long = [r for r in rows if r.doc_id == 9]
    assert sorted(r.piece for r in long) == list(range(len(long))) and all(r.length == 2048 for r in long if r.piece < len(long) - 1)
    assert len(seqs) == -(-sum(r.length for r in rows) // 2048)
    assert by_doc[3] == by_doc[4] == by_doc[5] == 1
    assert packing.pack(packing.token_pieces(empty, tokens.tokenizer_path("word_bpe_49k.json"))).count() == 0


def test_plan_uses_every_length_and_fills_exactly():
    rng = np.random.default_rng(2)
    counts = {int(k): int(n) for k, n in zip(range(1, 101), rng.integers(0, 50, 100), strict=True) if n}
    used = Counter()
    for items, times in packing.plan(counts, 100):
        assert sum(items) <= 100
        for x in items:
            used[x] += times
    assert used == Counter(counts)
    assert len(packing.plan({100: 10**9, 60: 10**9, 40: 10**9}, 100)) == 2  # whole groups at once
    for c, size, loss in ((counts, 100, 1.04), ({k: 1000 + k for k in range(1, 2048)}, 2048, 1.01), ({k: 3000 - k for k in range(1, 2048)}, 2048, 1.01)):
        least = max(sum(k * n for k, n in c.items()) / size, sum(n for k, n in c.items() if 2 * k > size))
        assert sum(t for _, t in packing.plan(c, size)) <= loss * least + 1


def test_store_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    path = f"{scratch(spark)}/store-{uuid.uuid4().hex}"
    blocks = token_store.write_store(odd, path, tokens.tokenizer_path("byte_bpe_50k.json"), end_id=2, partitions=3)
    assert len({r.dict_hash for r in blocks.select("dict_hash").collect()}) == 1
    rows = sorted(token_store.read_store(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert len(rows) == odd.count()
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(t.encode(r.text or "", add_special_tokens=False).ids + [2])
    at, last = 0, -1
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and ids in texts[r.doc_id] and zlib.crc32(r.ids) == r.ids_crc32
        at, key = at + len(ids), -1 if r.doc_id is None else r.doc_id
        assert key >= last
        last = key
    # A short document is read without its neighbours.
    b = blocks.where(F.array_contains("doc_ids", F.lit(6).cast("long"))).first()
    i = list(b.doc_ids).index(6)
    import zstandard

    d = zstandard.ZstdCompressionDict(bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary))
    one = zstandard.ZstdDecompressor(dict_data=d).decompress(b.frames[(b.ends[i - 1] if i else 0) : b.ends[i]])
    assert np.frombuffer(one, "<u2").tolist() in texts[6]
    token_store.write_store(empty, f"{path}-empty", tokens.tokenizer_path("byte_bpe_50k.json"), end_id=2, partitions=2)
    assert token_store.read_store(spark, f"{path}-empty").count() == 0


# ---- media -----------------------------------------------------------------------------------------------------------


def test_streams_keep_payloads_times_and_access_points():
    rng = np.random.default_rng(0)
    for n in (0, 1, 191, 192, 193, 12_288, 12_289, 200_000):
        text = "".join(rng.choice(list("ab é"), n)) if n else None
        pay = media_ts.padded(text)
        assert len(pay) % 192 == 0 and len(pay) > 0
        media = media_ts.mux_bytes(pay)
        got = media_ts.demux_bytes(media)
        assert got["payload"] == pay and got["errors"] == 0 and len(media) % 188 == 0
        units = -(-len(pay) // media_ts.UNIT)
        assert got["pts"] == [i * media_ts.TICKS for i in range(units)] and got["access"] == [i % media_ts.GOP == 0 for i in range(units)]
        assert got["places"] == [i * media_ts.UNIT for i in range(units)]


def test_broken_streams_are_told():
    media = media_ts.mux_bytes(media_ts.padded("x" * 5000))
    assert media_ts.demux_bytes(media[: 188 * 5] + media[188 * 6 :])["errors"] > 0  # a packet is lost
    assert media_ts.demux_bytes(b"\0" + media[1:])["errors"] > 0
    damaged = bytearray(media)
    damaged[10] ^= 1  # in the association table
    assert media_ts.demux_bytes(bytes(damaged))["errors"] > 0
    assert media_ts.demux_bytes(b"")["payload"] == b""
    assert media_ts.crc_mpeg(b"123456789") == 0x0376E6E7


def test_cut_streams_have_errors_and_raise_nothing(spark):
    media = media_ts.mux_bytes(media_ts.padded("some text " * 3000))
    for n in range(0, 3000):
        assert media_ts.demux_bytes(media[:n])["errors"] > 0
    rows = [(1, 5, media[:400]), (2, 0, None), (3, 1, media)]
    got = {r.doc_id: r.errors for r in media_ts.demux(spark.createDataFrame([(i, n, bytearray(m) if m else None) for i, n, m in rows], "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1] > 0 and got[2] > 0 and got[3] == 0


def test_media_query(spark, odd, empty):
    got = {(r.doc_id, r.payload_sha256) for r in media_ts.demux(media_ts.mux(odd)).collect()}
    assert got == {(r.doc_id, hashlib.sha256(media_ts.padded(r.text)).hexdigest()) for r in odd.collect()}
    assert media_ts.demux(media_ts.mux(empty)).count() == 0


# ---- Jaccard join ----------------------------------------------------------------------------------------------------


def brute(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    return Counter((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_components_of_odd_rows(odd, empty, k, num):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_components(odd, k=k, num=num).collect())
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()], k, num, 100)
    assert jaccard.join_components(empty).count() == 0


@pytest.mark.parametrize("few,heavy", [(8, 4096), (2, 4096), (2, 12)])
def test_components_of_large_near_copy_groups(spark, monkeypatch, few, heavy):
    """Copies with edits, most of them only near enough to a few others; with ``few`` small, keys go the long way; also with heavy keys."""
    monkeypatch.setattr(jaccard, "FEW", few)
    if heavy < 4096:
        for name, n in (("HEAVY", heavy), ("SHARE", 1 << 40), ("SAMPLED", 1)):
            monkeypatch.setattr(jaccard, name, n)
    rng = np.random.default_rng(few)
    passage = [f"p{i}" for i in range(50)]
    rows = []
    for i in range(120):
        base = [f"w{i % 3}x{j}" for j in range(90)]
        for _ in range(rng.integers(0, 5)):
            base[rng.integers(0, 90)] = f"e{rng.integers(0, 1000)}"
        rows.append((i, " ".join(base)))
    rows += [(200 + i, " ".join(passage + [f"o{i}y{j}" for j in range(rng.integers(4, 20))])) for i in range(60)]
    rows += [(300 + n, " ".join(f"s{j}" for j in range(n))) for n in range(1, 40)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, num=85).collect())
    assert got == brute(rows, 4, 85, 100)


def test_forest_joins_what_the_edges_join_by_the_least_distances():
    rng = np.random.default_rng(5)
    for size, edges in ((1, 0), (2, 1), (30, 25), (40, 400)):
        a, b = rng.integers(0, size, edges), rng.integers(0, size, edges)
        far = rng.integers(0, 9, edges)
        at = jaccard._forest(a, b, far, size)
        up = list(range(size))

        def find(x, up=up):
            return x if up[x] == x else find(up[x])

        least = []
        for e in np.argsort(far, kind="stable"):
            if find(a[e]) != find(b[e]):
                up[find(a[e])] = find(b[e])
                least.append(far[e])
        assert sorted(far[at]) == sorted(least)


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_of_words_and_marks(monkeypatch, name, drops):
    """Chunks with and without marks, letters of other alphabets, marks alone; plain ASCII words need no pattern."""
    e = tokens.Encoder(tokens.tokenizer_path(name), drops)
    texts = ["", " ", ".", ",", "a.", "a,", " a.", " .", "..", "a..", "É.", " É,", "ß", "µ", "ª", "A-b", "x\ny.", "  two  b,", "日本.", "A.B.", "ÀB,", "Ġ", "a'b", None, " ,", "I'm.", "<|endoftext|>x."]
    want = [e.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from what is kept
        ids, at = e.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want

    class Never:
        def fullmatch(self, chunk):
            raise AssertionError(chunk)

    monkeypatch.setattr(tokens, "_PLAIN", Never())
    ids, _ = e.encode(pa.array(["Plain words only, with marks.\nAnd lines"]))
    assert ids.tolist() == e.tok.encode("Plain words only, with marks.\nAnd lines", add_special_tokens=False).ids


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_words_are_known_whatever_marks_are_behind(monkeypatch, name, drops):
    """A word that is kept isn't encoded again with other marks behind; slices of an array; what is in many slices stays."""
    e = tokens.Encoder(tokens.tokenizer_path(name), drops)
    whole = e._whole
    marks = ["", ".", ",", "!?", "%%%,", "...", ")(", "-", "_`~", "$$$"]
    words = ["alpha", "béta", "Ñandú", "delta"]
    texts = [" ".join(w + m for w in words) + "\n" + words[0] + m for m in marks] + ["x's", "x.'s", "x'.", "x.y", "x\u0301.", "x.\u0338", "", "<|endoftext|>.", "a  b.\r\n", "\x1c a.", "  ", "n" * 99 + "!"]
    want = [e.tok.encode(t, add_special_tokens=False).ids for t in texts]
    for x in (pa.array(["before", *texts]).slice(1), pa.array(["É" * 9, None, *texts]).slice(2), pa.array(texts).slice(0)):
        ids, at = e.encode(x)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want
    assert len(e.keys) == len(e.size) == len(e.uses) and len(e.flat) == e.size.sum() and max(map(len, e.keys.to_pylist())) <= tokens.CHUNK_CHARS

    asked = []
    monkeypatch.setattr(e, "_whole", lambda t: asked.extend(t) or whole(t))
    monkeypatch.setattr(e, "model", None)  # no word is new
    text = " ".join(w + "#%" for w in words) + "\n" + words[0] + "#%"
    ids, _ = e.encode(pa.array([text]))
    assert ids.tolist() == e.tok.encode(text, add_special_tokens=False).ids and asked == ["#%"]
    monkeypatch.undo()

    e.kept = 50
    for i in range(40):
        ids, _ = e.encode(pa.array([text + "".join(f" q{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" * 2 for j in range(60))]))
        assert len(e.keys) <= 100
    assert {w.lower() for w in words} <= {k.strip().lower() for k in e.keys.to_pylist()}
    assert e.encode(pa.array([text]))[0].tolist() == e.tok.encode(text, add_special_tokens=False).ids
    e.forget()
    assert e.encode(pa.array([text]))[0].tolist() == e.tok.encode(text, add_special_tokens=False).ids and e.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_open_pairs_of_a_large_key_in_little_memory():
    """Eight million pairs of one key's members: all are found, a slice at a time."""
    size = 4096
    node, same = np.arange(size), np.zeros(size, np.int64)
    maps = np.zeros((size, 32), np.uint8)
    for every, pairs in ((True, size * (size - 1) // 2), (False, size - 1)):
        tracemalloc.start()
        found = sum(len(x) for x, _, _ in jaccard.open_pairs(node, same + 50, node, same + 1, same, maps, 80, 100, every))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == pairs and peak < 48 << 20


def test_open_pairs_and_key_groups_against_brute_force(monkeypatch):
    """Groups over several batches, bitmaps of several sizes, one block and two, deletions, kinds, components."""
    monkeypatch.setattr(jaccard, "AT_ONCE", 100)
    rng = np.random.default_rng(8)
    groups = [(key, i, j) for key in range(6) for i, j in ((0, 0), (0, 1))]
    rows = []
    for key, i, j in groups:
        seed = rng.integers(0, 256, 64).astype(np.uint8)
        for _ in range(rng.integers(2, 50)):
            bits = seed.copy()
            bits[rng.integers(0, 64)] ^= rng.integers(0, 256)
            kind = int(rng.choice([0, 1, 1, 2, 5, 6]))
            rows.append((key, i, j, int(rng.choice([i, j])), int(rng.integers(0, 1 << 40)), int(rng.integers(40, 60)), int(rng.integers(0, 9)), kind, bits.tobytes() if rng.random() < 0.7 else jaccard._fold(bits[None], 32).tobytes()))
    batches = [pa.RecordBatch.from_pylist([dict(zip("abcdefghi", r, strict=True)) for r in rows[lo : lo + 37]]) for lo in range(0, len(rows), 37)]
    got = set()
    for key, i, j, own, node, n, root, kind, maps in jaccard.key_groups(batches):
        for x, y, _ in jaccard.open_pairs(node, n, root, kind, own, maps, 80, 100, True):
            got |= {(key[0], i[0], j[0], *sorted(p)) for p in zip(x.tolist(), y.tolist(), strict=True)}
    want = set()
    for g in groups:
        mine = [r[3:] for r in rows if r[:3] == g]
        least = min(len(r[-1]) for r in mine)
        for a, x in enumerate(mine):
            for y in mine[:a]:
                deletions = (x[4] >= 4) + (y[4] >= 4)
                allowed = (x if (x[2], x[1]) > (y[2], y[1]) else y)[4] % 4
                far = sum(bin(p ^ q).count("1") for p, q in zip(*(jaccard._fold(np.frombuffer(r[-1], np.uint8)[None], least)[0].tolist() for r in (x, y)), strict=True))
                blocks = g[1] == g[2] or x[0] != y[0]
                if blocks and x[3] != y[3] and deletions < 2 and allowed >= 1 + deletions and 100 * min(x[2], y[2]) >= 80 * max(x[2], y[2]) and far <= 20 * (x[2] + y[2]) // 180:
                    want.add((*g, *sorted((x[1], y[1]))))
    assert want and got == want


def test_components_say_when_they_are_not_whole(spark):
    with pytest.raises(RuntimeError):
        components.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), rounds=1)


def test_pigeonhole_holds_for_linked_sets():
    """Two linked sets share a probed key, whatever their sizes: the larger set's allocation decides."""
    rng, bands = np.random.default_rng(3), jaccard.Bands(80, 100)
    for _ in range(300):
        n = int(rng.integers(3, 300))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = x.copy()
        for _ in range(int(rng.integers(0, max(1, n // 7)))):
            if rng.random() < 0.5 and len(y) > 1:
                y = np.delete(y, rng.integers(0, len(y)))
            else:
                y = np.append(y, rng.integers(0, 2**63, 1).astype(np.uint64))
        y = np.unique(y)
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both) or np.array_equal(x, y):
            continue
        large, small = (x, y) if (len(x), x.sum()) > (len(y), y.sum()) else (y, x)
        (ka, ca), (kb, cb) = jaccard.signatures(large, bands), jaccard.signatures(small, bands)
        known = defaultdict(list)
        for k, c in zip(kb.tolist(), cb.tolist(), strict=True):
            known[k].append(c)
        assert any((c >= 4) + (d >= 4) < 2 and c % 4 >= 1 + (c >= 4) + (d >= 4) for k, c in zip(ka.tolist(), ca.tolist(), strict=True) for d in known[k]), (len(x), len(y), both)


def test_first_rows_of_components(odd):
    rows = jaccard.join_components(odd, firsts=True).collect()
    firsts = [r.doc_id for r in rows if r["__first"]]
    assert 1 not in firsts and 2 not in firsts and firsts.count(0) == 2  # row 0 is there twice
    assert {3, 4, 5} <= set(firsts)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys(range(100, 140), 100)}


# ---- mixing ----------------------------------------------------------------------------------------------------------


def test_temperature_meets_its_targets():
    t = np.array([10_000.0, 500, 300, 200])
    tau, w, total = mixing.temperature(t, 0.9, 100.0, None)
    h = -(w * np.log(w)).sum() / np.log(4)
    assert abs(h - 0.9) < 1e-6 and abs(w.sum() - 1) < 1e-12 and abs((w * total / t).min() - 1) < 1e-9
    tau2, w2, total2 = mixing.temperature(t, 0.9, 2.0, None)
    assert tau2 > tau and abs((w2 * total2 / t).max() - 2) < 1e-6
    assert mixing.temperature(np.array([5.0, 5.0]), 0.99, 2.0, None)[0] == 1.0
    assert mixing.temperature(np.array([5.0]), 0.99, 2.0, 20.0)[2] == 20.0


def test_budgets_and_permutations(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "big" if i % 3 == 0 else (None if i % 17 == 0 else f"s{i % 5}"), int(rng.integers(1, 50))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.placements(df).collect()
    size, taken, times = Counter(), Counter(), Counter()
    for i, s, n in rows:
        size[s] += n
    for r in got:
        taken[r.source] += r.n
        times[r.doc_id] += 1
    _, w, total = mixing.temperature(np.array([size[s] for s in sorted(size, key=lambda x: (x is not None, x))]), mixing.ENTROPY, mixing.REPEATS, None)
    for s, share in zip(sorted(size, key=lambda x: (x is not None, x)), w, strict=True):
        assert 0 <= round(share * total) - taken[s] < 50  # the budget, up to a document that no longer fits
    assert min(times[i] for i, _, _ in rows) >= 1 and max(times.values()) <= 3
    assert sorted(got) == sorted(mixing.placements(df.repartition(7)).collect())
    blocks = defaultdict(list)
    for r in got:
        blocks[r.block].append(r.place)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in blocks.values())
    assert mixing.placements(df.limit(0)).count() == 0
    cut = mixing.placements(df, budget=sum(size.values()) / 4).groupBy("source").agg(F.sum("n")).count()
    assert cut == len(size)


def test_mix_keeps_columns_and_copies(odd, empty):
    got = mixing.mix(odd, mixing.words("text"))
    assert got.columns == [*odd.columns, "__epoch", "__block", "__place"]
    first = got.where("__epoch = 0").select(*odd.columns)
    assert first.exceptAll(odd).count() == 0 and odd.exceptAll(first).count() == 0
    assert mixing.mix(empty, mixing.words("text")).count() == 0


def test_salted_prefix(spark):
    df = spark.createDataFrame([(g, i, i % 4 + 1) for g in ("a", None) for i in range(200)], "g string, i long, n long")
    rows = salted_prefix(df, ["g"], ["i"], "n", "s", 8).collect()
    for g in ("a", None):
        at = 0
        for r in sorted((r for r in rows if r.g == g), key=lambda r: r.s):
            assert r.s == at
            at += r.n


# ---- nearest neighbours ----------------------------------------------------------------------------------------------


def test_neighbours_with_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 16)).astype(np.float32)
    v[40:80] = v[0]
    rows = [(i, [float(x) for x in v[i]], "x") for i in range(300)]
    rows += [(1000, None, "x"), (1050, [0.0] * 16, "x"), (1100, [float("nan")] * 16, "x"), (1150, [None] + [1.0] * 15, "x"), (None, [1.0] * 16, "x"), (1200, [1.0, 2.0], "x"), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids string")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    hits = total = 0
    for q in range(0, 300, 50):
        s = u @ u[q]
        want = [int(i) for i in np.lexsort((np.arange(300), -s.round(12))) if i != q][:5]
        assert len(got[q]) == 5 and all(abs(s[i] - x) < 1e-12 for i, x in got[q])
        hits += len(set(want) & {i for i, _ in got[q]})
        total += 5
    assert set(got) == set(range(0, 300, 50)) and hits / total >= 0.9
    assert [i for i, _ in got[0]] == [40, 41, 42, 43, 44]  # ties go to the smaller id
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_scaled_copies_go_to_the_smaller_id(spark, monkeypatch):
    """Many different vectors of one direction, in several blocks that are asked in several turns."""
    monkeypatch.setattr(ann, "CELL", 16)
    monkeypatch.setattr(ann, "ASKED", 1)
    rng = np.random.default_rng(6)
    v = rng.standard_normal((200, 8))
    rows = [(int(i), [float(x) for x in (v[0] * 2.0 ** (int(i) % 40 - 20) if i < 60 else v[i])]) for i in rng.permutation(200)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and all(len(x) == 5 for x in got.values())


def test_recall_on_the_given_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    v, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    u, hits, total = v / np.linalg.norm(v, axis=1)[:, None], 0, 0
    found = defaultdict(set)
    for r in queries.op7_nearest(spark, SF).collect():
        found[r.query_id].add(r.vec_id)
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        s[i] = -2
        hits += len(found[ids[i]] & set(ids[np.lexsort((ids, -s.round(12)))[:5]]))
        total += 5
    assert hits / total >= 0.9


def test_chi_square_bound():
    assert abs(ann.chi_square_bound(8, 0.95) - 15.507) < 1e-2 and abs(ann.chi_square_bound(2, 0.99) - 9.2103) < 1e-3


# ---- urls ------------------------------------------------------------------------------------------------------------


def test_url_rules_against_brute_force(spark):
    urls = ["http://Example.COM/en/7?x", "https://a.b.example.com/en/", "http://example.net/de/81", "http://x.net/de/", "http://org/es/", "http://xorg/es/", "nothing", None, "http://", "://net/de/#f", "http://a.com/EN/", "ftp://com/en/", "http://..com/en/x", "x http://a://b.com/en/"]
    pages = spark.createDataFrame([(i % 12, u, "h", "x") for i, u in enumerate(urls)] + [(0, urls[0], "h", "x")], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")

    def judge(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0] if rest[cut : cut + 1] == "/" else ""
        fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    got = Counter(tuple(r) for r in url_filter.url_verdicts(pages, rules).collect())
    assert got == Counter((r.page_id, *judge(r.url)) for r in pages.collect())
    assert url_filter.url_verdicts(pages, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == pages.count()
    assert url_filter.url_verdicts(pages.limit(0), rules).count() == 0


# ---- pages -----------------------------------------------------------------------------------------------------------


def test_main_text_of_hand_made_pages(spark):
    body = "<header>Top</header><nav><ul><li>A<li>B</ul></nav><div class='sidebar'>side</div><article><h1>Title {i}</h1><p>One&nbsp;&amp; two<b>three</b> {i}<br>x</p><aside>no</aside><div class=\"comments\"><p>reader says</p></div><p>last {i}</article><form>f</form><script>var a='</p>';</script><style>p{{}}</style><!-- <p>c</p> --><footer>end</footer>"
    pages = [(i, f"http://h{i % 2}.com/{i}", "<html><body>" + body.format(i=i) + "</body></html>", "t") for i in range(6)]
    pages += [(90, "http://h0.com/", None, "t"), (91, None, "", "t"), (92, "x", "no tags &lt; here", "t"), (93, "http://z/", "<p>cut off <b", "t"), (94, "http://z/", "<div><p>plain</p>  text", "t"), pages[0]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_tree.main_text(df).collect()}
    for i in range(6):
        want = f"Title {i} One & twothree {i} x last {i}"
        assert got[i] == (want, len(want))
    assert got[90] == ("", 0) and got[91] == ("", 0) and got[92][0] == "no tags < here" and got[93][0] == "cut off" and got[94][0] == "plain text"
    assert html_tree.main_text(df).count() == len(pages) and html_tree.main_text(df.limit(0)).count() == 0


def test_style_tree_cuts_what_is_alike_everywhere(spark):
    page = "<body><div class='zone'><p>same words on every page</p></div><div class='story'><p>{}</p></div></body>"
    df = spark.createDataFrame([(i, "http://h.com/", page.format(f"story number {i} tells {i * 7}")) for i in range(40)], "page_id long, url string, html string")
    assert {r.text for r in html_tree.main_text(df).collect()} == {f"story number {i} tells {i * 7}" for i in range(40)}


def test_tree_and_not_the_name_lists_decide(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    text = lambda: {r.page_id: r.text for r in html_tree.main_text(df).collect()}
    usual = text()
    monkeypatch.setattr(html_tree, "NAMED", 1.0)
    assert sum(t != usual[i] for i, t in text().items()) <= 0.02 * len(usual)
    uncut = {r.page_id: html_tree.page_text(r.html, {}) for r in df.collect()}
    assert sum(t != usual[i] for i, t in uncut.items()) > 0.9 * len(usual)


def test_hand_made_layouts(spark):
    """Per layout 30 pages of one host: what must be in the text, what must not."""
    filler = lambda i, k: f"tale {i * 31 + k} of hill {i * 17 + k} told by {i * 7 + k} men"
    layouts = {
        "no-article": ("<div id=top><b>Site</b> Home About</div><div class=x><p>{a}<p>{b}</div><div class=y>All rights kept</div>", ["a", "b"], ["About", "rights"]),
        "two-articles": ("<p>Same words</p><article><p>{a}</article><article><p>{b}</article>", ["a", "b"], ["Same"]),
        "comments": ("<article><p>{a}</p><div class='comments'><p>{b}</p></div></article>", ["a"], ["b"]),
        "comments-outside": ("<article><p>{a}</p></article><section id=comments><p>{b}</p></section>", ["a"], ["b"]),
        "entry-header": ("<article class=post><div class='entry-header'><h1>{a}</h1></div><p class='search-results-study'>{b}</p></article>", ["a", "b"], []),
        "header-in-article": ("<header>Brand line</header><article><header><h1>{a}</h1></header><p>{b}</article>", ["a", "b"], ["Brand"]),
        "role": ("<div role=navigation>{b}</div><div role=main><p>{a}</div>", ["a"], ["b"]),
        "position": ("<div><div>Buy now cheap</div><div class=s><p>{a}</p></div><div>Buy now cheap</div></div>", ["a"], ["Buy"]),
        "table": ("<table><tr><td>Home<td class=c>{a}<br>{b}<tr><td colspan=2>Imprint</table>", ["a", "b"], ["Imprint"]),
        "deep": ("<div>" * 90 + "<p>{a}</p>" + "</div>" * 90 + "<form>{b}</form>", ["a"], ["b"]),
        "hidden": ("<main><p>{a}</p><p hidden>{b}</p></main>", ["a"], ["b"]),
        "list": ("<ul class=menu><li>{b}</ul><section><h2>{a}</h2><ul><li>one {c}<li>two {d}</ul></section>", ["a", "c", "d"], ["b"]),
    }
    rows = []
    for j, (name, (form, _, _)) in enumerate(layouts.items()):
        rows += [(j * 100 + i, f"http://{name}.org/{i}", "<html><body>" + form.format(**{k: filler(i, n) for n, k in enumerate("abcd")}) + "</body></html>") for i in range(30)]
    rows += [(9000 + i, f"http://mirror.org/{i}", "<body><div class=w><p>one story on all pages</p></div></body>") for i in range(30)]
    rows += [(9100, "http://one.org/", "<body><p>" + "word " * 300_000 + "</p></body>")]
    got = {r.page_id: r.text for r in html_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for j, (name, (_, keeps, drops)) in enumerate(layouts.items()):
        for i in range(30):
            part = {k: filler(i, n) for n, k in enumerate("abcd")}
            assert all(part[k] in got[j * 100 + i] for k in keeps), (name, got[j * 100 + i])
            assert not any(part.get(k, k) in got[j * 100 + i] for k in drops), (name, got[j * 100 + i])
    assert all(got[9000 + i] == "one story on all pages" for i in range(30)) and got[9100] == ("word " * 300_000).strip()


def test_given_pages_give_their_articles(spark):
    import html
    import re

    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in queries.op1_html_main_text(spark, SF).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", re.sub(r"</?b>", "", inner))).split())


# ---- language model --------------------------------------------------------------------------------------------------


def model_by_hand(rows, m, order):
    import math

    docs = [((t or "").encode().lower().split() + [b"</s>"], p) for _, t, p in rows]
    c, grams, before = Counter(), Counter(), Counter()
    walk = lambda w, k: [(tuple(([b"<s>"] + w)[i + 2 - k : i + 1]), x) for i, x in enumerate(w) if i + 2 >= k]
    for w, p in docs:
        if p != lm.TEST:
            c.update(w)
            for k in range(2, order + 1):
                grams.update(walk(w, k))
                before.update(x for x, _ in walk(w, k))
    n, v, out = sum(c.values()), len(c), []
    for w, _ in docs:
        base, s = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 0.0
        for i, x in enumerate(w):
            p = m.unigram * c[x] / max(n, 1) + (1 - m.unigram) / (v + 1)
            for k in range(2, order + 1):
                if i + 2 >= k and before[(context := tuple(([b"<s>"] + w)[i + 2 - k : i + 1]))]:
                    share = m.weights[k - 2][min(int(math.log2(before[context])) + 1, lm.BUCKETS - 1)]
                    p = share * grams[context, x] / before[context] + (1 - share) * p
            s += math.log10(p)
        out.append((len(w), sum(c[x] > 0 for x in w), n, base, s))
    return out


@pytest.mark.parametrize("order,batch,slot", [(2, lm.BATCH_TOKENS, lm.SLOT_TOKENS), (2, 300, 500), (3, 200, 100_000), (3, lm.BATCH_TOKENS, 1000)])
def test_scores_against_brute_force(spark, odd, monkeypatch, order, batch, slot):
    """Also in many small batches and slots."""
    for name, n in (("BATCH_TOKENS", batch), ("SLOT_TOKENS", slot), ("SLICE_BYTES", 4096)):
        monkeypatch.setattr(lm, name, n)
    kept = []
    learn = lm.learn
    monkeypatch.setattr(lm, "learn", lambda t: kept.append(learn(t)) or kept[-1])
    unigram, first = [], lm.learn_unigram
    monkeypatch.setattr(lm, "learn_unigram", lambda *a: unigram.append(first(*a)) or unigram[-1])
    more = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).unionByName(odd.select("doc_id", "text"))
    rows = [(r.doc_id, r.text, i % 5 if i % 5 < 3 else lm.EST) for i, r in enumerate(more.collect())]
    df = spark.createDataFrame([(i, t, p) for i, (_, t, p) in enumerate(rows)], "doc_id long, text string, part int").repartition(3)
    got = {r.doc_id: r for r in lm.score(df, F.col("part"), order=order).collect()}
    m = type("M", (), {"weights": kept, "unigram": unigram[-1]})
    assert len(kept) == order - 1
    for i, (n, known, train, base, s) in enumerate(model_by_hand(rows, m, order)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train), i
        assert abs(r.base_score - base) < 1e-7 * max(1, abs(base)) and abs(r.score - s) < 1e-7 * max(1, abs(s)), i


def test_weights_raise_the_likelihood():
    import pandas as pd

    t = pd.DataFrame({"cell": [3 << 20, 3 << 20 | 5], "n": [60.0, 40.0], "s2": [60 * -1.0, 40 * -99.0], "s1": [60 * -8.0, 40 * -8.0]})
    w = lm.learn(t)[3]
    ll = lambda x: 60 * np.log(x * 0.5 + (1 - x) / 256) + 40 * np.log((1 - x) / 256)
    assert all(ll(w) >= ll(x) for x in (0.1, 0.3, 0.5, 0.55, 0.65, 0.8))


def test_scores_without_rows_or_training(spark, empty):
    assert lm.score(empty.select("doc_id", "text"), F.lit(0)).count() == 0
    r = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(lm.TEST)).first()
    assert r.n_tokens == 3 and r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score)


# ---- language ID -----------------------------------------------------------------------------------------------------


def test_gradient_is_that_of_finite_differences():
    net = langid.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, real = langid._pad([b"hello", b"wor", b"x"])
    y = np.array([0, 1, 2])
    _, g = net.gradient(x, real, y)
    for k, w in net.w.items():
        i = np.unravel_index(np.argmax(np.abs(g[k])), w.shape)
        keep = w[i]
        w[i] = keep + 1e-3
        high = net.gradient(x, real, y)[0]
        w[i] = keep - 1e-3
        low = net.gradient(x, real, y)[0]
        w[i] = keep
        assert abs((high - low) / 2e-3 - g[k][i]) < 1e-5


def test_languages_of_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.op10_language_id(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(got[d.doc_id].held_out for d in held) and len(got) == len(docs)
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.97


def test_odd_texts_have_languages(odd, empty):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, F.col("lang").isNotNull()).collect()}
    assert all(got[i] == ("und", 0.0) for i in (3, 4, 5, 8)) and got[6][0] == "en" and 0 <= got[6][1] <= 1
    assert langid.predict(odd, F.lit(False)).where("lang_pred = 'und' and score = 0").count() == odd.count()
    assert langid.predict(empty, F.lit(True)).count() == 0


def test_windows_read_every_byte_once_and_agree_with_whole_texts(spark):
    net = langid.fit({"en": [b"the thing and", b"in the end"], "de": [b"sch und der", b"die ung und"]})
    rng = np.random.default_rng(3)
    texts = ["the sch und the thing " + "x" * 120, "", "日本語 " * 500, "é", "".join(rng.choice(list("aé語\U0001f600 "), 3000)), "a" * langid.WINDOW, "b" * (langid.WINDOW + 1)]
    raw = [t.encode() for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    flat = np.frombuffer(b"".join(raw), np.uint8)
    of, start, n, lo, hi = langid.windows(flat, edges)
    for i, r in enumerate(raw):
        at = [(s + a, s + b) for s, a, b in zip(start[of == i], lo[of == i], hi[of == i], strict=True)]
        assert [x for a, b in at for x in range(a, b)] == list(range(edges[i], edges[i + 1]))
        for a, m in zip(start[of == i], n[of == i], strict=True):
            flat[a : a + m].tobytes().decode(errors="strict" if a + m == edges[i + 1] else "ignore")
            assert flat[a] & 0xC0 != 0x80
    p = net.documents(flat, edges)
    for i, r in enumerate(raw):
        if not r:
            assert (p[i] == 0).all()
            continue
        parts = []
        for s, m, a, b in zip(*(x[of == i] for x in (start, n, lo, hi)), strict=True):
            x, real = langid._pad([flat[s : s + m].tobytes()])
            both = np.concatenate([net._read(x, real, d, False)[0] for d in "fb"], 2) @ net.w["o"] + net.w["oc"]
            e = np.exp(both - both.max(2, keepdims=True))
            parts.append((e / e.sum(2, keepdims=True))[a:b, 0])
        assert np.allclose(p[i], np.concatenate(parts).mean(0), atol=1e-4)
        assert len(langid.label_positions(net, texts[i])) == len(r)


def test_mixture_against_one_place(spark):
    """Every placement, from budgets of a temperature found on a grid, and running sums over the documents in their order."""
    rng = np.random.default_rng(12)
    docs = [(i, f"s{min(int(rng.integers(0, 9)), 4) if i % 7 else 'rare'}", int(rng.integers(1, 400))) for i in range(500)]
    rows = spark.createDataFrame(docs, "doc_id long, source string, n long")
    entropy, repeats = 0.97, 3.0
    tokens = Counter()
    for _, s, n in docs:
        tokens[s] += n
    names = sorted(tokens)
    t = np.array([tokens[s] for s in names], float)
    weights = lambda tau: (t / t.sum()) ** tau / ((t / t.sum()) ** tau).sum()
    grid = [k / 20_000 for k in range(20_001)]
    good = [x for x in grid if -(weights(x) * np.log(weights(x))).sum() >= entropy * np.log(len(t)) and (weights(x) * (t / weights(x)).max() / t).max() <= repeats]
    tau, w, total = mixing.temperature(t, entropy, repeats, None)
    assert 0 < max(good) < 1 and abs(tau - max(good)) < 1e-4
    budget = {s: round(x * total) for s, x in zip(names, w, strict=True)}
    epochs = max(budget[s] // tokens[s] for s in names) + 1
    order = rows.crossJoin(spark.range(epochs).withColumnRenamed("id", "epoch")).withColumn("__h", F.xxhash64(F.lit(mixing.SEED), "epoch", "doc_id")).withColumn("b", F.pmod(F.xxhash64("__h", "doc_id"), F.lit(64)))
    order = order.withColumn("m", F.xxhash64(F.lit(mixing.SEED), F.lit(0).cast("long"), "epoch", "doc_id")).collect()
    blocks = max(1, -(-total // mixing.BLOCK_TOKENS))
    assert blocks == 1
    kept = []
    for s in names:
        for e in range(budget[s] // tokens[s] + 1):
            at = e * tokens[s]
            for r in sorted((r for r in order if r.source == s and r.epoch == e), key=lambda r: (r.b, r["__h"], r.doc_id)):
                if at + r.n <= budget[s]:
                    kept.append(r)
                at += r.n
    want = {(r.doc_id, r.epoch): i for i, r in enumerate(sorted(kept, key=lambda r: (r.m, r.doc_id, r.epoch)), 1)}
    got = {(r.doc_id, r.epoch): r.place for r in mixing.placements(rows, entropy, repeats).collect()}
    assert got == want and {d for d, _ in got} == set(range(500)) and max(Counter(d for d, _ in got).values()) > 1
    each = spark.createDataFrame([(i, f"s{i}", 1) for i in range(300)], "doc_id long, source string, n long")  # a source a document
    assert mixing.placements(each).count() == 300
