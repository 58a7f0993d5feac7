"""Language of texts by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in both directions and gives every byte position a probability for each language; a
document's probabilities are the mean over all its positions. Texts are read in windows of WINDOW bytes that begin at
whole characters, with MARGIN bytes more on both sides, so states run across words and into each window's positions from
before and behind; every byte of every text is read and counts once.

Training is backpropagation through time in numpy with Adam, on the driver, over a bounded sample: about PER_LANG
documents for each language, picked by a hash of their id, and PIECES pieces of PIECE bytes spread over the whole of each.

With ``rejects`` the network learns one class more, of texts in no language taught: strings of random letters, digits and
signs from alphabets of any size, and letters of scripts that the sample doesn't have. A document in which that class is
the most probable is "und". (Pieces with their characters permuted, tried as well, cost clean documents of few words.)

Defined results: a null text or one without a letter is "und" with score 0; so is everything if no training row has a
language; ties go to the language first in sort order; repeated rows each get their row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import lean, text_slices

WINDOW, MARGIN, HIDDEN = 192, 16, 12
PER_LANG, PIECES, PIECE, STEPS, BATCH, RATE, SEED = 400, 40, 32, 250, 384, 0.01, 11
AT_ONCE, ROWS = 2 << 20, 1024  # bytes of text that a worker cuts into windows at once; windows that the network reads at once
UND, REJECT = "und", "\0"  # no language has this name
#: First and last code points of scripts that stand for unknown ones (fixed values).
SCRIPTS = [
    (0x0370, 0x03FF), (0x0400, 0x04FF), (0x0530, 0x058F), (0x0590, 0x05FF), (0x0600, 0x06FF), (0x0900, 0x097F), (0x0980, 0x09FF), (0x0B80, 0x0BFF), (0x0E00, 0x0E7F),
    (0x10A0, 0x10FF), (0x1200, 0x137F), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
]
STRANGERS = 6000  # pieces of the rejecting class


def strangers(samples: dict[str, list[bytes]]) -> list[bytes]:
    """STRANGERS pieces that belong to no language of the sample: random strings, and other scripts."""
    rng = np.random.default_rng(SEED)
    known = [w.decode(errors="ignore") for k in sorted(samples) for w in samples[k]]
    codes = np.frombuffer("".join(known).encode("utf-32-le"), np.uint32)
    blocks = [(lo, hi) for lo, hi in SCRIPTS if ((codes >= lo) & (codes <= hi)).sum() < 0.001 * len(codes)]
    shown = np.array([chr(i) for i in range(33, 127)])
    out = []
    while len(out) < STRANGERS and known:
        if rng.random() < 0.6 or not blocks:
            letters = rng.choice(shown, rng.integers(2, 60))
        else:
            lo, hi = blocks[rng.integers(len(blocks))]
            letters = np.array([chr(i) for i in rng.integers(lo, hi + 1, rng.integers(2, 80))])
        text = " ".join("".join(rng.choice(letters, rng.integers(1, 15))) for _ in range(6))
        out.append(text.encode()[:PIECE].decode(errors="ignore").encode() or b"?")
    return out


def _pad(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as (time, word), and which of them are real."""
    n = np.array([len(w) for w in words])
    t = int(n.max())
    x = np.frombuffer(b"".join(w.ljust(t, b"\0") for w in words), np.uint8).reshape(len(words), t).T
    return x.astype(np.int64), np.arange(t)[:, None] < n[None, :]


def windows(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts raw[edges[i]:edges[i + 1]]: each window's text, place from where it is read, length, and what counts (from, to)."""
    size = np.diff(edges)
    each = -(-size // WINDOW)
    of = np.repeat(np.arange(len(size)), each)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    first, last = edges[:-1][of], edges[1:][of]

    def whole(at):  # the next place where a character begins
        for _ in range(3):
            inner = at < last
            at = at + (inner & (raw[np.minimum(at, len(raw) - 1)] & 0xC0 == 0x80))
        return at

    lo = whole(first + turn * WINDOW)
    hi = np.where(turn + 1 == each[of], last, whole(np.minimum(first + (turn + 1) * WINDOW, last)))
    start, stop = whole(np.maximum(first, lo - MARGIN)), np.minimum(last, hi + MARGIN)
    ok = hi > lo
    return of[ok], start[ok], (stop - start)[ok], (lo - start)[ok], (hi - start)[ok]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights by name; all arrays are float32."""

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray] | None = None):
        self.langs, h, k = langs, HIDDEN, len(langs)
        r = np.random.default_rng(SEED)
        self.w = weights or {f"{name}{d}": (r.standard_normal(shape) * scale).astype(np.float32) for d in "fb" for name, shape, scale in (("x", (256, 3 * h), 0.3), ("u", (h, 3 * h), 1 / np.sqrt(h)), ("c", (3 * h,), 0.0))} | {"o": (r.standard_normal((2 * h, k)) / np.sqrt(2 * h)).astype(np.float32), "oc": np.zeros(k, np.float32)}

    def _read(self, x: np.ndarray, real: np.ndarray, d: str, keep: bool):
        """States of one direction after each position; with ``keep``, what its gradient needs."""
        h, (t, n) = HIDDEN, x.shape
        wx, u, c = self.w[f"x{d}"], self.w[f"u{d}"], self.w[f"c{d}"]
        state, states, kept = np.zeros((n, h), np.float32), np.zeros((t, n, h), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a, s = wx[x[i]] + c, state @ u
            gates = _sigmoid(a[:, : 2 * h] + s[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * s[:, 2 * h :])
            m = real[i][:, None]
            if keep:
                kept.append((i, state, z, r, new, s[:, 2 * h :], m))
            state = np.where(m, (1 - z) * new + z * state, state)
            states[i] = state
        return states, kept

    def _logits(self, x: np.ndarray, real: np.ndarray | None, d: str, out: np.ndarray) -> None:
        """Adds one direction's part of the logits (time, language, window); all arrays are laid out window last.

        A sigmoid is 1 / (1 + exp(-x)) and a tanh 2 / (1 + exp(-2x)) - 1: the factors are put into the weights.
        ``real`` None: all windows are as long as the longest.
        """
        h, (t, n) = HIDDEN, x.shape
        scale = np.concatenate([np.full(2 * h, -1.0), np.full(h, -2.0)]).astype(np.float32)[:, None]
        wx, u = np.ascontiguousarray((self.w[f"x{d}"] + self.w[f"c{d}"]).T * scale), np.ascontiguousarray(self.w[f"u{d}"].T * scale)
        o = np.ascontiguousarray(self.w["o"][:h].T if d == "f" else self.w["o"][h:].T)
        state, a, s, part = np.zeros((h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((len(o), n), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            np.take(wx, x[i], axis=1, out=a, mode="clip")
            np.matmul(u, state, out=s)
            gates, new = a[: 2 * h], s[2 * h :]
            gates += s[: 2 * h]
            np.exp(np.minimum(gates, 80, out=gates), out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            new *= gates[h:]
            new += a[2 * h :]
            np.exp(np.minimum(new, 80, out=new), out=new)
            new += 1
            np.divide(2, new, out=new)
            new -= 1
            after = state - new
            after *= gates[:h]
            after += new
            state = after if real is None else np.where(real[i], after, state)
            out[i] += np.matmul(o, state, out=part)

    def positions(self, x: np.ndarray, real: np.ndarray | None) -> np.ndarray:
        """Probabilities (time, language, window) of bytes x(time, window)."""
        e = np.zeros((len(x), len(self.langs), x.shape[1]), np.float32)
        e += self.w["oc"][:, None]
        for d in "fb":
            self._logits(x, real, d, e)
        e -= e.max(1, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(1, keepdims=True)
        return e

    def documents(self, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Mean probabilities over all positions of each text; 0 for empty ones."""
        of, start, n, lo, hi = windows(raw, edges)
        out = np.zeros((len(edges) - 1, len(self.langs)))
        by = np.argsort(n, kind="stable")
        for at in range(0, len(by), ROWS):
            k = by[at : at + ROWS]
            t = int(n[k[-1]])
            place = np.arange(t)[:, None]
            x = raw[np.minimum(start[k] + place, len(raw) - 1)].astype(np.intp)
            p = self.positions(x, None if n[k[0]] == t else place < n[k])
            p *= ((place >= lo[k]) & (place < hi[k]))[:, None, :]
            np.add.at(out, of[k], p.sum(0).T)
        return out / np.maximum(np.diff(edges), 1)[:, None]

    def gradient(self, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions, and its gradient by backpropagation through time."""
        h, t, n = HIDDEN, *x.shape
        (sf, kf), (sb, kb) = self._read(x, real, "f", True), self._read(x, real, "b", True)
        both = np.concatenate([sf, sb], 2)
        e = both @ self.w["o"] + self.w["oc"]
        e = np.exp(e - e.max(2, keepdims=True))
        p = e / e.sum(2, keepdims=True)
        total = real.sum()
        hit = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (t, n, 1)), 2)[:, :, 0]
        loss = float(-(np.log(hit + 1e-12) * real).sum() / total)
        p[:, np.arange(n), y] -= 1
        p *= real[:, :, None] / np.float32(total)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["o"], g["oc"] = both.reshape(-1, 2 * h).T @ p.reshape(-1, p.shape[2]), p.sum((0, 1))
        back = p @ self.w["o"].T
        for d, kept, part in (("f", kf, back[:, :, :h]), ("b", kb, back[:, :, h:])):
            u, carry = self.w[f"u{d}"], np.zeros((n, h), np.float32)
            for i, before, z, r, new, sn, m in reversed(kept):
                into = carry + part[i]
                live = np.where(m, into, 0)
                da = live * (1 - z) * (1 - new * new)
                dz, dr = live * (before - new) * z * (1 - z), da * sn * r * (1 - r)
                dx, ds = np.concatenate([dz, dr, da], 1), np.concatenate([dz, dr, da * r], 1)
                np.add.at(g[f"x{d}"], x[i], dx)
                g[f"c{d}"] += dx.sum(0)
                g[f"u{d}"] += before.T @ ds
                carry = np.where(m, live * z + ds @ u.T, into)
        return loss, g


def fit(samples: dict[str, list[bytes]], rejects: bool = False) -> Network:
    """A network for the languages of ``samples``, and perhaps for none of them; each step sees all classes alike."""
    if rejects:
        samples = samples | {REJECT: strangers(samples)}
    langs = sorted(k for k, v in samples.items() if v)
    net, rng = Network(langs), np.random.default_rng(SEED)
    words = [sorted(samples[k], key=lambda w: (len(w), w)) for k in langs]
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    s = {k: np.zeros_like(v) for k, v in net.w.items()}
    each = max(1, BATCH // len(langs))
    for step in range(1, STEPS + 1):
        at = rng.random()  # runs of about one length, so that little is padding
        pick, y = [], []
        for k, w in enumerate(words):
            place = np.clip(at + 0.15 * (rng.random(each) - 0.5), 0, 1) * (len(w) - 1)
            pick += [w[int(i)] for i in place]
            y += [k] * each
        loss, g = net.gradient(*_pad(pick), np.array(y))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k in net.w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] * g[k]
            net.w[k] = (net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def sample_pieces(train: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[bytes]]:
    """Pieces of PER_LANG documents a language, whose number doesn't grow with the data."""
    rows = train.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    share = {r.lang: PER_LANG / r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    shares = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 20)) < shares[F.col("lang")] * (1 << 20))

    def spread(batches):
        for b in batches:
            langs, out = [], []
            for ident, text, lang in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                starts = range(0, len(raw), PIECE)
                if len(starts) > PIECES:
                    starts = np.random.default_rng(zlib.crc32((ident or "").encode())).choice(len(raw) - PIECE, PIECES, replace=False)
                for lo in starts:
                    while lo < len(raw) and raw[lo] & 0xC0 == 0x80:  # pieces begin at whole characters
                        lo += 1
                    langs.append(lang)
                    out.append(raw[lo : lo + PIECE])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "piece"])

    got: dict[str, list[bytes]] = {k: [] for k in share}
    for r in chosen.mapInArrow(spread, "lang string, piece binary").collect():
        got[r.lang].append(bytes(r.piece))
    return got


def label_positions(net: Network, text: str) -> list[str]:
    """The most probable language at each byte."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out = []
    for _, start, n, lo, hi in zip(*windows(raw, np.array([0, len(raw)])), strict=True):
        p = net.positions(raw[start : start + n, None], None)[lo:hi, :, 0]
        out += [net.langs[i] for i in p.argmax(1)]
    return out


def predict(docs: DataFrame, is_train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score"), rejects: bool = False) -> DataFrame:
    """The columns ``carry`` (id_col), lang_pred, score for every row; learns from the rows where ``is_train`` holds.

    ``rejects``: a text that is more probably in none of the learned languages than in the best of them is "und", too.
    """
    carried = carry or [id_col]
    samples = sample_pieces(docs.where(is_train), id_col, text_col, lang_col)
    net = fit(samples, rejects) if any(samples.values()) else None
    at_text = carried.index(text_col) if text_col in carried and dict(docs.dtypes)[text_col] == "string" else len(carried)

    def run(batches):
        for b in batches:
            for part in text_slices(b, at_text, AT_ONCE):
                texts = [t if net and t and any(map(str.isalpha, t)) else "" for t in part.column(at_text).to_pylist()]
                raw = [t.encode() for t in texts]
                edges = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
                langs, scores = [UND] * len(raw), [0.0] * len(raw)
                if edges[-1]:
                    p = net.documents(np.frombuffer(b"".join(raw), np.uint8), edges)
                    for i in np.flatnonzero(np.diff(edges)):
                        langs[i], scores[i] = net.langs[int(p[i].argmax())], min(1.0, max(0.0, float(p[i].max())))
                        if langs[i] == REJECT:
                            langs[i], scores[i] = UND, 0.0
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carried)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*carried, *names])

    rows = docs.select(*carried, *([F.col(text_col).cast("string").alias("__text")] if at_text == len(carried) else []))
    schema = T.StructType([docs.schema[c] for c in carried]).add(names[0], "string").add(names[1], "double")
    return rows.mapInArrow(lean(run), schema)
