"""Ids of a public tokenizer, each distinct chunk of a batch of texts encoded once."""

from __future__ import annotations

import contextlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain, groupby
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Keys longer than this aren't kept; a worker keeps up to twice so many in a partition, and reads so many bytes of text at once.
CHUNK_CHARS, KEPT, AT_ONCE = 40, 120_000, 4 << 20
WORDS = 10_000  # given to the model at once: its tokens are objects
ALONE = 1000  # characters from which on the tokenizer gets a text by itself
_ID = attrgetter("id")
#: Where the byte-level pattern starts a new piece whatever precedes: before a space that stands
#: between visible characters, and around runs of white space.
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space to Python, but not to the tokenizers.
_ODD = re.compile("[\0\x1c-\x1f]")
#: Texts whose gaps are other than single spaces and line ends.
_GAPS = r"[\x00\t\x0B\x0C\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ \n][ \n]"
#: One piece of letters, perhaps with a space before: the model alone gives its ids.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_HEAD = rf"\A{_PLAIN.pattern}\z"
_HEAD_CHARS = " " + "".join(c for c in map(chr, range(256)) if _PLAIN.fullmatch(c))
#: Marks that are one piece of their own behind letters, however many (an apostrophe may begin a piece with letters).
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def _byte_letters() -> np.ndarray:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = np.arange(256, dtype="<u2")
    letters[hidden] = 256 + np.arange(len(hidden))
    return letters


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_slices(batch: pa.RecordBatch, column: int, at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``at_once`` bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = int(size[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, before + at_once, "right")))
        yield batch.slice(lo, hi - lo)
        pa.default_memory_pool().release_unused()  # what was made of a slice isn't kept for the next
        lo = hi


def trim(keeps: bool = False) -> None:
    """Lets this worker give unused memory back and, unless it ``keeps`` them, forget its chunks."""
    import ctypes

    for e in () if keeps else _ENCODERS.values():
        e.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run, keeps: bool = False):
    """``run`` of a mapInArrow whose worker is trimmed when a partition is done: other stages use it again.

    ``keeps``: the next partition finds the chunks of this one, of which there is a bounded number.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim(keeps)

    return whole


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of ``flat`` one after the other."""
    end = np.cumsum(size)
    return flat[np.repeat(start - (end - size), size) + np.arange(len(end) and end[-1])]


class Encoder:
    """``encode(texts)``: the ids of all texts, and where each text's ids begin (with the end).

    A chunk keeps the space before it; ``drops_space``: the tokenizer discards white space and the case of letters, so
    any blank is a space. No piece of either tokenizer reaches over a chunk's edge, so ids of chunks joined
    are the ids of the text. A text in which an added token is spelled out is encoded whole: the tokenizer cuts it there
    before anything else.
    """

    def __init__(self, path: str, drops_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.drops = Tokenizer.from_file(path), drops_space
        self.model, self.letters = self.tok.model, _byte_letters()
        self.letters[ord("\n")] = ord("\n")  # stands between keys here, and is in none of plain letters
        self.kept = KEPT // 2 if drops_space else KEPT  # chunks are words there: fewer, and longer
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Drops all keys with their ids (``flat``), how many each has, and in how many slices it was."""
        self.keys, self.flat = pa.array([], pa.large_string()), np.empty(0, "<u4")
        self.size, self.uses = np.empty(0, np.int64), np.empty(0, np.int64)

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for long, some in groupby(texts, lambda t: len(t) > ALONE):
            for part in ([t] for t in some) if long else (list(some),):
                out += [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _ids(self, plain: pa.Array, rest: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new keys, those of plain letters first, and how many each has."""
        lines = "\n".join(plain.to_numpy(zero_copy_only=False).tolist())
        lines = lines.lower().replace(" ", "") if self.drops else lines
        seen = self.letters[np.frombuffer(lines.encode(), np.uint8)].tobytes().decode("utf-16-le").split("\n") if len(plain) else []
        size, flat = [], []
        for lo in range(0, len(seen), WORDS):
            pieces = list(map(self.model.tokenize, seen[lo : lo + WORDS]))
            size += map(len, pieces)
            flat.append(array("I", map(_ID, chain.from_iterable(pieces))).tobytes())
        whole = self._whole(rest.to_numpy(zero_copy_only=False).tolist())
        size += (len(x) // 4 for x in whole)
        return np.frombuffer(b"".join(flat + whole), "<u4"), np.array(size, np.int64)

    def _known(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each distinct key begin and how many they are; new keys are kept."""
        row = pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(row < 0)
        plain = pc.match_substring_regex(keys.take(pa.array(fresh)), _HEAD).to_numpy(zero_copy_only=False)
        parts = fresh[plain], fresh[~plain]
        fresh, new = np.concatenate(parts), [keys.take(pa.array(x)) for x in parts]
        ids, n = self._ids(*new)
        self.uses[row[row >= 0]] += 1
        row[fresh] = len(self.size) + np.arange(len(fresh))
        self.keys, self.flat = pa.concat_arrays([self.keys, *new]), np.concatenate([self.flat, ids])
        self.size, self.uses = np.concatenate([self.size, n]), np.concatenate([self.uses, np.ones(len(n), np.int64)])
        flat, start = self.flat, np.cumsum(self.size) - self.size
        found = flat, start[row], self.size[row]
        keep = np.flatnonzero(pc.less_equal(pc.utf8_length(self.keys), CHUNK_CHARS).to_numpy(zero_copy_only=False))
        if full := len(keep) > 2 * self.kept:  # half of it goes: what was in the fewest slices, the oldest first
            keep = np.sort(keep[np.argsort(self.uses[keep], kind="stable")[-self.kept :]])
        if len(keep) < len(self.size):
            self.keys, self.flat = self.keys.take(pa.array(keep)), _gather(flat, start[keep], self.size[keep])
            self.size, self.uses = self.size[keep], self.uses[keep] // (2 if full else 1)
        return found

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks one after the other, and how many each has: letters and the marks behind them apart."""
        heads = pc.ascii_rtrim(chunks, characters=_MARKS)
        plain = pc.match_substring_regex(heads, _HEAD)
        tails = pc.if_else(plain, pc.utf8_ltrim(chunks, characters=_HEAD_CHARS), pa.scalar("", pa.large_string()))
        both = pa.concat_arrays([pc.if_else(plain, heads, chunks), tails]).dictionary_encode()
        flat, start, size = self._known(both.dictionary)
        pairs = both.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.ravel()
        return _gather(flat, start[pairs], size[pairs]), size[pairs].reshape(-1, 2).sum(1)

    def _begins(self, texts: pa.Array, named: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each byte whether a chunk begins there; named texts are one chunk."""
        begins = data == 32
        if not self.drops:
            line = data == 10
            begins |= line
            begins[1:] |= line[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        for i in np.flatnonzero(named).tolist():
            begins[offsets[i] + 1 : offsets[i + 1]] = False
        odd = () if self.drops else np.flatnonzero(pc.match_substring_regex(texts, _GAPS).to_numpy(zero_copy_only=False) & ~named).tolist()
        for i in odd:
            begins[offsets[i] + 1 : offsets[i + 1]] = False
            text = texts[i].as_py()
            if not _ODD.search(text):
                size = np.array([len(x.encode()) for x in _SPACED.findall(text)])
                begins[offsets[i] + np.cumsum(size[:-1])] = True
        return begins

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        named = np.zeros(len(texts), bool)
        for name in self.added:
            named |= pc.match_substring(texts, name, ignore_case=True).to_numpy(zero_copy_only=False)
        if self.drops:
            even = texts
            for gap in "\n\t\r":
                even = pc.replace_substring(even, gap, " ")
            even = pc.ascii_lower(even)  # not before: of a slice, whose first offset isn't 0, it makes wrong offsets
            texts = pc.if_else(pa.array(named), texts, even) if named.any() else even
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        first = np.flatnonzero(self._begins(texts, named, data, offsets))
        chunks = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.append(first, len(data))), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        flat, size = self._chunks(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = size[which]
        ids = _gather(flat, (np.cumsum(size) - size)[which], n)
        return ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(first, offsets)]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """This worker's encoder; what it keeps of chunks it keeps for one partition."""
    if (path, drops_space) not in _ENCODERS:
        _ENCODERS[path, drops_space] = Encoder(path, drops_space)
    return _ENCODERS[path, drops_space]
