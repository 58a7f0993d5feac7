"""MPEG transport streams as a binary column: multiplex bytes, and parse them back.

``mux`` stores each payload losslessly as 8-bit units of one private elementary stream: a program
association table, a program map table, then packetised elementary packets with presentation times,
clock references and random-access marks. ``demux`` reads only the stored bytes: it checks the tables'
checksums, follows the tables to the elementary stream, checks continuity counters and reassembles the
packets.

Defined results: null payloads are stored as empty; equal payloads give equal streams; a stream that
loses sync has ``errors`` > 0 and what could be read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET, SYNC, PMT_PID, ES_PID, STREAM_ID, STREAM_TYPE = 188, 0x47, 0x1000, 0x100, 0xBD, 0x06
UNIT, TICKS, GOP = 192 * 64, 3600, 8  # bytes an access unit, 90 kHz ticks between two, units between random-access points
PAD = 192


@functools.lru_cache(1)
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def crc_mpeg(data: bytes) -> int:
    """The tables' checksum: most significant bit first, all ones at the start, no final inversion."""
    c, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ t[(c >> 24) ^ b]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


@functools.lru_cache(1)
def _tables() -> bytes:
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
    out = b""
    for pid, s in ((0, pat), (PMT_PID, pmt)):
        out += bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + s + b"\xff" * (183 - len(s))
    return out


def _pts(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 1 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 1 | (t << 1) & 0xFE])


def mux_bytes(payload: bytes) -> bytes:
    out, cc, base = [_tables()], 0, ES_PID
    first, later = (0x4000 | base).to_bytes(2, "big"), base.to_bytes(2, "big")
    for k, lo in enumerate(range(0, max(1, len(payload)), UNIT)):
        t, unit = (k * TICKS) % (1 << 33), payload[lo : lo + UNIT]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(t) + unit
        if k % GOP == 0:  # random access, with the clock reference
            field = b"\x07\x50" + ((t << 15) | 0x7E00).to_bytes(6, "big")
        else:
            field = b""
        at, start = 0, True
        while at < len(pes):
            room = 184 - len(field)
            part = pes[at : at + room]
            at += len(part)
            if (lack := room - len(part)) > 0:  # stuffing goes into the adaptation field
                if field:
                    field = bytes([field[0] + lack]) + field[1:] + b"\xff" * lack
                else:
                    field = b"\x00" if lack == 1 else bytes([lack - 1, 0]) + b"\xff" * (lack - 2)
            out.append(b"\x47" + (first if start else later) + bytes([(0x30 if field else 0x10) | cc]) + field + part)
            cc, start, field = (cc + 1) & 15, False, b""
    return b"".join(out)


def _program(packets: np.ndarray, pid: int, table: int) -> bytes | None:
    """The first section of a pid, if its checksum holds."""
    for p in packets[pid == (((packets[:, 1] & 0x1F).astype(int) << 8) | packets[:, 2])][:1]:
        raw = p[4:].tobytes()
        s = raw[1 + raw[0] :]
        n = 3 + (int.from_bytes(s[1:3], "big") & 0xFFF)
        if len(s) > 3 and s[0] == table and n <= len(s) and crc_mpeg(s[:n]) == 0:
            return s[:n]
    return None


def demux_bytes(media: bytes) -> dict:
    """payload, errors (sync and continuity), and per access unit its time, place and whether it is a random-access point."""
    n = len(media) // PACKET
    p = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    errors = int((p[:, 0] != SYNC).sum()) + (len(media) % PACKET > 0)
    out = {"payload": b"", "errors": errors, "pts": [], "places": [], "access": [], "pid": -1, "stream_type": -1}
    pat = _program(p, 0, 0)
    pmt = pat and _program(p, int.from_bytes(pat[10:12], "big") & 0x1FFF, 2)
    if not pmt:
        return out | {"errors": errors + 1}
    at = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
    out["stream_type"], pid = pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    out["pid"] = pid
    p = p[(((p[:, 1] & 0x1F).astype(int) << 8) | p[:, 2]) == pid]
    control, cc = (p[:, 3] >> 4) & 3, p[:, 3] & 15
    p, control, cc = p[control & 1 == 1], control[control & 1 == 1], cc[control & 1 == 1]  # the counter moves only with payload
    out["errors"] += int(((cc[1:] - cc[:-1]) & 15 != 1).sum())
    skip = 4 + np.where(control == 3, p[:, 4].astype(int) + 1, 0)
    access = (control == 3) & (p[:, 4] > 0) & (p[:, 5] & 0x40 > 0)
    starts = np.flatnonzero(p[:, 1] & 0x40)
    if not len(starts) or starts[0]:  # no unit at all, or packets before the first one
        out["errors"] += 1
    if not len(starts):
        return out
    flat, parts, place = p.tobytes(), [], 0
    for a, b in zip(starts, [*starts[1:], len(p)], strict=True):
        pes = b"".join([flat[i * PACKET + skip[i] : (i + 1) * PACKET] for i in range(a, b)])
        size = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\x00\x00\x01" or len(pes) != size + 6:
            out["errors"] += 1
        if len(pes) < 14:  # cut off within its head: nothing can be told
            continue
        h = pes[9:14]
        out["pts"].append(((h[0] & 0x0E) << 29 | h[1] << 22 | (h[2] & 0xFE) << 14 | h[3] << 7 | h[4] >> 1) if pes[7] & 0x80 else None)
        body = pes[9 + pes[8] : 6 + size]
        out["places"].append(place)
        out["access"].append(bool(access[a]))
        parts.append(body)
        place += len(body)
    return out | {"payload": b"".join(parts)}


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % PAD or (0 if raw else PAD))


def mux(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One stream for each row: id_col, n_bytes, media."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                part = texts[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo : lo + 256], pa.array([len((t or "").encode()) for t in part], pa.int64()), pa.array([mux_bytes(padded(t)) for t in part], pa.binary())], [id_col, "n_bytes", "media"])

    rows = df.select(id_col, F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def demux(df: DataFrame, id_col: str = "doc_id", with_payload: bool = False) -> DataFrame:
    """What the stored streams hold: payload digests, and access units with their times, places and random-access points."""

    def run(batches):
        for b in batches:
            rows = []
            for media in (x or b"" for x in b.column(2).to_pylist()):
                d = demux_bytes(media)
                pay, units = d["payload"], len(d["pts"])
                feature = f"pid={d['pid']};type={d['stream_type']};units={units};access={sum(d['access'])};first={d['pts'][0] if units else -1};last={d['pts'][-1] if units else -1};errors={d['errors']}"
                row = {"payload_bytes": len(pay), "payload_sha256": hashlib.sha256(pay).hexdigest(), "tail_crc32": zlib.crc32(pay[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature, "errors": d["errors"]}
                row["units"] = [{"pts": t, "place": x, "access": a} for t, x, a in zip(d["pts"], d["places"], d["access"], strict=True)]
                rows.append(row | ({"payload": pay} if with_payload else {}))
            kind = pa.list_(pa.struct([("pts", pa.int64()), ("place", pa.int64()), ("access", pa.bool_())]))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "errors", "units", *["payload"] * with_payload]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), kind, *[pa.binary()] * with_payload]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=True)]], [id_col, "n_bytes", *names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, errors long, units array<struct<pts:long,place:long,access:boolean>>" + ", payload binary" * with_payload)
