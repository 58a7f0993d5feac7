"""Token-id files: each document compressed alone against one shared dictionary.

A file is a row (part, block, start_in_part, dict_hash, doc_ids, ends, sizes, frames) of a Parquet table,
so Spark's committers, not this code, deal with lost executors, and any store that Spark writes will do.
``frames`` holds one zstandard frame for each document, ``ends`` where each ends and ``sizes`` how many
ids it has: a single document is read by slicing ``frames``. The dictionary, trained on the serialized ids
of a bounded sample (PIECES pieces of about SAMPLE_DOCS documents, picked by a hash), is a one-row table beside it.

Defined results: null text is encoded as empty (its only id is the end id); rows are in ascending order of
doc_id, null first, and rows with equal doc_id in order of their text's hash; an empty table gives empty files.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize
from .tokens import encoder, lean, text_slices

SAMPLE_DOCS, PIECES, PIECE_IDS, DICT_BYTES, LEVEL = 512, 8, 1024, 65_536, 3
BLOCK_DOCS, BLOCK_BYTES, PART_BYTES = 4096, 4 << 20, 128 << 20
KIND = np.dtype("<u2")  # both public BPE vocabularies have fewer than 65,536 ids; checked on writing


def serialize(ids: np.ndarray) -> bytes:
    if len(ids) and ids.max() >= 1 << 16:
        raise ValueError("an id does not fit 16 bits")
    return ids.astype(KIND).tobytes()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples their bytes as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


@functools.lru_cache(2)
def _dictionary(data: bytes):
    import zstandard

    if not data:
        return None
    shared = zstandard.ZstdCompressionDict(data)
    shared.precompute_compress(level=LEVEL)  # else it is digested anew for each document
    return shared


def _samples(rows: DataFrame, tokenizer: str) -> list[bytes]:
    """Serialized pieces of about SAMPLE_DOCS documents picked by a hash threshold, spread over the whole of each."""
    n = rows.count()
    chosen = rows if n <= SAMPLE_DOCS else rows.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 40)) < int(SAMPLE_DOCS / n * (1 << 40)))

    def pieces(batches):
        for b in batches:
            for part in text_slices(b, 1):
                ids, at = encoder(tokenizer, False).encode(part.column(1))
                out = []
                for lo, hi in zip(at, at[1:], strict=False):
                    starts = range(lo, hi, PIECE_IDS)
                    out += [serialize(ids[x : min(x + PIECE_IDS, hi)]) for x in starts[:: math.ceil(len(starts) / PIECES) or 1]]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["piece"])

    return sorted(bytes(r.piece) for r in chosen.mapInArrow(pieces, "piece binary").collect())


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode, compress and write all documents under ``path``; returns the stored blocks."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    data = train_dictionary(_samples(rows, tokenizer))
    digest = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(digest, bytearray(data))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def compress(batches):
        import zstandard

        shared = _dictionary(data)
        make = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared) if shared else zstandard.ZstdCompressor(level=LEVEL)
        end = np.array([end_id], "<u4")
        for b in batches:
            for part in text_slices(b, 1):
                ids, at = encoder(tokenizer, False).encode(part.column(1))
                frames = [make.compress(serialize(np.append(ids[lo:hi], end))) for lo, hi in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(at) + 1), pa.array(frames, pa.binary())], ["doc_id", "h", "size", "frame"])

    # What is put in order are the compressed frames, not the texts; written first, as finding the ranges reads ids twice.
    encoded = materialize(rows.withColumn("h", F.xxhash64("text")).select("doc_id", "text", "h").mapInArrow(lean(compress, keeps=True), "doc_id long, h long, size long, frame binary"), "frames")

    def pack(batches):
        part, block, start = TaskContext.get().partitionId(), 0, 0
        ids_, sizes, frames, size = [], [], [], 0

        def flush():
            ends = np.cumsum([len(f) for f in frames])
            row = {"part": [part], "block": [block], "start_in_part": [start], "dict_hash": [digest], "doc_ids": [ids_], "ends": [ends], "sizes": [sizes], "frames": [b"".join(frames)]}
            return pa.RecordBatch.from_pydict(row, schema=to_arrow)

        to_arrow = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("start_in_part", pa.int64()), ("dict_hash", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("frames", pa.binary())])
        for b in batches:
            for doc_id, n, frame in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids_.append(doc_id)
                sizes.append(n)
                frames.append(frame)
                size += len(frame)
                if len(ids_) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield flush()
                    start, block = start + sum(sizes), block + 1
                    ids_, sizes, frames, size = [], [], [], 0
        if ids_:
            yield flush()

    bytes_ = encoded.agg(F.coalesce(F.sum(F.length("frame")), F.lit(0))).first()[0]
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), bytes_ // PART_BYTES, 1)
    ordered = encoded.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "size", "frame")
    schema = "part long, block long, start_in_part long, dict_hash string, doc_ids array<long>, ends array<long>, sizes array<long>, frames binary"
    ordered.mapInArrow(pack, schema).write.parquet(f"{path}/blocks")
    return spark.read.schema(schema).parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every stored document: doc_id, start (ids before it), n_tokens, ids_crc32, and ids on demand."""
    blocks = spark.read.parquet(f"{path}/blocks")
    dictionary = spark.read.parquet(f"{path}/dictionary").first()
    data, digest = bytes(dictionary.dictionary), dictionary.dict_hash

    def unpack(batches):
        import zstandard

        shared = _dictionary(data)
        read = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
        for b in batches:
            for r in b.to_pylist():
                if r["dict_hash"] != digest:
                    raise ValueError("these frames need another dictionary")
                frames, lo, start, out = memoryview(r["frames"]), 0, r["start_in_part"], []
                for doc_id, end, n in zip(r["doc_ids"], r["ends"], r["sizes"], strict=True):
                    ids = np.frombuffer(read.decompress(frames[lo:end]), KIND).astype("<u4")
                    if len(ids) != n:
                        raise ValueError("a frame is damaged")
                    raw = ids.tobytes()
                    out.append((r["part"], doc_id, start, n, zlib.crc32(raw), raw if with_ids else None))
                    lo, start = end, start + n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "doc_id", "s", "n_tokens", "ids_crc32", "ids"])

    # One row for each range partition: their number, not the data's, bounds this window and broadcast.
    sums = blocks.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    docs = blocks.mapInArrow(unpack, "part long, doc_id long, s long, n_tokens long, ids_crc32 long, ids binary")
    out = docs.join(F.broadcast(before), "part").select("doc_id", (F.col("base") + F.col("s")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")
