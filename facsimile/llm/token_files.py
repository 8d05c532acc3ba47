"""Token ids in files of byte planes: fixed-size blocks, transposed, zstandard-compressed, with an index.

A data set is a Parquet table with one row a chunk: its place (``shard``, ``chunk``),
the ids and documents it holds and ``payload``, the chunk in this library's format:

    header   magic, bytes an id, block length, ids, blocks
    index    for each block and plane the length of its compressed bytes
    planes   the compressed planes one after the other

Plane j of a block holds byte j of each of its ids, so the nearly constant high bytes
stand together.  Chunks hold whole documents, so any chunk can be read on its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facsimile.llm.common import arrow_limits
from facsimile.llm.encode import encoder
from facsimile.session import default_parallelism

MAGIC = b"IDPL"
BLOCK = 1 << 14            # ids a block
CHUNK = 1 << 17            # ids after which a chunk is closed
LEVEL = 3
_HEAD = struct.Struct("<4sBIQI")


def pack_ids(ids: np.ndarray, block: int = BLOCK, level: int = LEVEL) -> bytes:
    """One chunk: unsigned 32-bit ids as compressed byte planes with their index."""
    ids = np.ascontiguousarray(ids, "<u4")
    width = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 1
    zip_ = zstandard.ZstdCompressor(level=level)
    planes = [zip_.compress(np.ascontiguousarray(ids[i:i + block].view(np.uint8).reshape(-1, 4)[:, j]).tobytes())
              for i in range(0, len(ids), block) for j in range(width)]
    head = _HEAD.pack(MAGIC, width, block, len(ids), len(planes) // width)
    return head + np.array([len(p) for p in planes], "<u4").tobytes() + b"".join(planes)


def unpack_ids(payload: bytes) -> np.ndarray:
    """The ids of a chunk written by :func:`pack_ids`."""
    magic, width, block, n, blocks = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a chunk of byte planes")
    sizes = np.frombuffer(payload, "<u4", width * blocks, _HEAD.size)
    at = _HEAD.size + 4 * len(sizes)
    unzip = zstandard.ZstdDecompressor()
    out = np.zeros((n, 4), np.uint8)
    for k, size in enumerate(sizes.tolist()):
        lo = k // width * block
        m = min(block, n - lo)
        out[lo:lo + m, k % width] = np.frombuffer(unzip.decompress(payload[at:at + size], max_output_size=m), np.uint8)
        at += size
    return out.view("<u4").ravel()


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
              text_col: str = "text") -> None:
    """Encode whole texts in ascending id order and write them as chunks under ``path``.

    Every document ends with ``end_id``; a null text is empty.  Rows with one id stand
    together in an order that depends on their texts alone; a null id comes first.  The
    texts are dealt by ranges of the id, so shards follow each other in id order.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    src = src.repartitionByRange(default_parallelism(spark), "id").sortWithinPartitions("id", "text")
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("first_doc", pa.int64()),
                        ("n_ids", pa.int64()), ("ids_of", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                        ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        shard, chunk, done = TaskContext.get().partitionId(), 0, 0
        held, names, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal chunk, done, held, names, size
            lengths = [len(x) for x in held]
            out = pa.RecordBatch.from_pylist([dict(
                shard=shard, chunk=chunk, first_doc=done, n_ids=size, ids_of=names, lengths=lengths,
                payload=pack_ids(np.concatenate(held)))], schema)
            chunk, done, held, names, size = chunk + 1, done + len(names), [], [], 0
            return out

        for b in batches:
            ids, limits = enc.encode(b.column(1))
            for name, lo, hi in zip(b.column(0).to_pylist(), limits[:-1].tolist(), limits[1:].tolist()):
                held.append(np.append(ids[lo:hi], np.uint32(end_id)))
                names.append(name)
                size += hi - lo + 1
                if size >= CHUNK:
                    yield close()
        if held:
            yield close()

    out = src.mapInArrow(run, "shard int, chunk long, first_doc long, n_ids long, ids_of array<long>, "
                              "lengths array<long>, payload binary")
    out.write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids): every document of the data set at ``path`` with its ids.

    ``ids`` is binary, little-endian unsigned 32-bit; ``start`` counts the ids of all
    documents before it.  Where each chunk starts comes from the chunk index alone: a
    running sum inside a shard over the sums of the shards before.
    """
    table = spark.read.parquet(path)
    index = table.select("shard", "chunk", "n_ids")
    # one row a shard: as many rows as there are partitions
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    inner = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n_ids")
    starts = (index.withColumn("inner", inner).join(base, "shard")
              .select("shard", "chunk", (F.col("base") + F.col("inner")).alias("at")))
    chunks = table.select("shard", "chunk", "ids_of", "lengths", "payload").join(starts, ["shard", "chunk"])
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                names, lengths, payload, at = (b.column(c)[i].as_py() for c in ("ids_of", "lengths", "payload", "at"))
                ids = unpack_ids(payload)
                ends = np.cumsum(lengths)
                parts = [x.tobytes() for x in np.split(ids, ends[:-1])] if names else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(at + ends - lengths), pa.array(lengths, pa.int64()),
                     pa.array(parts, pa.binary())], schema=schema)

    return chunks.mapInArrow(run, "id long, start long, n_tokens long, ids binary")
