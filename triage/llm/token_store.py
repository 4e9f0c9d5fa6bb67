"""Token files: whole texts as ids, frequency-ranked and byte-aligned, in document order.

Format: a parquet table of blocks, one row each, in ascending ``part`` and
``block``.  A block lists its documents (``doc_ids``, ``lengths``), the ids it
uses by falling frequency (``ranked``: rank -> id), and its ids as ranks in
byte-aligned variable-length coding: ``data`` holds 1 to 4 little-endian bytes
for each rank, ``control`` two bits for each that give the number of bytes,
four to a byte.  Frequent ids have small ranks and take one byte.  Ranks are
counted in each block, so writing needs one pass over the texts, reading needs
nothing but the block, and a lost task is written again alone.

Edge cases: a null or empty text has only the end id; null ``doc_id``s come
first; rows with equal ``doc_id`` are all stored, ordered by text; a text of any
length is one document of one block.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch
from .encoding import encoder

BLOCK_IDS = 1 << 20
BLOCKS = "part int, block int, first long, n_ids long, doc_ids array<long>, lengths array<long>, ranked array<int>, control binary, data binary"
DOCUMENTS = "part int, doc_id long, first long, n_tokens long, ids_crc32 long"


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    sizes = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = sizes - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


#: Number of bytes of each of the four values under a control byte.
SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The values again: sizes by table lookup, then one gather for each byte place."""
    sizes = SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(sizes) - sizes
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    values = raw[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(sizes > k)
        values[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def _blocks(tokenizer_path: str, end_id: int, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, spaces=True).encode
        part = TaskContext.get().partitionId()
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ranked", pa.list_(pa.int32())), ("control", pa.binary()), ("data", pa.binary())])
        block, first, held, docs, n = 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held, docs, n
            ids = np.concatenate(held)
            counts = np.bincount(ids)
            ranked = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
            rank = np.zeros(len(counts), np.uint32)
            rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
            control, data = pack(rank[ids])
            row = pa.RecordBatch.from_pylist([{"part": part, "block": block, "first": first, "n_ids": n, "doc_ids": docs, "lengths": [len(x) for x in held], "ranked": ranked, "control": control, "data": data}], schema)
            block, first, held, docs, n = block + 1, first + n, [], [], 0
            return row

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(_texts(batch["text"]))):
                held.append(np.append(ids, np.int32(end_id)))
                docs.append(doc_id)
                n += len(ids) + 1
                if n >= block_ids:
                    yield flush()
        if held:
            yield flush()

    return write


def _texts(column: pa.Array) -> Iterator[str | None]:
    """The texts one by one, so that a batch is not held twice."""
    return (x.as_py() for x in column)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> str:
    """Encode every whole text, append ``end_id`` and write the token files; their path.

    One shuffle deals the texts out by ranges of ``doc_id``; a task holds one
    block of ids at a time (or one document, where that is longer).
    """
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.save(ordered.mapInArrow(_blocks(tokenizer_path, end_id, block_ids), BLOCKS), "tokens")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch[name][k] for name in batch.schema.names}
            lengths = row["lengths"].values.to_numpy()
            ranked = row["ranked"].values.to_numpy().astype("<u4")
            ids = ranked[unpack(row["control"].as_py(), row["data"].as_py(), int(lengths.sum()))]
            ends = np.cumsum(lengths)
            crcs = [zlib.crc32(ids[e - n : e].tobytes()) for n, e in zip(lengths, ends)]
            part = pa.array(np.full(len(lengths), row["part"].as_py(), np.int32))
            yield pa.RecordBatch.from_arrays([part, row["doc_ids"].values, pa.array(row["first"].as_py() + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], schema=schema)


def read_tokens(spark, path: str) -> DataFrame:
    """Decode the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    A document's start adds its part's base, from one row for each part
    (that bounds the broadcast), to its place in the part.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = blocks.select("part", "first", "doc_ids", "lengths", "ranked", "control", "data").mapInArrow(_decoded, DOCUMENTS)
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
