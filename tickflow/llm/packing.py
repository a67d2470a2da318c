"""Compressed texts for shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tickflow.llm.shared import chunks, released, written


def packed_texts(docs: DataFrame) -> DataFrame:
    """(id, packed): ``doc_id`` and the compressed text of each row; a null text is packed as empty."""

    @released
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in chunks(batches, "text"):
            packed = [squeeze((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "packed"])

    return docs.select(docs["doc_id"].cast("long").alias("id"), "text").mapInArrow(pack, "id long, packed binary")


def blocks(batches: Iterator[pa.RecordBatch], block_bytes: int = 8 << 20) -> Iterator[tuple[int, list, list[str]]]:
    """(block id, doc ids, texts) of batches (doc_id, text): bounded, and the id follows from the documents alone."""
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> tuple[int, list, list[str]]:
        ids = [x for b in held for x in b.column(0).to_pylist()]
        texts = [x or "" for b in held for x in b.column(1).to_pylist()]
        name = xxhash.xxh64_intdigest(repr([(i, len(t)) for i, t in zip(ids, texts, strict=True)]))
        return name - (1 << 63), ids, texts

    for batch in chunks(batches, "text", block_bytes // 8):
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= block_bytes:
            yield block()
            held, size = [], 0
    if held:
        yield block()


def packed_blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_id, packed) of every row."""

    @released
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for block, ids, texts in blocks(batches):
            for at in range(0, len(ids), 1000):
                packed = [squeeze(t.encode()) for t in texts[at : at + 1000]]
                names = pa.array([block] * len(packed), pa.int64())
                arrays = [names, pa.array(ids[at : at + 1000], pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "doc_id", "packed"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(pack, "block long, doc_id long, packed binary")


def stored_blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_id, packed) of every row, written once: all later readings see the same blocks.

    A block's name is that of its task and its number there, so equal blocks keep apart.
    """

    @released
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        first = TaskContext.get().partitionId() << 32
        for k, (_, ids, texts) in enumerate(blocks(batches)):
            for at in range(0, len(ids), 1000):
                packed = [squeeze(t.encode()) for t in texts[at : at + 1000]]
                arrays = [pa.array([first + k] * len(packed), pa.int64()), pa.array(ids[at : at + 1000], pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "doc_id", "packed"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(pack, "block long, doc_id long, packed binary"), compression="uncompressed")


def unpacked_blocks(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[tuple[int, list, list[bytes]]]:
    """(block, doc ids, texts) of rows (block, doc_id, packed): pieces of one block of about ``max_bytes``."""
    unpack = zstandard.ZstdDecompressor().decompress
    name, ids, texts, size = None, [], [], 0
    for batch in batches:
        for block, doc_id, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if texts and (block != name or size >= max_bytes):
                yield name, ids, texts
                ids, texts, size = [], [], 0
            name = block
            ids.append(doc_id)
            texts.append(unpack(packed))
            size += len(texts[-1])
    if texts:
        yield name, ids, texts


def unpack_texts(column: pa.Array) -> list[str]:
    return [x.decode() for x in unpack_bytes(column)]


def unpack_bytes(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in column.to_pylist()]
