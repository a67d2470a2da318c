"""Media columns: payloads as lossless images in archives, read by a data source.

The writer stores each payload as an 8-bit grey PNG of fixed width in zip
archives of bounded size (members are stored, not packed again), under temporary
names that are renamed when an archive is whole; a manifest lists what counts.
The data source ``media_archive`` plans partitions as byte ranges over the
archives, streams the members that start in a range as Arrow batches of bounded
size, and reads each member by its own offset, again and on a new handle if a
read or a checksum fails.

Defined results for odd input
-----------------------------
* null or empty payload: one row of the image, all padding;
* null ids and repeated rows: a member each; ids are only part of its name;
* an empty table: a manifest without archives and no rows;
* payloads of any length: height grows; further columns are ignored.
"""

from __future__ import annotations

import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEMBER_SCHEMA = "doc_id long, n_bytes long, media binary"


def pad(payload: bytes) -> bytes:
    """Spaces up to a positive multiple of the width."""
    return payload + b" " * (max(1, -(-len(payload) // WIDTH)) * WIDTH - len(payload))


def to_png(samples: bytes) -> bytes:
    """Samples, a multiple of the width, as a grey image without row filters."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw, 5)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples (height, width) of an image that ``to_png`` made; checksums are verified."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, shape, packed = 8, None, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != int.from_bytes(media[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", data)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit grey")
            shape = height, width
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Height, mean, spread, and mean step along the rows, from integer sums."""
    x = samples.astype(np.int64)
    step = np.abs(np.diff(x, axis=1)).sum()
    return f"{x.shape[0]}x{x.shape[1]};sum={x.sum()};sq={(x * x).sum()};min={x.min()};max={x.max()};step={step}"


class _Sink(io.RawIOBase):
    """What ``zipfile`` needs of a stream that only grows."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def seekable(self) -> bool:
        return False

    def tell(self) -> int:
        return self.at


def write_archives(docs: DataFrame, where: str, archive_bytes: int = 32 << 20) -> int:
    """Store (doc_id, payload binary) under ``where``; the number of archives."""
    filesystem, top = fs.FileSystem.from_uri(where)
    filesystem.create_dir(top, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, folder = fs.FileSystem.from_uri(where)
        done, packer, name, seq = [], None, "", 0

        def close() -> None:
            packer.close()
            sink.out.close()
            own.move(f"{folder}/.{name}.tmp", f"{folder}/{name}")
            done.append((name, sink.at))

        for batch in batches:
            for doc_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if packer is None:
                    name = f"{uuid.uuid4().hex}.zip"  # a task that runs again writes other archives; the manifest has one set
                    sink = _Sink(own.open_output_stream(f"{folder}/.{name}.tmp", compression=None))
                    packer, seq = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED), 0
                payload = payload or b""
                member = zipfile.ZipInfo(f"{seq}_{'null' if doc_id is None else doc_id}_{len(payload)}.png")
                packer.writestr(member, to_png(pad(payload)))
                seq += 1
                if sink.at >= archive_bytes:
                    close()
                    packer = None
        if packer is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["name", "bytes"]
        )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("payload").cast("binary"))
    archives = sorted(tuple(r) for r in rows.mapInArrow(write, "name string, bytes long").collect())
    temp = f"{top}/.manifest.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(temp, compression=None) as out:
        out.write(json.dumps(archives).encode())
    filesystem.move(temp, f"{top}/manifest.json")
    return len(archives)


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


def read_member(open_archive: Callable, info: zipfile.ZipInfo, attempts: int = 3, wait: float = 0.2) -> bytes:
    """One stored member by its offset, on a new handle for each attempt; checked against its CRC."""
    for attempt in range(attempts):
        try:
            with open_archive() as f:
                f.seek(info.header_offset)
                head = f.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError(f"no member at {info.header_offset}")
                name, extra = struct.unpack("<HH", head[26:30])
                f.seek(info.header_offset + 30 + name + extra)
                data = f.read(info.file_size)
            if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                raise ValueError(f"damaged member {info.filename}")
            return data
        except (OSError, ValueError):
            if attempt + 1 == attempts:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.where = options["path"]
        self.range_bytes = int(options.get("range_bytes", 8 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))

    def partitions(self) -> list[InputPartition]:
        filesystem, top = fs.FileSystem.from_uri(self.where)
        with filesystem.open_input_stream(f"{top}/manifest.json", compression=None) as f:
            archives = json.loads(f.read())
        plan = [ByteRange(n, at, at + self.range_bytes) for n, size in archives for at in range(0, size, self.range_bytes)]
        return plan or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        filesystem, top = fs.FileSystem.from_uri(self.where)
        path = f"{top}/{partition.archive}"
        with filesystem.open_input_file(path) as f:
            listed = zipfile.ZipFile(f).infolist()
        members = [m for m in listed if partition.start <= m.header_offset < partition.end]
        rows: list[tuple] = []
        held = 0
        # The members of a range are read in one pass; only what fails is read again alone.
        with filesystem.open_input_file(path) as f:
            for m in members:
                try:
                    f.seek(m.header_offset)
                    head = f.read(30)
                    f.seek(m.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])))
                    media = f.read(m.file_size)
                    if head[:4] != b"PK\x03\x04" or zlib.crc32(media) != m.CRC:
                        raise ValueError(m.filename)
                except (OSError, ValueError, struct.error):
                    media = read_member(lambda: filesystem.open_input_file(path), m)
                _, doc_id, n_bytes = m.filename.removesuffix(".png").split("_")
                rows.append((None if doc_id == "null" else int(doc_id), int(n_bytes), media))
                held += len(media)
                if held >= self.batch_bytes:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.binary())
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, where: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").load(where)


def features(members: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload, media and feature, from the stored bytes alone."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = [from_png(m) for m in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([s.tobytes() for s in samples], pa.binary()),
                    pa.array([feature(s) for s in samples], pa.string()),
                ],
                ["doc_id", "n_bytes", "media", "payload", "feature"],
            )

    return members.mapInArrow(decode, MEMBER_SCHEMA + ", payload binary, feature string")
