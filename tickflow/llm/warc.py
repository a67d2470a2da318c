"""A deterministic sharded WARC writer and its reader.

Pages are sorted by id, then payload digest, in ranges of about equal bytes; each range
is written as gzip members, one per record, to files that roll by compressed size.
The bounds of the ranges come from a sample that hashes of the rows choose, so they follow
from the rows alone, whether ids are dense, sparse or repeated.
Headers and digests are made anew from the payload.  A file is written under a
temporary name and renamed; a manifest that names every file with its size and
digest is written last, in the same way, and the reader opens only what the
manifest names.  Dates and record ids come from parameters and page ids, so any
run over the same rows gives the same bytes, and a task that runs again
replaces its files by equal ones.

Of pages with equal payloads of at least ``min_dedup_bytes`` the one with the
largest id is written as ``response``, the others as ``revisit`` without payload.

Defined results for odd input
-----------------------------
* null html: an empty payload; null url: an empty target;
* a null page_id sorts first and is a response only where no page with an id has its
  payload; rows of one id, null too, may be dealt to many ranges, by their payloads;
* rows with equal id and payload are each written, all with the same type;
* a payload of any length is one record, held whole by the task that writes it;
* an empty table gives a manifest without files and no rows;
* further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.llm.shared import written

FILE_ROW = "name string, records long, bytes long, sha256 string"
READ_ROW = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}\n{url}')}>"


def record(page_id: int | None, url: str, payload: bytes, response: int | None, revisit: bool, date: str) -> bytes:
    """One record with its headers; ``response`` is the page that a revisit refers to."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, url)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
        ("WARC-Block-Digest", "sha1:" + sha1_base32(block)),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", str(response))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # the header's time is 0
    return packer.compress(data) + packer.flush()


class _Roller:
    """The open file of a shard; a file is renamed into place when it is full or the shard ends."""

    def __init__(self, where: str, max_bytes: int):
        self.fs, self.top = fs.FileSystem.from_uri(where)
        self.max_bytes, self.out = max_bytes, None

    def open(self, shard: int, roll: int) -> None:
        self.name = f"pages-{shard:012d}-{roll:05d}.warc.gz"
        self.temp = f"{self.top}/.{self.name}.{uuid.uuid4().hex}.tmp"
        self.out, self.records, self.bytes, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()

    def put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.records, self.bytes = self.records + 1, self.bytes + len(member)

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temp, f"{self.top}/{self.name}")
        self.out = None
        return self.name, self.records, self.bytes, self.sha.hexdigest()


#: What a record weighs beside its payload.
HEADER_BYTES = 512


def _positions(ids: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """16 bytes a row that sort as (id, head of the digest) does."""
    out = np.empty((len(ids), 2), ">u8")
    out[:, 0] = ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1] = heads.astype(np.uint64)
    return out.view("S16").ravel()


def _ranges(light: DataFrame, shard_bytes: int, min_shards: int, per_shard: int, most: int) -> np.ndarray:
    """The positions where ranges of about equal bytes begin, but for the first.

    They are cut from ``per_shard`` rows a range, ``most`` in all, of ``light``, whose rows have
    no repeats: the sample bears on the balance of the ranges only.
    """
    weight = F.col("bytes") + F.col("n") * HEADER_BYTES
    rows, total = light.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    n = max(min_shards, -(-total // shard_bytes))
    kept = int((1 << 32) * min(1.0, min(n * per_shard, most) / max(rows, 1)))
    drawn = light.filter(F.pmod(F.xxhash64("page_id", "sha1"), F.lit(1 << 32)) < kept).select(*_place(), weight).toPandas().to_numpy(np.int64)
    if n < 2 or not len(drawn):
        return np.zeros(0, "S16")
    at = _positions(drawn[:, 0], drawn[:, 1])
    order = np.argsort(at)
    at, upto = at[order], np.cumsum(drawn[order, 2].astype(np.float64))
    cuts = np.searchsorted(upto, upto[-1] * np.arange(1, n) / n)
    return np.unique(at[np.minimum(cuts, len(at) - 1)])


def _place() -> tuple[Column, Column]:
    """The two longs that rows are ranged by; the second grows with the digest."""
    return F.coalesce("page_id", F.lit(-(1 << 63))), F.conv(F.substr("sha1", F.lit(1), F.lit(15)), 16, 10).cast("long")


def write_warc(
    pages: DataFrame,
    where: str,
    min_dedup_bytes: int = 0,
    shard_bytes: int = 1 << 30,
    min_shards: int = 64,
    max_file_bytes: int = 64 << 20,
    date: str = "2024-01-01T00:00:00Z",
    sample_rows: int = 1_000_000,
) -> list[str]:
    """Write ``pages`` (page_id, url, html) to the folder ``where``; returns the file names.

    A range, one task's work, is ``shard_bytes`` of payload, or less where there would be fewer than
    ``min_shards`` ranges.  Only the manifest, a line per file, and at most about
    ``sample_rows`` sampled positions come to the driver.
    """
    filesystem, top = fs.FileSystem.from_uri(where)
    filesystem.create_dir(top, recursive=True)
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        html.alias("html"),
        F.sha1(F.encode(html, "UTF-8")).alias("sha1"),
        F.octet_length(html).cast("long").alias("size"),
    )
    # Only ids and digests are shuffled to find the copies; payloads move once, to their range.
    light = keyed.groupBy("page_id", "sha1").agg(F.min("size").alias("size"), F.sum("size").alias("bytes"), F.count("*").alias("n"))
    light = written(light)
    cuts = _ranges(light, shard_bytes, min_shards, 50, sample_rows)
    bounds = pages.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("long")
    def range_of(ids: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, _positions(ids.to_numpy(), heads.to_numpy()), side="right"))

    shard = range_of(*_place()).alias("shard")
    # The table of payloads that more than one page has is written, so that the join can split a payload of very many pages.
    first = light.filter(F.col("size") >= min_dedup_bytes).groupBy("sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("pages"))
    first = written(first.filter("pages > 1").select("sha1", "response"))
    copies = light.join(first, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("response")))
    none = F.lit(None).cast("string")
    copies = copies.select(shard, "page_id", F.lit(0).alias("kind"), none.alias("url"), none.alias("html"), "sha1", "response")
    payloads = keyed.select(shard, "page_id", F.lit(1).alias("kind"), "url", "html", "sha1", F.lit(None).cast("long").alias("response"))
    # Each range is a partition of its own; a copy's row comes before those of its page and payload.
    ranged = payloads.union(copies).repartitionById(len(cuts) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "sha1", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, done, shard, roll = _Roller(where, max_file_bytes), [], None, 0
        page, to = None, None
        for batch in batches:
            for at, page_id, kind, url, text, sha1, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (at, page_id, sha1) != page:
                    page, to = (at, page_id, sha1), None
                if kind == 0:
                    to = response
                    continue
                if at != shard or roller.out is None:
                    if roller.out is not None:
                        done.append(roller.close())
                    shard, roll = at, 0 if at != shard else roll + 1
                    roller.open(shard, roll)
                roller.put(gzip_member(record(page_id, url, text.encode(), to, to is not None, date)))
                if roller.bytes >= max_file_bytes:
                    done.append(roller.close())
        if roller.out is not None:
            done.append(roller.close())
        columns = list(zip(*done, strict=True)) or [[]] * 4
        types = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["name", "records", "bytes", "sha256"]
        )

    files = sorted(tuple(r) for r in ranged.mapInArrow(write, FILE_ROW).collect())
    manifest = json.dumps([dict(zip(("name", "records", "bytes", "sha256"), f, strict=True)) for f in files], indent=1)
    temp = f"{top}/.manifest.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(temp) as out:
        out.write(manifest.encode())
    filesystem.move(temp, f"{top}/manifest.json")
    return [f[0] for f in files]


def parse_file(data: bytes, sha256: str) -> Iterator[tuple]:
    """(page_id, payload_bytes, digest, type, refers_to, url, payload) of each record, verified."""
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError("the file differs from its manifest")
    view = memoryview(data)
    while len(view):
        unpack = zlib.decompressobj(31)
        raw = unpack.decompress(view)
        view = view[len(view) - len(unpack.unused_data) :]
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or "sha1:" + sha1_base32(block) != fields["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        revisit = fields["WARC-Type"] == "revisit"
        payload = None if revisit else block.partition(b"\r\n\r\n")[2]
        if payload is None:
            size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
        else:
            size, digest = len(payload), sha1_base32(payload)
        page = int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None
        refers = int(fields["X-Refers-To-Page-Id"]) if revisit else None
        yield page, size, digest, fields["WARC-Type"], refers, fields["WARC-Target-URI"], payload


def read_warc(spark: SparkSession, where: str) -> DataFrame:
    """Every record of the files that the manifest in ``where`` names."""
    filesystem, top = fs.FileSystem.from_uri(where)
    with filesystem.open_input_stream(f"{top}/manifest.json") as f:
        files = [(x["name"], x["sha256"]) for x in json.loads(f.read())]
    listed = spark.createDataFrame(files, "name string, sha256 string").repartition(max(1, len(files)))
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("url", pa.string()),
            ("payload", pa.binary()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, folder = fs.FileSystem.from_uri(where)
        for batch in batches:
            for name, sha in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with own.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    data = f.read()
                rows, held = [], 0
                for row in parse_file(data, sha):
                    rows.append(row)
                    held += len(row[6] or b"")
                    if held > 1 << 23 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                        )
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                    )

    return listed.mapInArrow(read, READ_ROW)


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // {p}) % 32 + 1, 1)"
ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
r AS (SELECT h, max(page_id) AS response FROM d GROUP BY h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(8), lambda i: list_transform([('0x' || substr(d.h, (i * 5 + 1)::INT, 5))::BIGINT],
         lambda v: {' || '.join(_DIGIT.format(p=32**k) for k in (3, 2, 1, 0))})[1]), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM d JOIN r ON d.h = r.h
"""
