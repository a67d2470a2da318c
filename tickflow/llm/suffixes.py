"""Exact substring dedup by bucket-pointer refinement of sampled suffixes.

Every string of 200 bytes has one anchor: the first of the least of the identifiers of its
64-byte strings.  Identifiers are built by doubling, each from two of half the
length, so an anchor depends on the string alone and equal strings have equal
anchors at equal offsets.  Strings with one anchor start in one run of offsets;
all of them lie in the anchor's hull.

1. Anchors whose identifier is met once are dropped (a count, then a join).
2. Of equal hulls all bytes are repeated.  Only hulls that are met once beside
   other hulls of their anchor are open; one hull of each class is kept as text.
3. The kept hulls of an anchor meet in a block.  There the suffixes are sorted by
   bucket-pointer refinement: buckets of 8-byte strings are refined by the bucket
   identifiers 8 bytes on, and the refined identifiers are used again 16, 32, 64
   and 72 bytes on, up to 200; suffixes alone in their bucket leave the sort.
4. Anchors with too many hulls for a block go the same way over the cluster: buckets of
   8-byte strings are refined by the identifiers of the buckets 8, 16, 32, 64 and 72 bytes on, within
   each hull, and the buckets of all hulls are counted.

Steps 1, 2 and 4 count with partial sums.  The joins that follow are of written counts, one row
a key, with the occurrences: a key that is in every document is split by the adaptive skew join.

Defined results for odd input
-----------------------------
* null text: as empty; texts under 200 bytes lose nothing; a text of any length is read whole by one task;
* repeated rows, with equal or null ids too: each is elsewhere for the other;
* an empty table gives no rows; other columns of the input are kept.

Identifiers are 64 bits wide and are compared together with a hull identifier of
another 64 bits; step 3 compares bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow.llm.packing import unpack_bytes
from tickflow.llm.shared import aside, chunks, released, written
from tickflow.llm.words import Texts, mix

LENGTH = 200
GRAM = 64
CHUNK = 1 << 19
#: Bytes of hulls in a block, each of which takes about 125 bytes while it is sorted, and hulls of an anchor that may share one.
BLOCK_BYTES = 1 << 19
BLOCK_HULLS = 2000
#: Identifiers are compared without these bits, in which positions stand meanwhile: an anchor depends on its string alone.
LOW = np.uint64((1 << 24) - 1)


def row_id(doc_id: int | None, text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text, 0 if doc_id is None else (doc_id + 1) & (2**64 - 1)) - (1 << 63)


def _join_ids(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The identifier of two strings end to end."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as an integer."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, raw = np.empty(n, np.uint64), data.tobytes()
    for k in range(min(8, n)):
        out[k::8] = np.frombuffer(raw, "<u8", (n - k + 7) // 8, k)
    return out


def identifiers(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Identifiers of the strings of ``length`` bytes (a power of two over 8, or 200) from each position."""
    ids = mix(_eights(data) + np.uint64(seed))
    size = 8
    while 2 * size <= length:
        ids = _join_ids(ids[:-size], ids[size:]) if len(ids) > size else ids[:0]
        size *= 2
    if size < length:
        step = length - size
        ids = _join_ids(ids[:-step], ids[step:]) if len(ids) > step else ids[:0]
    return ids


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the first of the least of ``width`` values is, from each position on.  The low bits of the values are 0."""
    n = len(values)
    steps, span = [], 1
    while 2 * span <= width:
        steps.append(span)
        span *= 2
    steps += [width - span] if span < width else []
    if n <= int(LOW):  # positions fit below the values: one minimum does for both
        least = values | np.arange(n, dtype=np.uint64)
        for step in steps:
            least = np.minimum(least[: len(least) - step], least[step:])
        return (least & LOW).astype(np.int64)
    at = np.arange(n)
    for step in steps:
        later = values[step:] < values[: len(values) - step]
        values, at = (np.where(later, x[step:], x[: len(x) - step]) for x in (values, at))
    return at


def anchors(t: Texts) -> dict[str, np.ndarray]:
    """Of each run of starts with one anchor: key, hull, text, lo, hi (first and last start, in the text)."""
    n = len(t.data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return {"key": none, "hull": none, "text": none, "lo": none, "hi": none}
    ids = identifiers(t.data, GRAM)
    anchor = leftmost_least(ids & ~LOW, LENGTH - GRAM + 1)  # of the string that starts at each position
    sizes = np.diff(t.bounds) - 1
    has = np.flatnonzero(sizes >= LENGTH)
    first, last = t.bounds[:-1][has], t.bounds[1:][has] - 1 - LENGTH
    opens = np.zeros(len(anchor) + 1, np.int64)
    opens[first] += 1
    opens[last + 1] -= 1
    valid = np.cumsum(opens[:-1]) > 0
    change = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~valid[:-1]])
    change[first] = True
    lo = np.flatnonzero(change & valid)
    stop = np.concatenate([change[1:] | ~valid[1:], [True]])
    hi = np.flatnonzero(stop & valid)
    at = anchor[lo]
    hull = t.hashes(t.sums(), lo, hi + LENGTH) + mix((at - lo).astype(np.uint64))
    text = np.searchsorted(t.bounds, lo, side="right") - 1
    base = t.bounds[text]
    return {"key": ids[at].view(np.int64), "hull": hull.view(np.int64), "text": text, "lo": lo - base, "hi": hi - base}


def refine(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the 200-byte strings from each position of ``data``; -1 where none starts.

    ``data`` holds pieces end to end; strings stay inside their piece.
    """
    n = len(data)
    room = np.repeat(ends, ends - starts) - np.arange(n)
    bucket = np.full(n, -1, np.int64)
    at = np.flatnonzero(room >= 8)
    _, bucket[at] = np.unique(_eights(data)[at], return_inverse=True)
    size = 8
    while size < LENGTH:
        step = min(size, LENGTH - size)
        whole = np.flatnonzero(room >= size + step)
        # A suffix alone in its bucket stays alone: only the others are sorted again.
        counts = np.bincount(bucket[whole]) if len(whole) else np.zeros(1, np.int64)
        shared = counts[bucket[whole]] > 1
        alone, many = whole[~shared], whole[shared]
        refined = np.full(n, -1, np.int64)
        top = int(bucket.max(initial=0)) + 1
        groups, inverse = np.unique(bucket[many] * top + bucket[many + step], return_inverse=True)
        refined[many] = inverse
        refined[alone] = len(groups) + np.arange(len(alone))
        bucket, size = refined, size + step
    return bucket


def repeated_starts(pieces: list[bytes]) -> list[np.ndarray]:
    """For each hull, which of its starts have a string that starts elsewhere too."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    bucket = refine(np.frombuffer(b"".join(pieces), np.uint8), ends - sizes, ends)
    own = bucket[bucket >= 0]
    again = np.zeros(len(bucket), bool)
    again[bucket >= 0] = np.bincount(own)[own] > 1
    return [again[e - s : e - LENGTH + 1] for s, e in zip(sizes, ends, strict=True)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _anchors(docs: DataFrame) -> DataFrame:
    @released
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            texts = batch.column(1).to_pylist()
            rid = [row_id(i, (x or "").encode()) for i, x in zip(batch.column(0).to_pylist(), texts, strict=True)]
            found = anchors(Texts.of(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found["key"]),
                    pa.array(found["hull"]),
                    pa.array(np.array(rid, np.int64)[found["text"]]),
                    pa.array(found["lo"].astype(np.int32)),
                    pa.array(found["hi"].astype(np.int32)),
                ],
                ["key", "hull", "rid", "lo", "hi"],
            )

    return docs.select("doc_id", "text").mapInArrow(emit, "key long, hull long, rid long, lo int, hi int")


def _packed(docs: DataFrame) -> DataFrame:
    """All columns but the text, the row's identifier and the compressed text."""
    others = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*docs.select(*others).schema.fields, T.StructField("__rid", T.LongType()), T.StructField("__packed", T.BinaryType())])

    @released
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in chunks(batches, "__text"):
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            rid = [row_id(i, x) for i, x in zip(batch.column(0).to_pylist(), raw, strict=True)]
            made = [pa.array(rid, pa.int64()), pa.array([squeeze(x) for x in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], [*others, "__rid", "__packed"])

    return docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"), *others).mapInArrow(pack, schema)


def _hull_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (key, rid, lo, hi, single, many) with the bytes of each hull."""

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "packed", 1 << 20):
            rows = []
            for rid, raw, hulls in zip(batch.column(0).to_pylist(), unpack_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                rows += [(h["key"], rid, h["lo"], h["single"], h["many"], raw[h["lo"] : h["hi"] + LENGTH]) for h in hulls]
            for k in range(0, len(rows), 20_000):
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
                yield _batch(rows[k : k + 20_000], ["key", "rid", "lo", "single", "many", "hull"], kinds)

    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("key", "lo", "hi", "single", "many")).alias("hulls"))
    texts = _packed(docs.select("doc_id", "text")).select(F.col("__rid").alias("rid"), F.col("__packed").alias("packed"))
    rows = texts.dropDuplicates(["rid"]).join(lists, "rid").select("rid", "packed", "hulls")
    return rows.mapInArrow(cut, "key long, rid long, lo int, single boolean, many boolean, hull binary")


def _refined_spans(hulls: DataFrame) -> DataFrame:
    """Spans (rid, start, end) from blocks of whole anchors."""

    @released
    def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def spans(upto: int) -> list[tuple]:
            out = []
            block = held[:upto]
            for (_, rid, lo, single, _), flags in zip(block, repeated_starts([h[4] for h in block]), strict=True):
                if single:
                    out += [(rid, lo + a, lo + b - 1 + LENGTH) for a, b in runs(flags)]
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    if found := spans(len(held)):
                        yield _batch(found, ["rid", "start", "end"], [pa.int64(), pa.int32(), pa.int32()])
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held and (found := spans(len(held))):
            yield _batch(found, ["rid", "start", "end"], [pa.int64(), pa.int32(), pa.int32()])

    rows = hulls.filter("NOT many").select("key", "rid", "lo", "single", "hull").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(sort_blocks, "rid long, start int, end int")


def _counted_spans(hulls: DataFrame) -> DataFrame:
    """Spans of anchors with many hulls: identifiers of all starts, counted."""

    @released
    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "hull", 1 << 19):
            sizes = np.array([len(h) for h in batch.column(3).to_pylist()])
            data = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8)
            at = np.cumsum(sizes) - sizes
            counts = sizes - LENGTH + 1
            inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            where = np.repeat(at, counts) + inside
            a, b = (identifiers(data, LENGTH, seed)[where].view(np.int64) for seed in (0, 77))
            rid, lo, single = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(a),
                    pa.array(b),
                    pa.array(np.repeat(rid, counts)),
                    pa.array((np.repeat(lo, counts) + inside).astype(np.int32)),
                    pa.array(np.repeat(single.astype(bool), counts)),
                ],
                ["a", "b", "rid", "start", "single"],
            )

    rows = hulls.filter("many").select("rid", "lo", "single", "hull").mapInArrow(starts, "a long, b long, rid long, start int, single boolean")
    again = rows.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b")
    found = rows.filter("single").join(again, ["a", "b"])
    return found.select("rid", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(rid, start, end) byte spans, not merged, that cover every repeated 200-byte string."""
    all_anchors = _anchors(docs)
    # Written first: a join of two plain shuffles is one whose hot keys Spark splits.
    met = written(all_anchors.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    near = written(all_anchors.join(met, "key").select("key", "hull", "rid", "lo", "hi"))
    classes = near.groupBy("key", "hull").agg(F.count("*").alias("n"), F.min(F.struct("rid", "lo", "hi")).alias("rep"))
    classes = written(classes)
    copies = classes.filter("n > 1").select("key", "hull")
    done = near.join(copies, ["key", "hull"]).select("rid", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))
    single = F.max((F.col("n") == 1).cast("int"))
    opened = classes.groupBy("key").agg(F.count("*").alias("hulls"), single.alias("any")).filter("hulls > 1 AND any = 1")
    opened = opened.select("key", (F.col("hulls") > BLOCK_HULLS).alias("many"))
    wanted = classes.join(opened, "key").select("key", "rep.rid", "rep.lo", "rep.hi", (F.col("n") == 1).alias("single"), "many")
    hulls = written(_hull_texts(docs, wanted))
    return done.union(_refined_spans(hulls)).union(_counted_spans(hulls))


def deduplicate(docs: DataFrame, characters: bool = False) -> DataFrame:
    """The columns of ``docs`` but the text, with n_bytes, n_removed, n_spans, spans and kept (binary).

    A further column of ``docs`` with the name of one of these gives way to it.  With ``characters``, bytes of
    cut characters are gone from ``kept`` too; they do not count as removed.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    added = "n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept binary"
    new = T._parse_datatype_string(added)
    docs = docs.drop(*new.names)
    spans = repeated_spans(docs).groupBy(F.col("rid").alias("__of")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans"))
    packed = _packed(docs)
    others = [c for c in docs.columns if c != "text"]
    joined = packed.join(spans, F.col("__rid") == F.col("__of"), "left").select("__packed", "__spans", *others)
    schema = T.StructType([*docs.select(*others).schema.fields, *new.fields])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    @released
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__packed", 1 << 21):
            rows = []
            for raw, found in zip(unpack_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s in found or []:
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                body = b"".join(kept)
                removed = len(raw) - len(body)
                if characters and removed:
                    body = body.decode("utf-8", "ignore").encode()
                rows.append((len(raw), removed, len(merged), [{"start": a, "end": b} for a, b in merged], body))
            kinds = [pa.int64(), pa.int64(), pa.int64(), span_type, pa.binary()]
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], [f.name for f in schema.fields])

    return joined.mapInArrow(keep, schema)


def keep_text(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes gone from ``text``; bytes of a cut character go too, ``n_chars`` follows."""
    moved, back = aside(docs, "doc_id", "text")
    at = dict(zip(docs.columns, moved.columns, strict=False))
    # Characters are made whole by the task that cuts: a Python function after it would be a second worker for each task.
    out = deduplicate(moved.drop(at["text"]), characters=True).withColumn(at["text"], F.decode("kept", "UTF-8"))
    if "n_chars" in at:
        n = F.when(F.col("n_removed") == 0, F.col(at["n_chars"])).otherwise(F.char_length(at["text"]))
        out = out.withColumn(at["n_chars"], n.cast(docs.schema["n_chars"].dataType))
    return out.select(*back)
