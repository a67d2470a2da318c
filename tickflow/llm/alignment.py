"""Two tokenizations of one text set side by side by a sweep over their token ends.

Each text, with a space before it, is encoded by tokenizer A and tokenizer B.
The end events of both are dealt by document and sorted by offset; a machine
reads them as a stream, cuts groups where both have an end, and links the two
tokens that end there.  Its state is the group that is open, a running digest
and the counts of the document, so a document of any length passes through.

Events travel in packed rows: one row holds the ids of one side that end in one
stretch of ``STRETCH`` bytes, and the offset where the first begins; the other
offsets follow from the ids, whose byte lengths each task knows.  Rows are sorted
by document, stretch and side, and the machine meets the ends of a stretch's two
rows in order.  Equal rows of one input partition (same id and text) share a
document key, are swept once and counted; other copies have keys of their own,
so that no group of copies meets in one task.

Counts of linked id pairs over the corpus: the sweep writes its documents in
blocks, each with its distinct pairs.  A pair is a row for each block, not for
each link; the sums by pair, and the largest by B id, go back to the blocks, and
each block finishes its own documents.

Defined results for odd input
-----------------------------
* null or empty text, or one that a tokenizer does not give back byte for byte: no tokens, zeros and no groups;
* special tokens' strings are ordinary text; null and equal ids are rows of their own, repeated rows are repeated;
* an empty table gives no rows; further columns, of any name, are not returned;
* a text is encoded whole by one task; an open group is held, and is as long as the two sides have no common end.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm import bpe
from tickflow.llm.pretokens import Kept
from tickflow.llm.shared import chunks, written

#: Bytes of a text whose ends share an event row.
STRETCH = 1 << 20
#: Pairs, told apart within documents, that a block of swept documents holds before it is closed.
BLOCK_PAIRS = 1_000_000
#: Distinct pairs of which the counts, 24 bytes each, go to every task.
SENT = 1_500_000
#: Words kept with their ids by a task in each of two generations, and the longest of them.
KEPT, KEPT_CHARS = 200_000, 48
#: Fixed value: the byte-level pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

EVENTS = "key long, doc_id long, stretch long, side int, whole boolean, ids binary"
SWEPT = (
    "block long, doc_id array<long>, copies array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "digest array<string>, n_pairs array<int>, codes binary, times binary, pairs binary, totals binary"
)
SUMMARY = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokenizer:
    """Ids of a text and the bytes of each id."""

    pieces: list[bytes]

    def prepare(self) -> None:
        if not all(self.pieces):
            raise ValueError("a token without bytes has no end of its own")
        self.sizes = np.array(list(map(len, self.pieces)), np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a space and each text."""
        raise NotImplementedError

    def whole(self, ids: np.ndarray, raw: bytes) -> bool:
        return int(self.sizes[ids].sum()) == len(raw) and b"".join(map(self.pieces.__getitem__, ids.tolist())) == raw


class ByteTokenizer(Tokenizer):
    """A byte-level tokenizer file.  Where its merges come in the order of their ids, the ids are ranks, and the
    tiktoken library encodes by them; else its own library does.  Byte-level tokens always give the text back."""

    def __init__(self, path: str, pattern: str):
        voc = bpe.Vocabulary(path)
        self.pieces = [voc.pieces.get(i, b"\0") for i in range(max(voc.pieces) + 1)]
        self.prepare()
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        merges = [m if isinstance(m, list) else m.split(" ") for m in raw["model"]["merges"]]
        made = [raw["model"]["vocab"][a + b] for a, b in merges]
        plain = {piece: i for i, piece in voc.pieces.items() if piece.decode("utf-8", "replace") not in voc.special}
        single = [plain.get(bytes([b]), len(plain)) for b in range(256)]
        if made == sorted(set(made)) and max(single) < min(made, default=len(plain)) and len(plain) == 256 + len(made):
            import tiktoken

            library = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=plain, special_tokens={})
            self.encode = lambda texts: [library.encode_to_numpy(text, disallowed_special=()).astype("<u4") for text in texts]
        else:
            self.encode = self._by_its_library(path)

    @staticmethod
    def _by_its_library(path: str) -> Callable[[list[str]], list[np.ndarray]]:
        from tokenizers import Tokenizer as Library

        library = Library.from_file(path)
        library.no_padding()
        library.no_truncation()
        library.encode_special_tokens = True
        return lambda texts: [np.array(e.ids, "<u4") for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode([" " + text for text in texts])

    def whole(self, ids: np.ndarray, raw: bytes) -> bool:
        return int(self.sizes[ids].sum()) == len(raw)


class PieceTokenizer(Tokenizer):
    """A sentence-piece model, which adds the space itself.

    Where no piece has a space after another character and spaces are kept as they are, no merge
    crosses the start of a run of spaces: the runs with what follows are encoded once each.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.pieces = [
            bytes([int(name[3:-1], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)
        ]
        self.prepare()
        self.space = model.piece_to_id("▁")
        self.kept = Kept(self._words, KEPT, KEPT_CHARS)
        probe = "a  b "
        self.by_words = (
            self.space != model.unk_id()
            and not any(re.search("[^▁]▁", name) for name in names)
            and b"".join(self.pieces[i] for i in model.encode(probe)) == b" " + probe.encode()
        )
        self.find = re.compile(" +[^ ]*").findall

    def _words(self, words: list[str]) -> list[bytes]:
        found = self.model.encode([word[1:] for word in words], num_threads=1) if words else []
        return [np.array(ids if len(word) > 1 else [self.space], "<u4").tobytes() for word, ids in zip(words, found, strict=True)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.array(ids, "<u4") for ids in self.model.encode(texts, num_threads=1)] if texts else []
        found = self.kept.joined([self.find(" " + text) if "▁" not in text else [] for text in texts])
        return [np.frombuffer(x, "<u4") if "▁" not in text else np.array(self.model.encode(text), "<u4") for x, text in zip(found, texts, strict=True)]


@lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> tuple[Tokenizer, Tokenizer]:
    return ByteTokenizer(path_a, PATTERN), PieceTokenizer(path_b)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers, compressed: two bytes each where they fit."""
    narrow = not len(values) or int(values.max()) <= 0xFFFF
    body = bytes([narrow]) + values.astype("<u2" if narrow else "<u4" if values.itemsize <= 4 else "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(body)


def unpack(packed: bytes, kind: str = "<u4") -> np.ndarray:
    """The integers that ``pack`` was given with the type ``kind``, as signed 64-bit ones."""
    body = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(body, "<u2" if body[0] else kind, offset=1).astype(np.int64)


def end_events(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Event rows of both tokenizers over ``doc_id`` and ``text``; a text without tokens has one row, not ``whole``."""
    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, place = tokenizers(path_a, path_b), TaskContext.get().partitionId()
        for batch in chunks(batches, "text", 1 << 20):
            rows, texts = [], [text or "" for text in batch.column(1).to_pylist()]
            for doc_id, text, *coded in zip(batch.column(0).to_pylist(), texts, *[t.ids(texts) for t in pair], strict=True):
                raw = b" " + text.encode()
                key = xxhash.xxh64_intdigest(raw, seed=xxhash.xxh64_intdigest(f"{doc_id},{place}")) - (1 << 63)
                if not text or not all(t.whole(ids, raw) for t, ids in zip(pair, coded, strict=True)):
                    rows.append((key, doc_id, 0, 0, False, b""))
                    continue
                for side, ids in enumerate(coded):
                    if len(raw) <= STRETCH:
                        rows.append((key, doc_id, 0, side, True, pack(ids)))
                        continue
                    first = (np.cumsum(pair[side].sizes[ids]) - 1) // STRETCH
                    for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(first)) + 1):
                        rows.append((key, doc_id, int(first[part[0]]), side, True, pack(ids[part])))
            arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, _NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(events, EVENTS)


_NAMES = [part.split()[0] for part in EVENTS.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]


def by_document(events: DataFrame) -> DataFrame:
    """The events of each document in one partition, in order."""
    return events.repartition("key").sortWithinPartitions("key", "doc_id", "stretch", "side")


@dataclass
class Groups:
    """What one stretch closes: ids of both sides, and where each group ends among them."""

    a: np.ndarray
    b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray

    @property
    def pairs(self) -> np.ndarray:
        """The linked ids, A above B."""
        return self.a[self.last_a] << 32 | self.b[self.last_b]


@dataclass
class Sweep:
    """The machine of one document: it is fed the two rows of a stretch and closes groups."""

    sizes_a: np.ndarray
    sizes_b: np.ndarray
    open_a: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    open_b: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def feed(self, a: np.ndarray, b: np.ndarray) -> Groups:
        """Both open parts begin at the last common end, so ends are counted from there."""
        a, b = np.concatenate([self.open_a, a]), np.concatenate([self.open_b, b])
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        at = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a) if len(ends_b) else at[:0]
        last_b = at[last_a]
        n_a, n_b = (int(x[-1]) + 1 if len(x) else 0 for x in (last_a, last_b))
        self.open_a, self.open_b = a[n_a:], b[n_b:]
        return Groups(a[:n_a], b[:n_b], last_a, last_b)


class Writer:
    """Groups as text, ``a1,a2|b1;a3|b2``: each id is looked up with the mark that follows it."""

    def __init__(self, n_a: int, n_b: int):
        self.names = [b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(max(n_a, n_b))]
        self.n = max(n_a, n_b)

    def text(self, g: Groups) -> bytes:
        """Every group with a semicolon after it."""
        group_a = np.searchsorted(g.last_a, np.arange(len(g.a)))
        group_b = np.searchsorted(g.last_b, np.arange(len(g.b)))
        out = np.empty(len(g.a) + len(g.b), np.int64)
        before_b = np.concatenate([[0], g.last_b + 1])
        at_a, at_b = np.arange(len(g.a)) + before_b[group_a], np.arange(len(g.b)) + g.last_a[group_b] + 1
        out[at_a], out[at_b] = g.a, g.b
        out[at_a[g.last_a]] += self.n
        out[at_b[g.last_b]] += 2 * self.n
        return b"".join(map(self.names.__getitem__, out.tolist()))


def _documents(batches: Iterator[pa.RecordBatch], pair: tuple[Tokenizer, Tokenizer]) -> Iterator[tuple[int | None, bool, Iterator[Groups], list[int]]]:
    """(doc id, whole, groups by stretch, [copies]) of sorted event rows; the groups are to be read before the next document.

    A row like the one before it is that of an equal document: it is counted, not swept.
    """
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(rows, None)
    while row is not None:
        name, copies = row[:2], [0]

        def stretches(whole: bool, first=row, name=name, copies=copies) -> Iterator[Groups]:
            nonlocal row
            machine, sides, last = Sweep(pair[0].sizes, pair[1].sizes), [np.zeros(0, np.int64)] * 2, None
            row = first
            while row is not None and row[:2] == name:
                _, _, stretch, side, _, ids = row
                copies[0] += (stretch, side) == first[2:4]
                if whole and (stretch, side) != last:
                    if last is not None and stretch != last[0]:
                        yield machine.feed(*sides)
                        sides = [np.zeros(0, np.int64)] * 2
                    sides[side] = unpack(ids)
                last = stretch, side
                row = next(rows, None)
            if whole:
                yield machine.feed(*sides)

        parts = stretches(row[4])
        yield name[1], row[4], parts, copies
        for _ in parts:
            pass


def sweep(events: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Blocks of swept documents (``SWEPT``) of sorted events."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(path_a, path_b)
        writer = Writer(len(pair[0].pieces), len(pair[1].pieces))
        block, held, found = TaskContext.get().partitionId() << 32, [], 0
        for doc_id, whole, parts, copies in _documents(batches, pair):
            n_a = n_b = n_groups = pending = 0
            digest, gap = hashlib.sha256(), b""
            linked: list[tuple[np.ndarray, np.ndarray]] = []
            for g in parts:
                n_a, n_b, n_groups = n_a + len(g.a), n_b + len(g.b), n_groups + len(g.last_a)
                if len(g.last_a):
                    text = writer.text(g)
                    digest.update(gap)
                    digest.update(memoryview(text)[:-1])
                    gap = b";"
                    linked.append(np.unique(g.pairs, return_counts=True))
                    pending += len(linked[-1][0])
                    if pending > BLOCK_PAIRS and len(linked) > 1:
                        linked = [_merged(linked)]
                        pending = len(linked[0][0])
            pairs, times = _merged(linked)
            held.append((doc_id, copies[0], n_a, n_b, n_groups, digest.hexdigest() if whole else "", pairs, times))
            found += len(pairs) + 16
            if found >= BLOCK_PAIRS:
                yield _block(block, held)
                block, held, found = block + 1, [], 0
        if held:
            yield _block(block, held)

    return events.mapInArrow(run, SWEPT)


def _merged(linked: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(linked) == 1:
        return linked[0]
    pairs, at = np.unique(np.concatenate([np.zeros(0, np.int64), *[p for p, _ in linked]]), return_inverse=True)
    times = np.zeros(len(pairs), np.int64)
    np.add.at(times, at, np.concatenate([np.zeros(0, np.int64), *[t for _, t in linked]]))
    return pairs, times


def _block(block: int, held: list[tuple]) -> pa.RecordBatch:
    *columns, pairs, times = zip(*held, strict=True)
    sizes = np.array(list(map(len, pairs)), np.int64)
    distinct, codes = np.unique(np.concatenate(pairs), return_inverse=True)
    times = np.concatenate(times)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, codes, times * np.repeat(np.array(columns[1], np.int64), sizes))
    kinds = [pa.int64()] * 5 + [pa.string()]
    arrays = [pa.array([block], pa.int64()), *[pa.array([c], pa.list_(kind)) for c, kind in zip(columns, kinds, strict=True)]]
    arrays.append(pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())))
    packed = [codes.astype("<u4"), times.astype("<u4"), distinct.astype("<u8"), totals.astype("<u8")]
    arrays += [pa.array([pack(x)], pa.binary()) for x in packed]
    return pa.RecordBatch.from_arrays(arrays, [part.split()[0] for part in SWEPT.split(", ")])


def block_pairs(swept: DataFrame) -> DataFrame:
    """(block, pair, n): the distinct linked pairs of each block."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, totals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs, totals = unpack(pairs, "<u8"), unpack(totals, "<u8")
                for at in range(0, len(pairs), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    arrays = [pa.array(np.full(len(pairs[part]), block)), pa.array(pairs[part]), pa.array(totals[part])]
                    yield pa.RecordBatch.from_arrays(arrays, ["block", "pair", "n"])

    return swept.select("block", "pairs", "totals").mapInArrow(listed, "block long, pair long, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n, best): links that hold each pair, and whether no pair of its B id has more."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


_OWN = ["block", "doc_id", "copies", "n_a", "n_b", "n_groups", "digest", "n_pairs", "codes", "times"]


def _finished(row: dict, n: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """The documents of one block (``_OWN`` of ``SWEPT``); ``n`` and ``best`` are the counts of its pairs, ascending."""
    codes, times = unpack(row["codes"]), unpack(row["times"])
    owner = np.repeat(np.arange(len(row["n_pairs"])), row["n_pairs"])
    sums = np.zeros((2, len(row["n_pairs"])), np.int64)
    np.add.at(sums[0], owner, times * n[codes])
    np.add.at(sums[1], owner, times * best[codes])
    copies = np.repeat(np.arange(len(row["doc_id"])), row["copies"])
    columns = [row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_groups"], sums[1], sums[0], row["digest"]]
    kinds = [pa.int64()] * 7 + [pa.string()]
    arrays = [pa.array(c, kind).take(pa.array(copies)) for c, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [part.split()[0] for part in SUMMARY.split(", ")])


def _finished_group(swept: pa.Table, counts: pa.Table) -> pa.Table:
    order = np.argsort(counts.column("pair").to_numpy())
    n, best = (counts.column(c).to_numpy()[order].astype(np.int64) for c in ("n", "best"))
    return pa.Table.from_batches([_finished(row, n, best) for row in swept.to_pylist()])


def summarize(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row of counts and the digest of its groups (``SUMMARY``) for each row of ``docs``.

    Distinct pairs are counted first.  Up to ``SENT`` of them go to every task as sorted arrays, and blocks finish
    where they are; more are joined to the blocks that hold them.
    """
    swept = written(sweep(by_document(end_events(docs, path_a, path_b)), path_a, path_b))
    pairs = block_pairs(swept)
    counts = written(pair_counts(pairs))
    if counts.count() > SENT:
        back = pairs.select("block", "pair").join(counts, "pair").select("block", "pair", "n", "best")
        return swept.select(*_OWN).groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_finished_group, SUMMARY)
    table = counts.orderBy("pair").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast([table.column(c).to_numpy().astype(np.int64) for c in ("pair", "n", "best")])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                at = np.searchsorted(pair, unpack(row["pairs"], "<u8"))
                yield _finished(row, n[at], best[at])

    return swept.select(*_OWN, "pairs").mapInArrow(finish, SUMMARY)


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, start, end, a, b): each group's ids and its bytes in the space and text; repeated rows repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(path_a, path_b)
        for doc_id, _, parts, copies in _documents(batches, pair):
            start, lists = 0, []
            for g in parts:
                ends = start + np.cumsum(pair[0].sizes[g.a])[g.last_a]
                starts = np.concatenate([[start], ends[:-1]]) if len(ends) else ends
                start = int(ends[-1]) if len(ends) else start
                cuts = [np.concatenate([[0], last + 1]).astype(np.int32) for last in (g.last_a, g.last_b)]
                lists.append((starts, ends, *[pa.ListArray.from_arrays(pa.array(c), pa.array(x)) for c, x in zip(cuts, (g.a, g.b), strict=True)]))
            for starts, ends, a, b in lists * copies[0]:
                ids = pa.array([doc_id] * len(starts), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), a, b], ["doc_id", "start", "end", "a", "b"])

    return by_document(end_events(docs, path_a, path_b)).mapInArrow(run, "doc_id long, start long, end long, a array<long>, b array<long>")


def token_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, end, a, b): the linked ids, the last of each group, and the byte where both end."""
    groups = token_groups(docs, path_a, path_b)
    return groups.select("doc_id", "end", F.element_at("a", -1).alias("a"), F.element_at("b", -1).alias("b"))
