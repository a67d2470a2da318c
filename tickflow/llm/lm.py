"""Language-model scores by online logistic context mixing over bits.

A byte is coded as a way down a binary tree that the byte before it chooses, so
each byte is a few yes-or-no decisions.  Hashed contexts (the last 2 and the last 5 bytes,
with the node of the tree) give the logit of each decision, counted over all training
documents in tables of fixed size.  Weights, gated by the depth in the tree and by how sure
the longer context is, combine the logits; they start equal for every document and
are refined as it is read, by all decisions of each block of 128 bytes.

Longer contexts are of words.  Every three-word context has an
entry: the text up to the end of the next word that followed it most often in the training documents, and how
often.  The entries are a distributed table that grows with the corpus and is joined to the blocks
of documents.  While the followed text agrees with what is read, it predicts the next
byte, and one more decision says whether that byte comes; its chance is counted as the document is
read, apart by how long the text has been followed and, where it did not follow more often than all others together, by how
far it goes.  Only where it fails, or nothing
is followed, the byte is coded as above.

A score is the total of all decisions, with those of the end, and depends on its text and the corpus
only: the text's log10 probability; ``bits`` is the same in bits.

A training document's own text is no evidence for it: it follows entries that were met
at least twice, a held-out document those that were met at all.

The base is an add-0.1 unigram model over words and one end token per document.
Words and entries are listed once per block of documents, added up over the cluster in
one pass, and joined back to their block.  The blocks are written once and read by every pass.

Defined results for odd input
-----------------------------
* null text: as empty, one end token; a null doc_id is never held out;
* repeated rows, in equal files too, are counted and scored each; an empty table gives no rows;
* of texts that followed a context equally often the least is followed;
* without training rows all counts are 0 and every decision is even;
* a text of any length is scored whole, in the memory of one task;
* further columns are ignored.  Words and contexts are told apart by 63-bit hashes.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow.llm.packing import stored_blocks, unpack_bytes, unpacked_blocks
from tickflow.llm.shared import written
from tickflow.llm.words import Texts, grams

END, SYMBOLS = 256, 257
ORDERS = (2, 5)
BITS = (18, 21)
#: Where each order's table starts in the one array of slots.
STARTS = tuple(int(x) for x in np.concatenate([[0], np.cumsum([1 << b for b in BITS])]))
SCALE = 15.0
#: Gates: depth (8), and how sure the longer context is (3).
GATES = 24
START_WEIGHTS = (0.35, 0.75)
#: The most bytes that an entry predicts.
REACH = 255
#: After so many agreed bytes the followed text is in its next state, and the first counts (right, wrong) of each state;
#: the last eight are of texts that are not sure, by the place in them.
AGREED = (8, 24, 64)
FIRST = ((2.0, 1.0), (6.0, 0.5), (20.0, 0.4), (60.0, 0.3), (6.0, 0.5), (20.0, 0.4), (60.0, 0.3), (200.0, 0.2), *[(6.0, 0.5), (1.0, 1.0), (2.0, 1.0), (6.0, 0.5)] * 2)
#: The weights of a text are refined after so many of its bytes.
BLOCK = 128
#: Logits are read from tables at steps of 1 / FINE up to LIMIT.
FINE, LIMIT = 32, 11
#: A gate's weights move by its gradient over so much a decision, and so much more.
A_DECISION, MORE = 3.0, 20.0
PIECE = 1 << 19
FLUSH = 1 << 22
SLICE = 1 << 15


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


@dataclass
class Trees:
    """Of each pair (byte before, symbol): where its way starts in ``steps``, and its length.

    A step is ``node * 16 + depth * 2 + bit``.
    """

    start: np.ndarray
    length: np.ndarray
    steps: np.ndarray


def build_trees(pairs: np.ndarray) -> Trees:
    """A Huffman tree for each byte before; unseen symbols get long ways."""
    start, length = np.zeros(SYMBOLS**2, np.int32), np.zeros(SYMBOLS**2, np.int32)
    steps: list[int] = []
    for before in range(SYMBOLS):
        counts = pairs[before * SYMBOLS : (before + 1) * SYMBOLS].astype(np.int64) * 64 + 1
        heap = [(int(c), s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        name = SYMBOLS
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]], parent[b[1]] = (name, 0), (name, 1)
            heapq.heappush(heap, (a[0] + b[0], name))
            name += 1
        for symbol in range(SYMBOLS):
            way, at = [], symbol
            while at in parent:
                at, bit = parent[at]
                way.append((at - SYMBOLS) * 16 + bit)
            k = before * SYMBOLS + symbol
            start[k], length[k] = len(steps), len(way)
            steps += [x + 2 * min(d, 7) for d, x in enumerate(reversed(way))]
    return Trees(start, length, np.array(steps, np.uint32))


@dataclass
class Symbols:
    """Of each coded symbol (the bytes of all texts, an end after each): pair with the one before, and the hash of each order."""

    sizes: np.ndarray
    pair: np.ndarray
    hashes: list[np.ndarray]


def symbols(texts: list[bytes], orders: tuple[int, ...] = ORDERS) -> Symbols:
    sizes = np.array([len(t) for t in texts], np.int64)
    # Five ends before each text and one after it; those before are not coded.
    s = np.frombuffer(bytes(5) + bytes(6).join(texts) + bytes(1), np.uint8).astype(np.uint32)
    first = 5 + np.cumsum(sizes + 6) - sizes - 6
    ahead = (first[:, None] + np.arange(-5, 0)).ravel()
    s[ahead] = END
    s[first + sizes] = END
    coded = np.ones(len(s), bool)
    coded[ahead] = False
    coded = coded[5:]
    n = len(s)
    pair = (s[4:-1] * np.uint32(SYMBOLS) + s[5:])[coded].astype(np.int64)
    hashes, h = [], np.zeros(n - 5, np.uint32)
    for k in range(1, max(orders, default=0) + 1):
        h = (h * np.uint32(0x2C1B3C6D)) ^ (s[5 - k : n - k] + np.uint32(k * 0x3C6EF372 & 0xFFFFFFFF))
        if k in orders:
            x = h[coded] * np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            hashes.append(x * np.uint32(0x27D4EB2F))
    return Symbols(sizes + 1, pair, hashes)


def count_pairs(stored: DataFrame) -> np.ndarray:
    """Counts of (byte before, symbol) in the training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**2, np.int64)
        for _, ids, texts in unpacked_blocks(batches, PIECE):
            if train := [t for i, t in zip(ids, texts, strict=True) if not is_held_out(i)]:
                total += np.bincount(symbols(train, ()).pair, minlength=SYMBOLS**2)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    table = stored.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**2, np.int64)
    out[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return out


def ways(pair: np.ndarray, trees: Trees, length: np.ndarray) -> np.ndarray:
    """The steps of all symbols; those of length 0 have none."""
    last = np.cumsum(length, dtype=np.int32)
    way = np.repeat(trees.start[pair] - last + length.astype(np.int32), length)
    way += np.arange(len(way), dtype=np.int32)
    return trees.steps[way]


def slots(hashes: list[np.ndarray], length: np.ndarray, step: np.ndarray, widths: tuple[int, ...] = BITS) -> Iterator[np.ndarray]:
    """For each order, the slot of every decision in the order's table."""
    node = (step >> np.uint32(4)) * np.uint32(0x9E3779B1)
    for h, bits in zip(hashes, widths, strict=True):
        x = np.repeat(h, length)
        x += node
        x >>= np.uint32(32 - bits)
        yield x


def train_tables(stored: DataFrame, trees: Trees) -> np.ndarray:
    """The logits of all slots, from every decision of the training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * STARTS[-1], np.uint32)
        for _, ids, texts in unpacked_blocks(batches, FLUSH):
            train = [t for i, t in zip(ids, texts, strict=True) if not is_held_out(i)]
            if not train:
                continue
            s = symbols(train)
            for k, h in enumerate(s.hashes):
                # Equal contexts with equal symbols are added up first, then take their way once.
                gram = np.sort((h.astype(np.int64) << 31) | s.pair)
                first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
                n, gram = np.diff(np.append(first, len(gram))), gram[first]
                pair = gram & 0x7FFFFFFF
                length = trees.length[pair]
                step = ways(pair, trees, length)
                (x,) = slots([(gram >> 31).astype(np.uint32)], length, step, BITS[k : k + 1])
                x = x.astype(np.int64) * 2 + (step & np.uint32(1))
                own = slice(2 * STARTS[k], 2 * STARTS[k + 1])
                total[own] += np.bincount(x, np.repeat(n, length), minlength=2 << BITS[k]).astype(np.uint32)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for k in range(0, STARTS[-1], SLICE):
            part = total[2 * k : 2 * (k + SLICE)]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([squeeze(part.tobytes())], pa.binary())], ["at", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def logits() -> pa.RecordBatch:
            zero, one = total[0::2], total[1::2]
            x = np.clip(np.log((one + 0.4) / (zero + 0.4)) * SCALE, -127, 127).round().astype(np.int8)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["at", "logits"])

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), unpack_bytes(batch.column(1)), strict=True):
                if k != at:
                    if at is not None:
                        yield logits()
                    at, total = k, np.zeros(2 * SLICE, np.int64)
                total += np.frombuffer(raw, np.uint32)
        if at is not None:
            yield logits()

    parts = stored.mapInArrow(count, "at long, counts binary").repartition("at").sortWithinPartitions("at")
    out = np.zeros(STARTS[-1], np.int8)
    for row in parts.mapInArrow(add_up, "at long, logits binary").toLocalIterator():  # as many bytes as there are slots
        out[row.at : row.at + SLICE] = np.frombuffer(row.logits, np.int8)
    return out


@dataclass
class Read:
    """Word hashes of texts with their owners, and the three-word contexts: hash, end, owner."""

    texts: Texts
    words: np.ndarray
    owner: np.ndarray
    context: np.ndarray
    at: np.ndarray
    text: np.ndarray


def read(texts: list[bytes]) -> Read:
    t = Texts.of(texts)
    low = t.lowered()
    starts, ends, owner = low.words()
    hashes = low.hashes(low.sums(), starts, ends)
    three, first = grams(hashes, owner, 3)
    words = (hashes & ~np.uint64(1)).view(np.int64)
    contexts = (three | np.uint64(1)).view(np.int64)
    return Read(t, words, owner, contexts, ends[first + 2] if len(first) else first, owner[first])


def follower_ends(r: Read) -> np.ndarray:
    """Where what follows each context ends: at the next one's end, or that of the text."""
    end = (r.texts.bounds[1:] - 1)[r.text]
    if len(end):
        end[:-1] = np.where(r.text[1:] == r.text[:-1], r.at[1:], end[:-1])
    return np.minimum(end, r.at + REACH)


def followers(r: Read) -> list[bytes]:
    """What follows each context in its text, up to the next one."""
    raw = r.texts.data.tobytes()
    return [raw[a:b] for a, b in zip(r.at.tolist(), follower_ends(r).tolist(), strict=True)]


def slices(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> bytes:
    """The slices of ``data``, one after the other."""
    last = np.cumsum(size)
    return data[np.repeat(begin - last + size, size) + np.arange(last[-1] if len(last) else 0)].tobytes()


@dataclass
class Listed:
    """Keys (words, and contexts with what follows them) of a block or part, as bytes and back."""

    key: np.ndarray  # contexts are odd
    n: np.ndarray
    held: np.ndarray
    size: np.ndarray
    after: bytes | np.ndarray
    sure: np.ndarray | None = None  # the text followed its context more often than all others

    def pack(self) -> bytes:
        flags = self.held.astype(np.uint8) | (0 if self.sure is None else self.sure.astype(np.uint8) << 1)
        # Steps from key to key by their bytes' places: those of sorted keys have few high bytes.
        steps = np.diff(self.key.view(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
        body = [np.array([len(self.key)], np.int64), steps, self.n.astype(np.int64), flags, self.size.astype(np.uint8)]
        return zstandard.ZstdCompressor(level=1).compress(b"".join([x.tobytes() for x in body]) + self.after)

    @classmethod
    def unpack(cls, raw: bytes) -> Listed:
        m = int.from_bytes(raw[:8], "little")
        steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * m, 8).reshape(8, m).T).view(np.uint64).ravel()
        key, n = np.cumsum(steps, dtype=np.uint64).view(np.int64), np.frombuffer(raw, np.int64, m, 8 + 8 * m)
        flags, size = np.frombuffer(raw, np.uint8, 2 * m, 8 + 16 * m).reshape(2, m)
        return cls(key, n, (flags & 1).astype(bool), size.astype(np.int64), raw[8 + 18 * m :], flags >> 1 > 0)


def list_block(texts: list[bytes], train: np.ndarray) -> tuple[Listed, np.ndarray]:
    """The words of a block with their training counts, then contexts with what follows, each pair once; and the places of what follows in ``after``."""
    found, counts, pairs, raw, base, lo = [], [], [], [], 0, 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < PIECE // 2):
            size += len(texts[hi])
            hi += 1
        r, known = read(texts[lo:hi]), train[lo:hi]
        own, inverse = np.unique(r.words, return_inverse=True)
        found.append(own)
        counts.append(np.bincount(inverse, known[r.owner], minlength=len(own)).astype(np.int64))
        end = follower_ends(r)
        pairs.append((r.context, r.texts.hashes(r.texts.sums(), r.at, end), known[r.text], r.at + base, end - r.at))
        raw.append(r.texts.data)
        base += len(r.texts.data)
        lo = hi
    words, inverse = np.unique(np.concatenate(found), return_inverse=True)
    n_words = np.bincount(inverse, np.concatenate(counts), minlength=len(words)).astype(np.int64)
    key, said, known, begin, size = (np.concatenate([p[k] for p in pairs]) for k in range(5))
    pair = key.view(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + said
    order = np.argsort(pair)
    key, pair, known, begin, size = (x[order] for x in (key, pair, known, begin, size))
    starts = np.flatnonzero(np.diff(pair, prepend=~pair[:1]))
    many = np.diff(np.append(starts, len(key)))
    n = np.add.reduceat(known.astype(np.int64), starts) if len(starts) else starts
    none = np.zeros(len(words), np.int64)
    listed = Listed(
        np.concatenate([words, key[starts]]),
        np.concatenate([n_words, n]),
        np.concatenate([none.astype(bool), n < many]),
        np.concatenate([none, size[starts]]),
        np.concatenate(raw),
    )
    return listed, np.concatenate([none, begin[starts]])


def part_totals(lists: list[tuple[int, Listed]]) -> Iterator[tuple[int, int, int, bytes]]:
    """(block, n_tokens, n_types, packed) of one part: what the training rows say of each key, for every block that lists it."""
    key, n, held = (np.concatenate([getattr(x, f) for _, x in lists]) for f in ("key", "n", "held"))
    owner = np.repeat(np.arange(len(lists)), [len(x.key) for _, x in lists])
    size = np.concatenate([x.size for _, x in lists])
    text, begin = np.frombuffer(b"".join([x.after for _, x in lists]), np.uint8), np.cumsum(size) - size
    said = []
    for _, x in lists:
        t, end = Texts.of([x.after]), np.cumsum(x.size)
        said.append(t.hashes(t.sums(), end - x.size, end))
    said = np.concatenate(said)
    order = np.argsort(key)
    key, n, held, owner, size, begin, said = (x[order] for x in (key, n, held, owner, size, begin, said))
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    runs = np.diff(np.append(starts, len(key)))
    total = np.add.reduceat(n, starts)
    is_word = (key[starts] & 1) == 0
    first = np.zeros(len(key), bool)
    first[starts] = is_word & (total > 0)
    # An entry met once, in a training document, tells nothing to any other.
    useful = ~is_word & ((np.logical_or.reduceat(held, starts) & (total > 0)) | (total > 1))
    # Of each useful key: how often each text followed it, and the text that did most often; of several the least.
    run = np.repeat(np.arange(len(starts)), runs)
    rows = np.flatnonzero(useful[run])
    rows = rows[np.lexsort((said[rows], run[rows]))]
    its, said = run[rows], said[rows]
    each = np.flatnonzero((np.diff(its, prepend=-1) != 0) | (np.diff(said, prepend=~said[:1]) != 0))
    top, chosen = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    if len(each):
        often = np.add.reduceat(n[rows], each)
        np.maximum.at(top, its[each], often)
        best = each[often == top[its[each]]]
        chosen[its[best]] = rows[best]
        least: dict[int, bytes] = {}
        for k in rows[best[(np.bincount(its[best], minlength=len(starts)) > 1)[its[best]]]].tolist():
            r, after = int(run[k]), text[begin[k] : begin[k] + size[k]].tobytes()
            if r not in least or after < least[r]:
                least[r], chosen[r] = after, k
    words = np.flatnonzero((key & 1) == 0)
    words = words[np.argsort(owner[words], kind="stable")]
    cut = np.searchsorted(owner[words], np.arange(len(lists) + 1))
    told = np.unique(owner[rows] * len(starts) + run[rows])
    where, told = np.searchsorted(told, np.arange(len(lists) + 1) * len(starts)), told % len(starts)
    spread = np.repeat(total, runs)
    for b, (block, _) in enumerate(lists):
        own, entries = words[cut[b] : cut[b + 1]], told[where[b] : where[b + 1]]
        at = chosen[entries]
        out = Listed(
            np.concatenate([key[own], key[at]]),
            np.concatenate([spread[own], top[entries]]),
            np.concatenate([np.ones(len(own), bool), total[entries] > 1]),
            np.concatenate([np.zeros(len(own), np.int64), size[at]]),
            slices(text, begin[at], size[at]),
            np.concatenate([np.zeros(len(own), bool), 2 * top[entries] > total[entries]]),
        )
        yield block, int(n[own].sum()), int(first[own].sum()), out.pack()


def totals(stored: DataFrame, n_blocks: int) -> DataFrame:
    """(block, n_tokens, n_types, packed): the words and contexts of each block with what the training rows say of them.

    Keys are dealt to parts by ranges of their hash.  There are at least half as many parts as blocks, so a part holds the
    keys of two blocks at any size of the corpus; a key has one row in each block that lists it.
    """
    parts = max(4 * int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_blocks // 2)
    width = np.uint64((1 << 64) // parts + 1)

    def list_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in unpacked_blocks(batches):
            listed, begin = list_block(texts, np.array([not is_held_out(i) for i in ids]))
            part = (listed.key.view(np.uint64) // width).astype(np.int64)
            order = np.argsort(listed.key.view(np.uint64), kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
                size = listed.size[own]
                packed = Listed(listed.key[own], listed.n[own], listed.held[own], size, slices(listed.after, begin[own], size)).pack()
                values = [pa.array([part[own[0]]], pa.int64()), pa.array([block], pa.int64()), pa.array([packed], pa.binary())]
                yield pa.RecordBatch.from_arrays(values, ["part", "block", "packed"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lists = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for block, n_tokens, n_types, packed in part_totals(lists):
                values = zip([block, n_tokens, n_types, packed], [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["block", "n_tokens", "n_types", "packed"])

        for batch in batches:
            for part, block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), unpack_bytes(batch.column(2)), strict=True):
                if part != at and lists:
                    yield from out()
                    lists = []
                at = part
                lists.append((block, Listed.unpack(raw)))
        if lists:
            yield from out()

    rows = stored.mapInArrow(list_keys, "part long, block long, packed binary").repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(add_up, "block long, n_tokens long, n_types long, packed binary")


class Known:
    """The words and entries of a block, sorted by their hash."""

    def __init__(self, packed: list[bytes]):
        lists = [Listed.unpack(raw) for raw in packed] or [Listed(*[np.zeros(0, np.int64)] * 4, b"", np.zeros(0, bool))]
        key, n, again, size, sure = (np.concatenate([getattr(x, f) for x in lists]) for f in ("key", "n", "held", "size", "sure"))
        self.text, begin = np.frombuffer(b"".join([x.after for x in lists]), np.uint8), np.cumsum(size) - size
        order = np.argsort(key)
        is_word = (key[order] & 1) == 0
        words, entries = order[is_word], order[~is_word]
        self.words, self.counts = key[words], n[words]
        self.contexts, self.often, self.again = key[entries], n[entries], again[entries].astype(bool)
        self.sizes, self.starts, self.sure = size[entries], begin[entries], sure[entries]

    def count(self, words: np.ndarray) -> np.ndarray:
        """Of words that the block lists; one that it does not is an error."""
        if not len(words):
            return np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.words, words), max(0, len(self.words) - 1))
        if not len(self.words) or not (self.words[k] == words).all():
            raise RuntimeError("a block holds words that were not listed for it")
        return self.counts[k]

    def followed(self, r: Read, held_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each byte and end: the symbol that the followed text predicts (-1: none), and its state.

        A state is how long the text has agreed (0 to 3), and 4 more where it followed its context several times.  Of
        a text that is not sure it is 8 more, and the place in the text in place of how long it has agreed.
        """
        n = len(r.texts.data)
        predicted, state = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        if not len(self.contexts) or not len(r.context):
            return predicted, state
        k = np.minimum(np.searchsorted(self.contexts, r.context), len(self.contexts) - 1)
        use = (self.contexts[k] == r.context) & (self.again[k] | held_out[r.text])
        k, at, end = k[use], r.at[use], (r.texts.bounds[1:] - 1)[r.text[use]]
        size = np.minimum(self.sizes[k], end - at)
        k, at, size = k[size > 0], at[size > 0], size[size > 0]
        if not len(k):
            return predicted, state
        last = np.cumsum(size)
        inside = np.arange(last[-1]) - np.repeat(last - size, size)
        where, said = np.repeat(at, size) + inside, self.text[np.repeat(self.starts[k], size) + inside]
        right = r.texts.data[where] == said
        wrong = np.minimum.reduceat(np.where(right, REACH + 1, inside), last - size)
        go = inside <= np.repeat(wrong, size)  # the first byte that differs is predicted too
        where, said = where[go], said[go]
        predicted[where] = said
        often, unsure = np.repeat(self.often[k] > 1, size)[go], np.repeat(~self.sure[k], size)[go]
        state[where] = 4 * often + np.where(unsure, 8 + np.minimum(inside[go], 3), 0)
        good = predicted == r.texts.data
        position = np.arange(n)
        broken = np.maximum.accumulate(np.where(good, -1, position))
        agreed = position - 1 - np.concatenate([[-1], broken[:-1]])
        state += np.where(state < 8, np.searchsorted(AGREED, agreed, side="right"), 0)
        return predicted, state


_GRID = np.arange(-LIMIT * FINE, LIMIT * FINE + 1) / FINE
LOSS = np.log1p(np.exp(-_GRID)).astype(np.float32)
MISS = (1 / (1 + np.exp(_GRID))).astype(np.float32)


def followed_loss(right: np.ndarray, state: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The loss of each decision that says whether the followed text is right; its chance is that so far in its text and state."""
    group = owner * len(FIRST) + state
    order = np.argsort(group, kind="stable")
    group, own = group[order], right[order].astype(np.int64)
    begins = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.maximum.accumulate(np.where(begins, np.arange(len(group)), 0))
    before = np.cumsum(own) - own
    hits = before - before[first]
    met = np.arange(len(group)) - first
    a, b = np.array(FIRST)[group % len(FIRST)].T
    chance = (hits + a) / (met + a + b)
    out = np.empty(len(group))
    out[order] = -np.log(np.where(own == 1, chance, 1 - chance))
    return out


def mix_scores(texts: list[bytes], trees: Trees, tables: np.ndarray, predicted: np.ndarray | None = None, state: np.ndarray | None = None) -> np.ndarray:
    """The log10 probability of each text."""
    s = symbols(texts)
    n, sizes = len(texts), s.sizes
    length = trees.length[s.pair].astype(np.int64)
    out = np.zeros(n)
    if predicted is not None:
        at = np.flatnonzero(predicted >= 0)
        right = predicted[at] == s.pair[at] % SYMBOLS
        owner = np.repeat(np.arange(n), sizes)[at]
        out += np.bincount(owner, followed_loss(right, state[at], owner), minlength=n)
        length[at[right]] = 0
    # Longest first, a block of each text after the other: the texts that are still read at a level are the first ones.
    by_size = np.argsort(-sizes, kind="stable")
    levels = -(-sizes[by_size] // BLOCK)
    many = n - np.searchsorted(levels[::-1], np.arange(levels[0]), side="right")  # texts of each level
    rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    level = np.repeat(np.arange(levels[0]), many)
    first = (np.cumsum(sizes) - sizes)[by_size][rank] + level * BLOCK
    width = np.minimum(BLOCK, sizes[by_size][rank] - level * BLOCK)
    last = np.cumsum(width)
    order = np.repeat(first - last + width, width)
    order += np.arange(last[-1])
    length = length[order]
    step = ways(s.pair[order], trees, length)
    block_ends = np.cumsum(length)[last - 1]  # of each block, in decisions
    sign = (step & np.uint32(1)).astype(np.int8) * np.int8(2) - np.int8(1)
    inputs = []
    for x, start in zip(slots([h[order] for h in s.hashes], length, step), STARTS, strict=False):
        raw = tables[start:][x]
        raw *= sign
        inputs.append(raw)
    sure = np.abs(inputs[-1])
    local = (step >> np.uint32(1)).astype(np.int8) & np.int8(7)
    local *= np.int8(3)
    local += sure > 8
    local += sure > 45
    gate = np.repeat(rank * GATES, np.diff(block_ends, prepend=0))
    gate += local
    inputs = [x.astype(np.float32) for x in inputs]
    # Logits are inputs over SCALE; the weights take the scale, and the step of the tables, in.
    weights = [np.full(n * GATES, w * FINE / SCALE, np.float32) for w in START_WEIGHTS]
    loss, lo = np.empty(len(gate), np.float32), 0
    for hi in block_ends[np.cumsum(many) - 1].tolist():
        if hi == lo:
            continue
        g, xs = gate[lo:hi], [x[lo:hi] for x in inputs]
        z = weights[0][g]
        z *= xs[0]
        for w, x in zip(weights[1:], xs[1:], strict=True):
            z += w[g] * x
        np.minimum(z, LIMIT * FINE, out=z)
        np.maximum(z, -LIMIT * FINE, out=z)
        z += LIMIT * FINE + 0.5
        q = z.astype(np.int64)
        loss[lo:hi] = LOSS[q]
        miss = MISS[q]
        size = int(g[-1]) // GATES * GATES + GATES
        norm = np.bincount(g, minlength=size) * A_DECISION
        norm += MORE
        for w, x in zip(weights, xs, strict=True):
            w[:size] += (FINE / SCALE**2) * np.bincount(g, miss * x, minlength=size) / norm
        lo = hi
    some = np.flatnonzero(np.diff(block_ends, prepend=0))
    starts = np.concatenate([[0], block_ends[:-1]])[some]
    found = np.zeros(n)
    if len(some):
        found[by_size] = np.bincount(rank[some], np.add.reduceat(loss, starts, dtype=np.float64), minlength=n)
    return -(out + found) / np.log(10)


OUT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits, bits_per_byte of every row."""
    stored = stored_blocks(docs)
    trees = build_trees(count_pairs(stored))
    tables = train_tables(stored, trees)
    seen = stored.agg(F.count_if(~_held_out()).alias("ends"), F.count_distinct("block").alias("blocks")).first()
    listed = written(totals(stored, seen.blocks), compression="uncompressed")
    sums = listed.agg(F.sum("n_tokens").alias("n"), F.sum("n_types").alias("v")).first()
    n_ends = seen.ends
    n_total, n_types = (sums.n or 0) + n_ends, (sums.v or 0) + (n_ends > 0)
    norm = float(np.log10(n_total + 0.1 * (n_types + 1)))
    end = float(np.log10(n_ends + 0.1))
    shared = docs.sparkSession.sparkContext.broadcast((trees, tables))  # both of fixed size

    def score(rows: pa.Table, lists: pa.Table) -> pa.Table:
        trees, tables = shared.value
        known = Known(unpack_bytes(lists.column("packed").combine_chunks()) if lists.num_rows else [])
        ids, raw = rows.column("doc_id").to_pylist(), rows.column("packed").to_pylist()
        unpack = zstandard.ZstdDecompressor().decompress
        out, at = [], 0
        while at < len(raw):
            piece, size = [], 0
            while at + len(piece) < len(raw) and (not piece or size < PIECE):
                piece.append(unpack(raw[at + len(piece)]))
                size += len(piece[-1])
            r, own = read(piece), ids[at : at + len(piece)]
            apart = np.array([is_held_out(i) for i in own])
            c, m = known.count(r.words), len(piece)
            n = np.bincount(r.owner, minlength=m) + 1
            n_known = np.bincount(r.owner, c > 0, minlength=m) + (n_ends > 0)
            base = np.bincount(r.owner, np.log10(c + 0.1), minlength=m) + end - n * norm
            got = mix_scores(piece, trees, tables, *known.followed(r, apart))
            for j, text in enumerate(piece):
                out.append((own[j], bool(apart[j]), int(n[j]), int(n_known[j]), n_total, float(base[j]), float(got[j]), len(text)))
            at += m
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        names = [f.split()[0] for f in OUT.split(", ")]
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.table({a: pa.array(c, t) for a, c, t in zip(names, columns, kinds, strict=True)})

    joined = stored.groupBy("block").cogroup(listed.select("block", "packed").groupBy("block"))
    rows = joined.applyInArrow(score, OUT).withColumn("bits", F.col("score") / F.log10(F.lit(0.5)))
    return rows.withColumn("bits_per_byte", F.col("bits") / F.greatest("n_bytes", F.lit(1)))
