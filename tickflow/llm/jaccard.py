"""Jaccard join of word shingles through parity sketches.

A document's shingles are hashed and the equal sets become classes.  For sets
with a Jaccard similarity of t or more, the symmetric difference is at most
``d = n1 (1 - t) / t`` for the smaller size n1.  In each size band a set's shingles
are dealt to P > d parts; every shingle flips one bit of its part's 64-bit parity
word, so the Hamming distance of two sketches is a lower bound of the symmetric
difference, and at least P - d parts of two linked sets agree.  A part that agrees
holds the same shingles in both, so the exclusive or of their hashes agrees too
and makes the key selective; parts without shingles are left out where a set has
fewer of them than the P - d parts that must agree.

Sets that share a key are candidates.  First each is checked against the least
class of its key, where the Hamming distance of their sketches allows a link; then, for keys whose sets are not yet in one component, pairs
across components pass a Hamming filter and are checked, in rounds, until they are
joined or no unchecked pair is left.  Long sets have a second sketch as wide as they need, since one of fixed width fills
up and allows every pair.  Checks compare whole sets, which are made only for the classes of pairs that both sketches allow.
Linked sets lie in one component, so the
links of a class are counted there, between bands of classes; copies are not expanded.

Defined results for odd input
-----------------------------
* null or blank text: no shingles, its own component;
* fewer words than a shingle has: the whole sequence is the one shingle;
* repeated rows are one class, and ``keep_one`` keeps one of them; a null doc_id takes part and never names a
  component unless all of its ids are null;
* an empty table gives no rows; further columns are ignored (``keep_one`` returns them);
* a text of any length is one set, held whole by the tasks that compare it.

Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.components import components
from tickflow.llm.packing import packed_texts, unpack_texts
from tickflow.llm.shared import aside, chunks, released, written
from tickflow.llm.words import Texts, grams, mix

CHUNK = 1 << 21
SKETCH_WORDS = 32
SALTS = 16
BAND, BAND_BYTES = 1024, 16 << 20


@dataclass(frozen=True)
class Settings:
    """Linked: ``100 * |A & B| >= percent * |A | B|`` of the ``words``-word shingles."""

    words: int = 3
    percent: int = 90
    ratio: float = 1.25


def shingle_sets(texts: list[str | None], s: Settings) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    t = Texts.of(texts, lower=True)
    starts, ends, owner = t.words()
    hashes = t.hashes(t.sums(), starts, ends)
    values, at = grams(hashes, owner, s.words)
    values_owner = owner[at]
    edges = np.searchsorted(values_owner, np.arange(len(texts) + 1))
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k in range(len(texts)):
        if edges[k + 1] > edges[k]:
            out.append(np.unique(values[edges[k] : edges[k + 1]]))
        elif first[k + 1] > first[k]:
            own = hashes[first[k] : first[k + 1]]
            out.append(np.array([xxhash.xxh3_64_intdigest(own.tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


class Bands:
    """Size bands: where each starts, and its number of parts and of differences."""

    def __init__(self, s: Settings):
        self.s, self.starts = s, [1]

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, parts, differences) for the band of size n and those whose larger partner n can be."""
        while self.starts[-1] <= n:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * self.s.ratio)))
        band = int(np.searchsorted(self.starts, n, side="right")) - 1
        out = []
        while band >= 0:
            most = self.starts[band + 1] - 1
            if n * self.s.percent <= 100 * most:
                d = most * (100 - self.s.percent) // self.s.percent
                out.append((band, d + 1 + (-(-(d + 1) // 7) if d else 0), d))
            else:
                break
            band -= 1
        return out


def keys_of(values: np.ndarray, bands: Bands) -> np.ndarray:
    """The join keys of one set: one per band and part that holds shingles."""
    out = []
    for band, parts, d in bands.of(len(values)):
        part = (mix(values + np.uint64(band)) >> np.uint64(16)) % np.uint64(parts)
        order = np.argsort(part)
        part, own = part[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        folded = np.bitwise_xor.reduceat(own, first)
        parity = np.bitwise_xor.reduceat(np.uint64(1) << (own >> np.uint64(58)), first)
        salt = np.uint64(band * 0x1000003)
        keys = mix(mix(folded + part[first] + salt) ^ parity)
        sizes = np.diff(np.append(first, len(own)))
        for weak in (1, 0):  # parts of one shingle are left out too where enough others must agree
            if int((sizes > weak).sum()) > d:
                keys = keys[sizes > weak]
                break
        else:
            missing = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[first])
            keys = np.concatenate([keys, mix(mix(missing + salt) ^ np.uint64(0))])
        out.append(keys)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(values: np.ndarray, words: int = SKETCH_WORDS) -> bytes:
    """A parity sketch of fixed width."""
    bits = np.bincount((mix(values) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def wide_sketch(values: np.ndarray) -> bytes | None:
    """A sketch of two to four bits a shingle; None where the one of fixed width has as many."""
    words = SKETCH_WORDS
    while 32 * words < len(values):
        words *= 2
    return sketch(values, words) if words > SKETCH_WORDS else None


def distance(a: bytes, b: bytes) -> int:
    """The Hamming distance of two sketches, the wider folded to the width of the other."""
    width = min(len(a), len(b))
    one, other = (np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), axis=0) for x in (a, b))
    return int(np.bitwise_count(one ^ other).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    same = int((large[at] == small).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def _classes(docs: DataFrame, s: Settings) -> DataFrame:
    @released
    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            sets = shingle_sets(batch.column(1).to_pylist(), s)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(v) for v in sets], pa.int64()),
                    pa.array([class_of(v) if len(v) else None for v in sets], pa.int64()),
                    pa.array([sketch(v) if len(v) else None for v in sets], pa.binary()),
                    pa.array([wide_sketch(v) for v in sets], pa.binary()),
                ],
                ["doc_id", "digest", "n_shingles", "cls", "sketch", "wide"],
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(classify, "doc_id long, digest long, n_shingles long, cls long, sketch binary, wide binary")


def _shared_keys(docs: DataFrame, s: Settings) -> DataFrame:
    """(key, cls, pivot) of the keys that more than one class has."""

    @released
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(s)
        for batch in chunks(batches, "text", CHUNK):
            keys, cls, seen = [], [], set()
            for values in shingle_sets(batch.column(0).to_pylist(), s):
                if len(values) and (c := class_of(values)) not in seen:
                    seen.add(c)
                    own = keys_of(values, bands)
                    keys.append(own)
                    cls.append(np.full(len(own), c, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(cls))], ["key", "cls"]
                )

    @released
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: drops keys of one class; holds one batch, and the last row of the one before."""
        last: tuple[int, int] | None = None  # the last row
        pivot, open_key = 0, False  # the least class of its key, and whether that key has been given out
        for batch in batches:
            key, cls = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(key):
                continue
            if last is not None:
                key, cls = np.append(last[0], key), np.append(last[1], cls)
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
            key, cls = key[new], cls[new]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            least = np.repeat(cls[starts], sizes)
            many = np.repeat(sizes > 1, sizes)
            if last is not None and key[0] == last[0]:
                run = slice(0, sizes[0])
                least[run] = pivot
                many[run] |= open_key
                if open_key:
                    many[0] = False  # given out before
            tail = starts[-1]
            given = sizes[-1] > 1 or (len(starts) == 1 and last is not None and open_key)
            pivot = least[tail]
            last, open_key = (key[-1], cls[-1]), bool(given)
            if many.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[many]), pa.array(cls[many]), pa.array(least[many])], ["key", "cls", "pivot"]
                )

    rows = docs.select("text").mapInArrow(emit, "key long, cls long").repartition("key").sortWithinPartitions("key", "cls")
    return rows.mapInArrow(shared, "key long, cls long, pivot long")


def _verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The links among ``pairs`` (cls, pivot): a pivot's pairs are dealt to salts, each with its set."""
    salted = pairs.withColumn("salt", F.pmod(F.hash("cls"), F.lit(SALTS)))
    own = salted.select(F.col("pivot").alias("cls"), "pivot", "salt").distinct()
    rows = salted.select("cls", "pivot", "salt").union(own).join(sets.select("cls", "shingles"), "cls")
    first = (F.col("cls") != F.col("pivot")).alias("rest")
    rows = rows.select("pivot", "salt", first, "cls", "shingles").repartition("pivot", "salt")

    @released
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = None, None
        for batch in batches:
            found = []
            for pivot, rest, cls, raw in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                values = np.frombuffer(raw, np.uint64)
                if not rest:
                    at, base = pivot, values
                elif pivot == at and similar(values, base, s.percent):
                    found.append((cls, pivot))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return rows.sortWithinPartitions("pivot", "salt", "rest").mapInArrow(check, "a long, b long")


def _near(pairs: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """The ``pairs`` (cls, pivot) whose sketches allow a link: their Hamming distance is at most the difference that links have."""
    one = sketches.select("cls", "n", "sketch")
    other = sketches.select(F.col("cls").alias("pivot"), F.col("n").alias("m"), F.col("sketch").alias("against"))
    rows = pairs.join(one, "cls").join(other, "pivot").select("cls", "pivot", "n", "m", "sketch", "against")

    @released
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS) for k in (4, 5))
            near = np.bitwise_count(a ^ b).sum(1) * (100 + s.percent) <= n * (100 - s.percent)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], ["cls", "pivot"])

    return rows.mapInArrow(compare, "cls long, pivot long")


def _near_long(pairs: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """The ``pairs`` (cls, pivot), near by sketches of fixed width, that the wide ones allow too; pairs without two wide ones stay."""
    one = sketches.select("cls", "n", "wide")
    other = sketches.select(F.col("cls").alias("pivot"), F.col("n").alias("m"), F.col("wide").alias("against"))
    rows = pairs.join(one, "cls").join(other, "pivot").select("cls", "pivot", "n", "m", "wide", "against")

    @released
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(iter([whole]), "wide", CHUNK):
                n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                both = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
                far = np.array([distance(a, b) if a and b else 0 for a, b in both])
                near = far * (100 + s.percent) <= n * (100 - s.percent)
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], ["cls", "pivot"])

    return rows.mapInArrow(compare, "cls long, pivot long")


def _sets(docs: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """(cls, shingles) of the documents that stand for the classes ``reps`` (doc_id, cls)."""

    @released
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "packed", CHUNK // 4):
            wanted = batch.column(0).to_pylist()
            sets = shingle_sets(unpack_texts(batch.column(1)), s)
            rows = [(c, v.tobytes()) for c, v in zip(wanted, sets, strict=True) if class_of(v) == c]
            if rows:
                types = (pa.int64(), pa.binary())
                arrays = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["cls", "shingles"])

    texts = packed_texts(docs).join(reps, F.col("id").eqNullSafe(F.col("doc_id"))).select("cls", "packed")
    return texts.mapInArrow(build, "cls long, shingles binary")


def _across(rows: DataFrame, s: Settings, pace: int) -> DataFrame:
    """Pairs (key, cls, pivot) that may join the labels of each key: their sketches are near enough.

    At pace 1 labels that a pair would join count as one from then on, so a key gives fewer pairs
    than it has labels.  At a greater pace a class gives up to so many of its pairs at once, and the
    rest in later rounds.  ``failed`` lists partners of a class that are known not to be linked.
    """

    @released
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key in _runs(batches):
            root, cls, n = (key.column(k).to_numpy(zero_copy_only=False).copy() for k in (1, 2, 3))
            bits = np.frombuffer(b"".join(key.column(4).to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)
            failed = key.column(5).to_pylist()
            found = []
            for k in range(len(cls) - 1):
                differ = np.flatnonzero(root[k + 1 :] != root[k]) + k + 1
                if not len(differ):
                    continue
                far = np.bitwise_count(bits[differ] ^ bits[k]).sum(1)
                near = differ[far * (100 + s.percent) <= (n[differ] + n[k]) * (100 - s.percent)]
                not_linked, given = set(failed[k] or ()), 0
                for j in near.tolist():
                    if root[j] != root[k] and int(cls[j]) not in not_linked:
                        found.append((int(cls[j]), int(cls[k])))
                        given += 1
                        if pace == 1:
                            root[root == root[j]] = root[k]
                        elif given == pace:
                            break
            if found:
                columns = [[key.column(0)[0].as_py()] * len(found), *zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "cls", "pivot"])

    return rows.mapInArrow(pairs, "key long, cls long, pivot long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        edges = [0, *cuts.tolist(), len(key)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if held and lo == 0 and hi and held[-1].column(0)[-1].as_py() != key[0]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if lo and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` after the links ``found`` (a, b): only the components that they tie together are searched."""
    ties = found
    for end in ("a", "b"):
        at = roots.select(F.col("node").alias(end), "root")
        ties = ties.join(at, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    tied = written(components(ties.select("a", "b")))
    moved = roots.join(tied.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    fresh = tied.join(roots.select("node"), "node", "left_anti")
    return written(moved.select("node", F.coalesce("top", "root").alias("root")).union(fresh.select("node", "root")))


def _joined(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, digest, n_shingles, cls, root) of every row, the components, and the documents (doc_id, cls) that stand for
    the classes that share a key; blank texts have no root."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = written(_classes(docs, s))
    classes = sketched.drop("sketch", "wide")
    shared = written(_shared_keys(docs, s))
    star = written(shared.filter("cls <> pivot").select("cls", "pivot").distinct())
    wanted = star.select("cls").union(star.select(F.col("pivot").alias("cls"))).distinct()
    reps = written(classes.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(wanted, "cls"))
    sketches = sketched.select("cls", F.col("n_shingles").alias("n"), "sketch", "wide").join(reps, "cls", "left_semi")
    sketches = written(sketches.dropDuplicates(["cls"]))

    def links(pairs: DataFrame) -> DataFrame:
        """The links among ``pairs`` (cls, pivot), near by sketches of fixed width: only what wide ones allow is fetched and checked."""
        pairs = written(_near_long(pairs, sketches, s))
        ends = pairs.select("cls").union(pairs.select(F.col("pivot").alias("cls"))).distinct()
        return _verified(pairs, _sets(docs, written(reps.join(ends, "cls")), s), s)

    roots = components(links(written(_near(star, sketches, s))))

    failed, keys, pace = None, shared.select("key", "cls"), 1
    while True:
        # A key whose classes share a component is done, and so is one that gave no pair in the last round:
        # later components only join, and pairs that failed stay failed.
        labelled = keys.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        labelled = written(labelled.select("key", "cls", F.coalesce("root", "cls").alias("label")))
        open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
        keys = written(labelled.join(written(open_keys.select("key")), "key"))
        rows = keys.join(sketches.select("cls", "n", "sketch"), "cls")
        keys = keys.select("key", "cls")
        if failed is None:
            rows = rows.withColumn("failed", F.lit(None).cast("array<bigint>"))
        else:
            partners = failed.groupBy("cls").agg(F.collect_set("pivot").alias("failed"))
            rows = rows.join(partners, "cls", "left")
        rows = rows.select("key", "label", "cls", "n", "sketch", "failed").repartition("key").sortWithinPartitions("key", "cls")
        given = written(_across(rows, s, pace))
        pace *= 4
        across = given.select("cls", "pivot").distinct()
        if not given.limit(1).count():
            break
        keys = keys.join(given.select("key").distinct(), "key", "left_semi")
        found = written(links(across))
        missed = across.join(found.select(F.col("a").alias("cls"), F.col("b").alias("pivot")), ["cls", "pivot"], "left_anti")
        both = missed.union(missed.select(F.col("pivot").alias("cls"), F.col("cls").alias("pivot")))
        failed = written(both if failed is None else failed.union(both))
        if found.limit(1).count():
            roots = _merged(roots, found)
        elif not missed.limit(1).count():
            break
    named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    return named, roots, reps


def _link_counts(roots: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(cls, n_links): the other classes each is linked to.

    Linked classes are in one component.  Its classes are dealt to bands, and each pair of bands is a group
    of its own, which holds two bands: about ``2 * BAND`` sets, or ``2 * BAND_BYTES`` of them.
    """
    rows = roots.select(F.col("node").alias("cls"), "root").join(sets.select("cls", "shingles").dropDuplicates(["cls"]), "cls")
    sizes = rows.groupBy("root").agg(F.count("*").alias("m"), F.sum(F.octet_length("shingles")).alias("b"))
    bands = F.ceil(F.greatest(F.col("m") / BAND, F.col("b") / BAND_BYTES)).cast("int")
    rows = rows.join(sizes.select("root", bands.alias("bands")), "root").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("bands")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    rows = rows.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cls", "shingles")

    def count(group: pa.Table) -> pa.Table:
        lo, own = group.column("lo").to_numpy(), group.column("own").to_numpy()
        same = bool(group.column("hi")[0].as_py() == lo[0])
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        n = np.array([len(v) for v in sets])
        left, right = (np.arange(len(n)),) * 2 if same else (np.flatnonzero(own == lo), np.flatnonzero(own != lo))
        both = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2^24 are exact
        _, value, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(n)), n)
        value, row = (np.cumsum(often > 1) - 1)[value[often[value] > 1]], row[often[value] > 1]
        order = np.argsort(value)
        value, row = value[order], row[order]
        for at in range(0, int(value[-1]) + 1 if len(value) else 0, 2048):
            part = slice(*np.searchsorted(value, (at, at + 2048)))
            has = np.zeros((len(n), 2048), np.float32)
            has[row[part], value[part] - at] = 1
            both += has[left] @ has[right].T
        links = 100 * both.astype(np.int64) >= s.percent * (n[left][:, None] + n[right] - both.astype(np.int64))
        out = np.zeros(len(n), np.int64)
        if same:
            np.fill_diagonal(links, False)
        out[left] += links.sum(1)
        if not same:
            out[right] += links.sum(0)
        return pa.table({"cls": group.column("cls"), "n": pa.array(out)})

    return rows.groupBy("root", "lo", "hi").applyInArrow(count, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n_links"))


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, cls, n_links of every row of ``docs``.

    ``n_links`` counts all other classes that the row's class is linked to; copies are one class.
    """
    named, roots, reps = _joined(docs, s)
    sets = written(_sets(docs, written(reps.join(roots.select(F.col("node").alias("cls")), "cls")), s))
    counts = _link_counts(roots, sets, s)
    least = named.groupBy("root").agg(F.min("doc_id").alias("least"))
    return (
        named.join(least, "root", "left")
        .join(counts, "cls", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
            "cls",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )


def keep_one(docs: DataFrame, s: Settings = Settings(words=5, percent=80, ratio=1.5)) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group one row of the least id stays, null ids last.

    A row is told by its id and the hash of its text; of rows that share both one stays.
    """
    named, *_ = _joined(docs, s)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    rows = named.filter("root IS NOT NULL").groupBy("root", row.alias("row")).agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min("row").alias("first"))
    marked = rows.join(first, "root").filter("n > 1 OR row <> first")
    names = [F.col("row.doc_id").alias("marked_id"), F.col("row.digest").alias("marked_digest")]
    marked = written(marked.select(*names, (F.col("row") == F.col("first")).alias("repeated")))
    moved, back = aside(docs, "doc_id", "text")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("marked_id")) & (F.xxhash64("text") == F.col("marked_digest"))
    kept = moved.join(marked, same, "left_anti")
    if marked.filter("repeated").limit(1).count():
        again = moved.join(marked.filter("repeated"), same, "left_semi").withColumn("marked_digest", F.xxhash64("text"))
        kept = kept.union(again.dropDuplicates(["doc_id", "marked_digest"]).drop("marked_digest"))
    return kept.select(*back)
