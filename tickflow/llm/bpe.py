"""Byte-level BPE through a table of distinct words.

Texts are split into words by the tokenizer's own pattern in blocks of bounded
size.  The distinct words of each block are dealt out by word, so that equal
words of all blocks meet and each is encoded once; their ids, without the words, are
joined back to their block, where every text is put together by the position of its words.
A block lists a word once, so a frequent word is listed once per block and not once
per occurrence, and no word or document makes a large group.  Decoding gathers
the piece of each id from the vocabulary (a table of fixed size) that each task holds.

Both passes over the texts cut them into blocks, and deal and order a block's words, by
the same rule, and a list of ids names its words by a digest.  Were a block cut differently
the second time, the words that it lacks are encoded in place.

Defined results for odd input
-----------------------------
* null text: as the empty text, no ids and an empty decoded text;
* rows with equal or null doc_id: each is encoded on its own;
* an empty table gives no rows; further columns are not returned;
* a special token's string inside a text is that token, as in the library;
* a text longer than a block is a block of its own, and one word of any length is a word: both are held whole by a task.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.packing import blocks, packed_blocks
from tickflow.llm.shared import give_back, released

#: The byte-level pattern, with white space as Unicode defines it.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"


def _plane_find() -> Callable[[str], list[str]]:
    """``PATTERN`` over texts of the first plane, with its classes written out: the same words in half the time."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    classes = {}
    for name in ("White_Space", "L", "N"):
        points = np.array([ord(c) for c in regex.findall(rf"\p{{{name}}}", every)])
        runs = np.split(points, np.flatnonzero(np.diff(points) != 1) + 1)
        classes[name] = "".join(f"\\u{run[0]:04x}-\\u{run[-1]:04x}" for run in runs)
    space, letter, number = classes.values()
    plain = PATTERN.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[^{space}{letter}{number}]")
    for name, inside in ((r"\p{White_Space}", f"[{space}]"), (r"\P{White_Space}", f"[^{space}]"), (r"\p{L}", f"[{letter}]"), (r"\p{N}", f"[{number}]")):
        plain = plain.replace(name, inside)
    return re.compile(plain).findall


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file: words of a text, ids of words, pieces of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        self.pieces = {
            i: bytes(letters[c] for c in piece)
            for piece, i in raw["model"]["vocab"].items()
            if piece not in self.special
        } | {i: s.encode() for s, i in self.special.items()}
        self.path = path
        self._find, self._plane_find = regex.compile(PATTERN).findall, _plane_find()
        names = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.cut = regex.compile(f"({names})").split if names else None
        self._tokenizer = self._table = None

    def find(self, text: str) -> list[str]:
        first_plane = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return (self._plane_find if first_plane else self._find)(text)

    def words(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.find(text)
        out: list[str] = []
        for k, part in enumerate(self.cut(text)):
            out += [part] if k % 2 else self.find(part)
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        if self._tokenizer is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.no_padding()
            self._tokenizer.no_truncation()
        out = []
        for at in range(0, len(words), 20_000):
            for e in self._tokenizer.encode_batch(words[at : at + 20_000], add_special_tokens=False):
                out.append(array("I", e.ids))
        if sys.byteorder == "big":
            for ids in out:
                ids.byteswap()
        return [ids.tobytes() for ids in out]

    def close(self) -> None:
        """Lets the library's tokenizer go, which later stages of a reused worker do not need."""
        self._tokenizer = None

    def decode(self, ids: np.ndarray) -> bytes:
        """The pieces of ``ids`` end to end."""
        if self._table is None:
            pieces = [self.pieces.get(i, b"") for i in range(max(self.pieces) + 1)]
            sizes = np.array([len(p) for p in pieces], np.int64)
            self._table = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes
        return b"".join([gather(*self._table, ids[k : k + (1 << 17)]).tobytes() for k in range(0, len(ids), 1 << 17)])

    def text(self, ids: np.ndarray) -> str:
        return self.decode(ids).decode("utf-8", "replace")


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of ``data`` that ``which`` names, end to end."""
    width = sizes[which]
    ends = np.cumsum(width)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - ends + width, width)]


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Numbers(dict):
    """The numbers of words, in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def dealt_words(words: Iterable[str], parts: int) -> list[list[str]]:
    """Distinct words by part, in an order that follows from the words alone."""
    dealt: list[list[str]] = [[] for _ in range(parts)]
    for word in sorted(words):
        dealt[xxhash.xxh32_intdigest(word) % parts].append(word)
    return dealt


def words_body(words: list[str]) -> bytes:
    """Words end to end after their number and lengths."""
    raw = [w.encode() for w in words]
    return np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw)


def body_words(body: bytes) -> list[str]:
    n = int.from_bytes(body[:4], "little")
    ends = np.cumsum(np.frombuffer(body, "<u4", n, 4)).tolist()
    text = body[4 + 4 * n :]
    return [text[lo:hi].decode() for lo, hi in zip([0, *ends], ends, strict=False)]


def words_digest(body: bytes) -> int:
    return xxhash.xxh3_64_intdigest(body) - (1 << 63)


def pack_ids(ids: list[bytes]) -> bytes:
    """The ids of words, compressed: width, number of words, number of ids of each, ids."""
    sizes = np.array([len(ids), *[len(i) // 4 for i in ids]], "<u4")
    every = np.frombuffer(b"".join(ids), "<u4")
    wide = bool(len(every)) and int(every.max()) > 0xFFFF
    return zstandard.ZstdCompressor(level=3).compress(bytes([wide]) + sizes.tobytes() + (every if wide else every.astype("<u2")).tobytes())


def unpack_ids(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The number of ids of each word, and all ids."""
    body = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(body[1:5], "little")
    ids = np.frombuffer(body, "<u4" if body[0] else "<u2", -1, 5 + 4 * n)
    return np.frombuffer(body, "<u4", n, 5).astype(np.int64), ids.astype("<u4")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded for each row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Words are dealt by hash to more parts than the shuffle has tasks; equal words share a part.
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @released
    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for block, _, texts in blocks(batches):
            found: set[str] = set()
            for text in texts:
                found.update(voc.words(text))
            dealt, found = dealt_words(found, parts), set()
            squeeze = zstandard.ZstdCompressor(level=3).compress
            for part, words in enumerate(dealt):
                if words:
                    packed = squeeze(words_body(words))
                    arrays = [pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([packed], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["part", "block", "packed"])

    @released
    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by part: each distinct word of a part is encoded once, and each block gets the ids of its own words."""
        voc, at, known = vocabulary(path), None, {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part, block, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    at, known = part, {}
                words = body_words(body := unpack(packed))
                new = [w for w in words if w not in known]
                known.update(zip(new, voc.encode(new), strict=True))
                arrays = [pa.array([x], pa.int64()) for x in (block, part, words_digest(body))]
                arrays.append(pa.array([pack_ids([known[w] for w in words])], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, ["block", "part", "digest", "packed"])
        voc.close()

    def put_together(docs: pa.Table, coded: pa.Table) -> pa.Table:
        """A block's words have numbers; the ids of a text are gathered by the numbers of its words, its pieces by its ids."""
        voc, number, own = vocabulary(path), Numbers(), []
        unpack = zstandard.ZstdDecompressor().decompress
        for packed in docs.column("packed").to_pylist():
            split = voc.words(unpack(packed).decode())
            own.append(np.fromiter(map(number.__getitem__, split), np.int32, len(split)))
        given = dict(zip(zip(*(coded.column(c).to_pylist() for c in ("part", "digest")), strict=True), coded.column("packed").to_pylist(), strict=True))
        order, sizes, held, lost = [], [], [], []
        for part, words in enumerate(dealt_words(number, parts)):
            packed = given.get((part, words_digest(words_body(words)))) if words else None
            if packed is None:  # the block was cut otherwise when its words were listed
                lost += words
                continue
            own_sizes, own_ids = unpack_ids(packed)
            sizes.append(own_sizes)
            held.append(own_ids)
            order += words
        found = voc.encode(lost)
        sizes = np.concatenate([*sizes, np.array([len(i) // 4 for i in found], np.int64)])
        ids_of = np.concatenate([*held, np.frombuffer(b"".join(found), "<u4")])
        row = np.empty(len(number), np.int64)
        row[np.fromiter(map(number.__getitem__, order + lost), np.int64, len(number))] = np.arange(len(number))
        starts = (np.cumsum(sizes) - sizes)[row]
        sizes = sizes[row]
        del number, given, held, order, lost, found
        n_tokens, ids, decoded = [], [], []
        for words in own:
            text_ids = gather(ids_of, starts, sizes, words)
            n_tokens.append(len(text_ids))
            ids.append(text_ids.tobytes())
            decoded.append(voc.text(text_ids))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "ids": pa.array(ids, pa.binary()),
                "decoded": pa.array(decoded, pa.string()),
            }
        )

    def join_back(docs: pa.Table, coded: pa.Table) -> pa.Table:
        try:
            return put_together(docs, coded)
        finally:
            give_back()

    words = texts.mapInArrow(list_words, "part long, block long, packed binary").repartition("part").sortWithinPartitions("part")
    coded = words.mapInArrow(encode_words, "block long, part long, digest long, packed binary")
    return packed_blocks(docs).groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(join_back, ENCODED)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids array) by a join of every id with its piece."""
    voc: Callable = vocabulary(path)
    pieces = encoded.sparkSession.createDataFrame(list(voc.pieces.items()), "id int, piece binary")
    rows = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces), "id")
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("piece")))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x.piece), "")), "UTF-8")
    return encoded.select("doc_id").join(parts.select("doc_id", text.alias("text")), "doc_id", "left").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
