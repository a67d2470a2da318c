"""Byte-level BPE by merge ranks: a rank queue of hierarchical bitmaps over a linked list.

A pre-token is a linked list of byte runs.  Pairs of neighbours that the rank file
knows, and that go before the pairs beside them, wait in the bucket of their rank; a bitmap tells the ranks that
have a bucket and a bitmap above it the words of the first that are not zero, so
the least rank is two find-first-set steps away however long the pre-token is.
A bucket, a position or a heap of them, gives its leftmost position first.  A merge changes the pairs to both
sides; what they left in other buckets is stale, is told by the pair's present
rank and skipped.  A pre-token of n bytes takes about n pushes and pops, so one
of many megabytes is no special case.

Texts are read in Arrow batches and never shuffled: a hot source or a group of
copies is spread as the table's files are.  A task keeps the ids of short
pre-tokens that it has met, up to a bound; this changes no result.

Defined results for odd input
-----------------------------
* null text: as the empty text: no tokens, no decoded bytes;
* rows with equal or null ids, and repeated rows: each is encoded on its own;
* an empty table gives no rows; further columns, of any name, are not returned;
* special tokens do not exist: their strings are ordinary text;
* a text of any length is read whole, by one task, whose lists hold about 50 bytes a byte of its longest pre-token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.pretokens import Kept, Splitter, matched_patterns
from tickflow.llm.shared import chunks

ENCODED = "doc_id long, n_tokens long, ids binary"
#: Pre-tokens kept with their ids by a task in each of two generations, and the longest of them.
KEPT, KEPT_CHARS = 400_000, 48
#: Bits of one word of the bitmaps, of which there are two levels: ranks go up to its square.
SHIFT = 9
MASK = (1 << SHIFT) - 1
_BIT = [1 << k for k in range(1 << SHIFT)]
#: Above all ranks.
NONE = 1 << 2 * SHIFT


class RankVocabulary:
    """A rank file and a pre-token pattern: ids of texts, bytes of ids."""

    def __init__(self, path: str, *patterns: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError(f"{path} lacks a byte of its own")
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        if max(self.pieces) >> 2 * SHIFT:
            raise ValueError(f"{path} has ranks of {1 << 2 * SHIFT} or more")
        #: The queue, empty between pre-tokens: a bucket is a position or a heap of them, a bit tells that a rank has one.
        self.low = [0] * (1 << SHIFT)
        self.buckets: dict[int, int | list[int]] = {}
        self.code = [i.to_bytes(4, "little") for i in range(max(self.pieces) + 1)].__getitem__
        self.pretokens = Splitter(*patterns).words
        self.known = Kept(self._words, KEPT, KEPT_CHARS)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token; that of the whole where the file has it."""
        rank_of, n = self.ranks.get, len(piece)
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        low, top, buckets = self.low, 0, self.buckets
        following = [*range(1, n + 1), n]
        before = list(range(-1, n))
        # The rank of the pair that starts at each position; NONE at the ends, which are also positions n and -1.
        pair = [rank_of(piece[at : at + 2], NONE) for at in range(n - 1)] + [NONE, NONE]
        queued = [NONE] * (n + 1)
        changed = range(n - 1)
        while True:
            for at in changed:
                rank = pair[at]
                # Only a pair that goes before both its neighbours can be next; a neighbour's change brings it here again.
                if rank >= pair[before[at]] or rank > pair[following[at]] or rank == queued[at]:
                    continue
                queued[at] = rank
                if rank not in buckets:
                    word = rank >> SHIFT
                    buckets[rank] = at
                    low[word] |= _BIT[rank & MASK]
                    top |= _BIT[word]
                elif (held := buckets[rank]).__class__ is int:
                    buckets[rank] = [held, at] if held < at else [at, held]
                else:
                    heappush(held, at)
            while top:
                word = (top ^ (top - 1)).bit_length() - 1
                bits = low[word]
                rest = bits & (bits - 1)
                rank = (word << SHIFT) + (bits ^ rest).bit_length() - 1
                at = buckets[rank]
                if at.__class__ is int:
                    del buckets[rank]
                    low[word] = rest
                    if not rest:
                        top &= top - 1
                else:
                    held, at = at, heappop(at)
                    if len(held) == 1:
                        buckets[rank] = held[0]
                if pair[at] == rank:
                    break
                # else the position is stale: one of its neighbours has changed
            else:
                break
            gone, left = following[at], before[at]
            following[at] = end = following[gone]
            before[end] = at
            pair[gone] = NONE
            pair[at] = rank_of(piece[at : following[end]], NONE) if end < n else NONE
            changed = at, end
            if left >= 0:
                pair[left] = rank_of(piece[left:end], NONE)
                changed = before[left], left, at, end
        out, at = [], 0
        while at < n:
            end = following[at]
            out.append(rank_of(piece[at:end]))
            at = end
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        code, merge = self.code, self.merge
        return [b"".join(map(code, merge(word.encode()))) for word in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.known.joined(list(map(self.pretokens, texts)))

    def decode(self, ids: np.ndarray) -> bytes:
        piece = self.pieces.__getitem__
        return b"".join([b"".join(map(piece, ids[k : k + (1 << 17)].tolist())) for k in range(0, len(ids), 1 << 17)])


@lru_cache(maxsize=1)
def vocabulary(path: str, *patterns: str) -> RankVocabulary:
    return RankVocabulary(path, *patterns)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of each row of ``docs`` by the rank file ``path``."""
    patterns = matched_patterns(pattern, "tiktoken")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path, *patterns)
        for batch in chunks(batches, "text", 1 << 20):
            ids = voc.encode([text or "" for text in batch.column(1).to_pylist()])
            sizes = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, ENCODED)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of ``encode_documents`` with ``decoded``, the bytes of their ids."""
    patterns = matched_patterns(pattern, "tiktoken")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path, *patterns)
        for batch in chunks(batches, "ids"):
            decoded = [voc.decode(np.frombuffer(ids, "<u4")) for ids in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decode, ENCODED + ", decoded binary")
