"""Quality rules and a log-likelihood ratio of hashed n-grams.

Word unigrams and bigrams are hashed to a fixed number of buckets.  Their counts
over trusted documents (every row labelled good) and over the raw corpus (every
document) give two multinomials; a document's score is the sum of its n-grams' log
ratios divided by their number.  Documents below a threshold are rejected; the
threshold is the one that parts all labelled rows best, found by sums over ranges
of the scores.

Each task adds up its own buckets before the shuffle, so no n-gram is hot.

Defined results for odd input
-----------------------------
* null text: no words, all counts 0, fails the base rules;
* a text without n-grams scores 0;
* repeated rows and ids are judged each; an empty table gives no rows;
* without trusted rows the ratio is 0 everywhere and only the base rules decide;
* an id with labels of both classes is not trusted, and counts as rejected;
* further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickflow.llm.packing import packed_texts, unpack_bytes
from tickflow.llm.shared import chunks, written
from tickflow.llm.words import SPACE, Texts, grams, mix

CHUNK = 1 << 21
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    smoothing: float = 1.0
    #: Ranges of the scores in which the threshold is searched apart.
    ranges: int = 256


def _buckets(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every unigram and bigram."""
    pairs, at = grams(hashes, owner, 2)
    single = mix(hashes + np.uint64(1)) % np.uint64(n)
    return np.concatenate([single, mix(pairs + np.uint64(2)) % np.uint64(n)]).astype(np.int64), np.concatenate([owner, owner[at]])


def _hashed(texts: list[str | bytes | None]):
    t = Texts.of(texts)
    sums = t.sums()
    starts, ends, owner = t.words()
    return t, sums, starts, ends, owner, t.hashes(sums, starts, ends)


def rules(texts: list[str | None], hashed=None) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    t, sums, starts, ends, owner, hashes = hashed or _hashed(texts)
    n = len(texts)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[t.bounds])
    n_words = np.bincount(owner, minlength=n)
    letters = total(~SPACE[t.data] & ((t.data & 0xC0) != 0x80))
    # Lines end at \n or with their text.
    newline = np.flatnonzero(t.data == 10)
    line_end = np.unique(np.concatenate([newline, t.bounds[1:] - 1]))
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[worded], line_end[worded]
    line_owner = np.searchsorted(t.bounds, line_start, side="right") - 1
    line = mix(t.hashes(sums, line_start, line_end) + line_owner.astype(np.uint64))
    first = np.zeros(len(line), bool)
    first[np.unique(line, return_index=True)[1]] = True
    dup_lines = np.bincount(line_owner, ~first, minlength=n).astype(np.int64)
    triple, at = grams(hashes, owner, 3)
    _, inverse, counts = np.unique(mix(triple + owner[at].astype(np.uint64)), return_inverse=True, return_counts=True)
    covered = np.zeros(len(hashes), bool)
    twice = at[counts[inverse] > 1] if len(at) else at
    for k in range(3):
        covered[twice + k] = True
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": letters.astype(np.int64),
        "n_symbols": total(_SYMBOL[t.data]).astype(np.int64),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(owner, covered, minlength=n).astype(np.int64),
    }


def count_buckets(texts: DataFrame, packed: bool, s: Settings) -> np.ndarray:
    """N-grams of each bucket over all rows of ``texts``, one column of texts or of packed ones."""
    name = texts.columns[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets, np.int64)
        for batch in chunks(batches, name, CHUNK // 4 if packed else CHUNK):
            column = batch.column(0)
            *_, owner, hashes = _hashed(unpack_bytes(column) if packed else column.to_pylist())
            total += np.bincount(_buckets(hashes, owner, s.buckets)[0], minlength=s.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    table = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row per bucket at most
    out = np.zeros(s.buckets)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def log_ratio(counts: np.ndarray, s: Settings) -> np.ndarray:
    if not counts[1].any():
        return np.zeros(s.buckets)
    p = (counts + s.smoothing) / (counts.sum(1, keepdims=True) + s.smoothing * s.buckets)
    return np.log(p[1]) - np.log(p[0])


def scores(hashed, n: int, ratio: np.ndarray, s: Settings) -> np.ndarray:
    *_, owner, hashes = hashed
    bucket, of = _buckets(hashes, owner, s.buckets)
    return np.bincount(of, ratio[bucket], minlength=n) / np.maximum(1, np.bincount(of, minlength=n))


def best_threshold(rows: DataFrame, s: Settings = Settings()) -> float:
    """The cut of ``rows`` (score, good) with the least sum of both classes' error rates; the lowest of equals.

    Equal scores are one row.  Ranges of about equal numbers of scores are summed, then searched apart.
    """
    sums = [F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")]
    values = written(rows.groupBy("score").agg(*sums))
    # These bounds only deal the work: any others give the same cut.
    bounds = values.agg(F.percentile_approx("score", [k / s.ranges for k in range(1, s.ranges)], 10 * s.ranges)).first()[0]
    bounds = np.unique(np.array(bounds or [], float))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(0).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *batch.columns], ["range", "score", "good", "bad"])

    dealt = values.mapInArrow(deal, "range long, score double, good long, bad long")
    table = dealt.groupBy("range").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("range").toArrow()  # a row per range
    n_good, n_bad = (sum(table.column(c).to_pylist()) for c in ("good", "bad"))
    if not n_good or not n_bad:
        return -np.inf
    before = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)

    def below(kind: str):
        """Rows of a class under each score: those of lower ranges and those of its own."""
        totals = np.zeros(len(bounds) + 1, np.int64)
        totals[table.column("range").to_numpy()] = table.column(kind).to_numpy()
        starts = F.array(*[F.lit(x) for x in (np.cumsum(totals) - totals).tolist()]).cast("array<bigint>")
        return F.element_at(starts, F.col("range").cast("int") + 1) + F.coalesce(F.sum(kind).over(before), F.lit(0))

    error = (below("good") * n_bad - below("bad") * n_good).alias("error")
    cut = dealt.select(error, "score").agg(F.min(F.struct("error", "score")).alias("least")).first()[0]["score"]
    under = values.filter(F.col("score") < cut).agg(F.max("score")).first()[0]
    return float(cut if under is None else (under + cut) / 2)


def judge_documents(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_and(F.col("quality") > 0).alias("good"))
    # Merged at any size: the labels grow with the corpus.
    good = known.filter("good").select(F.col("doc_id").alias("id")).hint("merge")
    trusted = packed_texts(docs.filter("doc_id IS NOT NULL")).join(good, "id").select("packed")
    counts = np.stack([count_buckets(docs.select("text"), False, s), count_buckets(trusted, True, s)])
    ratio = log_ratio(counts, s)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            texts = batch.column(1).to_pylist()
            hashed = _hashed(texts)
            base = rules(texts, hashed)
            failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            arrays = [batch.column(0), *map(pa.array, base.values()), pa.array(failed), pa.array(scores(hashed, len(texts), ratio, s))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *base, "base_failed", "score"])

    judged = written(
        docs.mapInArrow(
            judge,
            "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
            " base_failed boolean, score double",
        )
    )
    # Only documents that pass the base rules place the threshold.
    threshold = best_threshold(judged.filter("NOT base_failed").join(known, "doc_id").select("score", "good"), s)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
