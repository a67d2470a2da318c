"""Encoding by merge ranks against the tiktoken library, round trips and odd input."""

import base64
import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from tickflow.llm import queries, rank_bpe  # noqa: E402
from tickflow.llm.pretokens import matched_patterns  # noqa: E402

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def ranks_of(path):
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def library(path, pattern=P.PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


def test_random_texts_of_odd_parts():
    own, theirs = rank_bpe.vocabulary(PATH, *matched_patterns(P.PATTERN, "tiktoken")), library(PATH)
    rng = random.Random(3)
    parts = ["a", "aa", "ab", " ", "é", "中", "\n", "0", "١", "՘", "\U0003fc3d", "\U00011de0", "'s", "𝒜", "\x1c", "　", "!!", "한국", "\0"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        ids = np.frombuffer(own.encode([text])[0], "<u4")
        assert ids.tolist() == theirs.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("make", [lambda r: "a" * 200_000, lambda r: "ab" * 50_000, lambda r: "".join(r.choice("abcdefghij") for _ in range(200_000))])
def test_long_pretokens(make):
    own, text = rank_bpe.vocabulary(PATH, *matched_patterns(P.PATTERN, "tiktoken")), make(random.Random(4))
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library(PATH).encode_ordinary(text)
    assert not own.buckets and not any(own.low), "the queue is empty between pre-tokens"


def test_equal_ranks_go_leftmost_first_and_lower_ranks_may_appear_late(tmp_path):
    """A file in which a longer piece has a lower rank than its parts: least rank first, not in the order met."""
    pieces = [bytes([b]) for b in range(256)] + [b"cab", b"bca", b"ab", b"aa", b"caab", b"abab", b"ca", b"bc"]
    path = str(tmp_path / "own.tiktoken")
    with open(path, "wb") as f:
        f.writelines(base64.b64encode(p) + b" %d\n" % k for k, p in enumerate(pieces))
    pattern = r"[abc]+|[^abc]+"
    own, theirs = rank_bpe.RankVocabulary(path, *matched_patterns(pattern, "tiktoken")), library(path, pattern)
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
        assert own.merge(text.encode()) == theirs.encode_ordinary(text)


def test_cleared_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(rank_bpe, "KEPT", 3)
    own = rank_bpe.RankVocabulary(PATH, *matched_patterns(P.PATTERN, "tiktoken"))
    for text in ["one two three four five", "five six seven", "one two"] * 3:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library(PATH).encode_ordinary(text)


def test_a_file_without_a_byte_is_refused(tmp_path):
    path = str(tmp_path / "short.tiktoken")
    with open(path, "wb") as f:
        f.write(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="byte"):
        rank_bpe.RankVocabulary(path, *matched_patterns(P.PATTERN, "tiktoken"))


def test_odd_rows(spark):
    long = "word " * 200_000
    rows = [(1, None, 5), (2, "", 5), (None, "null id", 5), (3, "twice", 5), (3, "twice", 5), (4, "<|endoftext|>", 5), (5, long, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumnRenamed("ids", "n_tokens")
    encoded = rank_bpe.encode_documents(docs, PATH, P.PATTERN)
    got = rank_bpe.decode_documents(encoded, PATH, P.PATTERN).collect()
    theirs = library(PATH)
    key = lambda r: (r[0] is None, r[0] or 0)
    for row, (doc_id, text, _) in zip(sorted(got, key=key), sorted(rows, key=key), strict=True):
        assert row.doc_id == doc_id
        assert np.frombuffer(row.ids, "<u4").tolist() == theirs.encode_ordinary(text or "")
        assert row.n_tokens == len(row.ids) // 4
        assert bytes(row.decoded) == (text or "").encode()
    assert rank_bpe.encode_documents(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_query_against_the_library(spark):
    sf_dir = "/root/testdata/sf0.001"
    theirs = library(PATH)
    got = {r.doc_id: r for r in queries.op13_rank_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array(theirs.encode_ordinary(d.text or ""), "<u4").tobytes()
        row = got[d.doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
