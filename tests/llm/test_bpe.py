import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickflow.llm import bpe
from tickflow.llm.queries import token_digests

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = "a 's<|endoftext|>  x  \x1c\x85y\n\n\t z'll ½٣ é<|endof|>\x00\U0001f600 "


def expected(text):
    ids = TOKENIZER.encode(text, add_special_tokens=False).ids
    return (
        len(ids),
        hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(),
        hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
    )


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text("a's \n\t \x1c\x85é1½!<|endoftext>", max_size=40))
def test_words_encode_as_the_library(text):
    voc = bpe.vocabulary(PATH)
    own = b"".join(voc.encode(voc.words(text)))
    assert own == b"".join(i.to_bytes(4, "little") for i in TOKENIZER.encode(text, add_special_tokens=False).ids)
    assert voc.text(np.frombuffer(own, "<u4")) == text


def test_documents(spark):
    texts = [None, "", ODD, ODD, "word " * 30_000, "x" * 5000]
    rows = [(i if i != 3 else 2, t, "clash", "b") for i, t in enumerate(texts)] + [(None, "null id", "c", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, block string")
    got = sorted(map(tuple, token_digests(bpe.encode_documents(docs, PATH)).collect()), key=str)
    assert got == sorted([(r[0], *expected(r[1] or "")) for r in rows], key=str)


def test_blocks_cut_otherwise(spark, monkeypatch):
    """Words that a block lacks, since it was cut otherwise when they were listed, are encoded in place."""
    rows = [(i, f"word{i} {'x' * i} shared") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = bpe.packed_blocks(docs)
    monkeypatch.setattr(bpe, "packed_blocks", lambda d: whole.withColumn("block", F.col("block") + F.col("doc_id") % 2))
    got = sorted(map(tuple, token_digests(bpe.encode_documents(docs, PATH)).collect()))
    assert got == sorted((i, *expected(t)) for i, t in rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(docs, PATH).count() == 0


def test_decode_join(spark):
    ids = TOKENIZER.encode(ODD, add_special_tokens=False).ids
    frame = spark.createDataFrame([(1, ids), (2, [])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, bpe.decode_ids(frame, PATH).collect())) == [(1, ODD), (2, "")]


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text("a's \n\t \x1c\x85é1½²Ⅷ一٣!\U0001d7d8\U0001f600\U00020000", max_size=40))
def test_first_plane_splits_as_the_pattern(text):
    """Texts of the first plane are split by classes written out; every code point of it is in the same class."""
    voc = bpe.vocabulary(PATH)
    assert voc.find(text) == voc._find(text)
    if max(text, default="") <= "￿":
        assert voc._plane_find(text) == voc._find(text)


def test_first_plane_classes():
    voc = bpe.vocabulary(PATH)
    every = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    for around in ("a{}a", "1{}1", "!{}!", "  {}  "):
        text = "\n".join(around.format(c) for c in every)
        assert voc._plane_find(text) == voc._find(text)


def test_ids_travel_without_words():
    """What a block gets back is the ids of its words, in an order that follows from the words."""
    words = [f" word{i}" for i in range(500)] + ["\U0001f600", " ", "é"]
    ids = bpe.vocabulary(PATH).encode(words)
    sizes, every = bpe.unpack_ids(bpe.pack_ids(ids))
    assert sizes.tolist() == [len(i) // 4 for i in ids] and every.tobytes() == b"".join(ids)
    sizes, every = bpe.unpack_ids(bpe.pack_ids([(1 << 20).to_bytes(4, "little"), b""]))
    assert sizes.tolist() == [1, 0] and every.tolist() == [1 << 20]
    parts = bpe.dealt_words(set(words), 7)
    assert parts == bpe.dealt_words(words[::-1], 7) and sorted(w for p in parts for w in p) == sorted(words)
    assert all(bpe.body_words(bpe.words_body(p)) == p for p in parts)
