import numpy as np
import hashlib
import random
import tracemalloc
from collections import Counter

from tickflow.llm import queries, suffixes


def brute(rows):
    raw = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(r[i : i + 200] for r in raw for i in range(len(r) - 199))
    out = []
    for (doc, *_), r in zip(rows, raw, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        n_spans = sum(1 for i in range(len(r)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((doc, len(r), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    draw = random.Random(4)
    text = lambda n: "".join(draw.choice(["ab", "cé", " ", "\n", "xyz", "q"]) for _ in range(n))
    passages = [text(n) for n in (60, 95, 100, 110, 130, 200, 400)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 199), (4, "a" * 200), (5, "b" * 201), (6, "the end " * 300)]
    for i in range(90):
        parts = [text(draw.randrange(1, 200))]
        for _ in range(draw.randrange(3)):
            p = draw.choice(passages)
            cut = draw.randrange(len(p) // 4)
            parts += [p[cut : len(p) - draw.randrange(len(p) // 4)], text(draw.randrange(0, 120))]
        rows.append((10 + i, "".join(parts)))
    whole = text(700)
    rows += [(200, whole), (201, whole), (202, whole[:350] + "!" + whole[351:]), (None, whole[3:]), (203, text(30)), (203, text(30))]
    rows += [(204, passages[6] + passages[6]), (204, passages[6] + passages[6])]
    return [(*r, "x") for r in rows]


def digests(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, hull string")
    return sorted(map(tuple, queries.span_digests(suffixes.deduplicate(docs)).collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus()
    assert digests(spark, rows) == brute(rows)


def test_anchors_with_many_hulls(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_HULLS", 3)
    rows = corpus()
    assert digests(spark, rows) == brute(rows)


def test_empty_and_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert suffixes.deduplicate(docs).count() == 0
    docs = spark.createDataFrame([(1, "é" * 150, 150), (2, "xé" + "é" * 150, 152), (3, None, None)], docs.schema)
    got = {r.doc_id: (r.text, r.n_chars) for r in suffixes.keep_text(docs).collect()}
    assert got == {1: ("", 0), 2: ("x", 1), 3: ("", None)}


def test_anchors_depend_on_the_string_alone(monkeypatch):
    """The same anchors for every length of the batch, with many ties, on both ways of finding them."""
    draw = np.random.default_rng(4)
    values = draw.integers(0, 3, 3000).astype(np.uint64) << np.uint64(24)
    want = [k + int(np.argmin(values[k : k + 137])) for k in range(len(values) - 136)]
    assert suffixes.leftmost_least(values, 137).tolist() == want
    monkeypatch.setattr(suffixes, "LOW", np.uint64(255))
    assert suffixes.leftmost_least(values, 137).tolist() == want


def test_clashing_columns(spark):
    """Columns named as the result's give way; all others, those named as the operator's own too, come through."""
    passage = "".join(chr(97 + k * k % 23) for k in range(260))
    rows = [(1, passage + "x", 7), (2, "y" + passage, 8), (2, "y" + passage, 8), (3, "alone", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a int")
    names = ["n_bytes", "n_removed", "n_spans", "spans", "kept", "rid", "start", "end", "key", "hull"]
    for n in names:
        docs = docs.withColumn(n, docs["a"] + 1)
    out = suffixes.deduplicate(docs)
    assert out.columns == ["doc_id", "a", "rid", "start", "end", "key", "hull", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept), r.rid - r.a) for r in out.collect())
    assert got == [(1, 261, 260, b"x", 1), (2, 261, 261, b"", 1), (2, 261, 261, b"", 1), (3, 5, 0, b"alone", 1)]


def test_a_block_of_hulls_takes_little_memory():
    """The arrays of a full block, with one anchor of many hulls at its end, leave room for another task and the JVM."""
    draw = np.random.default_rng(5)
    passage = draw.integers(0, 256, 336, np.uint8).tobytes()
    n = (suffixes.BLOCK_BYTES + suffixes.BLOCK_HULLS * 168) // 336
    pieces = [passage[:k] + b"!" + passage[k + 1 :] for k in draw.integers(0, 336, n).tolist()]
    tracemalloc.start()
    try:
        flags = suffixes.repeated_starts(pieces)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(flags) == n and all(len(f) == 137 for f in flags)
    assert peak < 140 << 20


def test_text_takes_one_python_function_after_the_last_shuffle(spark):
    """Cut characters go, replacement characters of the text stay, and no further function runs beside the cutting one."""
    passage = "".join(chr(0x400 + k * k % 97) for k in range(130))
    rows = [(1, "\ufffdé" + passage + "x", 133), (2, "\ufffdĩ" + passage + "y", 133), (3, "\ufffd", 1)]  # é and ĩ end alike
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = suffixes.keep_text(docs)
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("\ufffdx", 2), 2: ("\ufffdy", 2), 3: ("\ufffd", 1)}
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan
