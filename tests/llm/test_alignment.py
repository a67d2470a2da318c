"""Aligned tokens against both libraries and a plain loop over all pairs of ends; odd input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from tickflow.llm import alignment, bpe, queries  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


class Libraries:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.bytes_a = bpe.Vocabulary(A).pieces

    def tokens(self, text):
        """[(id, bytes)] of both sides, or none where one does not give the text back."""
        if not text:
            return [], []
        a = [(i, self.bytes_a[i]) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            name = self.b.id_to_piece(i)
            b.append((i, bytes([int(name[3:-1], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        if any(b"".join(x for _, x in side) != raw for side in (a, b)):
            return [], []
        return a, b


def ends(tokens):
    out, at = [], 0
    for i, raw in tokens:
        at += len(raw)
        out.append((at, i))
    return out


def brute(rows):
    """Rows as ``SUMMARY`` by loops over (doc_id, text)."""
    libraries, found, counts = Libraries(), [], Counter()
    for doc_id, text in rows:
        a, b = map(ends, libraries.tokens(text))
        links = [(i, j) for x, i in a for y, j in b if x == y] if len(a) * len(b) < 200_000 else None
        if links is None:
            at = dict(b)
            links = [(i, at[x]) for x, i in a if x in at]
        common, groups, last = sorted({x for x, _ in a} & {y for y, _ in b}), [], 0
        for end in common:
            sides = [[str(i) for x, i in side if last < x <= end] for side in (a, b)] if len(common) < 3000 else None
            if sides is None:
                break
            groups.append(",".join(sides[0]) + "|" + ",".join(sides[1]))
            last = end
        else:
            found.append((doc_id, a, b, links, ";".join(groups)))
            counts.update(links)
            continue
        raise AssertionError("keep test texts short")
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [
        (
            doc_id, len(a), len(b), len(groups.split(";")) if groups else 0, len(links),
            sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        )
        for doc_id, a, b, links, groups in found
    ]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def odd_texts(n):
    rng = random.Random(9)
    parts = ["a", "the", " ", "  ", "é", "中文", "\n", "\t", "1234", "<s>", "<|endoftext|>", "<0x41>", "\0", "　", "!!", "한국", "\U0003fc3d", "n't", "ﬁ", " ", "Ⅷ", "\x1c"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def test_encoders_equal_their_libraries():
    libraries, pair = Libraries(), alignment.tokenizers(A, B)
    assert pair[1].by_words
    own = alignment.ByteTokenizer._by_its_library(A)
    for text in [*odd_texts(1500), " ", "   ", "a ", " a", "a  b   ", "▁", "x▁y", "a" * 5000]:
        assert own([" " + text])[0].tolist() == pair[0].ids([text])[0].tolist() == libraries.a.encode(" " + text, add_special_tokens=False).ids
        assert pair[1].ids([text])[0].tolist() == libraries.b.encode(text)


def test_odd_rows(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(odd_texts(60))]
    rows += [(100, None), (101, ""), (102, "x▁y"), (None, "no id"), (None, "no id, another"), (103, "twice"), (103, "twice"), (103, "not twice")]
    rows += [(200 + k, "the same words in many rows") for k in range(30)] + [(None, "hot"), (None, "hot"), (None, "hot")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, block int, pair int").repartition(2)
    expected = ordered(brute(rows))
    assert ordered(alignment.summarize(docs, A, B).collect()) == expected
    monkeypatch.setattr(alignment, "SENT", 0)  # the other way back
    assert ordered(alignment.summarize(docs, A, B).collect()) == expected
    empty = alignment.summarize(docs.limit(0), A, B)
    assert empty.collect() == [] and empty.columns == [c.split()[0] for c in alignment.SUMMARY.split(", ")]


def test_stretches_and_blocks(monkeypatch):
    """Texts cut into many event rows, documents into many blocks; run without workers, whose constants stay."""
    import pyarrow as pa

    monkeypatch.setattr(alignment, "STRETCH", 7)
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 40)

    class Context:
        def partitionId(self):
            return 3

    monkeypatch.setattr(alignment.TaskContext, "get", classmethod(lambda cls: Context()))
    kept = {}

    class Frame:
        def select(self, *c):
            return self

        def mapInArrow(self, f, schema):
            kept["f"] = f
            return self

    monkeypatch.setattr(alignment.F, "col", lambda c: type("C", (), {"cast": lambda s, k: s, "alias": lambda s, n: s})())
    rows = [(k, t) for k, t in enumerate(odd_texts(40))] + [(50, "dup in one partition"), (50, "dup in one partition"), (51, None)]
    alignment.end_events(Frame(), A, B)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    events = [r for b in kept["f"](iter([batch])) for r in b.to_pylist()]
    assert max(e["stretch"] for e in events) > 5
    events.sort(key=lambda e: (e["key"], e["doc_id"], e["stretch"], e["side"]))
    alignment.sweep(Frame(), A, B)
    blocks = list(kept["f"](iter([pa.RecordBatch.from_pylist(events[k : k + 5], pa.schema(list(zip(alignment._NAMES, alignment._KINDS, strict=True)))) for k in range(0, len(events), 5)])))
    assert len(blocks) > 3
    totals = Counter()
    for b in blocks:
        row = b.to_pylist()[0]
        totals.update(dict(zip(alignment.unpack(row["pairs"], "<u8").tolist(), alignment.unpack(row["totals"], "<u8").tolist(), strict=True)))
    most = Counter()
    for pair, n in totals.items():
        most[pair & 0xFFFFFFFF] = max(most[pair & 0xFFFFFFFF], n)
    found = []
    for b in blocks:
        own = alignment.unpack(b.to_pylist()[0]["pairs"], "<u8").tolist()
        counts = pa.table({"pair": own[::-1], "n": [totals[p] for p in own[::-1]], "best": [totals[p] == most[p & 0xFFFFFFFF] for p in own[::-1]]})
        found += [tuple(r.values()) for r in alignment._finished_group(pa.Table.from_batches([b]), counts).to_pylist()]
    assert ordered(found) == ordered(brute(rows))


def test_groups_and_links(spark):
    rows = [(1, "Tokenizers disagree, sometimes."), (2, None), (3, "twice"), (3, "twice"), (4, "中文 text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    groups, libraries = alignment.token_groups(docs, A, B).collect(), Libraries()
    links = alignment.token_links(docs, A, B).collect()
    for doc_id, text in {r for r in rows if r[1]}:
        times = rows.count((doc_id, text))
        own = sorted((r for r in groups if r.doc_id == doc_id), key=lambda r: r.start)[::times]
        a, b = libraries.tokens(text)
        assert [i for r in own for i in r.a] == [i for i, _ in a] and [i for r in own for i in r.b] == [i for i, _ in b]
        assert all((r.start == 0) == (k == 0) for k, r in enumerate(own))
        both = sorted({x for x, _ in ends(a)} & {x for x, _ in ends(b)})
        assert sorted(r.end for r in links if r.doc_id == doc_id) == sorted(both * times)
    assert not [r for r in groups if r.doc_id == 2]


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = [(d.doc_id, d.text) for d in docs if len(d.text or "") < 4000]
    got = {r.doc_id: r for r in queries.op11_alignment(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    libraries, counts, linked = Libraries(), Counter(), {}
    for d in docs:
        a, b = map(ends, libraries.tokens(d.text))
        at = dict(b)
        linked[d.doc_id] = (len(a), len(b), [(i, at[x]) for x, i in a if x in at])
        counts.update(linked[d.doc_id][2])
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    for doc_id, (n_a, n_b, links) in linked.items():
        row = got[doc_id]
        assert (row.n_a, row.n_b, row.n_groups, row.n_links) == (n_a, n_b, len(links), len(links))
        assert (row.n_best, row.count_sum) == (sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links))
    for row in brute(short):
        assert got[row[0]].groups_sha256 == row[7]
    assert np.mean([bool(r.n_a) for r in got.values()]) > 0.9
