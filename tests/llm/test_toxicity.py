import random

import numpy as np
import pytest

from tickflow.llm import toxicity as X


def test_windows_cover_all():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        ids, lengths = X.windows(np.arange(n), 64, 48)
        assert lengths.sum() >= n and {int(i) for row, k in zip(ids, lengths, strict=True) for i in row[:k]} == set(range(n))


def test_gradients():
    s = X.Settings(words=16, grams=16, word_dim=2, gram_dim=2, hidden=3, attention=2)
    net, rng = X.Network(s), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, ids, lengths = rng.normal(size=(5, 4)), rng.integers(0, 5, (3, 6)), np.array([6, 4, 1])
    weights = rng.normal(size=3)
    _, state = net.forward(x, ids, lengths, keep=True)
    g, d_x = net.backward(x, state, weights)
    loss = lambda: float(weights @ net.forward(x, ids, lengths))
    for name, grad in [*g.items(), ("x", d_x)]:
        target = x if name == "x" else net.p[name]
        for _ in range(4):
            at = tuple(rng.integers(0, d) for d in target.shape)
            old = target[at]
            target[at] = old + 1e-3
            up = loss()
            target[at] = old - 1e-3
            down = loss()
            target[at] = old
            assert (up - down) / 2e-3 == pytest.approx(grad[at], rel=0.02, abs=2e-4), name


def corpus(n=500):
    draw = random.Random(6)
    vocabulary = ["".join(draw.choice("aeioubcdfgé") for _ in range(draw.randrange(2, 8))) for _ in range(2000)]
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(60, 200))]
        toxic = i % 5 == 0
        for _ in range(8 * toxic):
            words[draw.randrange(len(words))] = draw.choice(["VileWord", "vileword"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    odd = [(900, None), (901, ""), (902, "vileword"), (903, "long " * 30_000 + "vileword " * 3), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, score int").repartition(4)
    known = spark.createDataFrame([*labels, (901, None), (5000, 1)], "doc_id long, toxic int")
    model = X.fit(docs, known)
    got = {r.doc_id: r.score for r in X.score_documents(docs, model, ["doc_id"]).collect()}
    assert len(got) == len(rows) + len(odd) and all(0 <= v <= 1 for v in got.values())
    import zlib

    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.9
    assert got[900] == got[901] < 0.3
    alone = dict(zip((r[0] for r in rows), X.Scorer(*model).score([r[1] for r in rows]), strict=True))
    assert all(abs(alone[i] - got[i]) < 1e-5 for i in alone)
    assert X.score_documents(docs.limit(0), model, ["doc_id"]).count() == 0
    for some in (model, (None, 0.0)):
        clash = X.score_documents(docs, some, ["doc_id", "score", "text"])
        assert clash.columns == ["doc_id", "text", "score"] and clash.filter("score BETWEEN 0 AND 1").count() == len(got)
    none = X.fit(docs, known.filter("toxic = 0"))
    assert none[0] is None and X.score_documents(docs, none, ["doc_id"]).count() == len(rows) + len(odd)


def test_rows_without_id_are_not_held_out(spark):
    from tickflow.llm.queries import toxicity_rows

    docs = spark.createDataFrame([(None, "a"), (1, None)], "doc_id long, text string")
    got = {r.doc_id: r.held_out for r in toxicity_rows(X.score_documents(docs, (None, 0.0), ["doc_id"])).collect()}
    assert got[None] is False and got[1] in (True, False)
