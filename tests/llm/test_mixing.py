import hashlib
import random
import re

import pytest

from tickflow.llm import mixing


def brute(rows, weights=(3, 1, 2), share=1.5, epochs=2):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    target, free, left = {}, set(names), share * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > epochs * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: float(epochs * total[s]) for s in over}
        left -= sum(epochs * total[s] for s in over)
        free -= over
    out = []
    for s in names:
        budget, n = int(target[s] + 0.5), total[s]
        whole = budget // n if n else 0
        rest = budget - whole * n
        own = [(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest(), i if i is not None else -1, k, i, c) for (i, _, src), c, k in zip(rows, size, range(len(rows)), strict=True) if src == s]
        for *_, i, c in sorted(own):
            out.append((i, c, n, round(target[s], 6), whole * c + min(c, max(0, rest))))
            rest -= c
    return sorted(out, key=str)


def corpus():
    draw = random.Random(1)
    rows = [(i, "w " * draw.randrange(0, 60), draw.choice(["a", "a", "a", "b", "c", "é", None, ""])) for i in range(300)]
    return rows + [(900, None, "a"), (901, "", "only blank"), (902, "long " * 30_000, "z"), (None, "x y", "b")]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, offset int")
    got = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.plan_mix(docs).collect()), key=str)
    assert got == brute(rows)
    assert all(r[4] <= 2 * r[1] for r in got)


def test_apply(spark):
    rows = [(i, f"a{i}  b\tc\n", f"s{i % 3}", 9) for i in range(60)] + [(99, "", "s0", 0), (100, None, "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = mixing.apply_mix(docs).collect()
    assert got[0].asDict().keys() == dict.fromkeys(docs.columns).keys()
    assert sum(len((r.text or "").split()) for r in got) == pytest.approx(1.5 * 180, abs=3)
    assert {99, 100} <= {r.doc_id for r in got}
    assert all(dict((r[0], r[1]) for r in rows)[r.doc_id].startswith(r.text) for r in got if r.text is not None)
    assert mixing.apply_mix(docs.limit(0)).count() == 0


def test_clashing_columns(spark):
    """Columns with names that the plan uses come back as they were."""
    names = ["size", "target", "offset", "start", "skey", "range", "budget", "epochs", "copy", "copies", "cut", "hkey", "digest", "partial"]
    rows = [(i, f"a{i} b c", f"s{i % 3}", *range(i, i + len(names))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    got = mixing.apply_mix(docs).collect()
    assert len(got) >= 30
    for r in got:
        assert tuple(r)[3:] == tuple(range(r.doc_id, r.doc_id + len(names)))
    with pytest.raises(ValueError):
        mixing.plan_mix(docs, carry=["size"])


def test_null_ids_spread(spark):
    """Null ids are keyed by their texts, so they do not share one range."""
    docs = spark.createDataFrame([(None, f"w{i} " * 3, "a") for i in range(40)], "doc_id long, text string, source string")
    got = sorted((r.size, r.taken) for r in mixing.plan_mix(docs).collect())
    assert sum(t for _, t in got) == pytest.approx(1.5 * 120, abs=1) and all(s == 3 for s, _ in got)
