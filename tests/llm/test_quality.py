import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tickflow.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(twice)]


TEXT = st.none() | st.text("ab \n\t|#é\x1c", max_size=40) | st.text(max_size=20)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_rules(texts):
    got = quality.rules(texts)
    assert [list(map(int, x)) for x in zip(*got.values(), strict=True)] == [brute(t) for t in texts]


def test_documents(spark):
    draw = random.Random(5)
    good, bad = "the cat of it sat on mat and so we read".split(), "buy $$$ now %%% cheap ### the of".split()
    text = lambda i: " ".join(draw.choice(good if i % 2 else bad) + draw.choice(["", str(k)]) for k in range(80))
    rows = [(i, text(i), 1) for i in range(40)]
    rows += [(100, None, 1), (101, "", 1), (None, "word", 1), (1, rows[1][1], 1), (102, "long " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality long")
    got = quality.judge_documents(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept == bool(i % 2) for i in range(30, 40))
    assert by[100].base_failed and by[101].base_failed and by[102].base_failed and not by[100].kept
    assert quality.judge_documents(docs.limit(0), labels).count() == 0
    assert all(r.kept != r.base_failed for r in quality.judge_documents(docs, labels.limit(0)).collect())


def best_cut(good, bad):
    """By trying all cuts, in whole numbers."""
    values = sorted({*good, *bad})
    error = lambda c: sum(v < c for v in good) * len(bad) - sum(v < c for v in bad) * len(good)
    k = min(range(len(values)), key=lambda k: error(values[k]))
    return values[k] if k == 0 else (values[k - 1] + values[k]) / 2


def test_threshold_is_exact_for_any_ranges(spark):
    draw = random.Random(8)
    rows = [(draw.randint(-20, 20) / 8 + 1.5 * g, bool(g)) for g in (0, 1) for _ in range(150)]
    rows = spark.createDataFrame([*rows, (-1e300, True), (1e300, False)], "score double, good boolean")
    got = rows.collect()
    want = best_cut([r.score for r in got if r.good], [r.score for r in got if not r.good])
    assert {quality.best_threshold(rows, quality.Settings(ranges=n)) for n in (2, 7, 256)} == {want}
    assert quality.best_threshold(rows.filter("good")) == quality.best_threshold(rows.limit(0)) == -np.inf


def test_every_labelled_row_is_learned_from(spark):
    """More than 10,000 rows of each class: the counts, the scores and the threshold are those of all of them."""
    draw = np.random.default_rng(4)
    rows = []
    for i in range(22_000):
        words = draw.integers(0, 300, 55) + 100 * (i % 2)
        rows.append((i, " ".join(map(str, [*words.tolist(), 1000 + i // 4]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(21_500)], "doc_id long, quality int")
    s = quality.Settings()
    texts = [t for _, t in rows]
    hashed = quality._hashed(texts)
    bucket, of = quality._buckets(hashed[5], hashed[4], s.buckets)
    trusted = (of % 2 == 1) & (of < 21_500)
    ratio = quality.log_ratio(np.stack([np.bincount(b, minlength=s.buckets) for b in (bucket, bucket[trusted])]).astype(float), s)
    want = quality.scores(hashed, len(texts), ratio, s)
    failed = quality.rules(texts, hashed)
    failed = (failed["n_words"] < 50) | (100 * failed["n_repeat_words"] > 50 * failed["n_words"])
    assert not failed.any()
    good, bad = np.sort(want[1:21_500:2]), np.sort(want[0:21_500:2])
    cuts = np.unique([*good, *bad])
    k = int(np.argmin(np.searchsorted(good, cuts) * len(bad) - np.searchsorted(bad, cuts) * len(good)))
    threshold = (cuts[k - 1] + cuts[k]) / 2 if k else cuts[0]
    got = {r.doc_id: r for r in quality.judge_documents(docs, labels).collect()}
    assert [got[i].score for i in range(len(rows))] == want.tolist()
    assert [got[i].kept for i in range(len(rows))] == (want >= threshold).tolist()
