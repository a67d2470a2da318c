import random
import re

import numpy as np
import pytest

from tickflow.llm import jaccard
from tickflow.llm.components import components


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus():
    draw = random.Random(11)
    word = lambda: draw.choice("abcdefgh") + str(int(draw.paretovariate(0.6)) % 400)
    texts = [None, "", " \n", "One", "one", "two words", "Two  words", "three word text", "a b c d", "a b c d e"]
    line = " ".join(word() for _ in range(30))
    for size in (5, 9, 12, 20, 40, 90, 200):
        for _ in range(4):
            base = [word() for _ in range(size)]
            if draw.random() < 0.4:
                base += line.split()
            texts.append(" ".join(base))
            for edits in (0, 1, 1, 2, 4, 8):
                copy = list(base)
                for _ in range(edits * size // 40 + (edits > 0)):
                    copy[draw.randrange(len(copy))] = word()
                texts.append(" ".join(copy))
    draw.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("words", "percent", "ratio"), [(3, 90, 1.25), (5, 80, 1.5)])
def test_against_brute_force(spark, words, percent, ratio):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, cls int")
    got = jaccard.near_duplicates(docs, jaccard.Settings(words, percent, ratio))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute(rows, words, percent)


def test_linked_sets_share_a_key():
    draw = np.random.default_rng(3)
    for percent, ratio in ((90, 1.25), (80, 1.5)):
        s = jaccard.Settings(3, percent, ratio)
        bands = jaccard.Bands(s)
        for n in (1, 4, 5, 8, 9, 10, 19, 37, 100, 450, 2000):
            for _ in range(30):
                a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
                lost = draw.integers(0, n // 9 + 2)
                b = np.unique(np.concatenate([a[draw.permutation(len(a))[lost:]], draw.integers(0, 2**63, lost * draw.integers(0, 2)).astype(np.uint64)]))
                if jaccard.similar(a, b, percent):
                    assert np.intersect1d(jaccard.keys_of(a, bands), jaccard.keys_of(b, bands)).size


def test_empty_and_components(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    links = [(1, 2), (2, 3), (3, 9), (9, 4), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert [got[k] for k in (1, 2, 3, 4, 9, 20, 21, 140)] == [1, 1, 1, 1, 1, 20, 20, 100]


def test_new_links_tie_old_components(spark):
    """Links found later join components, classes that had none, and classes with each other."""
    old = [(1, 2), (2, 5), (7, 8), (20, 21)]
    new = [(5, 8), (30, 21), (40, 41), (41, 42), (8, 7)]
    pairs = lambda x: spark.createDataFrame(x, "a long, b long")
    got = jaccard._merged(components(pairs(old)), pairs(new))
    want = components(pairs(old + new))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("band", [1024, 3])
def test_all_links_are_counted(spark, monkeypatch, band):
    """Every class reports all other classes it is linked to, within and between bands; copies are one class."""
    monkeypatch.setattr(jaccard, "BAND", band)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:100] + [f"x{i}"]) for i in range(12)] + [" ".join(base[: 70 + i]) for i in range(0, 50, 4)] + ["alone here now", None]
    rows = [(i, t) for i, t in enumerate([*texts, texts[0], texts[0]])] + [(0, texts[0])]
    sets = [{tuple((t or "").split()[k : k + 3]) for k in range(len((t or "").split()) - 2)} for _, t in rows]
    linked = lambda a, b: a != b and a & b and 100 * len(a & b) >= 90 * len(a | b)
    want = sorted((i, len({frozenset(b) for b in sets if linked(a, b)})) for (i, _), a in zip(rows, sets, strict=True))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_links")
    assert sorted(map(tuple, got.collect())) == want and max(n for _, n in want) > 11


def test_wide_sketches_of_long_sets():
    """Long sets that are far apart are told by their wide sketches, which the fixed width allows; links always pass."""
    draw = np.random.default_rng(9)
    for n, percent in ((1025, 80), (6000, 80), (20_000, 90), (60_000, 90)):
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        allowed = lambda b, k: k * (100 + percent) <= (len(a) + len(b)) * (100 - percent)  # noqa: B023, E731
        for kept in (1.0, 0.97, 0.9, 0.3, 0.0):
            b = np.unique(np.concatenate([a[: int(kept * n)], draw.integers(0, 2**63, n - int(kept * n)).astype(np.uint64)]))
            far = jaccard.distance(jaccard.wide_sketch(a), jaccard.wide_sketch(b))
            assert far <= len(np.setxor1d(a, b))
            if jaccard.similar(a, b, percent):
                assert allowed(b, far)
            if kept < 0.5:
                assert not allowed(b, far)
    assert allowed(b, jaccard.distance(jaccard.sketch(a), jaccard.sketch(b)))  # the fixed width is full
    assert jaccard.wide_sketch(a[:1024]) is None and jaccard.distance(jaccard.wide_sketch(a), jaccard.sketch(a)) == 0


def test_sets_are_made_of_near_classes_only(spark, monkeypatch):
    """Long texts that share passages but are far apart are not fetched for a check; near ones are, and are linked."""
    draw = random.Random(4)
    word = lambda: f"w{draw.randrange(10**9)}"
    passage = " ".join(word() for _ in range(3000))
    texts = [passage + " " + " ".join(word() for _ in range(3000)) for _ in range(6)]
    rows = [*enumerate([*texts, texts[2] + " other", " ".join(word() for _ in range(40))])]
    fetched, sets = [], jaccard._sets

    def seen(docs, reps, s):
        fetched.extend(r.doc_id for r in reps.collect())
        return sets(docs, reps, s)

    monkeypatch.setattr(jaccard, "_sets", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == set(range(8)) - {6} and set(fetched) == {2, 6}
