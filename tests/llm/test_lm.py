import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from tickflow.llm import lm


def corpus():
    draw = random.Random(2)
    words = ["the", "Then", "ér", "ing", "on\tce", "a", "zebra", "\n"]
    rows = [(i, " ".join(draw.choices(words, weights=[9, 7, 5, 4, 3, 3, 1, 1], k=draw.randrange(1, 300)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (None, "no id"), (3, rows[3][1]), (502, "long the " * 20_000)]


def brute_base(rows):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, t in rows]
    train = Counter(w for (i, _), t in zip(rows, tokens, strict=True) if i is None or zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(train.values()), len(train)
    return [(len(t), sum(train[w] > 0 for w in t), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for t in tokens]


def test_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(5)
    got = lm.score_documents(docs).collect()
    want = sorted(((i, *b) for (i, _), b in zip(rows, brute_base(rows), strict=True)), key=str)
    assert len(got) == len(rows)
    for r, w in zip(sorted(got, key=lambda r: str((r.doc_id, r.n_tokens))), want, strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.score < 0 and r.bits == pytest.approx(-r.score / math.log10(2))
        assert r.n_bytes == len(next(t or "" for i, t in rows if i == r.doc_id).encode()) and r.bits_per_byte == r.bits / max(1, r.n_bytes)
    held = [r for r in got if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {(r.doc_id, r.score) for r in lm.score_documents(docs.coalesce(1)).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(docs).count() == 0
    held = next(i for i in range(100) if lm.is_held_out(i))
    (r,) = lm.score_documents(spark.createDataFrame([(held, "a b")], docs.schema)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_probabilities_add_up():
    """The ways of all symbols after a byte form a full tree, so the chances of all next symbols add up to one."""
    trees = lm.build_trees(np.random.default_rng(1).integers(0, 9, lm.SYMBOLS**2))
    for before in (0, 65, lm.END):
        lengths = trees.length[before * lm.SYMBOLS : (before + 1) * lm.SYMBOLS]
        assert math.isclose(sum(2.0**-int(n) for n in lengths), 1.0)
    tables = np.random.default_rng(2).integers(-127, 127, lm.STARTS[-1]).astype(np.int8)
    some = [b"", b"x", b"abc", b"abc" * 500]
    alone = np.concatenate([lm.mix_scores([t], trees, tables) for t in some])
    assert np.array_equal(lm.mix_scores(some, trees, tables), alone)


def brute_symbols(text):
    s = [lm.END] * 5 + list(text) + [lm.END]
    for i in range(5, len(s)):
        h, hashes = 0, []
        for k in range(1, 6):
            h = (h * 0x2C1B3C6D & 0xFFFFFFFF) ^ (s[i - k] + (k * 0x3C6EF372 & 0xFFFFFFFF) & 0xFFFFFFFF)
            if k in lm.ORDERS:
                x = h * 0x85EBCA6B & 0xFFFFFFFF
                hashes.append((x ^ x >> 15) * 0x27D4EB2F & 0xFFFFFFFF)
        yield s[i - 1], s[i], hashes


def brute_slots(hashes, step):
    return [start + ((h + (step >> 4) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - bits) for h, bits, start in zip(hashes, lm.BITS, lm.STARTS, strict=False)]


def steps_of(trees, before, symbol):
    pair = before * lm.SYMBOLS + symbol
    return trees.steps[trees.start[pair] : trees.start[pair] + trees.length[pair]].tolist()


def brute_mix(text, trees, tables, predicted, state):
    """One decision after the other."""
    weights = [[w] * lm.GATES for w in lm.START_WEIGHTS]
    met = [list(x) for x in lm.FIRST]
    total, held = 0.0, []
    for k, (before, symbol, hashes) in enumerate(brute_symbols(text)):
        if k % lm.BLOCK == 0:
            for gate in {g for g, _, _ in held}:
                own = [(m, xs) for g, m, xs in held if g == gate]
                for j in range(len(lm.ORDERS)):
                    weights[j][gate] += sum(m * xs[j] for m, xs in own) / (len(own) * lm.A_DECISION + lm.MORE)
            held = []
        if predicted[k] >= 0:
            right = predicted[k] == symbol
            a, b = met[state[k]]
            total += math.log((a if right else b) / (a + b))
            met[state[k]][not right] += 1
            if right:
                continue
        for step in steps_of(trees, before, symbol):
            sign = 2 * (step & 1) - 1
            xs = [int(tables[x]) / lm.SCALE * sign for x in brute_slots(hashes, step)]
            sure = abs(xs[-1] * lm.SCALE)
            gate = (step >> 1 & 7) * 3 + (sure > 8.5) + (sure > 45.5)
            z = min(max(sum(w[gate] * x for w, x in zip(weights, xs, strict=True)), -lm.LIMIT), lm.LIMIT)
            total -= math.log1p(math.exp(-z))
            held.append((gate, 1 / (1 + math.exp(z)), xs))
    return total / math.log(10)


def test_against_a_scalar_mixer():
    draw = np.random.default_rng(3)
    trees = lm.build_trees(draw.integers(0, 9, lm.SYMBOLS**2))
    tables = draw.integers(-127, 127, lm.STARTS[-1]).astype(np.int8)
    texts = [b"", b"some text, some more text. " * 12, "ér ".encode() * 90, b"z" * 400]
    predicted, state = [], []
    for t in texts:
        right = np.append(np.frombuffer(t, np.uint8), lm.END)
        own = np.where(draw.random(len(right)) < 0.3, right, -1)
        predicted.append(np.where(draw.random(len(right)) < 0.1, 101, own))
        state.append(draw.integers(0, len(lm.FIRST), len(right)))
    got = lm.mix_scores(texts, trees, tables, np.concatenate(predicted), np.concatenate(state))
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(brute_mix(t, trees, tables, predicted[k], state[k]), rel=0.01)


def test_tables_count_every_decision(spark):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choices("abcdefghé \n", k=draw.randrange(0, 400)))) for i in range(60)] + [(None, "x"), (7, None)]
    stored = lm.stored_blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    pairs = lm.count_pairs(stored)
    trees = lm.build_trees(pairs)
    want, both = Counter(), Counter()
    for i, t in rows:
        if lm.is_held_out(i):
            continue
        for before, symbol, hashes in brute_symbols((t or "").encode()):
            both[before * lm.SYMBOLS + symbol] += 1
            for step in steps_of(trees, before, symbol):
                for x in brute_slots(hashes, step):
                    want[x, step & 1] += 1
    assert {k: n for k, n in enumerate(pairs.tolist()) if n} == both
    got = lm.train_tables(stored, trees)
    for x in {x for x, _ in want}:
        logit = math.log((want[x, 1] + 0.4) / (want[x, 0] + 0.4)) * lm.SCALE
        assert abs(got[x] - min(max(logit, -127), 127)) <= 0.51
    assert np.count_nonzero(got) <= len({x for x, _ in want})


def brute_entries(rows):
    """For each three-word context with an entry: (training count, whether in a held-out text) of each text that follows it."""
    out = {}
    for i, t in rows:
        r = lm.read([(t or "").encode()])
        for key, after in zip(r.context.tolist(), lm.followers(r), strict=True):
            n, held = out.setdefault(key, {}).get(after, (0, False))
            out[key][after] = (n + (not lm.is_held_out(i)), held or lm.is_held_out(i))
    return out


def test_entries_grow_with_the_corpus(spark):
    """Every entry of the corpus is there with its counts, at every size, and the most frequent follower wins."""
    draw = random.Random(6)
    words = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(draw.choices(words, k=draw.randrange(0, 120)))) for i in range(90)]
    sizes = []
    for some in (rows[:20], rows):
        stored = lm.stored_blocks(spark.createDataFrame(some, "doc_id long, text string").repartition(5))
        got = {}
        for r in lm.totals(stored, 5).collect():
            x = lm.Listed.unpack(zstandard.ZstdDecompressor().decompress(r.packed))
            begin = np.cumsum(x.size) - x.size
            for k in np.flatnonzero(x.key & 1).tolist():
                value = (int(x.n[k]), bool(x.held[k]), x.after[begin[k] : begin[k] + x.size[k]])
                assert got.setdefault(int(x.key[k]), value) == value
        want = {}
        for key, texts in brute_entries(some).items():
            total = sum(n for n, _ in texts.values())
            if total > 1 or (total and any(h for _, h in texts.values())):
                best = min(texts, key=lambda a: (-texts[a][0], a))
                want[key] = (texts[best][0], total > 1, best)
        assert got == want
        sizes.append(len(want))
    assert sizes[1] > sizes[0] > 0


def test_followed_text_predicts(spark):
    """A held-out copy of one training document is told by it; a training document is not told by itself."""
    draw = random.Random(7)
    text = lambda: " ".join("".join(draw.choices("abcdefghij", k=5)) for _ in range(400))
    held = next(i for i in range(1000, 2000) if lm.is_held_out(i))
    free = [i for i in range(1000) if not lm.is_held_out(i)][:30]
    one = text()
    rows = [(i, text()) for i in free[1:]] + [(free[0], one), (held, one)]
    got = {r.doc_id: r.bits_per_byte for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held] < 0.5 * got[free[0]]


def test_equal_files(spark, tmp_path):
    """A table that is written twice has its words once among the distinct ones."""
    rows = [(2, "a b"), (3, "a c d")]
    for k in range(2):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    got = sorted((r.doc_id, round(r.base_score, 9)) for r in lm.score_documents(docs).collect())
    want = sorted((i, round(b[3], 9)) for (i, _), b in zip(rows * 2, brute_base(rows * 2), strict=True))
    assert got == want


def test_every_context_has_an_entry():
    """No three-word context of a text is left out, and what follows each goes to the end of the next word."""
    words = [f"w{k % 37}x{k % 11}" for k in range(400)]
    r = lm.read([" ".join(words).encode(), b"a b", b"", b"one two three four"])
    assert len(r.context) == 398 + 0 + 0 + 2
    assert lm.followers(r)[:397] == [f" {w}".encode() for w in words[3:]] and lm.followers(r)[397:] == [b"", b" four", b""]
    assert len(set(r.context.tolist())) == len({tuple(words[k : k + 3]) for k in range(398)}) + 2


def test_lists_go_to_bytes_and_back():
    draw = np.random.default_rng(8)
    key = np.sort(draw.integers(-(1 << 63), (1 << 63) - 1, 300))
    for k in (key, draw.permutation(key), key[:0]):
        m = len(k)
        x = lm.Listed(k, draw.integers(0, 9, m), draw.random(m) < 0.5, draw.integers(0, 3, m), b"", draw.random(m) < 0.5)
        y = lm.Listed.unpack(zstandard.ZstdDecompressor().decompress(x.pack()))
        assert all(np.array_equal(getattr(x, f), getattr(y, f)) for f in ("key", "n", "held", "size", "sure"))


def test_contexts_with_many_followers():
    """A text that follows less often than all others together is not sure, and its states are those of its places."""
    texts = [f"x y z {w}".encode() for w in ("aa", "aa", "bb", "cc", "dd")] + [b"p q r ss"] * 3
    listed, begin = lm.list_block(texts, np.ones(8, bool))
    listed.after = lm.slices(listed.after, begin, listed.size)
    ((_, _, _, packed),) = lm.part_totals([(0, listed)])
    known = lm.Known([zstandard.ZstdDecompressor().decompress(packed)])
    r = lm.read([b"x y z ab", b"p q r ss"])
    predicted, state = known.followed(r, np.array([True, True]))
    assert bytes(predicted[5:8].astype(np.uint8)) == b" aa" and state[5:8].tolist() == [12, 13, 14]
    at = r.texts.bounds[1] + 5
    assert bytes(predicted[at : at + 3].astype(np.uint8)) == b" ss" and state[at : at + 3].tolist() == [4, 4, 4]
