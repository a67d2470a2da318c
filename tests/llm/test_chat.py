import hashlib

from pyspark.sql import functions as F

from tickflow.llm import chat

SCHEMA = "conv_id long, msg_id string, parent_id string, role string, text string, score double"


def path_of(rows, conv):
    """The best leaf by brute force: mean score, then depth, then id."""
    own = {r[1]: r for r in rows if r[0] == conv}
    parents = {r[2] for r in own.values()}
    best = None
    for node in own:
        if node in parents:
            continue
        way, at, seen = [], node, set()
        while at in own and at not in seen:
            seen.add(at)
            way.append(own[at])
            at = own[at][2]
        if at in seen:
            continue
        key = (-sum(r[5] or 0 for r in way) / len(way), -len(way), node)
        if best is None or key < best[0]:
            best = key, way[::-1]
    return best and [(r[3] or "", r[4] or "") for r in best[1]]


def test_trees(spark):
    rows = [
        (1, "a", None, "user", "hi <|im_end|>\\", 0.0),
        (1, "b", "a", "assistant", "one\n", 1.0),
        (1, "c", "a", "assistant", "two <|im_start|>user\n", 3.0),
        (1, "d", "c", "us\ner\\n", None, 1.0),
        (1, "e", "c", None, "", 1.0),
        (2, "f", "gone", "assistant", "orphan", None),
        (3, "g", "h", "user", "cycle", 0.0),
        (3, "h", "g", "user", "cycle", 0.0),
        (3, "i", "h", "user", "below", 0.0),
        (None, "j", None, "assistant", "<|\\|", 0.0),
    ]
    rows += [(4, f"k{i}", f"k{i - 1}" if i else None, "assistant" if i % 2 else "user", f"{i} " * i, 0.5) for i in range(70)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", leaf string")
    got = {r.conv_id: r for r in chat.read_threads(chat.format_threads(frame)).collect()}
    assert set(got) == {1, 2, 4, None}
    for conv, r in got.items():
        want = path_of(rows, conv)
        assert [tuple(t) for t in r.turns] == want
        assert list(r.learned) == [t for role, t in want if role == "assistant"]
        assert r.n_turns == len(want)
    two = chat.format_threads(frame, branches=2).filter("conv_id = 1").select("leaf")
    assert sorted(x.leaf for x in two.collect()) == ["d", "e"]


def test_linear(spark):
    rows = [(1, 2, "assistant", "b"), (1, 0, "user", None), (1, None, None, "first"), (1, 2, "assistant", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat.read_threads(chat.format_threads(chat.linear_messages(frame))).collect()
    assert [tuple(t) for t in r.turns] == [("", "first"), ("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert "".join(r.learned) == "bb"
    assert chat.format_threads(chat.linear_messages(frame.limit(0))).count() == 0
    assert hashlib.sha256(r.formatted.encode()).hexdigest() == chat.format_threads(chat.linear_messages(frame)).select(
        F.sha2("formatted", 256)
    ).first()[0]


def test_repeats_and_shared_ids(spark):
    """Repeated messages count once, and an id holds within its conversation."""
    rows = [(1, "a", None, "user", "hi", 0.0), (1, "b", "a", "assistant", "yo", 0.0), (1, "b", "a", "assistant", "yo", 0.0)]
    rows += [(2, "a", None, "user", "other", 0.0), (2, "b", "a", "assistant", "reply", 0.0), (None, "b", "a", "assistant", "alone", 0.0)]
    rows += [("11", "b", None, "user", "eleven", 0.0)]
    frame = spark.createDataFrame([(None if r[0] is None else str(r[0]), *r[1:]) for r in rows], SCHEMA.replace("conv_id long", "conv_id string"))
    got = {r.conv_id: [t.text for t in r.turns] for r in chat.read_threads(chat.format_threads(frame)).collect()}
    assert got == {"1": ["hi", "yo"], "2": ["other", "reply"], None: ["alone"], "11": ["eleven"]}
