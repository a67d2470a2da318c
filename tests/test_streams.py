import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickflow.operators import audit as A
from tickflow.operators import streams as S
from tickflow.operators import windows as W
from tickflow.sources.tape import TAPE

PRICE, CENT = 376_000_000_000, 10_000_000


def tape(spark, rows, quotes=None):
    out = []
    for seq, (ns, side, size) in enumerate(rows):
        bid, ask = (quotes[seq] if quotes else (PRICE, PRICE + CENT))
        out.append((seq, 0, ns, ns, "T", side, size, bid, ask))
    return spark.createDataFrame(out, TAPE)


def listed(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("grp").collect()]


CASES = [
    ([(0, "B", 100), (0, "B", 200), (0, "B", 50), (5_000_000, "A", 100)], 0, False, [(350, 1, 3), (100, -1, 1)]),
    ([(0, "B", 100), (3000, "B", 100), (6000, "A", 100), (200_000, "B", 100)], 0, False, [(100, 1, 1)] * 2 + [(100, -1, 1), (100, 1, 1)]),
    ([(0, "B", 100), (3000, "B", 100), (6000, "A", 100), (200_000, "B", 100)], 10_000, False, [(200, 1, 2), (100, -1, 1), (100, 1, 1)]),
    ([(0, "A", 100), (0, "N", 100), (1000, "N", 100), (2000, "B", 100)], 10_000, False, [(300, -1, 3), (100, 1, 1)]),
    ([(0, "A", 100), (0, "N", 100), (1000, "N", 100), (2000, "B", 100)], 0, False, [(200, -1, 2), (100, 0, 1), (100, 1, 1)]),
    ([(0, "A", 100), (0, "N", 100), (1000, "N", 100), (2000, "B", 100)], 0, True, [(100, -1, 1), (100, 1, 1)]),
    ([(0, "A", 100), (0, "B", 300), (1_000_000, "A", 100)], 0, False, [(100, -1, 1), (300, 1, 1), (100, -1, 1)]),
]


@pytest.mark.parametrize(("rows", "merge", "sided", "expected"), CASES)
def test_orders(spark, rows, merge, sided, expected):
    assert listed(S.orders(tape(spark, rows), merge, sided), "size", "side", "n_fills") == expected


def test_opposite_sides_are_a_nanosecond_apart(spark):
    times = [r.out_ns for r in S.separate_ties(S.orders(tape(spark, CASES[-1][0]))).orderBy("grp").collect()]
    assert times == [0, 1, 1_000_000]


def test_mid_changes(spark):
    quotes = [(PRICE, PRICE + CENT), (PRICE, PRICE + 2 * CENT), (PRICE, PRICE + CENT), (None, PRICE + CENT), (PRICE + CENT, PRICE + 2 * CENT)]
    rows = [(0, "N", 1), (1000, "N", 1), (1000, "N", 1), (2000, "N", 1), (3000, "N", 1)]
    assert [(r.ts_ns, r.direction) for r in S.mid_changes(tape(spark, rows, quotes)).collect()] == [(3000, 1)]


def test_sweeps_against_a_loop(spark):
    draw = random.Random(3)
    ns, rows = 0, []
    for _ in range(400):
        ns += draw.choice([0, 0, 3, 8, 30])
        rows.append((ns, draw.choice("ABN"), 1))
    groups, held, grp, last = [], 0, 0, None
    for t, side, _ in rows:
        s = {"A": -1, "B": 1, "N": 0}[side]
        if last is None or t - last > 8 or (s and held and s != held):
            grp, held = grp + 1, s
        elif s:
            held = s
        groups.append(grp)
        last = t
    got = S.sweep_groups(tape(spark, rows), 8).orderBy("seq").collect()
    assert [r.grp for r in got] == groups
    out, previous = [], -1
    for r in sorted(S.separate_ties(S.orders(tape(spark, rows), 0) .select("day", "grp", "ts_ns", "seq")).collect(), key=lambda r: r.grp):
        previous = max(previous + 1, r.ts_ns)
        out.append(r.out_ns == previous)
    assert all(out)


def test_increasing(spark):
    good = tape(spark, [(0, "N", 1), (5, "N", 1)])
    bad = tape(spark, [(5, "N", 1), (5, "N", 1)])
    assert S.not_increasing(bad).first().violations == 1
    assert S.require_increasing(good).count() == 2
    with pytest.raises(Exception, match="increase"):
        S.require_increasing(bad).collect()


def test_windows(spark):
    rows = W.rolling_windows(spark, 34_200, 57_600, 600, 300).collect()
    assert len(rows) == 77 and rows[0].t0 == 34_200 and rows[-1].t1 == 57_600
    events = spark.createDataFrame([(float(t),) for t in (0, 299, 300, 600, 899, 900, 5000)], "t double")
    got = {(r.t, r.k, r.role) for r in W.assign(events, 3, 600, 300, before=300).collect()}
    want = {(t, k, "fit" if k * 300 <= t else "history") for t in (0.0, 299.0, 300.0, 600.0, 899.0, 900.0, 5000.0) for k in range(3) if k * 300 - 300 <= t < k * 300 + 600}
    assert got == want
    table = spark.createDataFrame([("m", k * 300.0, k * 300.0 + 600) for k in range(6)] + [("m", 300.0, 600.0)], "model string, t0 double, t1 double")
    assert sorted((r.t0, r.t1) for r in W.non_overlapping(table, ["model"]).collect()) == [(0, 600), (300, 600), (600, 1200), (1200, 1800)]


def test_instruments_are_kept_apart(spark):
    """The orders of two instruments in one day are those of each alone."""
    from tickflow.operators import streams as ST

    rows = [(k, 0, 10 * i + k, 1000 * (i // 2), "T", "B" if i % 3 else "A", 100) for k in (0, 1) for i in range(12)]
    tape = spark.createDataFrame(rows, "instrument long, day long, seq long, ts_ns long, action string, side string, size long")
    both = {(r.instrument, r.grp, r.ts_ns, r.size, r.n_fills) for r in ST.orders(tape).collect()}
    alone = set()
    for k in (0, 1):
        alone |= {(k, r.grp, r.ts_ns, r.size, r.n_fills) for r in ST.orders(tape.filter(f"instrument = {k}").drop("instrument")).collect()}
    assert both == alone
    assert {(r.instrument, r.out_ns) for r in ST.separate_ties(ST.orders(tape)).collect() if r.instrument == 0} == {
        (0, r.out_ns) for r in ST.separate_ties(ST.orders(tape.filter("instrument = 0").drop("instrument"))).collect()
    }


def test_audit_report_by_session(spark):
    day = 1_000_000_000 * 86400
    at = lambda d, s: d * day + s * 1_000_000_000
    rows = [
        (1, "x", 3, at(3, 34200), at(3, 34200), "T", "B", 10, 100, 102, 34200.0),
        (2, "x", 3, at(3, 34203), at(3, 34200), "T", "A", 5, 100, 104, 34203.0),
        (3, "x", 3, at(3, 57601), at(3, 57601), "C", "N", 1, 100, 106, 57601.0),
        (4, "y", 3, at(3, 40000), at(3, 40000), "C", "N", 1, None, None, 40000.0),
    ]
    tape = spark.createDataFrame(
        rows, "seq long, instrument string, day long, raw_ns long, ts_ns long, action string, side string, size long, bid long, ask long, t double"
    )
    got = {(r.instrument, r.field): r.value for r in A.report(tape).collect()}
    assert (got["x", "records"], got["x", "records_in_session"], got["x", "gap_max"], got["x", "gap_max_at"]) == (3, 2, 3, 34203)
    assert (got["x", "nondecreasing"], got["x", "increasing"], got["x", "latency_max"]) == (1, 0, 3e9)
    assert (got["x", "both_sides"], got["x", "timestamps_of_2_fills"], got["x", "shares"], got["x", "merge_0_events"]) == (1, 1, 15, 2)
    assert (got["y", "records"], got["y", "gap_max"]) == (1, None) and ("y", "executions") not in got
    assert A.report(tape.limit(0)).count() == 0


def test_lag_sums_are_those_of_the_pairs(spark):
    """Ties, repeated and null keys, blocks without events, and events whose distance is the reach but for rounding, as in the SQL."""
    rng = np.random.default_rng(3)
    ns = np.sort(np.concatenate([rng.integers(0, 4000, 300) * 10**9, rng.integers(0, 86_400_000_000, 300) * 1000, np.array([86_399_999_999_000])]))
    edge = np.array([n for n in rng.integers(0, 80_000_000_000, 2000).tolist() if ((n * 1000) / 1e9 > (n * 1000 + 1800 * 10**9) / 1e9 - 1800) != ((n * 1000 + 1800 * 10**9) / 1e9 - (n * 1000) / 1e9 < 1800)])
    assert len(edge) > 3
    ns = np.sort(np.concatenate([ns, edge * 1000, edge * 1000 + 1800 * 10**9]))
    rows = [(1 + k % 2, k // 3, float(n) / 1e9) for k, n in enumerate(ns.tolist())]
    rows += [(2, 7000 + k, 50_000 + k / 1e6) for k in range(0, 3000)] + [(None, 1, 5.0), (1, 2, None), (2, None, 50_000.5)]
    expected = {}
    for day in (1, 2):
        t = np.array(sorted(r[2] for r in rows if r[0] == day and r[2] is not None))
        for _, seq, at in (r for r in rows if r[0] == day and r[2] is not None):
            near = t[(t < at) & (t > at - 1800)]
            n, total = expected.get((day, seq), (0, 0.0))
            expected[day, seq] = (n + len(near), total + (at - near).sum())
    got = {(r.day, r.seq_i): (r.pairs, r.total) for r in W.lag_sums(spark.createDataFrame(rows, "day long, seq long, t double"), 1800.0).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: n for k, (n, _) in expected.items() if n}
    assert all(abs(v[1] - expected[k][1]) < 1e-6 for k, v in got.items())


def test_the_lag_query_makes_no_pairs(spark, tmp_path):
    """10,000 events within reach of each other are 50 million pairs; no step of the query has more than a few rows for each event."""
    from tickflow.plans import stream_queries as Q

    ts = F.to_timestamp_ntz(F.lit("2024-01-01 10:00:00")) + F.make_dt_interval(secs=F.col("id") / 10)
    spark.range(10_000).select(F.col("id").alias("event_id"), ts.alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    rows = Q.lag_pairs(spark, str(tmp_path))
    assert rows.agg(F.sum("pairs")).first()[0] == 10_000 * 9_999 // 2
    plan = rows._jdf.queryExecution().executedPlan()
    rows.collect()
    seen, todo = [], [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        if node.metrics().contains("numOutputRows"):
            seen.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    assert seen and max(seen) <= 40_000
