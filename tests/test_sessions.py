"""Two instruments of one day: every ordered or windowed operator gives for both what it gives for each alone.

And one long session: operators that run in blocks give what plain windows over the session give, in many tasks.
"""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickflow.functions import columns as C
from tickflow.operators import audit as A
from tickflow.operators import likelihood as L
from tickflow.operators import model as M
from tickflow.operators import scan
from tickflow.operators import streams as S
from tickflow.operators import windows as W

DAY_NS = 86_400 * 10**9


def records(instrument, n, seed):
    draw, ns, out = random.Random(seed), 0, []
    for seq in range(n):
        ns += draw.choice([0, 0, 5_000, 2 * 10**9, 40 * 10**9, 700 * 10**9 if n < 500 else 10**9])
        bid = 100 + draw.randrange(4) if draw.random() < 0.9 else None
        out.append((instrument, 3, seq, 3 * DAY_NS + ns + draw.randrange(1000), 3 * DAY_NS + ns, draw.choice("TTTC"), draw.choice("ABN"), 1 + seq % 7, bid, bid and bid + 2))
    return out


SCHEMA = "instrument string, day long, seq long, raw_ns long, ts_ns long, action string, side string, size long, bid long, ask long"


@pytest.fixture(scope="module")
def tape(spark):
    rows = spark.createDataFrame(records("x", 160, 1) + records("y", 140, 2), SCHEMA)
    return rows.withColumn("t", C.seconds_of_day(F.col("ts_ns"), F.col("day")))


@pytest.fixture(scope="module")
def parts(tape):
    """The tape, its orders and their rescaled intervals, of both instruments and of each alone."""

    def of(rows):
        rows = rows.cache()
        stream = S.trade_stream(rows).cache()
        taus = L.rescaled_intervals(stream, 0.01, 0.3, 0.01).select(*S.session_keys(rows), "seq", "t", "tau").cache()
        return rows, stream, taus

    return of(tape), {one: of(tape.filter(F.col("instrument") == one).drop("instrument")) for one in ("x", "y")}


OPERATORS = {
    "sweep_groups": lambda t, s, u: S.sweep_groups(t, 10_000).select(*S.session_keys(t), "seq", "grp"),
    "trade_stream": lambda t, s, u: s,
    "last_of_ts": lambda t, s, u: S.last_of_ts(t),
    "mid_changes": lambda t, s, u: S.mid_changes(t),
    "derived_stream": lambda t, s, u: S.derived_stream(s, "v", F.col("out_ns")),
    "not_increasing": lambda t, s, u: S.not_increasing(t),
    "lag_pairs": lambda t, s, u: W.lag_pairs(s, 100.0),
    "gaps": lambda t, s, u: A.gaps(t, "raw_ns"),
    "gaps_t": lambda t, s, u: A.gaps(s, "t"),
    "binned": lambda t, s, u: A.binned(t, 0, 86_400, 3600),
    "counts_in": lambda t, s, u: A.counts_in(t, {"early": (0, 1000.0)}),
    "window_loglik": lambda t, s, u: L.window_loglik(s, 0.01, 0.3, 0.01),
    "rescaled_intervals": lambda t, s, u: u,
    "ks_statistic": lambda t, s, u: L.ks_statistic(u),
    "ljung_box": lambda t, s, u: L.ljung_box(u),
    "dispersion": lambda t, s, u: L.dispersion(u),
    "run_rolling": lambda t, s, u: M.run_rolling(s, ["mix_const"], 3, 20_000, 10_000, unit=100.0).drop("mu", "alpha", "timescales"),
    "report": lambda t, s, u: A.report(t, 0, 86_400),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_two_instruments(parts, name):
    def told(rows):
        return sorted((tuple((k, f"{v:.9g}" if isinstance(v, float) else str(v)) for k, v in sorted(r.asDict().items()) if k != "instrument") for r in rows), key=str)

    both, alone = parts
    found = OPERATORS[name](*both)
    assert "instrument" in found.columns
    rows = found.collect()
    for one in ("x", "y"):
        assert told(r for r in rows if r.instrument == one) == told(OPERATORS[name](*alone[one]).collect())


def test_sums_over_two_instruments(tape):
    """Counts of timestamps are added over instruments, which share times."""
    executed = S.executions(tape)
    alone = [S.executions(tape.filter(F.col("instrument") == x).drop("instrument")) for x in ("x", "y")]
    assert A.both_sides(executed).first()[0] == sum(A.both_sides(a).first()[0] for a in alone)
    many = {r.fills: r.timestamps for r in A.tie_multiplicity(executed).collect()}
    parts = [{r.fills: r.timestamps for r in A.tie_multiplicity(a).collect()} for a in alone]
    assert many == {k: sum(p.get(k, 0) for p in parts) for k in many}
    assert A.audit(tape, 0, 86_400).first().orders == sum(S.orders(tape.filter(F.col("instrument") == x)).count() for x in ("x", "y"))


@pytest.fixture(scope="module")
def long_day(spark):
    rows = spark.createDataFrame(records("x", 6000, 5), SCHEMA).drop("instrument")
    return rows.withColumn("t", C.seconds_of_day(F.col("ts_ns"), F.col("day")))


def test_blocks_equal_plain_windows(long_day):
    plain = Window.partitionBy("day").orderBy("ts_ns", "seq")
    rows = scan.in_blocks(long_day)
    got = scan.running_count(scan.previous(rows, ["day"], ("ts_ns", "seq"), "size", "before"), ["day"], ("ts_ns", "seq"), "number")
    got = scan.running_sum(got, ["day"], ("ts_ns", "seq"), F.col("size"), "total")
    expected = long_day.select("seq", F.lag("size").over(plain).alias("b"), F.row_number().over(plain).alias("n"), F.sum("size").over(plain.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    assert rows.select("block").distinct().count() > 50
    assert got.join(expected, "seq").filter("NOT (before <=> b AND number = n AND total = s)").count() == 0
    assert got.join(expected, "seq").count() == 6000


@pytest.mark.parametrize("beta", [1e-4, 0.01, 1.0, 50.0, 1e5])
def test_faded_sums(long_day, beta):
    stream = S.trade_stream(long_day)
    t = np.array([r.t for r in stream.orderBy("t").collect()])
    s, state = [0.0], 0.0
    for gap in np.diff(t):
        state = np.exp(-beta * gap) * (state + 1)
        s.append(state)
    got = L.decay_sum(stream, beta).orderBy("t").collect()
    # Seconds of a day are held to about 1e-11, and a block's start is rounded to that: the exponent is off by beta times it.
    assert np.allclose([r.s for r in got], s, rtol=max(1e-8, 3e-11 * beta), atol=1e-12) and [r.i for r in got] == list(range(len(t)))


def test_one_session_uses_many_tasks(spark, long_day):
    """The rows of one day leave every ordered operator in at least eight partitions."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        for name, rows in {
            "groups": S.sweep_groups(long_day, 10_000),
            "ties": S.separate_ties(long_day.select("day", "seq", "ts_ns")),
            "mids": S.mid_changes(long_day),
            "sums": L.decay_sum(long_day.select("day", "seq", "t"), 0.01),
        }.items():
            assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= 8, name
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
