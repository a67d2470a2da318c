"""Joins to the last earlier row, panes, resuming, and fits by aggregates."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickflow.functions import hawkes as H
from tickflow.operators import concave as V
from tickflow.operators import scan
from tickflow.operators import windows as W
from tickflow.sources import tape as P


def test_asof_with_many_knots(spark):
    rng = np.random.default_rng(4)
    left = pd.DataFrame({"day": rng.integers(0, 2, 20_000), "t": np.round(rng.uniform(0, 86_400, 20_000), 2), "seq": np.arange(20_000)})
    right = pd.DataFrame({"day": rng.integers(0, 3, 100_000), "t": np.round(rng.uniform(1000, 86_400, 100_000), 2), "x": rng.integers(0, 10**9, 100_000)})
    most = right.groupby(["day", "t"], as_index=False)["x"].max()
    for strict in (False, True):
        joined = scan.asof(spark.createDataFrame(left), spark.createDataFrame(right), ["day"], "t", "x", strict=strict)
        expected = pd.merge_asof(left.sort_values("t"), most.sort_values("t"), on="t", by="day", allow_exact_matches=not strict)
        got = joined.toPandas().sort_values("seq")
        assert (got["x"].fillna(-1).to_numpy() == expected.sort_values("seq")["x"].fillna(-1).to_numpy()).all() and len(got) == 20_000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_asof_without_either_side(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, None, "b")], "day long, ts_ns long, name string")
    right = spark.createDataFrame([(2, 1, 7)], "day long, ts_ns long, x long")
    assert [tuple(r) for r in scan.asof(left, right, ["day"], "ts_ns", "x").filter("ts_ns = 5").collect()] == [(1, 5, "a", None)]
    assert scan.asof(left.limit(0), right, ["day"], "ts_ns", "x").count() == 0


def test_panes_equal_windows(spark):
    rng = np.random.default_rng(7)
    rows = [("x", 1, i, float(np.round(t, 1)), int(v)) for i, (t, v) in enumerate(zip(rng.uniform(0, 90_000, 3000), rng.integers(0, 9, 3000), strict=True))]
    events = spark.createDataFrame(rows + [("y", 1, 0, 7200.0, 3)], "instrument string, day long, seq long, t double, size long")
    args = (23, 7200, 3600)
    got = W.pane_windows(events, *args, 3600, 7200, {"n": F.count("*"), "size": F.sum("size")})
    expected = W.assign(events, *args, before=3600, after=7200).groupBy("instrument", "day", "k", "t0", "role").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.select(*got.columns).collect()))


def test_events_are_sent_once_at_any_overlap(spark):
    """The rows that panes shuffle do not depend on how many windows an event is in."""
    events = spark.range(50_000).select(F.lit(1).alias("day"), (F.col("id") * 86_400 / 50_000).alias("t"))

    def generated(stride):
        plan = W.pane_windows(events, 86_400 // stride, 3600, stride, 0, 0, {"n": F.count("*")})
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString()
        return text.index("Generate") < text.rindex("partial_count") if "partial_count" in text else text.index("Generate") < text.rindex("Exchange")

    assert generated(3600) and generated(60)  # read from the top: the copies are made above the first exchange, of panes


def test_a_killed_run_keeps_its_waves(spark, tmp_path):
    jobs = spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 3).alias("m"))
    path, ran = f"{tmp_path}/results", []

    def run(part, most=None):
        keys = sorted((r.k, r.m) for r in part.collect())
        if most is not None and len(ran) + len(keys) > most:
            raise RuntimeError("killed")
        ran.extend(keys)
        return part.withColumn("value", F.col("k") * 10)

    with pytest.raises(RuntimeError, match="killed"):
        P.resume(jobs, path, ["k", "m"], lambda p: run(p, 25), wave=8)
    kept = sorted((r.k, r.m) for r in spark.read.parquet(path).collect())
    assert 0 < len(kept) <= 25 and kept == sorted(ran)
    done = P.resume(jobs, path, ["k", "m"], run, wave=8)
    assert sorted(r.value for r in done.collect()) == [10 * k for k in range(40)]
    assert sorted(ran) == sorted(set(ran)), "no job ran twice"
    assert P.resume(jobs, path, ["k", "m"], run, wave=8).count() == 40 and len(ran) == 40
    assert P.resume(jobs.limit(0), f"{tmp_path}/none", ["k", "m"], run).count() == 0


@pytest.fixture(scope="module")
def bursts(spark):
    rng, rows = np.random.default_rng(12), []
    for day, name in ((1, "x"), (1, "y"), (2, "x")):
        t = np.sort(np.concatenate([rng.uniform(0, 30_000, 150), *[c + rng.exponential(400, 6) for c in rng.uniform(0, 28_000, 30)]]))
        rows += [(name, day, i, float(v)) for i, v in enumerate(t)]
    return spark.createDataFrame(rows, "instrument string, day long, seq long, t double").repartition(4)


def test_fits_by_aggregates_are_the_grouped_fits(spark, bursts):
    betas = np.array([1e-3, 1e-2, 0.1])
    design, totals = V.window_design(bursts, betas.tolist(), 3, 12_000.0, 6_000.0)
    design, totals = design.cache(), totals.cache()
    got = {(r.instrument, r.day, r.k): r for r in V.fit_windows(design, totals, 4, first=5).collect()}
    assert len(got) == 9
    events = bursts.toPandas()
    for (name, day, k), fit in got.items():
        t = np.sort(events[(events.instrument == name) & (events.day == day)].t.to_numpy())
        t0, t1 = k * 6000.0, k * 6000.0 + 12_000
        want = H.fit_fixed_decays(t[(t >= t0) & (t < t1)], t[t < t0], t0, t1, betas)
        assert fit.certificate < H.CERTIFICATE and want.converged and fit.n_events == want.n_events
        assert fit.value == pytest.approx(want.loglik, abs=1e-6)
        assert np.allclose(fit.theta, np.concatenate([want.mu, want.alpha]), rtol=1e-4, atol=1e-6)


def test_multiplicative_steps_never_lower_the_value(spark, bursts):
    design, totals = V.window_design(bursts.filter("day = 2"), [1e-3, 1e-2], 2, 12_000.0, 6_000.0)
    design = design.cache()
    state, last = V.start(totals), None
    for _ in range(3):
        values = {r.k: r.value for r in V.measured(design, state, 3).collect()}
        assert last is None or all(values[k] >= last[k] - 1e-9 for k in values)
        state, last = V.multiplicative_step(design, state, 3), values
