from tickflow.operators import model as M
from tickflow.plans import model_queries as Q


def test_neural_queries_do_the_whole_job(monkeypatch):
    """Three windows a day where the last may end with the session, and no fewer steps, nodes or events than the operator's own."""
    calls = {}
    monkeypatch.setattr(Q, "_stream", lambda spark, sf: None)
    monkeypatch.setattr(M, "seeds", lambda *a: None)
    monkeypatch.setattr(M, "neural_recovery", lambda *a, **k: calls.setdefault("recovery", (a, k)))
    monkeypatch.setattr(M, "run_neural", lambda *a, **k: calls.setdefault("window", (a, k)))
    Q.nk_recovery(None, "")
    Q.nk_window_job(None, "")
    (_, bases, n, length, stride, session, *_), named = calls["window"]
    assert bases == ["const", "mlp"] and n == (session - length) // stride + 1 == 3
    assert named == {"replicates": 20, "within": 1000.0} and calls["recovery"] == ((None,), {})


def test_robustness_has_all_variants(spark, monkeypatch):
    stream = spark.createDataFrame([(1, float(t)) for t in range(0, 5000, 7)] + [(2, 3.0)], "day long, t double")
    monkeypatch.setattr(Q.P, "read_tape", lambda *a, **k: None)
    monkeypatch.setattr(Q.ST, "trade_stream", lambda *a: stream)
    got = {name: (length, tuple(fitters)) for name, _, _, length, _, fitters in Q.robustness_streams(spark, "")}
    assert len(got) == 14 and all(len(f) == 2 for _, f in got.values())
    assert sorted(length for length, _ in got.values()) == [10_800] + [21_600] * 12 + [43_200]
    rows = [sorted(map(tuple, Q._jittered(stream, 1000.0, seed).collect())) for seed in (0, 0, 1)]
    assert rows[0] == rows[1] != rows[2] and len(set(rows[0])) == len(rows[0]) == stream.count()
    assert sum(t < 1000 for d, t in rows[0] if d == 1) == 143


def test_every_fit_has_a_bootstrap_row(spark):
    schema = "day long, k long, fitter string, t0 double, t1 double, mu array<double>, alpha array<double>, timescales array<double>, n double, n_events long"
    fit = lambda k, n, events: (1, k, "mix_const", 0.0, 600.0, [0.1], [n / 14] * 14, [float(i + 1) for i in range(14)], n, events)
    fits = spark.createDataFrame([fit(0, 0.2, 80), fit(1, 1.1, 80), fit(2, 0.0, 0)], schema)
    got = {r.k: r for r in M.bootstrap(fits, 4, 300.0).collect()}
    assert set(got) == {0, 1, 2} and got[0].boot_n <= 4
    assert [(got[k].boot_n, got[k].boot_mean, got[k].boot_hi) for k in (1, 2)] == [(0, None, None)] * 2


def test_learned_replicates_are_groups(spark):
    """One row for each session, window and baseline, with its own replicates, whichever way they are dealt."""
    rows = [(name, 1, i, float(t)) for name in ("x", "y") for i, t in enumerate(range(5, 5000, 90))]
    stream = spark.createDataFrame(rows, "instrument string, day long, seq long, t double")
    run = lambda: M.run_neural(stream, ["const", "mlp"], 2, 3000, 2000, 5000.0, 1.0, 500.0, steps=8, polish=2, replicates=3, within=50.0, per_decade=8)
    got = {(r.instrument, r.k, r.fitter): r for r in run().collect()}
    assert set(got) == {(i, k, f) for i in "xy" for k in (0, 1) for f in ("neural_const", "neural_mlp")}
    for r in got.values():
        assert r.n_events > 20 and len(r.kernel_phi) == 14 and r.fit_seconds > 0 and r.ks_stat is not None
        assert r.boot_n + r.boot_abandoned <= 3 and (r.boot_n == 0 or r.boot_lo <= r.boot_mean <= r.boot_hi)
    assert any(r.boot_n for r in got.values())
    again = {(r.instrument, r.k, r.fitter): (r.n, r.boot_mean) for r in run().collect()}
    assert again == {k: (r.n, r.boot_mean) for k, r in got.items()}
    assert M.run_neural(stream.limit(0), ["const"], 2, 3000, 2000, 5000.0, 1.0, 500.0).count() == 0


def test_a_kernel_without_mass_has_no_children():
    import numpy as np

    from tickflow.functions import neural as N

    model = N.Model(N.Grid(1.0, 100.0, 10), "const", np.log(0.01), 0)
    model.p["scale"] = np.array([-1e4])
    fit = N.NeuralFit(model, 0.0, 1000.0, 10, 0.0, True)
    assert fit.n == 0 and len(N.neural_times(fit, 0.0, 1000.0, np.random.default_rng(1))) > 0
