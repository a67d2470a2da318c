"""Model fits as grouped pandas functions: a window's events and history in, a row out.

A window goes once to a group that runs all its fitters; windows without events have a row
with null time and still give a fit.  Replicates of a bootstrap are groups too, and seeds come
from logical keys.  Groups have few rows and much work, so they are dealt to a stated number of
partitions (``spread``), which adaptive execution does not fold into one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.functions import hawkes as H
from tickflow.functions import neural as N
from tickflow.functions import simulate as S
from tickflow.operators import tables as T
from tickflow.operators import windows as W
from tickflow.operators.streams import session_keys

SEED = 20210128

FIT_ROW = (
    "day long, k long, fitter string, t0 double, t1 double, t_mid double, n_events long, n double, se_n double, mu_mean double,"
    " converged boolean, condition_number double, beta_exp double, mu array<double>, alpha array<double>, timescales array<double>,"
    " edge_window boolean, loglik_per_event double, gain_over_poisson_per_event double, ks_stat double, ks_p double, lb_stat double,"
    " lb_p double, dispersion_z double, dispersion_p double, heldout_gain_over_poisson_per_event double,"
    " heldout_gain_kernel_only_per_event double, heldout_n_events long"
)


def fitters(unit: float = 1.0) -> dict[str, Callable]:
    """The registry; ``unit`` stretches all timescales."""
    betas, slow = H.BETAS / unit, 1 / (np.geomspace(1e-3, 10, 9) * unit)
    grid = H.beta_grid() / unit
    return {
        "exp_const": lambda t, h, a, b: H.fit_exp(t, h, a, b, grid=grid),
        "exp_spline": lambda t, h, a, b: H.fit_exp(t, h, a, b, "spline", 5, grid=grid),
        "mix_const": lambda t, h, a, b: H.fit_fixed_decays(t, h, a, b, betas),
        "mix_spline": lambda t, h, a, b: H.fit_fixed_decays(t, h, a, b, betas, "spline", 5),
        "mix_const_1ms": lambda t, h, a, b: H.fit_fixed_decays(t, h, a, b, slow),
        "mix_spline_1ms": lambda t, h, a, b: H.fit_fixed_decays(t, h, a, b, slow, "spline", 5),
    }


def _null(x: float) -> float | None:
    return None if x is None or (isinstance(x, float) and np.isnan(x)) else float(x)


def score(name: str, fit: H.Fit, times, history, nxt, t0: float, t1: float, end: float, last: float) -> dict:  # noqa: ANN001
    """The columns of a fit: in the window, and on the next one if it lies before the session's and the data's end."""
    n, length = len(times), t1 - t0
    per = max(n, 1)
    out = {
        "n_events": n,
        "n": fit.n,
        "se_n": _null(fit.se_n),
        "mu_mean": fit.mu_mean,
        "converged": fit.converged,
        "condition_number": _null(fit.condition),
        "beta_exp": float(fit.betas[0]) if fit.kind == "exp" else None,
        "mu": fit.mu.tolist(),
        "alpha": fit.alpha.tolist(),
        "timescales": (1 / fit.betas).tolist(),
        "loglik_per_event": fit.loglik / per,
        "gain_over_poisson_per_event": _null((fit.loglik - H.poisson_loglik(n, n / length, length)) / per),
        "heldout_gain_over_poisson_per_event": None,
        "heldout_gain_kernel_only_per_event": None,
        "heldout_n_events": 0,
    }
    out |= {k: _null(v) for k, v in H.gof_tests(H.rescaled_intervals(fit, times, history, t0, t1)).items()}
    if len(nxt) and t1 + length <= min(last, end):
        past, m = np.concatenate([history, times]), len(nxt)
        kernel_only = H.loglik_refit_baseline(fit, nxt, past, t1, t1 + length) - H.poisson_loglik(m, m / length, length)
        out["heldout_gain_kernel_only_per_event"], out["heldout_n_events"] = _null(kernel_only / m), m
        if n:
            carried = H.loglik(fit, nxt, past, t1, t1 + length) - H.poisson_loglik(m, n / length, length)
            out["heldout_gain_over_poisson_per_event"] = _null(carried / m)
    return out


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to a stated number of partitions, at least four for each core."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)


def windowed(stream: DataFrame, n: int, length: float, stride: float, before: float) -> DataFrame:
    """Stream rows (session, t) by window and role, with a null row for each window of each session and the session's last time.

    ``before`` is how far back history reaches.
    """
    keys = session_keys(stream)
    rows = W.assign(stream.select(*keys, "t"), n, length, stride, before=before, after=length).select(*keys, "k", "t", "role")
    sessions = stream.groupBy(*keys).agg(F.max("t").alias("last"))
    every = sessions.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    empty = every.select(*keys, "k", F.lit(None).cast("double").alias("t"), F.lit("fit").alias("role"))
    return rows.unionByName(empty).join(sessions, keys)


def session_row(stream: DataFrame, row: str) -> str:
    """The schema ``row``, which begins with the day, with the session's other columns before it."""
    return "".join(f"{k} {stream.schema[k].dataType.simpleString()}, " for k in session_keys(stream) if k != "day") + row


def run_rolling(
    stream: DataFrame, names: list[str], n: int, length: float, stride: float, session: float = 86_400.0, margin: float = 900.0, unit: float = 1.0
) -> DataFrame:
    """One scored fit per session, window and fitter."""
    keys = [*session_keys(stream), "k"]
    slowest = max(60.0 if name.startswith("exp") else 10.0 for name in names) * unit
    rows = windowed(stream, n, length, stride, min(session, H.REACH * slowest))

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        k = key[-1]
        t0, t1 = float(k * stride), float(k * stride + length)
        by = {r: np.sort(g["t"].dropna().to_numpy()) for r, g in part.groupby("role")}
        times, history, nxt = (by.get(r, np.zeros(0)) for r in ("fit", "history", "next"))
        row = {**dict(zip(keys, key, strict=True)), "t0": t0, "t1": t1, "t_mid": (t0 + t1) / 2, "edge_window": t0 < margin or t1 > session - margin}
        out = []
        for name in names:
            fitted = fitters(unit)[name](times, history, t0, t1)
            out.append(row | {"fitter": name} | score(name, fitted, times, history, nxt, t0, t1, session, part["last"].iloc[0]))
        return pd.DataFrame(out)

    return spread(rows, *keys).groupBy(*keys).applyInPandas(fit, session_row(stream, FIT_ROW))


def bootstrap(fits: DataFrame, replicates: int, burn_in: float, unit: float = 1.0, seed: int = SEED) -> DataFrame:
    """Refits on simulations from each fit, one group per replicate; then their summary.

    Fits with n >= 1 or without events have no replicates, and a row with ``boot_n`` 0.
    """
    names, session = list(fitters()), session_keys(fits)
    drawn = F.when(F.expr("n < 1 AND n_events > 0"), F.sequence(F.lit(0), F.lit(replicates - 1))).otherwise(F.array(F.lit(-1)))
    rows = fits.withColumn("replicate", F.explode(drawn)).select(*session, "k", "fitter", "t0", "t1", "mu", "alpha", "timescales", "replicate")
    keys = [*session, "k", "fitter", "replicate"]

    def refit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        *_, k, name, replicate = key
        if replicate < 0:
            return pd.DataFrame([{**dict(zip(keys, key, strict=True)), "n": None}])
        r = part.iloc[0]
        kind, pieces = ("spline", 5) if "spline" in name else ("constant", 1)
        mu, alpha, betas = np.array(r.mu), np.array(r.alpha), 1 / np.array(r.timescales)
        fit = H.Fit("mixture", betas, alpha, mu, kind, pieces, r.t0, r.t1, 0, 0.0, True, np.nan, np.nan)
        rng = np.random.default_rng([seed, *key_seed(key[: len(session)]), int(k), names.index(name), int(replicate)])
        history, times = S.window_times(S.Params(fit.mu_at, alpha, betas, fit.mu_max), r.t0, r.t1, rng, burn_in)
        value = None
        if len(times) >= 10:
            again = fitters(unit)[name](times, history, r.t0, r.t1)
            value = again.n if again.converged else None
        return pd.DataFrame([{**dict(zip(keys, key, strict=True)), "n": value}])

    schema = session_row(fits, "day long, k long, fitter string, replicate int, n double")
    out = spread(rows, *keys).groupBy(*keys).applyInPandas(refit, schema)
    return T.bootstrap_summary(out, [*session, "k", "fitter"], "n", keep_empty=True)


def key_seed(session: tuple) -> list[int]:
    """Whole numbers of a session's key for a generator: its day, and the bytes of a name."""
    return [x for part in session for x in ([int(part)] if not isinstance(part, str) else part.encode())]


RECOVERY_ROW = (
    "kernel string, n_true double, events int, seed long, fitter string, n_events long, n_hat double, se_n double, converged boolean,"
    " loglik double, ks_stat double, ks_p double, seconds double, beta_hat double"
)


def recovery_cells(cells: DataFrame) -> DataFrame:
    """``cells`` (kernel, n, events, seed): simulate one window and fit it in five ways."""
    import time

    decades, half = 1 / np.geomspace(1e-3, 10, 5), H.BETAS

    def cell(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        kernel, n, events, seed = key
        p = S.recovery_params(kernel, n, events)
        history, times = S.window_times(p, S.T0, S.T1, np.random.default_rng([SEED, int(seed)]))
        ways = {
            "exp_true_beta": lambda: H.fit_fixed_decays(times, history, S.T0, S.T1, p.betas) if len(p.betas) == 1 else None,
            "exp_profile": lambda: H.fit_exp(times, history, S.T0, S.T1),
            "grid_decade_const": lambda: H.fit_fixed_decays(times, history, S.T0, S.T1, decades),
            "grid_default_const": lambda: H.fit_fixed_decays(times, history, S.T0, S.T1, half),
            "grid_default_spline2min": lambda: H.fit_fixed_decays(times, history, S.T0, S.T1, half, "spline", 5),
        }
        rows = []
        for name, way in ways.items():
            began = time.perf_counter()
            if (fit := way()) is None:
                continue
            d, q = H.ks_exp1(H.rescaled_intervals(fit, times, history, S.T0, S.T1)) if len(times) else (np.nan, np.nan)
            rows.append(
                {
                    "kernel": kernel, "n_true": n, "events": events, "seed": seed, "fitter": name, "n_events": len(times), "n_hat": fit.n,
                    "se_n": _null(fit.se_n), "converged": fit.converged, "loglik": fit.loglik, "ks_stat": _null(d), "ks_p": _null(q),
                    "seconds": time.perf_counter() - began, "beta_hat": float(fit.betas[0]) if len(fit.betas) == 1 else None,
                }
            )
        return pd.DataFrame(rows)

    keys = ["kernel", "n", "events", "seed"]
    return spread(cells, *keys).groupBy(*keys).applyInPandas(cell, RECOVERY_ROW)


STRESS_ROW = (
    "scenario string, seed long, fitter string, n_events long, n_hat double, se_n double, mu_mean_hat double, converged boolean,"
    " condition_number double, alpha_slowest_two double, n_true double, n_true_within_10s double, " + ", ".join(f"{c} double" for c in H.GOF)
)


def stress_cells(cells: DataFrame) -> DataFrame:
    """``cells`` (scenario, seed): misspecified data under three baselines."""
    ways = {"grid_const": ("constant", 1), "grid_spline2min": ("spline", 5), "grid_spline1min": ("spline", 10)}

    def cell(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        scenario, seed = key
        history, times, n, near = S.stress_times(scenario, np.random.default_rng([SEED, int(seed)]))
        rows = []
        for name, (kind, pieces) in ways.items():
            fit = H.fit_fixed_decays(times, history, S.T0, S.T1, H.BETAS, kind, pieces)
            gof = H.gof_tests(H.rescaled_intervals(fit, times, history, S.T0, S.T1))
            rows.append(
                {
                    "scenario": scenario, "seed": seed, "fitter": name, "n_events": len(times), "n_hat": fit.n, "se_n": _null(fit.se_n),
                    "mu_mean_hat": fit.mu_mean, "converged": fit.converged, "condition_number": _null(fit.condition),
                    "alpha_slowest_two": float(fit.alpha[-2:].sum()), "n_true": n, "n_true_within_10s": near,
                    **{k: _null(v) for k, v in gof.items()},
                }
            )
        return pd.DataFrame(rows)

    return spread(cells, "scenario", "seed").groupBy("scenario", "seed").applyInPandas(cell, STRESS_ROW)


def simulate_cells(cells: DataFrame, draw: Callable[[tuple, np.random.Generator], np.ndarray], keys: list[str]) -> DataFrame:
    """(keys, t): one seeded simulation per row of ``cells``; ``draw`` gets the keys and a generator."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*keys).schema) + ", t double"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        t = draw(key, np.random.default_rng([SEED, *"|".join(map(str, key)).encode()]))
        return pd.DataFrame({**{k: [v] * len(t) for k, v in zip(keys, key, strict=True)}, "t": t})

    return spread(cells, *keys).groupBy(*keys).applyInPandas(run, schema)


NEURAL_FIT = (
    "day long, k long, fitter string, t0 double, t1 double, n_events long, n double, n_within double, mu_mean double, loglik_per_event double,"
    " converged boolean, kernel_phi array<double>, mu_grid array<double>, heldout_gain_over_poisson_per_event double,"
    " heldout_gain_kernel_only_per_event double, heldout_n_events long, fit_seconds double, " + ", ".join(f"{c} double" for c in H.GOF)
)


def run_neural(
    stream: DataFrame, bases: list[str], n: int, length: float, stride: float, session: float, s_min: float, s_max: float,
    steps: int = 400, polish: int = 100, replicates: int = 0, within: float = 10.0, per_decade: int = 200, seed: int = SEED,
) -> DataFrame:
    """A learned kernel per session, window and baseline, with the summary of its bootstrap.

    Replicates shrink with the square of the window's events.  Each is a group of its own: a fit's row goes on with
    its weights, once for itself and once for each replicate, and the rows of a fit are folded together at the end.
    """
    import time

    rows = windowed(stream, n, length, stride, min(session, s_max)).withColumn("fitter", F.explode(F.array(*[F.lit(f"neural_{b}") for b in bases])))
    keys = [*session_keys(stream), "k", "fitter"]
    schema = session_row(stream, NEURAL_FIT)

    def job(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        *_, k, name = key
        t0, t1 = float(k * stride), float(k * stride + length)
        by = {r: np.sort(g["t"].dropna().to_numpy()) for r, g in part.groupby("role")}
        times, history, nxt = (by.get(r, np.zeros(0)) for r in ("fit", "history", "next"))
        grid, began = N.Grid(s_min, s_max, per_decade), time.perf_counter()
        fit = N.fit_neural(times, history, t0, t1, name.removeprefix("neural_"), grid, steps, seed=0, polish_steps=polish)
        spent = time.perf_counter() - began
        _, phi, big, _ = fit.model.kernel()
        m, span = max(len(times), 1), t1 - t0
        row = {
            **dict(zip(keys, key, strict=True)), "t0": t0, "t1": t1, "n_events": len(times), "n": fit.n,
            "n_within": float(grid.big_at(big, np.array([within]))[0]), "mu_mean": fit.mu_mean, "loglik_per_event": fit.loglik / m,
            "converged": fit.converged, "kernel_phi": grid.phi_at(phi, np.geomspace(s_min, s_max * 0.9, 14)).tolist(),
            "mu_grid": fit.mu_grid[::100].tolist(), "heldout_gain_over_poisson_per_event": None, "heldout_gain_kernel_only_per_event": None,
            "heldout_n_events": 0, "fit_seconds": spent, "weights": fit.model.flat().tolist(),
            **{c: _null(v) for c, v in H.gof_tests(N.rescaled_intervals(fit, times, history)).items()},
        }
        if len(nxt) and len(times) and t1 + span <= min(part["last"].iloc[0], session):
            past, c = np.concatenate([history, times]), len(nxt)
            came = N.carried(fit, nxt, past, t1, t1 + span)
            row["heldout_gain_over_poisson_per_event"] = (N.heldout_loglik(fit, nxt, past, t1, t1 + span, came=came) - H.poisson_loglik(c, len(times) / span, span)) / c
            row["heldout_gain_kernel_only_per_event"] = (N.heldout_loglik(fit, nxt, past, t1, t1 + span, True, came) - H.poisson_loglik(c, c / span, span)) / c
            row["heldout_n_events"] = c
        return pd.DataFrame([row])

    def again(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """The replicate's row: its value, or that it grew too large; the fit's own row passes."""
        *_, k, name, replicate = key
        part = part.assign(boot=None, abandoned=False)
        if replicate < 0:
            return part
        r, grid = part.iloc[0], N.Grid(s_min, s_max, per_decade)
        scale, base = max(int(r.n_events), 1), name.removeprefix("neural_")
        model = N.Model(grid, base, float(np.log(scale / (r.t1 - r.t0))), 0)
        model.load(np.array(r.weights))
        fit = N.NeuralFit(model, r.t0, r.t1, int(r.n_events), 0.0, True)
        rng = np.random.default_rng([seed, *key_seed(key[: len(keys) - 2]), int(k), int(replicate)])
        try:
            t = N.neural_times(fit, r.t0 - s_max, r.t1, rng, max(3 * scale, 5000))
        except S.SimulationTooLarge:
            return part.assign(abandoned=True)
        if (t >= r.t0).sum() >= 10:
            found = N.fit_neural(t[t >= r.t0], t[t < r.t0], r.t0, r.t1, base, grid, steps, start=model, polish_steps=0).n
            part = part.assign(boot=float(found))
        return part

    fits = spread(rows, *keys).groupBy(*keys).applyInPandas(job, schema + ", weights array<double>")
    wanted = F.greatest(F.lit(min(3, replicates)), F.least(F.floor(replicates * F.pow(1500 / F.greatest("n_events", F.lit(1)), 2)), F.lit(replicates))).cast("int")
    draws = F.when(F.col("n") < 1, wanted).otherwise(0)
    each = fits.withColumn("replicate", F.explode(F.sequence(F.lit(-1), draws - 1)))
    own = [f.name for f in fits.schema if f.name not in keys and f.name != "weights"]
    # Only what a refit reads goes along with a replicate.
    each = each.withColumns({c: F.when(F.col("replicate") < 0, F.col(c)) for c in own if c not in ("t0", "t1", "n_events")})
    each = each.withColumn("weights", F.when(F.col("replicate") >= 0, F.col("weights")))
    spread_schema = schema + ", weights array<double>, replicate int, boot double, abandoned boolean"
    done = spread(each, *keys, "replicate").groupBy(*keys, "replicate").applyInPandas(again, spread_schema)
    value = F.when(~F.isnan("boot"), F.col("boot"))
    return done.groupBy(*keys).agg(
        *[F.max_by(c, F.col("replicate") < 0).alias(c) for c in own],
        F.count(value).alias("boot_n"),
        F.avg(value).alias("boot_mean"),
        F.stddev_samp(value).alias("boot_sd"),
        F.percentile(value, 0.025).alias("boot_lo"),
        F.percentile(value, 0.975).alias("boot_hi"),
        F.count_if("abandoned").alias("boot_abandoned"),
    )


def neural_recovery(cells: DataFrame, steps: int = 400, polish: int = 100, events: float = 2000, per_decade: int = 200) -> DataFrame:
    """``cells`` (scenario, seed): two classical and two learned fits of a known truth."""
    schema = "scenario string, seed long, fitter string, n_events long, n_hat double, converged boolean, loglik double, n_true double, n_true_within_10s double"

    def cell(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        scenario, seed = key
        history, times, n, near = S.stress_times(scenario, np.random.default_rng([SEED, int(seed)]), events)
        grid = N.Grid(per_decade=per_decade)
        ways = {
            "grid_const": lambda: H.fit_fixed_decays(times, history, S.T0, S.T1),
            "grid_spline": lambda: H.fit_fixed_decays(times, history, S.T0, S.T1, H.BETAS, "spline", 5),
            "neural_const": lambda: N.fit_neural(times, history, S.T0, S.T1, "const", grid, steps, polish_steps=polish),
            "neural_mlp": lambda: N.fit_neural(times, history, S.T0, S.T1, "mlp", grid, steps, polish_steps=polish),
        }
        rows = []
        for name, way in ways.items():
            fit = way()
            rows.append((scenario, seed, name, len(times), fit.n, fit.converged, fit.loglik, n, near))
        return pd.DataFrame(rows, columns=[c.strip().split()[0] for c in schema.split(",")])

    return spread(cells, "scenario", "seed").groupBy("scenario", "seed").applyInPandas(cell, schema)


def seeds(spark: SparkSession, names: list[str], column: str, count: int) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{column} string").crossJoin(spark.range(count).withColumnRenamed("id", "seed"))
