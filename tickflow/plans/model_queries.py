"""Queries of the likelihood, model and simulation operators.

The test events are sparse, so timescales are stretched: windows of 6 hours every
3 hours, a decay of 1e-3 per second, and fits with all timescales times 1000.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.functions import columns as C
from tickflow.functions import hawkes as H
from tickflow.functions import simulate as S
from tickflow.operators import concave as V
from tickflow.operators import likelihood as L
from tickflow.operators import model as M
from tickflow.operators import streams as ST
from tickflow.operators import tables as T
from tickflow.plans.registry import query, sql
from tickflow.plans.table_queries import _r
from tickflow.sources import tape as P
from tickflow.sources.stage import staged

MU, ALPHA, BETA = 0.002, 0.3, 1e-3
UNIT = 1000.0


def _events(spark, sf: str) -> DataFrame:
    tape = P.read_tape(spark, sf)
    return tape.select("seq", "day", C.seconds_of_day(F.col("raw_ns"), F.col("day")).alias("t"))


def _stream(spark, sf: str) -> DataFrame:
    """Trade orders from untied event times."""
    tape = P.read_tape(spark, sf, grid_ns=1000)
    return ST.trade_stream(tape).select("seq", "day", "t")


SUMS = f"""sums AS (
  SELECT i.seq, i.day, i.t, coalesce(sum(exp(-{BETA}::DOUBLE * (i.t - j.t))), 0e0) AS s, count(j.seq) AS i
  FROM tape i LEFT JOIN tape j ON j.day = i.day AND j.t < i.t GROUP BY i.seq, i.day, i.t)"""
TAUS = f"""taus AS (
  SELECT seq, day, t, total - coalesce(lag(total) OVER (PARTITION BY day ORDER BY t, seq), 0) AS tau
  FROM (SELECT *, {MU}::DOUBLE * t + {ALPHA}::DOUBLE * (i - s) AS total FROM sums))"""


def _sql(body: str, *more: str) -> str:
    return sql("tape", body=", ".join(["", SUMS, *more]) + " " + body)


@query("exp_decay_sum", _sql("SELECT seq, i, round(s, 6) AS s FROM sums"))
def exp_decay_sum(spark, sf):
    return _r(L.decay_sum(_events(spark, sf), BETA).select("seq", F.col("i").cast("long").alias("i"), "s"))


#: Decays a second of the fits' own grid: a day of the sparse events is told in thousandths, 86.4 s.
FAST = (0.1, 2.0, 1000.0)


@query(
    "exp_decay_sum_fast",
    sql("tape", body=", b AS (SELECT unnest([0.1e0, 2e0, 1000e0]) AS beta), d AS (SELECT seq, day, t / 1000e0 AS t FROM tape) SELECT i.seq, beta, round(coalesce(sum(exp(-beta * (i.t - j.t))), 0e0), 6) AS s FROM b, d i LEFT JOIN d j ON j.day = i.day AND j.t < i.t GROUP BY i.seq, beta"),
)
def exp_decay_sum_fast(spark, sf):
    events = _events(spark, sf).withColumn("t", F.col("t") / 1000)
    out = None
    for beta in FAST:
        rows = L.decay_sum(events, beta).select("seq", F.lit(beta).alias("beta"), "s")
        out = rows if out is None else out.unionByName(rows)
    return _r(out)


@query(
    "loglik_history",
    sql("tape", body=f", h AS (SELECT day, t - 86400 AS t FROM tape WHERE t >= 43200), own AS (SELECT seq, day, t FROM tape WHERE t < 43200), "
    f"s AS (SELECT i.seq, i.day, i.t, (SELECT coalesce(sum(exp(-{BETA}::DOUBLE * (i.t - j.t))), 0e0) FROM (SELECT day, t FROM own UNION ALL SELECT day + 1, t FROM h) j WHERE j.day = i.day AND j.t < i.t) AS s FROM own i) "
    f"SELECT s.day, count(*) AS n_events, round(sum(ln({MU}::DOUBLE + {ALPHA * BETA}::DOUBLE * s)) - {MU}::DOUBLE * 43200 - {ALPHA}::DOUBLE * (sum(1 - exp(-{BETA}::DOUBLE * (43200 - t))) "
    f"+ coalesce(min((SELECT sum(exp({BETA}::DOUBLE * h.t)) FROM h WHERE h.day + 1 = s.day)), 0e0) * (1 - exp(-{BETA}::DOUBLE * 43200))), 5) AS loglik FROM s GROUP BY s.day"),
)
def loglik_history(spark, sf):
    """The first half of each day, with the second half of the day before as history."""
    events = _events(spark, sf)
    history = events.filter("t >= 43200").select((F.col("day") + 1).alias("day"), "seq", (F.col("t") - 86_400).alias("t"))
    return _r(L.window_loglik(events.filter("t < 43200"), MU, ALPHA, BETA, 43_200.0, history).select("day", "n_events", "loglik"), 5)


@query("excitation", _sql(f"SELECT day, round(sum({BETA}::DOUBLE * s), 6) AS at_events, round(sum(1 - exp(-{BETA}::DOUBLE * (86400 - t))), 6) AS integral, round(max(i - s), 6) AS cumulative FROM sums GROUP BY day"))
def excitation(spark, sf):
    rows = L.decay_sum(_events(spark, sf), BETA)
    return _r(rows.groupBy("day").agg(F.sum(BETA * F.col("s")).alias("at_events"), F.sum(1 - F.exp(-BETA * (86400 - F.col("t")))).alias("integral"), F.max(F.col("i") - F.col("s")).alias("cumulative")))


@query("baseline", sql("tape", body="SELECT day, knot, round(sum(greatest(0e0, 1 - abs(t / 17280e0 - knot))), 6) AS weight FROM tape, range(6) AS k(knot) GROUP BY day, knot"))
def baseline(spark, sf):
    hats = L.hat_basis(F.col("t"), 0, 86400, 5)
    rows = _events(spark, sf).select("day", F.posexplode(hats).alias("knot", "w"))
    return _r(rows.groupBy("day", F.col("knot").cast("long").alias("knot")).agg(F.sum("w").alias("weight")))


LOGLIK = f"lls AS (SELECT day, count(*) AS n_events, sum(ln({MU}::DOUBLE + {ALPHA * BETA}::DOUBLE * s)) - {MU}::DOUBLE * 86400 - {ALPHA}::DOUBLE * sum(1 - exp(-{BETA}::DOUBLE * (86400 - t))) AS loglik FROM sums GROUP BY day)"


@query("loglik", _sql("SELECT day, n_events, round(loglik, 5) AS loglik FROM lls", LOGLIK))
def loglik(spark, sf):
    return _r(L.window_loglik(_events(spark, sf), MU, ALPHA, BETA).select("day", "n_events", "loglik"), 5)


@query("poisson_loglik", sql("tape", "metric", body="SELECT model, day, k, round(n_events * ln(n_events / 21600e0) - n_events, 6) AS poisson FROM metric"))
def poisson_loglik(spark, sf):
    from tickflow.plans.table_queries import _metric

    return _r(L.poisson_loglik(_metric(spark, sf), 21600.0).select("model", "day", "k", "poisson"))


@query("rescaled_intervals", _sql("SELECT seq, round(tau, 6) AS tau FROM taus", TAUS))
def rescaled_intervals(spark, sf):
    return _r(L.rescaled_intervals(_events(spark, sf), MU, ALPHA, BETA).select("seq", "tau"))


KS = "ks AS (SELECT day, max(greatest(r / n::DOUBLE - c, c - (r - 1) / n::DOUBLE)) AS ks_stat FROM (SELECT day, 1 - exp(-tau) AS c, row_number() OVER (PARTITION BY day ORDER BY tau, seq) AS r, count(*) OVER (PARTITION BY day) AS n FROM taus) GROUP BY day)"
ACF = (
    "cent AS (SELECT seq, day, t, tau - avg(tau) OVER (PARTITION BY day) AS c, row_number() OVER (PARTITION BY day ORDER BY t, seq) AS rn FROM taus), "
    "tot AS (SELECT day, count(*) AS n, sum(c * c) AS cc FROM cent GROUP BY day), "
    "acf AS (SELECT a.day, n, b.rn - a.rn AS lag, sum(a.c * b.c) / min(cc) AS r FROM cent a JOIN cent b ON a.day = b.day AND b.rn - a.rn BETWEEN 1 AND 10 JOIN tot ON tot.day = a.day GROUP BY a.day, n, b.rn - a.rn)"
)
LB = "lb AS (SELECT day, min(n) * (min(n) + 2) * sum(r * r / (n - lag)) AS lb_stat FROM acf WHERE n > 10 GROUP BY day)"
DISP = "disp AS (SELECT day, sqrt(count(*) / 8e0) * (var_samp(tau) - 1) AS dispersion_z FROM taus GROUP BY day)"


def _taus(spark, sf: str) -> DataFrame:
    return L.rescaled_intervals(_events(spark, sf), MU, ALPHA, BETA)


@query("gof_ks", _sql("SELECT day, round(ks_stat, 6) AS ks_stat FROM ks", TAUS, KS))
def gof_ks(spark, sf):
    return _r(L.ks_statistic(_taus(spark, sf)))


@query("autocorr", _sql("SELECT day, n, lag, round(r, 6) AS r FROM acf", TAUS, ACF))
def autocorr(spark, sf):
    return _r(L.autocorrelations(_taus(spark, sf)))


@query("gof_lb", _sql("SELECT day, round(lb_stat, 5) AS lb_stat FROM lb", TAUS, ACF, LB))
def gof_lb(spark, sf):
    return _r(L.ljung_box(_taus(spark, sf)), 5)


@query("gof_disp", _sql("SELECT day, round(dispersion_z, 6) AS dispersion_z FROM disp", TAUS, DISP))
def gof_disp(spark, sf):
    return _r(L.dispersion(_taus(spark, sf)))


CHI = " + ".join(f"power(lb_stat / 2, {k}) / {float(np.prod(range(1, k + 1)))}::DOUBLE" for k in range(5))


@query("gof_tests", _sql(f"SELECT ks.day, round(ks_stat, 6) AS ks_stat, round(lb_stat, 5) AS lb_stat, round(exp(-lb_stat / 2) * ({CHI}), 6) AS lb_p, round(dispersion_z, 6) AS dispersion_z FROM ks JOIN lb ON ks.day = lb.day JOIN disp ON ks.day = disp.day", TAUS, KS, ACF, LB, DISP))
def gof_tests(spark, sf):
    taus = _taus(spark, sf)
    rows = L.ks_statistic(taus).join(L.ljung_box(taus), "day").join(L.dispersion(taus), "day")
    return rows.select("day", F.round("ks_stat", 6).alias("ks_stat"), F.round("lb_stat", 5).alias("lb_stat"), F.round(C.chi2_sf_even(F.col("lb_stat")), 6).alias("lb_p"), F.round("dispersion_z", 6).alias("dispersion_z"))


@query("mu_mean_kernel", "SELECT k, round(0.6e0 * 2 * exp(-2 * s) + 0.3e0 * 0.1e0 * exp(-0.1e0 * s), 6) AS phi FROM (SELECT k, power(10e0, k / 4e0 - 2) AS s FROM range(14) AS r(k))")
def mu_mean_kernel(spark, sf):
    s = F.pow(F.lit(10.0), F.col("id") / 4 - 2)
    return _r(spark.range(14).select(F.col("id").alias("k"), L.kernel_value(s, [0.6, 0.3], [2.0, 0.1]).alias("phi")))


@query("beta_grid", "SELECT k, round(log10(1 / (1e-5 * power(6e6, k / 28e0))), 6) AS log_beta FROM range(29) AS r(k)")
def beta_grid(spark, sf):
    grid = spark.range(1).select(F.posexplode(C.geometric_grid(1e-5, 60.0, 29)).alias("k", "s"))
    return _r(grid.select(F.col("k").cast("long").alias("k"), F.log10(1 / F.col("s")).alias("log_beta")))


@query(
    "cumsum_trapz",
    sql("tape", "metric", body=", s AS (SELECT *, coalesce(0.5e0 * (est + lag(est) OVER w) * (t0 - lag(t0) OVER w), 0) AS seg FROM metric WINDOW w AS (PARTITION BY model, day ORDER BY t0)) SELECT model, day, k, round(sum(seg) OVER (PARTITION BY model, day ORDER BY t0), 4) AS head, round(sum(seg) OVER (PARTITION BY model, day) - sum(seg) OVER (PARTITION BY model, day ORDER BY t0), 4) AS tail FROM s"),
)
def cumsum_trapz(spark, sf):
    from tickflow.plans.table_queries import _metric

    rows = L.cumulative_trapezoid(_metric(spark, sf), ["model", "day"], "t0", "est")
    return _r(rows.select("model", "day", "k", "head", "tail"), 4)


@query("prefix_residual", _sql("SELECT day, seq, round(sum(1 - exp(-t / 1e4)) OVER (PARTITION BY day ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 6) AS spent FROM sums"))
def prefix_residual(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("day").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return _r(_events(spark, sf).select("day", "seq", F.sum(1 - F.exp(-F.col("t") / 1e4)).over(w).alias("spent")))


@query(
    "scalar_functions",
    "SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) AS ln, round(log10(l_extendedprice), 6) AS lg, round(exp(l_discount) - 1, 6) AS em, round(sqrt(l_quantity), 6) AS sq, floor(l_extendedprice)::BIGINT AS fl, "
    "abs(l_quantity - 25) AS ab, sign(l_quantity - 25)::BIGINT AS sg, round(sin(l_tax), 6) AS si, round(power(l_discount, 2), 6) AS pw, least(greatest(l_quantity, 10), 40) AS clip, round(ln(1 + exp(l_discount)), 6) AS softplus, round((exp(2 * l_tax) - 1) / (exp(2 * l_tax) + 1), 6) AS tanh FROM lineitem",
)
def scalar_functions(spark, sf):
    q, p, d, t = (F.col(f"l_{c}") for c in ("quantity", "extendedprice", "discount", "tax"))
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return _r(
        rows.select(
            "l_orderkey", "l_linenumber", F.log(p).alias("ln"), F.log10(p).alias("lg"), F.expm1(d).alias("em"), F.sqrt(q).alias("sq"), F.floor(p).cast("long").alias("fl"),
            F.abs(q - 25).alias("ab"), F.signum(q - 25).cast("long").alias("sg"), F.sin(t).alias("si"), F.pow(d, 2).alias("pw"), F.least(F.greatest(q, F.lit(10.0)), F.lit(40.0)).alias("clip"),
            C.softplus(d).alias("softplus"), F.tanh(t).alias("tanh"),
        )
    )


@query("array_functions", "SELECT o_orderkey, array_to_string([k % 7, k % 5, k % 3][1:2], ' ') AS head, list_sum([k % 7, k % 5, k % 3])::BIGINT AS total, array_to_string(list_reverse([k % 7, k % 5, k % 3]), ' ') AS backward FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)")
def array_functions(spark, sf):
    k = F.col("o_orderkey")
    a = F.array(k % 7, k % 5, k % 3)
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", F.array_join(F.slice(a, 1, 2), " ").alias("head"), F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y).alias("total"), F.array_join(F.reverse(a), " ").alias("backward")
    )


# Fits by aggregates.

SLOW = (1e-3, 1e-2)
_LISTED = "range(3) AS r(k)"
DESIGN = [
    "s AS (SELECT i.seq, i.day, i.t, " + ", ".join(f"coalesce(sum(exp(-{b}::DOUBLE * (i.t - j.t))), 0e0) AS s{n}" for n, b in enumerate(SLOW))
    + " FROM tape i LEFT JOIN tape j ON j.day = i.day AND j.t < i.t GROUP BY i.seq, i.day, i.t)",
    f"own AS (SELECT s.*, k FROM s JOIN {_LISTED} ON t >= k * 21600 AND t < k * 21600 + 43200)",
    f"came AS (SELECT d.day, k, " + ", ".join(f"coalesce(sum(exp(-{b}::DOUBLE * (k * 21600 - t))), 0e0) * (1 - exp(-{b}::DOUBLE * 43200)) AS h{n}" for n, b in enumerate(SLOW))
    + f" FROM (SELECT DISTINCT day FROM tape) d CROSS JOIN {_LISTED} LEFT JOIN tape ON tape.day = d.day AND t < k * 21600 GROUP BY d.day, k)",
    "tot AS (SELECT day, k, count(*) AS n, " + ", ".join(f"sum(1 - exp(-{b}::DOUBLE * (k * 21600 + 43200 - t))) + min(h{n}) AS c{n}" for n, b in enumerate(SLOW))
    + " FROM own JOIN came USING (day, k) GROUP BY day, k)",
    "des AS (SELECT day, k, n, 1 / 43200e0 AS y0, " + ", ".join(f"{b}::DOUBLE * s{n} / c{n} AS y{n + 1}" for n, b in enumerate(SLOW)) + " FROM own JOIN tot USING (day, k))",
    "z0 AS (SELECT day, k, n, n / 3e0 AS a0, n / 3e0 AS a1, n / 3e0 AS a2 FROM tot)",
]
STEP = (
    "z{m} AS (SELECT day, k, min(z{k}.n) AS n, " + ", ".join(f"min(a{j}) * sum(y{j} / (y0 * a0 + y1 * a1 + y2 * a2)) AS a{j}" for j in range(3))
    + " FROM des JOIN z{k} USING (day, k) GROUP BY day, k)"
)


def _fixed_steps_sql(steps: int) -> str:
    parts = [*DESIGN, *[STEP.format(k=k, m=k + 1) for k in range(steps)]]
    value = f"SELECT day, k, n AS n_events, round(a0, 5) AS share_0, round(a1, 5) AS share_1, round(a2, 5) AS share_2 FROM z{steps}"
    return sql("tape", body=", " + ", ".join(parts) + " " + value)


def _three_windows(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    return V.window_design(_events(spark, sf), list(SLOW), 3, 43_200.0, 21_600.0)


@query("monotone_steps", _fixed_steps_sql(4))
def monotone_steps(spark, sf):
    """Four multiplicative steps of the likelihood of a constant rate and two decays, all windows at once."""
    design, totals = _three_windows(spark, sf)
    design, totals = staged(design), staged(totals)
    state = V.start(totals)
    for _ in range(4):
        state = V.multiplicative_step(design, state, 3)
    return _r(state.select("day", "k", "n_events", *[F.col("share")[j].alias(f"share_{j}") for j in range(3)]), 5)


@query(
    "certified_fits",
    sql("tape", body=", " + ", ".join(DESIGN) + " SELECT day, k, n AS n_events, true AS certified FROM z0"),
)
def certified_fits(spark, sf):
    """Every window's fit ends with a certificate: no slope that is left is above one millionth."""
    design, totals = _three_windows(spark, sf)
    fits = V.fit_windows(staged(design), staged(totals), 3)
    return fits.select("day", "k", "n_events", (F.col("certificate") < H.CERTIFICATE).alias("certified"))


@query("fit_by_aggregates")
def fit_by_aggregates(spark, sf):
    """The fits themselves; tests hold them against those of the grouped function."""
    design, totals = _three_windows(spark, sf)
    fits = V.fit_windows(staged(design), staged(totals), 3)
    return fits.select("day", "k", "n_events", F.col("theta")[0].alias("mu"), (F.col("theta")[1] + F.col("theta")[2]).alias("n"), F.col("value").alias("loglik"))


# Fits.


def _rolling(spark, sf: str, names: list[str]) -> DataFrame:
    return M.run_rolling(_stream(spark, sf), names, 7, 21_600, 10_800, unit=UNIT)


@query("fit_and_score")
def fit_and_score(spark, sf):
    return _rolling(spark, sf, ["mix_const"])


@query("fit_fixed_decays")
def fit_fixed_decays(spark, sf):
    return _rolling(spark, sf, ["mix_const", "mix_spline"]).select("day", "k", "fitter", "n", "se_n", "mu_mean", "converged", "loglik_per_event")


@query("fit_exp")
def fit_exp(spark, sf):
    return _rolling(spark, sf, ["exp_const"]).select("day", "k", "fitter", "n", "beta_exp", "converged", "loglik_per_event")


@query("run_rolling")
def run_rolling(spark, sf):
    return _rolling(spark, sf, ["exp_const", "exp_spline", "mix_const", "mix_spline"])


_FINE = """fine AS (SELECT event_id AS seq, raw_ns // 86400000000000 AS day, raw_ns AS ts_ns, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS sgn
  FROM (SELECT *, epoch_us(ts) * 1000 AS raw_ns FROM events) WHERE event_type NOT IN ('error', 'signup')),
pts AS (SELECT DISTINCT day, (ts_ns - day * 86400000000000) / 1e9 AS t FROM fine)"""


@query(
    "fit_invariants",
    f"WITH {_FINE} SELECT d.day, k.k, k * 10800e0 AS t0, k * 10800e0 + 21600 AS t1, (SELECT count(*) FROM pts p WHERE p.day = d.day AND t >= k * 10800 AND t < k * 10800 + 21600) AS n_events, "
    "k * 10800 < 900 OR k * 10800 + 21600 > 85500 AS edge_window, CASE WHEN k * 10800 + 43200 <= least(last, 86400) THEN (SELECT count(*) FROM pts p WHERE p.day = d.day AND t >= k * 10800 + 21600 AND t < k * 10800 + 43200) ELSE 0 END AS heldout_n_events "
    "FROM (SELECT day, max(t) AS last FROM pts GROUP BY day) d, range(7) AS k(k)",
)
def fit_invariants(spark, sf):
    return _rolling(spark, sf, ["mix_const"]).select("day", "k", "t0", "t1", "n_events", "edge_window", "heldout_n_events")


@query("heldout_gain")
def heldout_gain(spark, sf):
    return _rolling(spark, sf, ["mix_const", "mix_spline"]).groupBy("fitter").agg(
        F.count("heldout_gain_kernel_only_per_event").alias("windows"), F.avg("heldout_gain_kernel_only_per_event").alias("kernel_only"), F.avg("heldout_gain_over_poisson_per_event").alias("carried")
    )


@query("cond_number")
def cond_number(spark, sf):
    return _rolling(spark, sf, ["mix_const", "mix_spline"]).select("day", "k", "fitter", "condition_number")


@query("parametric_bootstrap")
def parametric_bootstrap(spark, sf):
    fits = _rolling(spark, sf, ["mix_const"])
    return M.bootstrap(fits, 100, burn_in=10_800.0, unit=UNIT)


@query("loglik_refit_baseline")
def loglik_refit_baseline(spark, sf):
    return _rolling(spark, sf, ["mix_const"]).select("day", "k", "heldout_gain_kernel_only_per_event", "heldout_n_events")


@query("baseline_function")
def baseline_function(spark, sf):
    fits = _rolling(spark, sf, ["mix_spline"]).select("day", "k", "t0", "t1", "mu")
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.col("t0") + (F.col("t1") - F.col("t0")) * i / 12)).alias("t")
    knots = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("t0") + (F.col("t1") - F.col("t0")) * i / 5)
    return fits.withColumn("knots", knots).select("day", "k", at, "knots", "mu").select("day", "k", "t", C.interpolate(F.col("t"), F.col("knots"), F.col("mu")).alias("rate"))


@query("branching_ratio_figure")
def branching_ratio_figure(spark, sf):
    fits = _rolling(spark, sf, ["mix_const", "mix_spline"])
    return fits.select("fitter", "day", "t_mid", "n", (F.col("n") - 1.96 * F.col("se_n")).alias("lo"), (F.col("n") + 1.96 * F.col("se_n")).alias("hi"), (F.col("ks_p") < 0.05).alias("ks_reject"))


@query("kernel_figure")
def kernel_figure(spark, sf):
    fits = _rolling(spark, sf, ["mix_const"]).select("day", "k", "alpha", "timescales")
    s = F.explode(C.geometric_grid(1.0, 10_000.0, 14)).alias("s")
    terms = F.zip_with("alpha", "timescales", lambda a, d: a / d * F.exp(-F.col("s") / d))
    rows = fits.select("day", "k", "alpha", "timescales", s)
    return rows.select("day", "k", "s", F.aggregate(terms, F.lit(0.0), lambda x, y: x + y).alias("phi"))


def _jittered(stream: DataFrame, resolution: float, seed: int) -> DataFrame:
    """Times rounded down to ``resolution`` and spread over it again, drawn for each day on its own."""
    import pandas as pd

    def day(key, part: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        rng = np.random.default_rng([M.SEED, int(resolution * 1e6), seed, int(key[0])])
        return pd.DataFrame({"day": key[0], "t": S.jittered(np.sort(part["t"].to_numpy()), resolution, rng)})

    coarse = stream.select("day", C.coarsen_seconds(F.col("t"), resolution).alias("t"))
    return coarse.groupBy("day").applyInPandas(day, "day long, t double")


def robustness_streams(spark, sf: str) -> list[tuple]:
    """(variant, stream, windows, length, stride, fitters): the reference's 14, all timescales times 1000."""
    tape = P.read_tape(spark, sf, grid_ns=1000)
    base, six, both = ST.trade_stream(tape), (7, 21_600, 10_800), ["mix_const", "mix_spline"]
    out = [("base", base, *six, both)]
    out += [(f"merge_{ms}ms", ST.trade_stream(tape, ms * 1_000_000), *six, both) for ms in (10, 100, 1000)]
    out.append(("sided", ST.trade_stream(tape, 0, True), *six, both))
    out += [(f"rounded_{grid:g}s_seed_{k}", _jittered(base, grid, k), *six, both) for grid in (1.0, 1000.0) for k in range(3)]
    out += [("window_3h", base, 15, 10_800, 5_400, both), ("window_12h", base, 3, 43_200, 21_600, both)]
    return [*out, ("grid_1ms", base, *six, ["mix_const_1ms", "mix_spline_1ms"])]


@query("robustness_variants")
def robustness_variants(spark, sf):
    out = None
    for name, stream, n, length, stride, names in robustness_streams(spark, sf):
        fits = M.run_rolling(stream, names, n, length, stride, unit=UNIT).withColumn("variant", F.lit(name))
        out = fits if out is None else out.unionByName(fits)
    return out.select("variant", "fitter", "day", "k", "n_events", "n", "converged", "ks_p")


# Simulations.


@query("sim_poisson")
def sim_poisson(spark, sf):
    return M.simulate_cells(spark.range(8).withColumnRenamed("id", "seed"), lambda k, rng: S.poisson_times(0.5, 0, 600, rng), ["seed"])


@query("sim_thin")
def sim_thin(spark, sf):
    draw = lambda k, rng: S.thinned_times(lambda t: 1 + np.sin(t / 50), 2.0, 0, 600, rng)
    return M.simulate_cells(spark.range(8).withColumnRenamed("id", "seed"), draw, ["seed"])


@query("sim_hawkes")
def sim_hawkes(spark, sf):
    draw = lambda k, rng: S.hawkes_times(S.recovery_params(k[0], 0.6, 500), S.T0, S.T1, rng)
    return M.simulate_cells(M.seeds(spark, list(S.KERNELS), "kernel", 3), draw, ["kernel", "seed"])


@query("sim_window")
def sim_window(spark, sf):
    draw = lambda k, rng: np.concatenate(S.window_times(S.recovery_params(k[0], 0.6, 500), S.T0, S.T1, rng))
    return M.simulate_cells(M.seeds(spark, list(S.KERNELS), "kernel", 3), draw, ["kernel", "seed"]).withColumn("is_history", F.col("t") < S.T0)


@query("sim_powerlaw")
def sim_powerlaw(spark, sf):
    draw = lambda k, rng: S.power_law_times(0.1, 0.9, 0.15, 0.1, 3600, 0, 3600, rng)
    return M.simulate_cells(spark.range(4).withColumnRenamed("id", "seed"), draw, ["seed"])


@query("sim_sweeps")
def sim_sweeps(spark, sf):
    draw = lambda k, rng: S.split_sweeps(S.poisson_times(1.0, 0, 600, rng), rng)[0]
    return M.simulate_cells(spark.range(4).withColumnRenamed("id", "seed"), draw, ["seed"])


def _scenario(key, rng):  # noqa: ANN001, ANN202
    history, times, *_ = S.stress_times(key[0], rng, 500)
    return np.concatenate([history, times])


@query("sim_scenario")
def sim_scenario(spark, sf):
    return M.simulate_cells(M.seeds(spark, list(S.STRESS), "scenario", 1), _scenario, ["scenario", "seed"])


@query("sim_scenario2")
def sim_scenario2(spark, sf):
    return M.simulate_cells(M.seeds(spark, list(S.LEARNED), "scenario", 1), _scenario, ["scenario", "seed"])


@query("jitter")
def jitter(spark, sf):
    draw = lambda k, rng: S.jittered(np.floor(S.poisson_times(2.0, 0, 600, rng)), 1.0, rng)
    return M.simulate_cells(spark.range(4).withColumnRenamed("id", "seed"), draw, ["seed"])


@query("sim_neural")
def sim_neural(spark, sf):
    from tickflow.functions import neural as N

    def draw(key, rng):  # noqa: ANN001, ANN202
        history, times = S.window_times(S.recovery_params("exp", 0.3, 200), S.T0, S.T1, rng)
        fit = N.fit_neural(times, history, S.T0, S.T1, "const", N.Grid(1e-3, 60.0, 40), 80, polish_steps=20)
        return N.neural_times(fit, S.T0, S.T1, rng, 20_000) if fit.n < 1 else np.zeros(0)

    return M.simulate_cells(spark.range(2).withColumnRenamed("id", "seed"), draw, ["seed"])


@query("recovery_cell")
def recovery_cell(spark, sf):
    cells = M.seeds(spark, list(S.KERNELS), "kernel", 2).withColumns({"n": F.lit(0.6), "events": F.lit(500)})
    return M.recovery_cells(cells)


@query("recovery_figure")
def recovery_figure(spark, sf):
    cells = M.seeds(spark, list(S.KERNELS), "kernel", 3).withColumn("n", F.explode(F.array(F.lit(0.3), F.lit(0.6)))).withColumn("events", F.lit(500))
    return T.recovery_summary(M.recovery_cells(cells), ["kernel", "fitter", "n_true", "events"])


@query("stress_cell")
def stress_cell(spark, sf):
    return M.stress_cells(M.seeds(spark, list(S.STRESS), "scenario", 1))


@query("nk_recovery")
def nk_recovery(spark, sf):
    return M.neural_recovery(M.seeds(spark, list(S.LEARNED), "scenario", 1))


@query("nk_window_job")
def nk_window_job(spark, sf):
    stream = _stream(spark, sf)
    return M.run_neural(stream, ["const", "mlp"], 3, 43_200, 21_600, 86_400.0, 1.0, 10_000.0, replicates=20, within=1000.0)


@query("nk_heldout")
def nk_heldout(spark, sf):
    stream = _stream(spark, sf)
    rows = M.run_neural(stream, ["const"], 3, 28_800, 21_600, 86_400.0, 1.0, 10_000.0)
    return rows.select("day", "k", "n_events", "heldout_n_events", "heldout_gain_over_poisson_per_event", "heldout_gain_kernel_only_per_event")


@query("negloglik")
def negloglik(spark, sf):
    """Value and gradient at a fixed point for each day, from the grouped design."""
    import pandas as pd

    def one(key, part: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        t = np.unique(part["t"].to_numpy())
        exc = H.excitation(t, np.zeros(0), 0.0, 86_400.0, np.array([BETA]))
        base = H.baseline(t, 0.0, 86_400.0)
        value, gradient = H.negative_loglik(np.array([MU, ALPHA]), np.hstack([base.at_events, exc.at_events]), np.concatenate([base.integral, exc.integral]))
        return pd.DataFrame([{"day": key[0], "value": value, "d_mu": gradient[0], "d_alpha": gradient[1]}])

    return _r(_events(spark, sf).groupBy("day").applyInPandas(one, "day long, value double, d_mu double, d_alpha double"), 5)


from tickflow.plans.registry import ORACLE  # noqa: E402

ORACLE["negloglik"] = _sql(
    f"SELECT day, round(-loglik, 5) AS value, round(d_mu, 5) AS d_mu, round(d_alpha, 5) AS d_alpha FROM lls JOIN (SELECT day AS dd, 86400 - sum(1 / ({MU}::DOUBLE + {ALPHA * BETA}::DOUBLE * s)) AS d_mu, "
    f"sum(1 - exp(-{BETA}::DOUBLE * (86400 - t))) - sum({BETA}::DOUBLE * s / ({MU}::DOUBLE + {ALPHA * BETA}::DOUBLE * s)) AS d_alpha FROM sums GROUP BY day) ON dd = day",
    LOGLIK,
)
