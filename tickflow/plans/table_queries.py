"""Queries of the result-table operators over per-window metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from tickflow.functions import columns as C
from tickflow.operators import inference as I
from tickflow.operators import tables as T
from tickflow.operators import windows as W
from tickflow.plans.registry import query, sql
from tickflow.sources import tape as P
from tickflow.sources.stage import staging

MODELS = ["click", "error", "purchase", "signup", "view"]


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _metric(spark, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    tape = P.tape_from_events(events).join(events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("model")), "seq")
    return T.metric_table(tape.withColumn("t", C.seconds_of_day(F.col("raw_ns"), F.col("day"))))


def _period(spark, sf: str) -> DataFrame:
    return T.with_period(_metric(spark, sf))


@query("metric_table", sql("tape", "metric", body="SELECT model, day, k, t0, t1, t_mid, n_events, round(est, 6) AS est, round(boot_sd, 6) AS boot_sd FROM metric"))
def metric_table(spark, sf):
    return _r(_metric(spark, sf))


@query("edge_flag", sql("tape", "metric", body="SELECT model, day, k, t0 < 900 OR t1 > 85500 AS edge_window FROM metric"))
def edge_flag(spark, sf):
    return _metric(spark, sf).select("model", "day", "k", C.edge_window(F.col("t0"), F.col("t1"), 0, 86400, 900).alias("edge_window"))


@query("label_period", sql("tape", "metric", "period", body="SELECT model, day, k, period FROM period"))
def label_period(spark, sf):
    return _period(spark, sf).select("model", "day", "k", "period")


@query("non_overlap", sql("tape", "metric", body="SELECT model, day, k FROM (SELECT *, t0 - min(t0) OVER (PARTITION BY model, day) AS off FROM metric) WHERE off % 21600 = 0"))
def non_overlap(spark, sf):
    return W.non_overlapping(_metric(spark, sf), ["model", "day"]).select("model", "day", "k")


@query("anchor_min", sql("tape", "metric", body="SELECT model, day, k, min(t0) OVER (PARTITION BY model, day, t1 - t0) AS anchor FROM metric"))
def anchor_min(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("model", "day", F.round(F.col("t1") - F.col("t0"), 6))
    return _metric(spark, sf).select("model", "day", "k", F.min("t0").over(w).alias("anchor"))


@query("derive_err", sql("tape", "metric", body="SELECT model, day, k, round(est - 0.25e0, 6) AS err, abs(est - 0.25e0) <= 1.96e0 * boot_sd AS covered FROM metric"))
def derive_err(spark, sf):
    err = F.col("est") - 0.25
    return _r(_metric(spark, sf).select("model", "day", "k", err.alias("err"), (F.abs(err) <= 1.96 * F.col("boot_sd")).alias("covered")))


@query("derive_bias", sql("tape", "metric", body="SELECT model, day, k, round(est - 0.3e0, 6) AS bias_total, round(est - 0.3e0 * (1 - exp(-t0 / 1e5)), 6) AS bias_within FROM metric"))
def derive_bias(spark, sf):
    est = F.col("est")
    return _r(_metric(spark, sf).select("model", "day", "k", (est - 0.3).alias("bias_total"), (est - 0.3 * (1 - F.exp(-F.col("t0") / 1e5))).alias("bias_within")))


@query("relabel", sql("tape", "metric", body="SELECT DISTINCT replace(model || '_1ms', '_1ms', '') AS base, model || '[round_1s]' AS variant, 'neural_' || model AS neural FROM metric"))
def relabel(spark, sf):
    tagged = F.concat("model", F.lit("_1ms"))
    return _metric(spark, sf).select(
        F.regexp_replace(tagged, "_1ms$", "").alias("base"), F.concat("model", F.lit("[round_1s]")).alias("variant"), F.concat(F.lit("neural_"), "model").alias("neural")
    ).distinct()


@query("str_pred", "SELECT count(*) FILTER (n_name LIKE 'N%') AS starts, count(*) FILTER (n_name LIKE '%1%') AS holds, count(*) FILTER (n_name IN ('NATION_1', 'NATION_7', 'x')) AS listed FROM nation")
def str_pred(spark, sf):
    n = F.col("n_name")
    return spark.read.parquet(f"{sf}/nation.parquet").agg(
        F.count_if(n.startswith("N")).alias("starts"), F.count_if(n.contains("1")).alias("holds"), F.count_if(n.isin("NATION_1", "NATION_7", "x")).alias("listed")
    )


@query("fuzzy_lookup", sql("tape", "metric", body="SELECT model, day, k FROM metric WHERE abs(t_mid - 43200.0000001e0) < 1e-3"))
def fuzzy_lookup(spark, sf):
    return _metric(spark, sf).filter(F.abs(F.col("t_mid") - 43200.0000001) < 1e-3).select("model", "day", "k")


@query("scan_results", sql("tape", "metric", body="SELECT model || '_w21600' AS source, count(*) AS n, sum(n_events)::BIGINT AS events FROM metric GROUP BY model"))
def scan_results(spark, sf):
    """Result files of each model, written as CSV and read back, each row tagged with its file."""
    table = _metric(spark, sf).select("model", "day", "k", "n_events", "est")
    where = staging(spark)
    schema = T_.StructType([f for f in table.schema if f.name != "model"])
    for model in ("click", "error", "purchase", "signup", "view"):
        P.write_csv(table.filter(F.col("model") == model).drop("model"), f"{where}/{model}_w21600")
    rows = P.read_results(spark, f"{where}/*_w21600", schema)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_events").alias("events"))


# Joins and set operations.


@query("align_base", sql("tape", "metric", body="SELECT v.day, v.k, round(v.est - b.est, 6) AS delta FROM metric v JOIN metric b ON v.day = b.day AND v.k = b.k WHERE v.model = 'click' AND b.model = 'view'"))
def align_base(spark, sf):
    m = _metric(spark, sf)
    both = T.align(m.filter("model = 'click'").select("day", "k", "est"), m.filter("model = 'view'"), ["day", "k"], "est")
    return _r(both.select("day", "k", "delta"))


PIVOT = "wide AS (SELECT day, k, avg(est) FILTER (model = 'click') AS click, avg(est) FILTER (model = 'view') AS view, avg(est) FILTER (model = 'error') AS error FROM metric GROUP BY day, k)"


@query("pivot_align", sql("tape", "metric", body=f", {PIVOT} SELECT day, k, round(click, 6) AS click, round(error, 6) AS error, round(view, 6) AS view FROM wide"))
def pivot_align(spark, sf):
    return _r(T.wide(_metric(spark, sf), ["day", "k"], ["click", "error", "view"], "est"))


@query(
    "heldout_summary",
    sql(
        "tape", "metric",
        body=f", {PIVOT}, d AS (SELECT 'click - view' AS comparison, click - view AS x FROM wide UNION ALL SELECT 'error - click', error - click FROM wide) "
        "SELECT comparison, count(*) AS windows, round(avg(x), 6) AS mean_diff, round(stddev_samp(x) / sqrt(count(*)), 6) AS se_diff, round(avg((x > 0)::INT), 6) AS fraction_positive "
        "FROM d WHERE x IS NOT NULL GROUP BY comparison",
    ),
)
def heldout_summary(spark, sf):
    wide = T.wide(_metric(spark, sf), ["day", "k"], ["click", "error", "view"], "est")
    return _r(T.paired_differences(wide, [("click", "view"), ("error", "click")]))


@query("resume_anti", sql("tape", "metric", body="SELECT model, day, k FROM metric m WHERE NOT EXISTS (SELECT 1 FROM metric d WHERE d.model = m.model AND d.day = m.day AND d.k = m.k AND d.n_events > 15)"))
def resume_anti(spark, sf):
    m = _metric(spark, sf).select("model", "day", "k", "n_events")
    return m.join(m.filter("n_events > 15"), ["model", "day", "k"], "left_anti").select("model", "day", "k")


@query("cell_product", "SELECT kernel, n, events, seed FROM (VALUES ('exp'), ('mixture'), ('exp_offgrid')) a(kernel), (VALUES (0.3e0), (0.6e0), (0.9e0)) b(n), (VALUES (500), (2000), (5000)) c(events), range(50) s(seed)")
def cell_product(spark, sf):
    one = lambda name, kind, values: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    cells = one("kernel", "string", ["exp", "mixture", "exp_offgrid"]).crossJoin(one("n", "double", [0.3, 0.6, 0.9]))
    return cells.crossJoin(one("events", "int", [500, 2000, 5000])).crossJoin(spark.range(50).withColumnRenamed("id", "seed"))


STATS = "stats AS (SELECT model, period, count(*) AS windows, avg(est) AS n_mean, stddev_samp(est) AS n_sd, min(est) AS n_min, max(est) AS n_max, avg(boot_sd) AS boot_sd_mean FROM period GROUP BY model, period)"
JOINED = "both_sides AS (SELECT x.model, p.a || ' - ' || p.b AS comparison, x.windows AS wa, y.windows AS wb, x.n_mean AS ma, y.n_mean AS mb, x.n_sd * x.n_sd / x.windows AS va, y.n_sd * y.n_sd / y.windows AS vb FROM pairs p JOIN stats x ON x.period = p.a JOIN stats y ON y.model = x.model AND y.period = p.b WHERE x.windows >= 2 AND y.windows >= 2)"


def _stats_sql(body: str) -> str:
    return sql("tape", "metric", "period", "pairs", body=f", {STATS}, {JOINED} {body}")


@query("period_stats", _stats_sql("SELECT model, period, windows, round(n_mean, 6) AS n_mean, round(n_sd, 6) AS n_sd, round(n_min, 6) AS n_min, round(n_max, 6) AS n_max, round(boot_sd_mean, 6) AS boot_sd_mean FROM stats"))
def period_stats(spark, sf):
    return _r(I.period_stats(_period(spark, sf)))


@query("period_pairs", _stats_sql("SELECT model, comparison, wa AS windows_a, wb AS windows_b FROM both_sides"))
def period_pairs(spark, sf):
    return I.paired(spark, I.period_stats(_period(spark, sf))).select("model", "comparison", "windows_a", "windows_b")


@query("union_by_name", sql("tape", "metric", body="SELECT model, day, k, n_events, NULL::DOUBLE AS est FROM metric WHERE model = 'click' UNION ALL SELECT model, day, k, NULL, round(est, 6) FROM metric WHERE model = 'view'"))
def union_by_name(spark, sf):
    m = _metric(spark, sf)
    a = m.filter("model = 'click'").select("model", "day", "k", "n_events")
    return _r(a.unionByName(m.filter("model = 'view'").select("model", "day", "k", "est"), allowMissingColumns=True))


@query("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_linestatus").distinct()


@query("intersect", sql("tape", "metric", body="SELECT day, k FROM metric WHERE model = 'click' INTERSECT SELECT day, k FROM metric WHERE model = 'error' AND n_events > 10"))
def intersect(spark, sf):
    m = _metric(spark, sf)
    return m.filter("model = 'click'").select("day", "k").intersect(m.filter("model = 'error' AND n_events > 10").select("day", "k"))


@query("ordered_dedupe", "SELECT o_orderpriority AS value, min(o_orderkey) AS first FROM orders GROUP BY 1 ORDER BY 2")
def ordered_dedupe(spark, sf):
    rows = T.first_seen(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderpriority", "o_orderkey")
    return rows.select(F.col("o_orderpriority").alias("value"), "first")


@query("sort", sql("tape", "metric", body="SELECT model, day, k, n_events FROM metric ORDER BY model, day, k"))
def sort(spark, sf):
    return _metric(spark, sf).select("model", "day", "k", "n_events").orderBy("model", "day", "k")


@query("first_only", sql("tape", "metric", body="SELECT model, day, k, n_events FROM metric ORDER BY n_events DESC, model, day, k LIMIT 1"))
def first_only(spark, sf):
    return _metric(spark, sf).select("model", "day", "k", "n_events").orderBy(F.desc("n_events"), "model", "day", "k").limit(1)


@query(
    "profile_argmax",
    sql("tape", "metric", body="SELECT model, day, t0 AS best, below, above FROM (SELECT *, coalesce(lag(t0) OVER w, t0) AS below, coalesce(lead(t0) OVER w, t0) AS above FROM metric WINDOW w AS (PARTITION BY model, day ORDER BY t0)) QUALIFY row_number() OVER (PARTITION BY model, day ORDER BY n_events DESC, t0) = 1"),
)
def profile_argmax(spark, sf):
    return T.argmax_with_neighbours(_metric(spark, sf), ["model", "day"], "t0", "n_events")


# Summaries.


@query("rolling_summary", sql("tape", "metric", body="SELECT model, count(*) AS windows, round(avg(est), 6) AS mean, round(stddev_samp(est), 6) AS sd, round(min(est), 6) AS min, round(max(est), 6) AS max FROM metric GROUP BY model"))
def rolling_summary(spark, sf):
    return _r(T.summary(_metric(spark, sf), ["model"], "est"))


FITS = "fits AS (SELECT model AS kernel, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS fitter, est AS n_hat, 0.25e0 AS n_true, boot_sd AS se_n, t0 / 86400e0 AS ks_p, n_events > 12 AS converged, n_events, n_events / 1e3 AS seconds, (k + 1) / 7e0 AS lb_p, est * 100 AS condition_number FROM metric WHERE boot_sd IS NOT NULL)"


def _fits(spark, sf: str) -> DataFrame:
    m = _metric(spark, sf).filter("boot_sd IS NOT NULL")
    return m.select(
        F.col("model").alias("kernel"), F.when(F.col("k") % 2 == 0, "even").otherwise("odd").alias("fitter"), F.col("est").alias("n_hat"), F.lit(0.25).alias("n_true"),
        F.col("boot_sd").alias("se_n"), (F.col("t0") / 86400).alias("ks_p"), (F.col("n_events") > 12).alias("converged"), "n_events", (F.col("n_events") / 1000).alias("seconds"),
        ((F.col("k") + 1) / 7).alias("lb_p"), (F.col("est") * 100).alias("condition_number"),
    )


@query(
    "recovery_summary",
    sql(
        "tape", "metric",
        body=f", {FITS} SELECT kernel, fitter, n_true, round(avg(n_hat), 6) AS mean, round(stddev_samp(n_hat), 6) AS sd, round(avg(n_hat - n_true), 6) AS bias, round(sqrt(avg((n_hat - n_true) * (n_hat - n_true))), 6) AS rmse, "
        "round(avg(se_n), 6) AS mean_se, round(avg((abs(n_hat - n_true) <= 1.96e0 * se_n)::INT), 6) AS coverage95, round(avg((ks_p < 0.05e0)::INT), 6) AS ks_reject5, round(avg(converged::INT), 6) AS converged, "
        "round(avg(n_events), 6) AS mean_events, round(avg(seconds), 6) AS seconds FROM fits GROUP BY kernel, fitter, n_true",
    ),
)
def recovery_summary(spark, sf):
    return _r(T.recovery_summary(_fits(spark, sf), ["kernel", "fitter", "n_true"]))


@query(
    "stress_summary",
    sql(
        "tape", "metric",
        body=f", {FITS} SELECT kernel AS scenario, fitter, min(n_true) AS n_true, round(avg(n_hat), 6) AS n_hat_mean, round(stddev_samp(n_hat), 6) AS n_hat_sd, round(avg(n_hat - n_true), 6) AS bias_total, "
        "round(avg(n_hat - n_true * 0.9e0), 6) AS bias_within_10s, round(avg(n_events), 6) AS mean_events, round(avg(converged::INT), 6) AS converged, round(avg((ks_p < 0.05e0)::INT), 6) AS ks_reject5, "
        "round(avg((lb_p < 0.05e0)::INT), 6) AS lb_reject5, round(median(condition_number), 6) AS condition_median FROM fits GROUP BY kernel, fitter",
    ),
)
def stress_summary(spark, sf):
    fits = _fits(spark, sf).withColumnRenamed("kernel", "scenario").withColumn("n_true_within_10s", F.col("n_true") * 0.9)
    return _r(T.stress_summary(fits))


@query(
    "robustness_summary",
    sql(
        "tape", "metric",
        body=", v AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'merge' ELSE 'round' END AS family FROM metric WHERE n_events > 5) SELECT v.family, v.model, count(*) AS windows, round(avg(v.n_events / 1e2), 6) AS n_mean, round(stddev_samp(v.n_events / 1e2), 6) AS n_sd_across_windows, "
        "round(avg(v.n_events / 1e2 - b.est), 6) AS mean_delta_vs_base, round(avg(abs(v.n_events / 1e2 - b.est)), 6) AS mean_abs_delta_vs_base, round(CASE WHEN count(*) > 2 THEN corr(v.n_events / 1e2, b.est) END, 6) AS corr_with_base "
        "FROM v JOIN metric b ON v.model = b.model AND v.day = b.day AND v.k = b.k GROUP BY v.family, v.model",
    ),
)
def robustness_summary(spark, sf):
    m = _metric(spark, sf)
    variant = m.filter("n_events > 5").select(F.when(F.col("k") % 2 == 0, "merge").otherwise("round").alias("family"), "model", "day", "k", (F.col("n_events") / 100).alias("x"))
    base = m.select("model", "day", "k", F.col("est").alias("x"))
    return _r(T.robustness_summary(variant, base, ["family", "model"], "x"))


@query("neural_summaries", sql("tape", "metric", body=", f AS (SELECT model, est, n_events FROM metric) SELECT model, round(avg(est), 6) AS mean, round(stddev_samp(est), 6) AS sd, round(avg(est - 0.25e0), 6) AS bias, round(avg((n_events > 12)::INT), 6) AS converged FROM f GROUP BY model"))
def neural_summaries(spark, sf):
    return _r(_metric(spark, sf).groupBy("model").agg(F.avg("est").alias("mean"), F.stddev_samp("est").alias("sd"), F.avg(F.col("est") - 0.25).alias("bias"), F.avg((F.col("n_events") > 12).cast("double")).alias("converged")))


@query("corr_ols", "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY l_returnflag")
def corr_ols(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag")
    return rows.agg(
        F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("r"),
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"),
        F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"),
    )


@query("invvar_mean", sql("tape", "metric", body="SELECT model, round(sum(est / (boot_sd * boot_sd)) / sum(1 / (boot_sd * boot_sd)), 6) AS mean, round(sqrt(1 / sum(1 / (boot_sd * boot_sd))), 6) AS se FROM metric WHERE boot_sd > 0 GROUP BY model"))
def invvar_mean(spark, sf):
    w = 1 / (F.col("boot_sd") * F.col("boot_sd"))
    return _r(_metric(spark, sf).filter("boot_sd > 0").groupBy("model").agg((F.sum(w * F.col("est")) / F.sum(w)).alias("mean"), F.sqrt(1 / F.sum(w)).alias("se")))


@query("bootstrap_summary", sql("tape", "metric", body="SELECT model, k, count(*) AS boot_n, round(avg(est), 6) AS boot_mean, round(stddev_samp(est), 6) AS boot_sd, round(quantile_cont(est, 0.025), 6) AS boot_lo, round(quantile_cont(est, 0.975), 6) AS boot_hi FROM metric GROUP BY model, k"))
def bootstrap_summary(spark, sf):
    return _r(T.bootstrap_summary(_metric(spark, sf), ["model", "k"], "est"))


@query("figure_curves", sql("tape", "metric", body="SELECT model, day, t_mid, round(est, 6) AS n, round(est - 1.96e0 * boot_sd, 6) AS lo, round(est + 1.96e0 * boot_sd, 6) AS hi FROM metric"))
def figure_curves(spark, sf):
    return _r(T.figure_curves(_metric(spark, sf), "est", 1.96 * F.col("boot_sd")))


@query("per_minute_figure", sql("tape", body="SELECT day, floor(t / 60)::BIGINT AS minute, count(*) AS n FROM tape GROUP BY ALL"))
def per_minute_figure(spark, sf):
    tape = P.read_tape(spark, sf)
    minute = F.floor(C.seconds_of_day(F.col("raw_ns"), F.col("day")) / 60)
    return tape.groupBy("day", minute.alias("minute")).agg(F.count("*").alias("n"))


# Inference.


@query("welch", _stats_sql("SELECT model, comparison, round(ma - mb, 6) AS diff, round((ma - mb) / sqrt(va + vb), 5) AS welch_t, round((va + vb) * (va + vb) / (va * va / (wa - 1) + vb * vb / (wb - 1)), 4) AS welch_df FROM both_sides"))
def welch(spark, sf):
    rows = I.welch(I.paired(spark, I.period_stats(_period(spark, sf))))
    return rows.select("model", "comparison", F.round("diff", 6).alias("diff"), F.round("welch_t", 5).alias("welch_t"), F.round("welch_df", 4).alias("welch_df"))


@query("perm_floor", _stats_sql("SELECT model, comparison, wa AS windows_a, wb AS windows_b, round(2e0 / exp(lgamma(wa + wb + 1) - lgamma(wa + 1) - lgamma(wb + 1)), 6) AS floor FROM both_sides"))
def perm_floor(spark, sf):
    rows = I.perm_floor(I.paired(spark, I.period_stats(_period(spark, sf))))
    return rows.select("model", "comparison", "windows_a", "windows_b", F.round("perm_p_floor", 6).alias("floor"))


@query(
    "mannwhitney",
    sql(
        "tape", "metric", "period", "pairs",
        body=", r AS (SELECT e.model, p.a, p.b, e.period = p.a AS first, rank() OVER (PARTITION BY e.model, p.a, p.b ORDER BY est) + (count(*) OVER (PARTITION BY e.model, p.a, p.b, est) - 1) / 2e0 AS mr FROM period e JOIN pairs p ON e.period IN (p.a, p.b)) "
        "SELECT model, a, b, count(*) FILTER (first) AS windows_a, count(*) FILTER (NOT first) AS windows_b, sum(mr) FILTER (first) - count(*) FILTER (first) * (count(*) FILTER (first) + 1) / 2e0 AS u FROM r GROUP BY model, a, b HAVING count(*) FILTER (first) >= 2 AND count(*) FILTER (NOT first) >= 2",
    ),
)
def mannwhitney(spark, sf):
    return I.mann_whitney(spark, _period(spark, sf)).select("model", "a", "b", "windows_a", "windows_b", "u")


@query(
    "weighted_z",
    sql(
        "tape", "metric", "period", "pairs",
        body=", s AS (SELECT model, period, count(*) AS n, count(boot_sd) AS c, sum(1 / (boot_sd * boot_sd)) AS w, sum(est / (boot_sd * boot_sd)) AS wx FROM period GROUP BY model, period) "
        "SELECT x.model, p.a || ' - ' || p.b AS comparison, round(x.wx / x.w - y.wx / y.w, 6) AS weighted_diff, round((x.wx / x.w - y.wx / y.w) / sqrt(1 / x.w + 1 / y.w), 5) AS weighted_z "
        "FROM pairs p JOIN s x ON x.period = p.a JOIN s y ON y.model = x.model AND y.period = p.b WHERE x.n >= 2 AND y.n >= 2 AND x.n = x.c AND y.n = y.c",
    ),
)
def weighted_z(spark, sf):
    rows = I.weighted_z(spark, _period(spark, sf).filter("boot_sd > 0 OR boot_sd IS NULL"))
    return rows.select("model", "comparison", F.round("weighted_diff", 6).alias("weighted_diff"), F.round("weighted_z", 5).alias("weighted_z"))


@query(
    "activity_control",
    sql(
        "tape", "metric", "period", "pairs",
        body=", x AS (SELECT *, ln(n_events / (t1 - t0)) AS lr FROM period WHERE n_events > 0), l AS (SELECT model, regr_slope(est, lr) AS slope, regr_intercept(est, lr) AS icept, corr(lr, est) AS c FROM x GROUP BY model HAVING count(*) >= 8), "
        "s AS (SELECT x.model, period, count(*) AS n, avg(est - (slope * lr + icept)) AS adj, var_samp(est - (slope * lr + icept)) AS v, min(slope) AS slope, min(c) AS c FROM x JOIN l ON l.model = x.model GROUP BY x.model, period), "
        "w AS (SELECT model, period, avg(est) AS raw FROM period GROUP BY model, period) "
        "SELECT a.model, p.a || ' - ' || p.b AS comparison, round(a.c, 5) AS corr_n_lograte, round(a.slope, 5) AS slope, round(wa.raw - wb.raw, 6) AS raw_diff, round(a.adj - b.adj, 6) AS activity_adjusted_diff, round((a.adj - b.adj) / sqrt(a.v / a.n + b.v / b.n), 5) AS welch_t "
        "FROM pairs p JOIN s a ON a.period = p.a JOIN s b ON b.model = a.model AND b.period = p.b JOIN w wa ON wa.model = a.model AND wa.period = p.a JOIN w wb ON wb.model = a.model AND wb.period = p.b WHERE a.n >= 2 AND b.n >= 2",
    ),
)
def activity_control(spark, sf):
    rows = I.activity_control(spark, _period(spark, sf))
    r = lambda c, d: F.round(c, d).alias(c)
    return rows.select("model", "comparison", r("corr_n_lograte", 5), r("slope", 5), r("raw_diff", 6), r("activity_adjusted_diff", 6), r("welch_t", 5))


@query("activity_tests")
def activity_tests(spark, sf):
    return I.activity_tests(spark, _period(spark, sf))


@query("period_figure", sql("tape", "metric", "period", body="SELECT model, period, day, k, round(t0 / 2 + t1 / 2, 3) AS t_mid, round(est, 6) AS est, round(boot_sd, 6) AS boot_sd, round(avg(est) OVER (PARTITION BY model, period), 6) AS period_mean FROM period"))
def period_figure(spark, sf):
    """The data of the plot of periods: every window, with its period's mean."""
    from pyspark.sql import Window

    mean = F.avg("est").over(Window.partitionBy("model", "period"))
    r = lambda c, d, name: F.round(c, d).alias(name)
    rows = _period(spark, sf)
    return rows.select("model", "period", "day", "k", r((F.col("t0") + F.col("t1")) / 2, 3, "t_mid"), r("est", 6, "est"), r("boot_sd", 6, "boot_sd"), r(mean, 6, "period_mean"))


@query("sign_table", _stats_sql("SELECT 'base' AS source, model, comparison, round(ma - mb, 6) AS diff, sign(ma - mb)::BIGINT AS sign FROM both_sides"))
def sign_table(spark, sf):
    rows = I.welch(I.paired(spark, I.period_stats(_period(spark, sf)))).withColumn("source", F.lit("base"))
    return _r(I.sign_table(rows))


@query("sign_set", _stats_sql("SELECT comparison, string_agg(DISTINCT sign(ma - mb)::INT::VARCHAR, ',' ORDER BY sign(ma - mb)::INT::VARCHAR) AS signs FROM both_sides GROUP BY comparison"))
def sign_set(spark, sf):
    rows = I.welch(I.paired(spark, I.period_stats(_period(spark, sf)))).withColumn("source", F.lit("base"))
    return I.sign_sets(I.sign_table(rows))


@query(
    "underpowered",
    sql(
        "tape", "metric", "period", "pairs",
        body=f", period1 AS (SELECT * FROM period WHERE day % 10 = 0 AND k % 2 = 0), {STATS.replace('FROM period', 'FROM period1')}, {JOINED} "
        "SELECT DISTINCT comparison, wa AS windows_a, wb AS windows_b FROM both_sides WHERE 2e0 / exp(lgamma(wa + wb + 1) - lgamma(wa + 1) - lgamma(wb + 1)) > 0.05",
    ),
)
def underpowered(spark, sf):
    """Comparisons that no permutation can call significant: here those of one day in ten, in windows that do not overlap."""
    few = _period(spark, sf).filter("day % 10 = 0 AND k % 2 = 0")
    return I.underpowered(I.perm_floor(I.paired(spark, I.period_stats(few)))).select("comparison", "windows_a", "windows_b")


@query("compare")
def compare(spark, sf):
    return I.period_tests(spark, _period(spark, sf))


@query("perm_test")
def perm_test(spark, sf):
    table = W.non_overlapping(_period(spark, sf), ["model", "day"])
    return I.period_tests(spark, table).select("model", "comparison", "windows_a", "windows_b", "perm_p", "perm_p_floor")


@query(
    "perm_test_exact",
    sql(
        "tape", "metric", "period", "pairs",
        body=", few AS (SELECT * FROM period WHERE day % 10 = 0 AND k % 2 = 0), "
        "sides AS (SELECT e.model, p.a, p.b, list(est ORDER BY e.period <> p.a, day, k) AS x, count(*) FILTER (e.period = p.a) AS na, count(*) FILTER (e.period = p.b) AS nb "
        "FROM few e JOIN pairs p ON e.period IN (p.a, p.b) GROUP BY e.model, p.a, p.b HAVING count(*) FILTER (e.period = p.a) >= 2 AND count(*) FILTER (e.period = p.b) >= 2), "
        "splits AS (SELECT model, a, b, x, na, nb, unnest(range(CAST(power(2, na + nb) AS BIGINT))) AS m FROM sides), "
        "sums AS (SELECT model, a, b, na, nb, m, list_sum(x) AS total, list_sum(list_transform(range(na + nb), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN x[i + 1] ELSE 0e0 END)) AS s "
        "FROM splits WHERE bit_count(m) = na), "
        "gaps AS (SELECT model, a, b, na, nb, abs(s / na - (total - s) / nb) AS gap, m = CAST(power(2, na) AS BIGINT) - 1 AS own FROM sums) "
        "SELECT model, a || ' - ' || b AS comparison, na AS windows_a, nb AS windows_b, round(avg((gap >= o - 1e-12)::INT), 6) AS perm_p "
        "FROM (SELECT *, max(gap) FILTER (own) OVER (PARTITION BY model, a, b) AS o FROM gaps) GROUP BY model, a, b, na, nb",
    ),
)
def perm_test_exact(spark, sf):
    """All splits of the windows of one day in ten that do not overlap; up to 200,000 splits are listed."""
    few = _period(spark, sf).filter("day % 10 = 0 AND k % 2 = 0")
    rows = I.period_tests(spark, few, exact_up_to=200_000)
    return rows.select("model", "comparison", "windows_a", "windows_b", F.round("perm_p", 6).alias("perm_p"))
