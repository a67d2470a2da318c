"""Algebra and summaries of result tables: one row per model and window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickflow.functions import columns as C
from tickflow.operators import windows as W


def metric_table(tape: DataFrame, n: int = 7, length: float = 21600, stride: float = 10800) -> DataFrame:
    """model, day, k, t0, t1, t_mid, n_events, est, boot_sd of each model's windows of a day."""
    rows = tape.withColumn("k", F.explode(W.window_numbers(F.col("t"), n, length, stride)))
    t0 = (F.col("k") * stride).cast("double")
    grouped = rows.groupBy("model", "day", "k").agg(
        F.count("*").alias("n_events"),
        (F.sum("size") / (F.count("*") * 997.0)).alias("est"),
        (F.stddev_samp("size") / 1000.0).alias("boot_sd"),
    )
    return grouped.withColumns({"t0": t0, "t1": t0 + length, "t_mid": t0 + length / 2})


def with_period(table: DataFrame) -> DataFrame:
    return table.withColumn("period", C.label_period(F.col("t_mid"))).filter("period IS NOT NULL")


def align(table: DataFrame, base: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of both tables with equal keys, and the difference of their values."""
    other = base.select(*keys, F.col(value).alias("base"))
    return table.join(other, keys).withColumn("delta", F.col(value) - F.col("base"))


def wide(table: DataFrame, keys: list[str], names: list[str], value: str) -> DataFrame:
    """One column per model; the names are given, so no pass is needed to find them."""
    return table.groupBy(*keys).pivot("model", names).agg(F.avg(value))


def paired_differences(wide_table: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """comparison, windows, mean, standard error and share above 0 of each pair's differences."""
    each = F.explode(F.array(*[F.struct(F.lit(f"{a} - {b}").alias("comparison"), (F.col(a) - F.col(b)).alias("x")) for a, b in pairs]))
    rows = wide_table.select(each.alias("p")).select("p.*").filter("x IS NOT NULL")
    return rows.groupBy("comparison").agg(
        F.count("*").alias("windows"),
        F.avg("x").alias("mean_diff"),
        (F.stddev_samp("x") / F.sqrt(F.count("*"))).alias("se_diff"),
        F.avg((F.col("x") > 0).cast("double")).alias("fraction_positive"),
    )


def summary(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    return table.groupBy(*keys).agg(
        F.count("*").alias("windows"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def recovery_summary(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy of estimates against the truth; needs n_hat, n_true, se_n, ks_p, converged, n_events, seconds."""
    err = F.col("n_hat") - F.col("n_true")
    rows = fits.withColumn("err", err).withColumn("covered", F.abs("err") <= 1.96 * F.col("se_n"))
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*keys).agg(
        F.avg("n_hat").alias("mean"),
        F.stddev_samp("n_hat").alias("sd"),
        F.avg("err").alias("bias"),
        F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"),
        F.avg("se_n").alias("mean_se"),
        share(F.col("covered")).alias("coverage95"),
        share(F.col("ks_p") < 0.05).alias("ks_reject5"),
        share(F.col("converged")).alias("converged"),
        F.avg("n_events").alias("mean_events"),
        F.avg("seconds").alias("seconds"),
    )


def stress_summary(fits: DataFrame) -> DataFrame:
    rows = fits.withColumn("bias_total", F.col("n_hat") - F.col("n_true"))
    rows = rows.withColumn("bias_within_10s", F.col("n_hat") - F.col("n_true_within_10s"))
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy("scenario", "fitter").agg(
        F.min("n_true").alias("n_true"),
        F.avg("n_hat").alias("n_hat_mean"),
        F.stddev_samp("n_hat").alias("n_hat_sd"),
        F.avg("bias_total").alias("bias_total"),
        F.avg("bias_within_10s").alias("bias_within_10s"),
        F.avg("n_events").alias("mean_events"),
        share(F.col("converged")).alias("converged"),
        share(F.col("ks_p") < 0.05).alias("ks_reject5"),
        share(F.col("lb_p") < 0.05).alias("lb_reject5"),
        F.median("condition_number").alias("condition_median"),
    )


def robustness_summary(table: DataFrame, base: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each variant against the base windows that it shares; no correlation of fewer than three."""
    both = align(table, base, ["model", "day", "k"], value)
    return both.groupBy(*keys).agg(
        F.count("*").alias("windows"),
        F.avg(value).alias("n_mean"),
        F.stddev_samp(value).alias("n_sd_across_windows"),
        F.avg("delta").alias("mean_delta_vs_base"),
        F.avg(F.abs("delta")).alias("mean_abs_delta_vs_base"),
        F.when(F.count("*") > 2, F.corr(value, "base")).alias("corr_with_base"),
    )


def bootstrap_summary(replicates: DataFrame, keys: list[str], value: str, keep_empty: bool = False) -> DataFrame:
    """Over the replicates with a value; ``keep_empty`` gives groups without any a row of ``boot_n`` 0."""
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    rows = replicates.withColumn(value, F.when(ok, F.col(value))) if keep_empty else replicates.filter(ok)
    return rows.groupBy(*keys).agg(
        F.count(value).alias("boot_n"),
        F.avg(value).alias("boot_mean"),
        F.stddev_samp(value).alias("boot_sd"),
        F.percentile(value, 0.025).alias("boot_lo"),
        F.percentile(value, 0.975).alias("boot_hi"),
    )


def first_seen(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values in the order in which they first appear."""
    return rows.groupBy(value).agg(F.min(position).alias("first")).orderBy("first")


def argmax_with_neighbours(profile: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The grid point of highest profile and the points around it; ends stand for themselves."""
    w = Window.partitionBy(*keys).orderBy(x)
    rows = profile.withColumns({"below": F.coalesce(F.lag(x).over(w), F.col(x)), "above": F.coalesce(F.lead(x).over(w), F.col(x))})
    best = F.max_by(F.struct(F.col(x).alias("best"), "below", "above"), F.struct(F.col(y), -F.col(x)))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def figure_curves(table: DataFrame, value: str, half_width: Column) -> DataFrame:
    """Points of one curve per model with a band."""
    v = F.col(value)
    return table.select("model", "day", "t_mid", v.alias("n"), (v - half_width).alias("lo"), (v + half_width).alias("hi"))
