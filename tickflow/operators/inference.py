"""Comparisons of periods: statistics by aggregation, probabilities by numpy on small groups."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickflow.functions import columns as C
from tickflow.functions import probability as P


def period_stats(table: DataFrame) -> DataFrame:
    return table.groupBy("model", "period").agg(
        F.count("*").alias("windows"),
        F.avg("est").alias("n_mean"),
        F.stddev_samp("est").alias("n_sd"),
        F.min("est").alias("n_min"),
        F.max("est").alias("n_max"),
        F.avg("boot_sd").alias("boot_sd_mean"),
    )


def pair_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.COMPARISONS, "a string, b string")


def compared(spark: SparkSession, table: DataFrame) -> DataFrame:
    """Each row of ``table`` once for every comparison (a, b) that its period is in: a join on equal periods."""
    sides = pair_list(spark).select("a", "b", F.explode(F.array("a", "b")).alias("period"))
    return table.join(F.broadcast(sides), "period")


def paired(spark: SparkSession, stats: DataFrame, count: str = "windows") -> DataFrame:
    """Each comparison of a model whose two periods have two windows or more; columns end in _a and _b."""
    side = lambda s: stats.select("model", F.col("period").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in stats.columns if c not in ("model", "period")])
    rows = side("a").join(F.broadcast(pair_list(spark)), "a").join(side("b"), ["model", "b"])
    rows = rows.filter((F.col(f"{count}_a") >= 2) & (F.col(f"{count}_b") >= 2))
    return rows.withColumn("comparison", F.concat_ws(" - ", "a", "b"))


def welch(pairs: DataFrame) -> DataFrame:
    """Difference of means, Welch's t and its degrees of freedom."""
    va = F.col("n_sd_a") * F.col("n_sd_a") / F.col("windows_a")
    vb = F.col("n_sd_b") * F.col("n_sd_b") / F.col("windows_b")
    return pairs.withColumns(
        {
            "diff": F.col("n_mean_a") - F.col("n_mean_b"),
            "welch_t": (F.col("n_mean_a") - F.col("n_mean_b")) / F.sqrt(va + vb),
            "welch_df": (va + vb) * (va + vb) / (va * va / (F.col("windows_a") - 1) + vb * vb / (F.col("windows_b") - 1)),
        }
    )


def perm_floor(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("perm_p_floor", 2.0 / C.comb(F.col("windows_a") + F.col("windows_b"), F.col("windows_a")))


def mann_whitney(spark: SparkSession, table: DataFrame) -> DataFrame:
    """U of the first period of each comparison, ties counted half, from ranks within the two."""
    both = compared(spark, table)
    key = ["model", "a", "b"]
    order = Window.partitionBy(*key).orderBy("est")
    same = Window.partitionBy(*key, "est")
    ranked = both.withColumn("mid_rank", F.rank().over(order) + (F.count("*").over(same) - 1) / 2)
    first = F.col("period") == F.col("a")
    out = ranked.groupBy(*key).agg(
        F.count_if(first).alias("windows_a"),
        F.count_if(~first).alias("windows_b"),
        F.sum(F.when(first, F.col("mid_rank"))).alias("rank_sum"),
    )
    out = out.filter("windows_a >= 2 AND windows_b >= 2")
    return out.withColumn("u", F.col("rank_sum") - F.col("windows_a") * (F.col("windows_a") + 1) / 2)


def weighted_z(spark: SparkSession, table: DataFrame) -> DataFrame:
    """Inverse-variance weighted difference and its z, where every window has a deviation."""
    w = 1 / (F.col("boot_sd") * F.col("boot_sd"))
    stats = table.groupBy("model", "period").agg(
        F.count("*").alias("windows"), F.count("boot_sd").alias("known"), F.sum(w).alias("w"), F.sum(w * F.col("est")).alias("wx")
    )
    rows = paired(spark, stats).filter("windows_a = known_a AND windows_b = known_b")
    diff = F.col("wx_a") / F.col("w_a") - F.col("wx_b") / F.col("w_b")
    return rows.withColumn("weighted_diff", diff).withColumn("weighted_z", diff / F.sqrt(1 / F.col("w_a") + 1 / F.col("w_b")))


def activity_residuals(table: DataFrame, least: int = 8) -> DataFrame:
    """Estimates less their line on the log event rate, per model with ``least`` windows or more."""
    x = F.log(F.col("n_events") / (F.col("t1") - F.col("t0")))
    rows = table.filter("n_events > 0").withColumn("x", x)
    line = rows.groupBy("model").agg(
        F.count("*").alias("n"), F.regr_slope("est", "x").alias("slope"), F.regr_intercept("est", "x").alias("intercept"), F.corr("x", "est").alias("corr")
    )
    rows = rows.join(line.filter(F.col("n") >= least), "model")
    return rows.withColumn("residual", F.col("est") - (F.col("slope") * F.col("x") + F.col("intercept")))


def activity_control(spark: SparkSession, table: DataFrame) -> DataFrame:
    """Differences of periods, raw over all windows, and adjusted for activity over those with events."""
    residuals = activity_residuals(table)
    raw = table.groupBy("model", "period").agg(F.avg("est").alias("raw"))
    stats = residuals.groupBy("model", "period").agg(
        F.count("*").alias("windows"),
        F.avg("residual").alias("n_mean"),
        F.stddev_samp("residual").alias("n_sd"),
        F.min("slope").alias("slope"),
        F.min("corr").alias("corr"),
    )
    rows = welch(paired(spark, stats.join(raw, ["model", "period"])))
    return rows.select(
        "model",
        "comparison",
        F.col("corr_a").alias("corr_n_lograte"),
        F.col("slope_a").alias("slope"),
        (F.col("raw_a") - F.col("raw_b")).alias("raw_diff"),
        F.col("diff").alias("activity_adjusted_diff"),
        "welch_t",
        "welch_df",
    )


def activity_tests(spark: SparkSession, table: DataFrame, seed: int = 20210128) -> DataFrame:
    """The tests of every comparison on the adjusted estimates."""
    adjusted = activity_residuals(table).withColumn("est", F.col("residual"))
    return period_tests(spark, adjusted, seed).select("model", "comparison", "diff", "welch_p", "perm_p")


def permutation_p(x: np.ndarray, y: np.ndarray, seed: list[int], draws: int = 20_000, exact_up_to: int = 0) -> float:
    """Two-sided label permutation by seeded draws, (c + 1) / (n + 1); all splits where there are at most ``exact_up_to``."""
    pooled = np.concatenate([x, y])
    n, k, total = len(pooled), len(x), pooled.sum()
    observed = abs(x.mean() - y.mean()) - 1e-12
    if comb(n, k) <= exact_up_to:
        sums = np.array([pooled[list(c)].sum() for c in combinations(range(n), k)])
        return float(np.mean(abs(sums / k - (total - sums) / (n - k)) >= observed))
    rng, hits = np.random.default_rng(seed), 0
    at_once = max(1, min(1000, 2_000_000 // n))  # the draws are the same however many are held at once
    for lo in range(0, draws, at_once):
        order = rng.random((min(at_once, draws - lo), n)).argsort(1)[:, :k]
        sums = pooled[order].sum(1)
        hits += int((abs(sums / k - (total - sums) / (n - k)) >= observed).sum())
    return (hits + 1) / (draws + 1)


def period_tests(spark: SparkSession, table: DataFrame, seed: int = 20210128, exact_up_to: int = 0) -> DataFrame:
    """Every test of every comparison; one group per model and comparison, seeded by its name."""
    both = compared(spark, table)

    def test(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        model, a, b = key
        rows = rows.sort_values(["day", "k"])
        x, y = (rows.loc[rows.period == p, "est"].to_numpy() for p in (a, b))
        if len(x) < 2 or len(y) < 2:
            return pd.DataFrame()
        t, df = P.welch(x, y)
        name = [seed, *f"{model}|{a}|{b}".encode()]
        return pd.DataFrame(
            [
                {
                    "model": model,
                    "comparison": f"{a} - {b}",
                    "windows_a": len(x),
                    "windows_b": len(y),
                    "diff": x.mean() - y.mean(),
                    "welch_t": t,
                    "welch_p": P.student_t_two_sided(t, df),
                    "perm_p": permutation_p(x, y, name, exact_up_to=exact_up_to),
                    "perm_p_floor": 2 / comb(len(x) + len(y), len(x)),
                    "mannwhitney_p": P.mann_whitney_p(x, y),
                }
            ]
        )

    schema = (
        "model string, comparison string, windows_a long, windows_b long, diff double, welch_t double, welch_p double,"
        " perm_p double, perm_p_floor double, mannwhitney_p double"
    )
    return both.groupBy("model", "a", "b").applyInPandas(test, schema)


def sign_table(tests: DataFrame) -> DataFrame:
    return tests.select("source", "model", "comparison", "diff", F.signum("diff").cast("long").alias("sign"))


def sign_sets(signs: DataFrame) -> DataFrame:
    return signs.groupBy("comparison").agg(F.array_join(F.array_sort(F.collect_set("sign")), ",").alias("signs"))


def underpowered(tests: DataFrame, level: float = 0.05) -> DataFrame:
    return tests.filter(F.col("perm_p_floor") > level).select("comparison", "windows_a", "windows_b").distinct()
