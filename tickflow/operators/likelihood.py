"""Likelihood terms at fixed parameters with window functions, per session.

A session is a day, or a day of an instrument where the stream has an ``instrument``.
The decay sum is ``exp(-b t_i) sum_{j < i} exp(b t_j)``, taken in blocks of a session and carried
over their ends (``operators.scan``), so any decay can run and a session uses many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickflow.operators import scan
from tickflow.operators.streams import session_keys

REACH = 300.0


def decay_sum(stream: DataFrame, beta: float, history: DataFrame | None = None) -> DataFrame:
    """``s``: the decayed weights of earlier events, those of ``history`` too; ``i``: how many are in the stream; ``carried``: the history's weight at 0.

    ``history``: the columns of the session, seq and t, with times below 0.
    """
    keys = session_keys(stream)
    rows = stream.withColumn("past", F.lit(False))
    if history is not None:
        rows = rows.unionByName(history.select(*keys, "seq", "t").withColumn("past", F.lit(True)), allowMissingColumns=True)
    rows = scan.faded_sums(rows, keys, ("t", "seq"), beta, REACH, "s")

    def counts(blocks: DataFrame, before: WindowSpec) -> DataFrame:
        """Rows before the block, without the history; and what the whole history weighs at 0."""
        every = Window.partitionBy(*keys)
        blocks = blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.sum("n_past").over(every))
        return blocks.withColumn("carried", F.coalesce(F.sum("weight").over(every), F.lit(0.0)))

    reduced = {"n": F.count("*"), "n_past": F.count_if("past"), "weight": F.sum(F.when(F.col("past"), F.exp(beta * F.col("t"))))}
    rows = scan.carry(rows, keys, reduced, counts, "offset", "carried")
    rows = rows.withColumn("i", F.col("offset") + F.row_number().over(scan.inside(keys, "t", "seq")) - 1)
    return rows.filter("NOT past").select(*stream.columns, "i", "s", "carried")


def intensity(rows: DataFrame, mu: float, alpha: float, beta: float) -> DataFrame:
    return rows.withColumn("rate", F.lit(mu) + alpha * beta * F.col("s"))


def compensator(rows: DataFrame, mu: float, alpha: float) -> DataFrame:
    """The compensator up to each event: the baseline's part and what earlier events have spent since 0."""
    return rows.withColumn("lambda_total", mu * F.col("t") + alpha * (F.col("i") + F.col("carried") - F.col("s")))


def window_loglik(stream: DataFrame, mu: float, alpha: float, beta: float, length: float = 86_400.0, history: DataFrame | None = None) -> DataFrame:
    rows = intensity(decay_sum(stream, beta, history), mu, alpha, beta)
    fade = F.lit(1 - math.exp(-beta * length))
    spent = F.sum(1 - F.exp(-beta * (length - F.col("t")))) + F.max("carried") * fade
    value = F.sum(F.log("rate")) - mu * length - alpha * spent
    return rows.groupBy(*session_keys(stream)).agg(F.count("*").alias("n_events"), value.alias("loglik"), spent.alias("integral"))


def poisson_loglik(counts: DataFrame, length: float) -> DataFrame:
    """At the window's own rate; null where there is no event."""
    n = F.col("n_events")
    return counts.withColumn("poisson", F.when(n > 0, n * F.log(n / length) - n))


def rescaled_intervals(stream: DataFrame, mu: float, alpha: float, beta: float) -> DataFrame:
    rows = scan.in_blocks(compensator(decay_sum(stream, beta), mu, alpha), "t", scan.SECONDS)
    rows = scan.previous(rows, session_keys(stream), ("t", "seq"), "lambda_total", "spent")
    return rows.withColumn("tau", F.col("lambda_total") - F.coalesce("spent", F.lit(0.0))).drop("block", "spent")


def ks_statistic(intervals: DataFrame) -> DataFrame:
    """Largest distance of the sorted intervals of each session from the unit exponential."""
    keys = session_keys(intervals)
    # Ranks by blocks of the distribution function, a hundredth each: a session's sort is spread over its blocks.
    rows = scan.in_blocks(intervals.select(*keys, "seq", "tau", (1 - F.exp(-F.col("tau"))).alias("cdf")), "cdf", 0.01)

    def counts(blocks: DataFrame, before: WindowSpec) -> DataFrame:
        blocks = blocks.withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0)))
        return blocks.withColumn("n", F.sum("m").over(Window.partitionBy(*keys)))

    rows = scan.carry(rows, keys, {"m": F.count("*")}, counts, "offset", "n")
    r = F.col("offset") + F.row_number().over(scan.inside(keys, "tau", "seq"))
    rows = rows.select(*keys, F.greatest(r / F.col("n") - F.col("cdf"), F.col("cdf") - (r - 1) / F.col("n")).alias("d"))
    return rows.groupBy(*keys).agg(F.max("d").alias("ks_stat"))


def autocorrelations(intervals: DataFrame, lags: int = 10) -> DataFrame:
    """The session's columns, n, lag, r."""
    keys = session_keys(intervals)
    order, whole = Window.partitionBy(*keys).orderBy("t", "seq"), Window.partitionBy(*keys)
    rows = intervals.withColumn("c", F.col("tau") - F.avg("tau").over(whole))
    products = [F.sum(F.col("c") * F.col(f"c{k}")) / F.sum(F.col("c") * F.col("c")) for k in range(1, lags + 1)]
    rows = rows.withColumns({f"c{k}": F.lag("c", k).over(order) for k in range(1, lags + 1)})
    wide = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*products).alias("r"))
    return wide.select(*keys, "n", F.posexplode("r").alias("pos", "r")).select(*keys, "n", (F.col("pos") + 1).cast("long").alias("lag"), "r")


def ljung_box(intervals: DataFrame, lags: int = 10) -> DataFrame:
    rows = autocorrelations(intervals, lags).filter(F.col("n") > lags)
    n = F.min("n")
    statistic = n * (n + 2) * F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("lag")))
    return rows.groupBy(*session_keys(intervals)).agg(statistic.alias("lb_stat"))


def dispersion(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy(*session_keys(intervals)).agg((F.sqrt(F.count("*") / 8) * (F.var_samp("tau") - 1)).alias("dispersion_z"))


def hat_basis(t: Column, t0: float, t1: float, pieces: int) -> Column:
    """The linear hats of a spline baseline at ``t``."""
    width = (t1 - t0) / pieces
    return F.transform(F.sequence(F.lit(0), F.lit(pieces)), lambda k: F.greatest(F.lit(0.0), 1 - F.abs((t - t0) / width - k)))


def kernel_value(s: Column, alphas: list[float], betas: list[float]) -> Column:
    return sum((a * b * F.exp(-b * s) for a, b in zip(alphas, betas, strict=True)), F.lit(0.0))


def cumulative_trapezoid(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``head``: the integral up to each row; ``tail``: from it to the end."""
    order = Window.partitionBy(*keys).orderBy(x)
    segment = F.coalesce(0.5 * (F.col(y) + F.lag(y).over(order)) * (F.col(x) - F.lag(x).over(order)), F.lit(0.0))
    rows = rows.withColumn("segment", segment)
    running = F.sum("segment").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"head": running, "tail": F.sum("segment").over(Window.partitionBy(*keys)) - running}).drop("segment")
