"""Rolling windows by arithmetic: an event lists the windows it belongs to, so no range join is planned."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tickflow.operators import scan
from tickflow.operators.streams import session_keys


def rolling_windows(spark: SparkSession, start: float, end: float, length: float, stride: float) -> DataFrame:
    """k, t0, t1, t_mid of the windows that fit; the last may end exactly at ``end``."""
    n = int((end - length - start) / stride + 1e-9) + 1 if end - length >= start else 0
    rows = spark.range(n).select(F.col("id").alias("k"), (F.lit(float(start)) + F.col("id") * stride).alias("t0"))
    return rows.withColumn("t1", F.col("t0") + length).withColumn("t_mid", F.col("t0") + length / 2)


def window_numbers(t: Column, n: int, length: float, stride: float, before: float = 0.0, after: float = 0.0) -> Column:
    """The windows k in [0, n) with ``k stride - before <= t < k stride + length + after``."""
    lo = F.greatest(F.floor((t - length - after) / stride) + 1, F.lit(0))
    hi = F.least(F.floor((t + before) / stride), F.lit(n - 1))
    return F.when(lo <= hi, F.sequence(lo, hi))


def assign(events: DataFrame, n: int, length: float, stride: float, before: float = 0.0, after: float = 0.0) -> DataFrame:
    """Each event once per window that it is in, precedes by up to ``before``, or follows by less than ``after``.

    Adds k, t0, t1 and ``role``: history, fit or next.
    """
    rows = events.withColumn("k", F.explode(window_numbers(F.col("t"), n, length, stride, before, after)))
    rows = rows.withColumn("t0", (F.col("k") * stride).cast("double")).withColumn("t1", F.col("t0") + length)
    role = F.when(F.col("t") < F.col("t0"), "history").when(F.col("t") < F.col("t1"), "fit").otherwise("next")
    return rows.withColumn("role", role)


def pane_windows(rows: DataFrame, n: int, length: int, stride: int, before: int, after: int, values: dict[str, Column]) -> DataFrame:
    """Aggregates of every window's history, fit and next, without a copy of any event.

    Window edges lie on a grid of panes, as wide as the greatest common divisor of all spans.  Events are reduced by
    pane, and only panes, one row each, are listed with their windows.  ``values`` are sums or counts; the result has
    the session's columns, k, t0, ``role`` and the values.  Windows without a pane in a role have no row for it.
    """
    keys = session_keys(rows)
    width = math.gcd(length, stride, before, after)
    panes = rows.groupBy(*keys, (F.floor(F.col("t") / width) * width).cast("double").alias("t")).agg(*[v.alias(k) for k, v in values.items()])
    listed = assign(panes, n, length, stride, before=before, after=after)
    return listed.groupBy(*keys, "k", "t0", "role").agg(*[F.sum(c).alias(c) for c in values])


def lag_pairs(events: DataFrame, support: float) -> DataFrame:
    """(session, seq_i, seq_j, lag) with ``0 < lag < support``: an equi-join on time buckets, not a range join."""
    bucket = F.floor(F.col("t") / support)
    keys = session_keys(events)
    late = events.select(*keys, F.col("seq").alias("seq_i"), F.col("t").alias("t_i"), F.explode(F.array(bucket, bucket - 1)).alias("b"))
    early = events.select(*keys, F.col("seq").alias("seq_j"), F.col("t").alias("t_j"), bucket.alias("b"))
    rows = late.join(early, [*keys, "b"]).withColumn("lag", F.col("t_i") - F.col("t_j"))
    return rows.filter((F.col("lag") > 0) & (F.col("lag") < support)).select(*keys, "seq_i", "seq_j", "lag")


def lag_sums(events: DataFrame, support: float) -> DataFrame:
    """(session, seq_i, pairs, total): the number and the sum of the lags that ``lag_pairs`` lists for each event, without a row for a pair.

    The earlier events within reach are those before the event less those up to ``support`` before it, so each event asks twice
    for a running count and a running sum of times, which ``operators.scan`` carries over blocks.  Times are summed as whole
    nanoseconds, so nothing is lost however many lags there are.  Events without a pair have no row.
    """
    keys = session_keys(events)
    rows = events.dropna(subset=[*keys, "t"]).select(*keys, "seq", "t")
    asks = F.array(F.struct(F.col("t").alias("x"), F.lit(0).alias("ends")), F.struct((F.col("t") - support).alias("x"), F.lit(1).alias("ends")))
    rows = rows.withColumn("ask", F.explode(asks)).select(*keys, "seq", "t", "ask.x", "ask.ends")
    rows = scan.in_blocks(rows, "x", scan.SECONDS)
    exact, event = "decimal(38,0)", F.col("ends") == 0
    start = F.col("block") * F.lit(scan.NANOSECONDS)
    whole = lambda c: F.round(F.col(c) * 1e9).cast("long")
    rows = rows.withColumn("into", F.when(event, whole("x") - start).otherwise(0))
    far = lambda n, into: n.cast(exact) * start.cast(exact) + into.cast(exact)

    def before(blocks: DataFrame, earlier: WindowSpec) -> DataFrame:
        blocks = blocks.withColumn("__n", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        return blocks.withColumn("__sum", F.coalesce(F.sum(far(F.col("n"), F.col("into"))).over(earlier), F.lit(0).cast(exact)))

    rows = scan.carry(rows, keys, {"n": F.count_if(event), "into": F.sum("into")}, before, "__n", "__sum")
    # An event's peers, of its own time, are not before it; those at the edge of its reach are not within it.
    upto = scan.inside(keys, "x", "ends").rangeBetween(Window.unboundedPreceding, 0)
    peers = F.when(event, F.count("*").over(Window.partitionBy(*keys, "block", "x", "ends"))).otherwise(0)
    rows = rows.withColumn("met", F.sum(F.when(event, 1).otherwise(0)).over(upto) - peers)
    rows = rows.withColumn("spent", F.sum("into").over(upto) - peers * F.col("into"))
    n = F.col("__n") + F.col("met")
    lags = n.cast(exact) * whole("t").cast(exact) - (F.col("__sum") + far(F.col("met"), F.col("spent")))
    found = rows.select(*keys, F.col("seq").alias("seq_i"), F.when(event, n).otherwise(-n).alias("n"), F.when(event, lags).otherwise(-lags).alias("lags"))
    sums = found.groupBy(*keys, "seq_i").agg(F.sum("n").alias("pairs"), (F.sum("lags").cast("double") / 1e9).alias("total"))
    return sums.filter("pairs > 0")


def non_overlapping(table: DataFrame, keys: list[str]) -> DataFrame:
    """Windows a whole length apart, counted from the first of each length and key."""
    length = F.round(F.col("t1") - F.col("t0"), 6)
    rows = table.withColumn("len", length)
    rows = rows.withColumn("anchor", F.min("t0").over(Window.partitionBy(*keys, "len")))
    steps = (F.col("t0") - F.col("anchor")) / F.col("len")
    return rows.filter(F.abs(steps - F.round(steps)) * F.col("len") < 1e-8).drop("len", "anchor")
