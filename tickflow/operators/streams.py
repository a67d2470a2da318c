"""Marked event streams from a tape: orders from fills, mid-price changes, ties and grids.

A session is a day, or the day of an instrument where the tape has an ``instrument``; no window
spans the table, and instruments are never merged.  Ordered operators work on blocks of a session
(``operators.scan``) and carry what a block needs from those before it, so one session uses many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickflow.functions import columns as C
from tickflow.operators import scan

#: The order of records in a session.
ORDER = ("ts_ns", "seq")


def session_keys(rows: DataFrame) -> list[str]:
    return [c for c in ("instrument", "day") if c in rows.columns]


def executions(tape: DataFrame, sided_only: bool = False) -> DataFrame:
    rows = tape.filter("action = 'T'").withColumn("sgn", C.encode_side(F.col("side")))
    return rows.filter("sgn <> 0") if sided_only else rows


def sweep_groups(tape: DataFrame, merge_ns: int = 0, sided_only: bool = False) -> DataFrame:
    """Executions with ``grp``, the number of their order in the day.

    An order goes on while the gap is at most ``merge_ns`` and the side agrees; fills
    without a side join either and take the side of the first sided fill.
    """
    keys = session_keys(tape)
    rows = scan.in_blocks(executions(tape, sided_only))
    rows = scan.previous(rows, keys, ORDER, "ts_ns", "before_ns")
    starts = F.col("before_ns").isNull() | (F.col("ts_ns") - F.col("before_ns") > merge_ns)
    rows = rows.withColumn("starts", starts)
    order = scan.inside(keys, *ORDER)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("chain", F.sum(F.col("starts").cast("long")).over(running))
    chain = Window.partitionBy(*keys, "block", "chain").orderBy(*ORDER)
    sided = F.last(F.when(F.col("sgn") != 0, F.col("sgn")), ignorenulls=True)
    rows = rows.withColumn("own", sided.over(chain.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("so_far", F.coalesce(F.when(F.col("sgn") != 0, F.col("sgn")), "own"))

    def sides(blocks: DataFrame, before: WindowSpec) -> DataFrame:
        """The side of the chain that is open where a block begins: that of the last block that began a chain or had a side."""
        told = F.when(F.col("began") | F.col("open.so_far").isNotNull(), F.col("open"))
        return blocks.withColumn("came", F.last(told, ignorenulls=True).over(before))

    last = {"began": F.bool_or("starts"), "open": F.max_by(F.struct("so_far"), F.struct(*ORDER))}
    rows = scan.carry(rows, keys, last, sides, "came")
    held = F.coalesce("own", F.when(F.col("chain") == 0, F.col("came.so_far")))
    breaks = F.col("starts") | F.coalesce((F.col("sgn") != 0) & (held != F.col("sgn")), F.lit(False))
    rows = scan.running_sum(rows, keys, ORDER, breaks.cast("long"), "grp")
    return rows.drop("block", "before_ns", "starts", "chain", "own", "so_far", "came")


def orders(tape: DataFrame, merge_ns: int = 0, sided_only: bool = False) -> DataFrame:
    """One row per order: day, grp, ts_ns and seq of its first fill, side, size, n_fills."""
    grouped = sweep_groups(tape, merge_ns, sided_only).groupBy(*session_keys(tape), "grp")
    return grouped.agg(
        F.min("ts_ns").alias("ts_ns"),
        F.min_by("seq", F.struct("ts_ns", "seq")).alias("seq"),
        F.signum(F.sum("sgn")).cast("long").alias("side"),
        F.sum("size").alias("size"),
        F.count("*").alias("n_fills"),
    )


def separate_ties(stream: DataFrame) -> DataFrame:
    """``out_ns``: the least strictly increasing times, a nanosecond apart, that are not earlier."""
    keys = session_keys(stream)
    order = scan.inside(keys, *ORDER)
    rows = scan.in_blocks(stream).withColumn("rn", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("base", F.col("ts_ns") - F.col("rn"))

    def peaks(blocks: DataFrame, before: WindowSpec) -> DataFrame:
        blocks = blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        return blocks.withColumn("peak", F.max(F.col("top") - F.col("offset")).over(before))

    rows = scan.carry(rows, keys, {"n": F.count("*"), "top": F.max("base")}, peaks, "offset", "peak")
    own = F.max("base").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("offset")
    return rows.withColumn("out_ns", F.col("offset") + F.col("rn") + F.greatest(own, "peak")).drop("block", "rn", "base", "offset", "peak")


def trade_stream(tape: DataFrame, merge_ns: int = 0, sided_only: bool = False) -> DataFrame:
    """Orders with tie-separated times and ``t``, seconds of the day."""
    rows = separate_ties(orders(tape, merge_ns, sided_only))
    return rows.withColumn("t", C.seconds_of_day(F.col("out_ns"), F.col("day")))


def last_of_ts(tape: DataFrame) -> DataFrame:
    """The last record of each timestamp."""
    after = F.lead("ts_ns").over(scan.inside(session_keys(tape), *ORDER))
    return scan.in_blocks(tape).withColumn("after", after).filter("after IS NULL OR after > ts_ns").drop("after", "block")


def mid_changes(tape: DataFrame) -> DataFrame:
    """Records that end a timestamp with a valid quote whose mid differs from the one before; the first is none."""
    kept = last_of_ts(tape).filter(C.valid_quote(F.col("bid"), F.col("ask"))).withColumn("twice_mid", F.col("bid") + F.col("ask"))
    kept = scan.previous(scan.in_blocks(kept), session_keys(tape), ORDER, "twice_mid", "before_mid")
    changed = kept.withColumn("change", F.col("twice_mid") - F.col("before_mid")).filter("change <> 0").drop("block", "before_mid")
    return changed.withColumn("direction", F.signum("change").cast("long"))


def derived_stream(stream: DataFrame, variant: str, ts_ns) -> DataFrame:  # noqa: ANN001
    """A stream under a variant's name with changed times and without marks."""
    return stream.select(F.lit(variant).alias("variant"), *session_keys(stream), "seq", ts_ns.alias("ts_ns"))


def _steps(stream: DataFrame, time: str) -> DataFrame:
    """``back``: the time is not after that of the row before, by ``seq``; in blocks of rows."""
    rows = scan.previous(scan.in_blocks(stream, "seq", 100_000), session_keys(stream), ("seq",), time, "came")
    return rows.withColumn("back", F.col(time) <= F.col("came")).drop("block", "came")


def not_increasing(stream: DataFrame, time: str = "ts_ns") -> DataFrame:
    """How many times of each session are not after the one before."""
    keys = session_keys(stream)
    return _steps(stream, time).groupBy(*keys).agg(F.count_if("back").alias("violations"))


def require_increasing(stream: DataFrame, time: str = "ts_ns") -> DataFrame:
    """The stream; reading it fails where a time is not after the one before."""
    checked = _steps(stream, time).withColumn("ok", F.assert_true(~F.coalesce("back", F.lit(False)), F.lit("times do not increase")))
    return checked.filter("ok IS NULL").drop("ok", "back")
