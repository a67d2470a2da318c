"""Running values over a session that spans many tasks.

A session's rows are cut into blocks of time.  What a row needs from before its block is an associative
summary of the blocks before it: a count, a peak, a last value, a faded sum.  Each block is reduced to one row,
the block rows of a session are scanned in order (a few hundred a day), and the result is joined back by block.
Row-level windows are partitioned by session and block, so a session uses as many tasks as it has blocks; equal
times share a block, so ties never straddle two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Seconds of a block.
SECONDS = 300.0
NANOSECONDS = 300 * 10**9


def in_blocks(rows: DataFrame, time: str = "ts_ns", width: float = NANOSECONDS) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col(time) / F.lit(width)))


def in_session_blocks(rows: DataFrame, time: str) -> DataFrame:
    """Blocks by a column of nanoseconds, if it holds integers, or of seconds."""
    return in_blocks(rows, time, NANOSECONDS if rows.schema[time].dataType.typeName() == "long" else SECONDS)


def inside(keys: list[str], *order: str) -> WindowSpec:
    """Rows of one block in order; for rows that have been cut into blocks."""
    return Window.partitionBy(*keys, "block").orderBy(*order)


def carry(rows: DataFrame, keys: list[str], reduced: dict[str, Column], scanned: Callable[[DataFrame, WindowSpec], DataFrame], *names: str) -> DataFrame:
    """``rows`` with columns ``names``, the same for all rows of a block.

    ``reduced`` makes one row of each block; ``scanned`` adds the named columns to these, with a window over the
    blocks of the session before each.
    """
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "block").agg(*[v.alias(k) for k, v in reduced.items()])
    return rows.join(scanned(blocks, before).select(*keys, "block", *names), [*keys, "block"])


def running_count(rows: DataFrame, keys: list[str], order: tuple[str, ...], name: str) -> DataFrame:
    """``name``: the number of each row in its session, from 1."""
    at = lambda blocks, before: blocks.withColumn("__offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = carry(rows, keys, {"n": F.count("*")}, at, "__offset")
    return rows.withColumn(name, F.col("__offset") + F.row_number().over(inside(keys, *order))).drop("__offset")


def running_sum(rows: DataFrame, keys: list[str], order: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the session up to each."""
    rows = rows.withColumn(name, value)
    at = lambda blocks, before: blocks.withColumn("__offset", F.coalesce(F.sum("total").over(before), F.lit(0)))
    rows = carry(rows, keys, {"total": F.sum(name)}, at, "__offset")
    own = F.sum(name).over(inside(keys, *order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(own, F.lit(0)) + F.col("__offset")).drop("__offset")


def previous(rows: DataFrame, keys: list[str], order: tuple[str, ...], value: str, name: str) -> DataFrame:
    """``name``: ``value`` of the row before in the session; null for the first."""
    last = {"last": F.max_by(F.struct(value), F.struct(*order))}
    at = lambda blocks, before: blocks.withColumn("__came", F.last("last").over(before))
    rows = carry(rows, keys, last, at, "__came")
    w = inside(keys, *order)
    first = F.row_number().over(w) == 1
    return rows.withColumn(name, F.when(first, F.col(f"__came.{value}")).otherwise(F.lag(value).over(w))).drop("__came")


def faded_sums(rows: DataFrame, keys: list[str], order: tuple[str, ...], beta: float, reach: float, name: str) -> DataFrame:
    """``name``: the sum of ``exp(-beta (t - t_j))`` over the earlier rows j of the session.

    Inside a block it is a running sum of positive terms, taken from the block's start.  A block leaves a weight
    at its end; the weights of earlier blocks are summed in the same way over spans of ``reach / beta``, of which
    the span before counts too and older ones weigh less than ``exp(-reach)``.  ``rows`` have a column ``t``.
    """
    width = min(reach / beta, SECONDS)
    per = max(int(reach / beta / width), 1)
    rows = in_blocks(rows, "t", width).withColumn("__into", F.col("t") - F.col("block") * width)
    earlier = inside(keys, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.coalesce(F.sum(F.exp(beta * F.col("__into"))).over(earlier), F.lit(0.0)))
    blocks = rows.groupBy(*keys, "block").agg(F.sum(F.exp(beta * (F.col("__into") - width))).alias("left"))
    blocks = blocks.withColumn("span", F.floor(F.col("block") / per)).withColumn("place", F.col("block") - F.col("span") * per)
    within = Window.partitionBy(*keys, "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    step = beta * width
    spans = blocks.groupBy(*keys, (F.col("span") + 1).alias("span")).agg(F.sum(F.col("left") * F.exp(step * (F.col("place") + 1 - per))).alias("older"))
    near = F.coalesce(F.sum(F.col("left") * F.exp(step * (F.col("place") + 1))).over(within), F.lit(0.0))
    blocks = blocks.withColumn("near", near).join(spans, [*keys, "span"], "left")
    came = F.exp(-step * F.col("place")) * (F.col("near") + F.coalesce("older", F.lit(0.0)))
    rows = rows.join(blocks.select(*keys, "block", came.alias("__came")), [*keys, "block"])
    return rows.withColumn(name, F.exp(-beta * F.col("__into")) * (F.col("__own") + F.col("__came"))).drop("__into", "__own", "__came")


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, strict: bool = False, width: float | None = None) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` that is not later (``strict``: earlier); null where there is none.

    No rows are compared with a range of rows: both tables are laid into one order, and the last value seen is
    carried down it, inside blocks and over their ends.  Of right rows of one time the largest value counts.
    """
    names = [c for c in left.columns if c not in (*keys, time)]
    side = F.struct(*[F.col(c) for c in names]).alias("__left") if names else F.lit(True).alias("__left")
    ours = left.select(*keys, time, side, F.lit(0 if strict else 1).alias("__turn"))
    theirs = right.select(*keys, time, F.col(value).alias(value), F.lit(1 if strict else 0).alias("__turn"))
    rows = ours.unionByName(theirs, allowMissingColumns=True)
    rows = in_blocks(rows, time, width) if width else in_session_blocks(rows, time)
    order = (time, "__turn", value)
    seen = F.when(F.col("__left").isNull(), F.struct(value))
    last = {"last": F.max_by(F.struct(value), F.when(F.col("__left").isNull(), F.struct(*order)))}

    def carried(blocks: DataFrame, before: WindowSpec) -> DataFrame:
        return blocks.withColumn("__came", F.last("last", ignorenulls=True).over(before))

    rows = carry(rows, keys, last, carried, "__came")
    running = inside(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__seen", F.coalesce(F.last(seen, ignorenulls=True).over(running), "__came"))
    kept = rows.filter(F.col("__left").isNotNull())
    return kept.select(*keys, time, *[F.col(f"__left.{c}").alias(c) for c in names], F.col(f"__seen.{value}").alias(value))
