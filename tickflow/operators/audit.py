"""What a tape looks like: counts, ties, gaps, grids, and a one-row report of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from tickflow.functions import columns as C
from tickflow.operators import scan
from tickflow.operators import streams as S

#: Records of a block where rows are ordered by their number.
RECORDS = 100_000


def grid_share(tape: DataFrame) -> DataFrame:
    share = lambda ns: F.round(F.avg((F.col("raw_ns") % ns == 0).cast("double")), 6)
    return tape.agg(share(1000).alias("us"), share(1_000_000_000).alias("s"), F.count_distinct(F.col("raw_ns") % 1_000_000).alias("digits"))


def gaps(rows: DataFrame, time: str) -> DataFrame:
    """``gap`` to the row before in the session; null for the first."""
    found = scan.previous(scan.in_session_blocks(rows, time), S.session_keys(rows), (time, "seq"), time, "came")
    return found.withColumn("gap", F.col(time) - F.col("came")).drop("block", "came")


def binned(rows: DataFrame, start: float, end: float, width: float) -> DataFrame:
    """Counts per session and bin with empty bins; the last bin holds its right end too."""
    keys = S.session_keys(rows)
    n = int((end - start) / width)
    inside = rows.filter((F.col("t") >= start) & (F.col("t") <= end))
    bins = F.least(F.floor((F.col("t") - start) / width), F.lit(n - 1)).alias("bin")
    counted = inside.groupBy(*keys, bins).agg(F.count("*").alias("n"))
    every = rows.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    return every.join(counted, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def counts_in(rows: DataFrame, named: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.groupBy(*S.session_keys(rows)).agg(*[F.count_if(C.between(F.col("t"), *span)).alias(name) for name, span in named.items()])


def value_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    parts = [rows.groupBy(F.col(f).alias("value")).agg(F.count("*").alias("n")).select(F.lit(f).alias("field"), "value", "n") for f in fields]
    return reduce(DataFrame.union, parts)


def tie_multiplicity(executions: DataFrame) -> DataFrame:
    """How many timestamps have 1, 2, ... 10 or more executions."""
    per = executions.groupBy(*S.session_keys(executions), "ts_ns").agg(F.count("*").alias("c"))
    return per.groupBy(F.least("c", F.lit(10)).cast("long").alias("fills")).agg(F.count("*").alias("timestamps"))


def both_sides(executions: DataFrame) -> DataFrame:
    per = executions.filter("sgn <> 0").groupBy(*S.session_keys(executions), "ts_ns").agg(F.min("sgn").alias("lo"), F.max("sgn").alias("hi"))
    return per.agg(F.count_if(F.col("lo") != F.col("hi")).alias("both_sides"))


def interarrival(stream: DataFrame, long_gap: float) -> DataFrame:
    rows = scan.previous(scan.in_blocks(stream, "out_ns"), S.session_keys(stream), ("out_ns",), "t", "came")
    rows = rows.select((F.col("t") - F.col("came")).alias("g"))
    at = lambda p: F.round(F.percentile("g", p), 6)
    return rows.agg(
        F.round(F.min("g"), 6).alias("min"),
        at(0.01).alias("p1"),
        at(0.5).alias("median"),
        at(0.99).alias("p99"),
        F.round(F.max("g"), 6).alias("max"),
        F.count_if(F.col("g") > long_gap).alias("long_gaps"),
    )


def latency(tape: DataFrame) -> DataFrame:
    rows = tape.select((F.col("raw_ns") - F.col("ts_ns")).alias("x"))
    return rows.agg(F.percentile("x", 0.5).alias("median"), F.round(F.percentile("x", 0.99), 3).alias("p99"), F.max("x").alias("max"))


def _one_row(*parts: DataFrame) -> DataFrame:
    """One-row tables with columns of their own as one row."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.agg(*[F.max(c).alias(c) for c in every.columns])


def monotone(tape: DataFrame) -> DataFrame:
    rows = scan.previous(scan.in_blocks(tape, "seq", RECORDS), S.session_keys(tape), ("seq",), "ts_ns", "came")
    rows = rows.select((F.col("ts_ns") - F.col("came")).alias("g"))
    return rows.agg(
        F.bool_and(F.coalesce(F.col("g") >= 0, F.lit(True))).alias("nondecreasing"),
        F.bool_and(F.coalesce(F.col("g") > 0, F.lit(True))).alias("increasing"),
    )


def audit(tape: DataFrame, start: float = 34200, end: float = 57600) -> DataFrame:
    """One row; each part is a small aggregate with columns of its own, and the rows are folded into one."""
    executions = S.executions(tape)
    keys = S.session_keys(tape)
    parts = [
        tape.agg(
            F.count("*").alias("n_records"),
            F.count_if(C.between(F.col("t"), start, end)).alias("in_session"),
            F.count_distinct("day").alias("days"),
        ),
        executions.agg(F.count("*").alias("executions"), F.sum("size").alias("shares"), F.count_distinct(*keys, "ts_ns").alias("timestamps")),
        S.orders(tape).agg(F.count("*").alias("orders"), F.max("n_fills").alias("max_fills")),
        S.mid_changes(tape).agg(F.count("*").alias("mid_changes")),
    ]
    return _one_row(*parts)


def _fields(grouped: GroupedData, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, field, value) rows of the aggregates ``values``, computed in one pass."""
    wide = grouped.agg(*[v.cast("double").alias(k) for k, v in values.items()])
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("value")) for k in values])))


def report(
    tape: DataFrame,
    start: float = 34200,
    end: float = 57600,
    merges: dict[str, int] | None = None,
    named: dict[str, tuple[float, float]] | None = None,
    long_gap: float = 5.0,
) -> DataFrame:
    """The audit of every session as (day, field, value) rows, by instrument where the tape has that column.

    Four aggregates by session: of the records, the executions, the order streams at each of ``merges``
    nanoseconds, and the mid-price changes.  Gaps between records and executions count between ``start`` and ``end``.
    """
    keys = S.session_keys(tape)
    inside = C.between(F.col("t"), start, end)
    late = F.col("raw_ns") - F.col("ts_ns")
    r6 = lambda c: F.round(c, 6)
    share = lambda ns: r6(F.avg((F.col("raw_ns") % ns == 0).cast("double")))
    records = scan.previous(scan.in_blocks(tape, "seq", RECORDS), keys, ("seq",), "ts_ns", "came_ns").drop("block")
    records = records.withColumns({"inside": inside, "step": F.col("ts_ns") - F.col("came_ns"), "late": late, "record": F.struct("raw_ns", inside.alias("inside"))})
    records = scan.previous(scan.in_blocks(records, "raw_ns"), keys, ("raw_ns", "seq"), "record", "came")
    records = records.withColumn("gap", F.when(F.col("inside") & F.col("came.inside"), F.col("raw_ns") - F.col("came.raw_ns")))
    parts = [
        _fields(
            records.groupBy(*keys),
            keys,
            {
                "records": F.count("*"),
                "records_in_session": F.count_if("inside"),
                "first": r6(F.min("t")),
                "last": r6(F.max("t")),
                "first_in_session": r6(F.min(F.when(F.col("inside"), F.col("t")))),
                "last_in_session": r6(F.max(F.when(F.col("inside"), F.col("t")))),
                "nondecreasing": F.bool_and(F.coalesce(F.col("step") >= 0, F.lit(True))),
                "increasing": F.bool_and(F.coalesce(F.col("step") > 0, F.lit(True))),
                "share_on_1us": share(1000),
                "share_on_1ms": share(1_000_000),
                "sub_us_digits": F.count_distinct(F.col("raw_ns") % 1000),
                "latency_median": F.percentile("late", 0.5),
                "latency_p99": F.round(F.percentile("late", 0.99), 3),
                "latency_max": F.max("late"),
                "gap_max": F.max("gap") / 1e9,
                "gap_max_at": r6(F.max_by("t", F.when(F.col("gap").isNotNull(), F.struct("gap", -F.col("t"))))),
                "gaps_over_1s": F.count_if(F.col("gap") > 1_000_000_000),
            },
        ),
    ]
    executed = S.executions(tape).filter(inside)
    ties = executed.groupBy(*keys, "ts_ns").agg(
        F.count("*").alias("c"),
        F.sum("size").alias("shares"),
        F.count_if(F.col("sgn") > 0).alias("buys"),
        F.count_if(F.col("sgn") < 0).alias("sells"),
    )
    fields = {
        "executions": F.sum("c"),
        "timestamps": F.count("*"),
        "fills_max": F.max("c"),
        "shares": F.sum("shares"),
        "buys": F.sum("buys"),
        "sells": F.sum("sells"),
        "both_sides": F.count_if((F.col("buys") > 0) & (F.col("sells") > 0)),
    }
    fields |= {f"timestamps_of_{k}_fills": F.count_if(F.least("c", F.lit(10)) == k) for k in range(1, 11)}
    parts.append(_fields(ties.groupBy(*keys), keys, fields))
    for name, merge_ns in (merges or {"merge_0": 0}).items():
        stream = scan.previous(scan.in_blocks(S.trade_stream(tape, merge_ns), "out_ns"), keys, ("out_ns",), "t", "came")
        wait = F.col("t") - F.col("came")
        at = lambda p: r6(F.percentile("wait", p))
        fields = {"events": F.count("*"), "wait_min": r6(F.min("wait")), "wait_p1": at(0.01), "wait_median": at(0.5), "wait_p99": at(0.99)}
        fields |= {"wait_max": r6(F.max("wait")), "long_gaps": F.count_if(F.col("wait") > long_gap)}
        fields |= {f"in_{k}": F.count_if(C.between(F.col("t"), *span)) for k, span in (named or {}).items()}
        parts.append(_fields(stream.withColumn("wait", wait).groupBy(*keys), keys, {f"{name}_{k}": v for k, v in fields.items()}))
    parts.append(_fields(S.mid_changes(tape).groupBy(*keys), keys, {"mid_changes": F.count("*")}))
    return reduce(DataFrame.unionByName, parts)
