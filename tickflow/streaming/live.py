"""Structured Streaming forms of the window operators, for tapes that are still being written.

Rolling counts use event-time windows with a watermark; the decay sum keeps one
number per instrument and decay and follows events in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_counts(events: DataFrame, length: str, stride: str, late: str) -> DataFrame:
    """Counts per key and sliding window; rows later than ``late`` are not counted."""
    windows = F.window("ts", length, stride)
    counted = events.withWatermark("ts", late).groupBy("key", windows.alias("w")).agg(F.count("*").alias("n_events"))
    return counted.select("key", F.col("w.start").alias("t0"), F.col("w.end").alias("t1"), "n_events")


def bin_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    return rolling_counts(events, width, width, late)


def decay_sums(events: DataFrame, beta: float) -> DataFrame:
    """``s`` of each event of a key: the decayed weight of those before, carried across batches.

    ``events``: key string, t double.  A key's events must arrive in order of time;
    one that is earlier than the last is given no sum and changes nothing.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        last, total = state.get if state.exists else (None, 0.0)
        times = np.sort(np.concatenate([p["t"].to_numpy() for p in parts]))
        out = []
        for t in times:
            if last is not None and t < last:
                out.append(None)
                continue
            s = 0.0 if last is None else float(np.exp(-beta * (t - last)) * (total + 1))
            last, total = float(t), s
            out.append(s)
        if last is not None:
            state.update((last, total))
        yield pd.DataFrame({"key": [key[0]] * len(times), "t": times, "s": out})

    return events.groupBy("key").applyInPandasWithState(
        step, "key string, t double, s double", "last double, total double", "append", "NoTimeout"
    )


ORDERS = "key string, grp long, ts_ns long, seq long, side long, size long, n_fills long, out_ns long"
_STATE = (
    "ts array<long>, seq array<long>, sgn array<long>, size array<long>, "
    "is_open boolean, first_ns long, first_seq long, last_ns long, held long, total long, shares long, fills long, grp long, last_out long"
)
_MS = 1_000_000


def orders(records: DataFrame, late: str, merge_ns: int = 0) -> DataFrame:
    """The orders of each key as they close, with tie-separated times: what ``operators.streams.trade_stream`` gives of the whole.

    ``records``: key string, ts timestamp, ts_ns long, seq long, sgn long, size long; executions in any order that is
    no more than ``late`` out.  Records wait until the watermark has passed them and are then taken in order of time
    and number.  An order closes when a record that is not its own is taken, or when the watermark has passed the last
    time at which one of its own could have come.  State is the records that wait, one open order and two numbers.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.exists:
            *waiting, is_open, first_ns, first_seq, last_ns, held, total, shares, fills, grp, last_out = state.get
        else:
            waiting, is_open, grp, last_out = [[], [], [], []], False, 0, None
            first_ns = first_seq = last_ns = held = total = shares = fills = 0
        passed = state.getCurrentWatermarkMs() * _MS
        rows = list(zip(*waiting, strict=True))
        for part in parts:
            rows += part[["ts_ns", "seq", "sgn", "size"]].itertuples(index=False, name=None)
        rows.sort()
        ready = [r for r in rows if r[0] <= passed]
        rows = rows[len(ready) :]
        closed = []

        def close() -> None:
            nonlocal last_out
            last_out = first_ns if last_out is None else max(last_out + 1, first_ns)
            closed.append((key[0], grp, first_ns, first_seq, (total > 0) - (total < 0), shares, fills, last_out))

        for ts_ns, seq, sgn, size in ready:
            if is_open and (ts_ns - last_ns > merge_ns or (sgn and held and sgn != held)):
                chained = ts_ns - last_ns <= merge_ns
                close()
                is_open = False
                held = held if chained else 0
            elif not is_open:
                held = 0
            if not is_open:
                is_open, first_ns, first_seq, total, shares, fills, grp = True, ts_ns, seq, 0, 0, 0, grp + 1
            last_ns, held, total, shares, fills = ts_ns, sgn or held, total + sgn, shares + size, fills + 1
        if is_open and passed > last_ns + merge_ns:
            close()
            is_open = False
        ends = [r[0] for r in rows] + ([last_ns + merge_ns] if is_open else [])
        columns = [list(map(int, c)) for c in zip(*rows, strict=True)] or [[], [], [], []]
        numbers = (first_ns, first_seq, last_ns, held, total, shares, fills, grp)
        state.update((*columns, is_open, *map(int, numbers), None if last_out is None else int(last_out)))
        if ends:
            state.setTimeoutTimestamp(max(min(ends) // _MS + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(closed, columns=[c.split()[0] for c in ORDERS.split(", ")])

    kept = records.withWatermark("ts", late).select("key", "ts", "ts_ns", "seq", "sgn", "size")
    return kept.groupBy("key").applyInPandasWithState(step, ORDERS, _STATE, "append", "EventTimeTimeout")
