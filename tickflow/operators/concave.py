"""Maxima of ``sum log(x theta) - c theta`` over theta >= 0 for all windows at once, by aggregates.

Events are rows of columns ``y = x / c`` as an array, in any number of partitions: a window may exceed a task.
The search is over ``share = c * theta``, one row of a few numbers for each window.  A multiplicative step is one
grouped sum; a step to the maximum of the second-order expansion adds the Gram matrix of the weighted columns,
and solves for each window on its own row.  That step is shortened by the decrement, so that it gains without a
search along it: the negative value is self-concordant.  What is left of the slopes certifies a maximum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow.functions import hawkes as H
from tickflow.operators import scan
from tickflow.operators import windows as W
from tickflow.operators.streams import session_keys
from tickflow.sources.stage import staged


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def window_design(stream: DataFrame, betas: list[float], n: int, length: float, stride: float) -> tuple[DataFrame, DataFrame]:
    """Event rows (keys, y) and window rows (keys, t0, n_events, c) of a constant rate and fixed decays.

    What an event sees of all earlier ones does not depend on the window, so it is summed once and the event is then
    listed with its windows.  What a window carries in from before is that of the event before it, faded.
    """
    keys = session_keys(stream)
    rows = stream.select(*keys, "seq", "t")
    for j, beta in enumerate(betas):
        rows = scan.faded_sums(rows, keys, ("t", "seq"), beta, 300.0, f"s{j}").drop("block")
    sums = F.array(*[F.col(f"s{j}") for j in range(len(betas))])
    rows = rows.select(*keys, "seq", "t", sums.alias("s"))
    starts = stream.select(*keys).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    starts = starts.withColumn("t", (F.col("k") * stride).cast("double"))
    came = scan.asof(starts, rows.select(*keys, "t", F.struct("t", "s").alias("came")), keys, "t", "came", strict=True)
    own = W.assign(rows, n, length, stride).select(*keys, "k", "t0", "t1", "t", "s")
    decays = F.array(*map(F.lit, betas))
    spent = [F.sum(1 - F.exp(-b * (F.col("t1") - F.col("t")))) for b in betas]
    totals = own.groupBy(*keys, "k").agg(F.count("*").alias("n_events"), F.array(*spent).alias("own"))
    carried = F.zip_with("came.s", decays, lambda s, b: (s + 1) * F.exp(-b * (F.col("t") - F.col("came.t"))) * (1 - F.exp(-b * length)))
    zero = F.array(*[F.lit(0.0)] * len(betas))
    totals = totals.join(came, [*keys, "k"])
    c = F.concat(F.array(F.lit(float(length))), F.zip_with("own", F.coalesce(carried, zero), lambda a, b: a + b))
    totals = totals.select(*keys, "k", F.col("t").alias("t0"), "n_events", c.alias("c"))
    x = F.concat(F.array(F.lit(1.0)), F.zip_with("s", decays, lambda s, b: s * b))
    y = F.zip_with(x, "c", lambda a, b: F.when(b > 0, a / b).otherwise(0.0))
    return own.join(totals.select(*keys, "k", "c"), [*keys, "k"]).select(*keys, "k", y.alias("y")), totals


def start(totals: DataFrame) -> DataFrame:
    """Every column accounts for equally many events."""
    keys = [c for c in totals.columns if c not in ("t0", "n_events", "c")]
    return totals.select(*keys, "n_events", F.transform("c", lambda c: F.when(c > 0, F.col("n_events") / F.size("c")).otherwise(0.0)).alias("share"))


def _keys(state: DataFrame) -> list[str]:
    return [c for c in state.columns if c in ("instrument", "day", "k")]


def multiplicative_step(design: DataFrame, state: DataFrame, p: int) -> DataFrame:
    """``state`` after one monotone step: each event is split over the columns in proportion to their rates."""
    keys = _keys(state)
    rows = design.join(state, keys).withColumn("rate", _dot("y", "share"))
    parts = rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("y")[j] / F.col("rate")) for j in range(p)]).alias("part"))
    return state.join(parts, keys).withColumn("share", F.zip_with("share", "part", lambda a, b: a * b)).select(*state.columns)


def measured(design: DataFrame, state: DataFrame, p: int) -> DataFrame:
    """``state`` with the value, the slopes and the Gram matrix (upper triangle by rows) of each window."""
    keys = _keys(state)
    rows = design.join(state, keys).withColumn("rate", _dot("y", "share"))
    rows = rows.select(*keys, F.log("rate").alias("log"), *[(F.col("y")[j] / F.col("rate")).alias(f"w{j}") for j in range(p)])
    gram = [F.sum(F.col(f"w{a}") * F.col(f"w{b}")) for a in range(p) for b in range(a, p)]
    slopes = F.array(*[F.sum(f"w{j}") - 1 for j in range(p)])
    sums = rows.groupBy(*keys).agg(F.sum("log").alias("log"), slopes.alias("slope"), F.array(*gram).alias("gram"))
    total = F.aggregate("share", F.lit(0.0), lambda s, x: s + x)
    return state.join(sums, keys).withColumn("value", F.col("log") - total).drop("log")


def fit_windows(design: DataFrame, totals: DataFrame, p: int, first: int = 20, steps: int = 40) -> DataFrame:
    """keys, n_events, theta, value, certificate of every window that has events.

    ``first`` multiplicative steps, then second-order ones until the certificate of every window is met or they have
    all been taken.  Each step is a pass over the events; a window's own row is all that goes from one to the next.
    """
    state = staged(start(totals))
    keys = _keys(state)
    for k in range(first):
        state = multiplicative_step(design, state, p)
        if k % 5 == 4:
            state = staged(state)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema) + ", value double, certificate double"
    upper = np.triu_indices(p)

    def step(batches):  # noqa: ANN001, ANN202
        """The next shares of each window; the value and the certificate are those of the shares it came with."""
        for part in batches:
            out = []
            for share, slope, flat in zip(part["share"], part["slope"], part["gram"], strict=True):
                share, slope = np.array(share, float), np.array(slope, float)
                h = np.zeros((p, p))
                h[upper] = flat
                h = h + h.T - np.diag(np.diag(h))
                used = np.diag(h) > 0
                slope = np.where(used, slope, np.minimum(slope, 0))
                left = H.certificate(np.where(share > 1e-9, share, 0.0), slope)
                move = H.nonnegative_quadratic(h, slope + h @ share, share) - share
                decrement = float(np.sqrt(max(move @ h @ move, 0.0)))
                size = 1.0 if decrement < 0.25 else 1 / (1 + decrement)
                out.append((left, share + size * move if left > 1e-10 else share))
            yield part.assign(certificate=[a for a, _ in out], share=[b for _, b in out])[[c.split()[0] for c in schema.split(", ")]]

    for _ in range(steps):
        moved = staged(measured(design, state.select(*keys, "n_events", "share"), p).mapInPandas(step, schema))
        if not moved.filter(F.col("certificate") > 1e-9).limit(1).count():
            break
        state = moved
    else:
        moved = staged(measured(design, state.select(*keys, "n_events", "share"), p).mapInPandas(step, schema))
    c = totals.select(*keys, "c")
    theta = F.zip_with("share", "c", lambda a, b: F.when(b > 0, a / b).otherwise(0.0))
    return moved.join(c, keys).select(*keys, "n_events", theta.alias("theta"), "value", "certificate")
