"""Column expressions: clocks, prices, grids, labels and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000
#: The named periods of a day by window centre, in seconds, half-open.
PERIODS = {"morning": (0, 32_400), "pre": (32_400, 43_200), "statement": (43_200, 54_000), "press": (54_000, 64_800), "close": (64_800, 86_400)}
COMPARISONS = [("statement", "morning"), ("press", "morning"), ("statement", "pre"), ("press", "statement"), ("close", "morning")]


def seconds_of_day(ts_ns: Column, day: Column) -> Column:
    return (ts_ns - day * DAY_NS) / F.lit(1e9)


def clock_to_seconds(date: Column, clock: Column, zone: str = "America/New_York") -> Column:
    """Seconds from local midnight to a wall clock time, right on days that change their offset."""
    local = lambda c: F.unix_micros(F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", date, c)), zone))
    return ((local(clock) - local(F.lit("00:00"))) / 1e6).cast("long")


def seconds_to_clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def utc_offset_hours(date: Column, clock: str, zone: str = "America/New_York") -> Column:
    local = F.to_timestamp(F.concat_ws(" ", date, F.lit(clock)))
    return (F.unix_micros(local) - F.unix_micros(F.to_utc_timestamp(local, zone))) / F.lit(3.6e9)


def encode_side(side: Column) -> Column:
    return F.when(side == "B", 1).when(side == "A", -1).otherwise(0)


def valid_quote(bid: Column, ask: Column) -> Column:
    return F.coalesce((bid > 0) & (ask > 0), F.lit(False))


def mid_price(bid: Column, ask: Column) -> Column:
    return (bid + ask) * F.lit(0.5e-9)


def coarsen_ns(ts_ns: Column, grid_ns: int) -> Column:
    return ts_ns - ts_ns % grid_ns


def coarsen_seconds(t: Column, grid: float) -> Column:
    """Down to the grid; a nudge of 8 ulp keeps values that are on it."""
    return F.floor(t / grid * (1 + 8 * 2.0**-52)) * F.lit(float(grid))


def between(t: Column, lo: float, hi: float) -> Column:
    return (t >= lo) & (t < hi)


def label_period(t_mid: Column) -> Column:
    out = None
    for name, (lo, hi) in PERIODS.items():
        out = F.when(between(t_mid, lo, hi), name) if out is None else out.when(between(t_mid, lo, hi), name)
    return out


def edge_window(t0: Column, t1: Column, start: float, end: float, margin: float) -> Column:
    return (t0 < start + margin) | (t1 > end - margin)


def largest_knot(x: Column, knots: Column) -> Column:
    """Index of the last knot at or below x, clipped to the pieces."""
    return F.least(F.greatest(F.size(F.filter(knots, lambda k: k <= x)) - 1, F.lit(0)), F.size(knots) - 2)


def interpolate(x: Column, knots: Column, values: Column) -> Column:
    """Linear between knots, constant beyond them."""
    i = largest_knot(x, knots)
    at = lambda a, k: F.element_at(a, k + 1)
    w = (x - at(knots, i)) / (at(knots, i + 1) - at(knots, i))
    w = F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))
    return at(values, i) * (1 - w) + at(values, i + 1) * w


def chi2_sf_even(x: Column, df: int = 10) -> Column:
    """Upper tail of chi-squared with an even number of degrees of freedom."""
    total, term = F.lit(1.0), F.lit(1.0)
    for k in range(1, df // 2):
        term = term * (x / 2) / k
        total = total + term
    return F.exp(-x / 2) * total


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def comb(n: Column, k: Column) -> Column:
    """Binomial coefficient as a double."""
    return F.aggregate(F.sequence(F.lit(1), k.cast("int")), F.lit(1.0), lambda acc, i: acc * (n - k + i) / i)


def geometric_grid(lo: float, hi: float, n: int) -> Column:
    step = F.lit((hi / lo) ** (1 / (n - 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(lo) * F.pow(step, i))
