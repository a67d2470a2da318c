import numpy as np
import pytest
from pyspark.sql import functions as F

from tickflow.functions.hawkes import decay_sums
from tickflow.operators import streams
from tickflow.streaming import live


def drain(spark, frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
        return spark.table(name).collect()
    finally:
        query.stop()


def test_decay_sums_across_batches(spark, tmp_path):
    t = np.sort(np.random.default_rng(1).uniform(0, 100, 60))
    for k in range(3):
        rows = [("a", float(x)) for x in t[20 * k : 20 * k + 20]]
        spark.createDataFrame(rows, "key string, t double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, t double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted((r.t, r.s) for r in drain(spark, live.decay_sums(stream, 0.5), "decays"))
    assert np.allclose([s for _, s in got], decay_sums(t, np.array([0.5]))[:, 0])


def test_rolling_counts(spark, tmp_path):
    rows = spark.range(100).select(F.lit("a").alias("key"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = {(r.t0.timestamp(), r.n_events) for r in drain(spark, live.rolling_counts(stream, "10 minutes", "5 minutes", "1 minute"), "rolled", "complete")}
    assert len(got) == 21 and sum(n for _, n in got) == 200


@pytest.mark.parametrize("merge_ns", [0, 3_000_000])
def test_orders_of_a_shuffled_stream(spark, tmp_path, merge_ns):
    """Records up to two seconds out of order, in micro-batches: the orders and their times are those of the whole."""
    rng, base = np.random.default_rng(3), 1_700_000_000 * 10**9
    rows = []
    for key in ("a", "b"):
        ns = np.cumsum(rng.choice([0, 0, 1_000_000, 2_000_000, 400_000_000], 200))
        rows += [(key, 0, base + int(t), seq, "T", "ABN"[rng.integers(0, 3)], int(rng.integers(1, 9))) for seq, t in enumerate(ns)]
    rows += [(key, 0, base + 10**12, 900, "T", "A", 1) for key in ("a", "b")]
    tape = spark.createDataFrame(rows, "instrument string, day long, ts_ns long, seq long, action string, side string, size long")
    fields = ("grp", "ts_ns", "seq", "side", "size", "n_fills", "out_ns")
    last = base + 10**12
    expected = sorted((r.instrument, *[r[f] for f in fields]) for r in streams.trade_stream(tape, merge_ns).collect() if r.ts_ns < last)
    sent = streams.executions(tape).select(F.col("instrument").alias("key"), F.timestamp_micros((F.col("ts_ns") / 1000).cast("long")).alias("ts"), "ts_ns", "seq", F.col("sgn").cast("long").alias("sgn"), "size")
    held = sorted(sent.collect(), key=lambda r: r.ts_ns + int(rng.integers(0, 1_900_000_000)) * (r.ts_ns < last))
    for k in range(0, len(held), 45):
        spark.createDataFrame(held[k : k + 45], sent.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drain(spark, live.orders(stream, "2 seconds", merge_ns), f"orders_{merge_ns}")
    assert sorted((r.key, *[r[f] for f in fields]) for r in got if r.ts_ns < last) == expected
