"""The tape: raw timestamped records as a DataFrame, and readers and sinks around it.

Tape contract: seq, day, raw_ns, ts_ns, action (T, A, C), side (B, A, N), size, bid,
ask.  Times are nanoseconds as BIGINT, never timestamps, so that ties survive;
prices are fixed-point integers, undefined ones null.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_NS = 86_400_000_000_000
HALF_HOUR_NS = 1_800_000_000_000
PRICE_TICK = 10_000_000

TAPE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("day", T.LongType()),
        T.StructField("raw_ns", T.LongType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("bid", T.LongType()),
        T.StructField("ask", T.LongType()),
    ]
)


def tape_from_events(events: DataFrame, grid_ns: int = HALF_HOUR_NS) -> DataFrame:
    """``events`` (event_id, ts, event_type, value) as a tape whose times lie on a grid, so that ties exist."""
    raw = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) * 1000
    tick = F.floor("value").cast("long") * PRICE_TICK
    kind = F.col("event_type")
    return events.select(F.col("event_id").alias("seq"), raw.alias("raw_ns"), "event_type", "value").select(
        "seq",
        F.floor(F.col("raw_ns") / DAY_NS).cast("long").alias("day"),
        "raw_ns",
        (F.col("raw_ns") - F.col("raw_ns") % grid_ns).alias("ts_ns"),
        F.when(kind == "error", "A").when(kind == "signup", "C").otherwise("T").alias("action"),
        F.when(kind == "purchase", "B").when(kind == "click", "A").otherwise("N").alias("side"),
        (F.floor("value").cast("long") + 1).alias("size"),
        F.when(F.col("value") >= 1, tick).alias("bid"),
        F.when(F.col("value") >= 1, tick + PRICE_TICK).alias("ask"),
    )


def read_tape(spark: SparkSession, sf_dir: str, grid_ns: int = HALF_HOUR_NS) -> DataFrame:
    return tape_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), grid_ns)


def read_single(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The one parquet file of ``folder`` that matches ``pattern``; an error if there is none or more."""
    found = spark.read.option("pathGlobFilter", pattern).parquet(folder)
    files = found.inputFiles()
    if len(files) != 1:
        raise ValueError(f"expected one file like {pattern} in {folder}, found {len(files)}")
    return found


def read_meta(spark: SparkSession, path: str, key: str = "query") -> DataFrame:
    """The fields below ``key`` of a JSON sidecar; no rows where the file has no such key."""
    meta = spark.read.option("multiLine", True).json(path)
    if key not in meta.columns:
        return spark.createDataFrame([], T.StructType([]))
    return meta.select(f"{key}.*")


def read_results(spark: SparkSession, glob: str, schema: T.StructType, kind: str = "csv") -> DataFrame:
    """Result files of one schema, each row tagged with the stem of its file; of a folder that Spark wrote, with the folder's."""
    reader = spark.read.schema(schema).option("header", True) if kind == "csv" else spark.read.schema(schema)
    rows = reader.format(kind).load(glob)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)(?:/part-[^/]*)?$", 1)
    return rows.withColumn("source", F.regexp_replace(F.url_decode(name), r"\.[^.]+$", ""))


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV with a header; arrays become space-separated text."""
    cols = [
        F.array_join(F.transform(c, lambda x: F.format_string("%.5f", x)), " ").alias(c) if t.startswith("array<double") else F.col(c)
        for c, t in df.dtypes
    ]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def report_json(report: DataFrame) -> str:
    """A one-row report as indented JSON text."""
    return json.dumps(json.loads(report.toJSON().first()), indent=2)


def table_text(df: DataFrame, digits: int = 4, rows: int = 100) -> str:
    """A bounded number of rows as aligned text, doubles rounded."""
    cols = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(*cols).limit(rows).toPandas().to_string(index=False)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def resume(jobs: DataFrame, path: str, keys: list[str], run: Callable[[DataFrame], DataFrame], wave: int = 64) -> DataFrame:
    """Runs the jobs that have no row in the results at ``path``, about ``wave`` at a time; all results.

    A wave's rows are committed before the next begins, so a run that is killed loses one wave at most, and the next
    run takes up the jobs that are left.  Which wave a job is in follows from its keys; a wave that has been cut
    short is told by the rows that it has left, job by job.
    """
    spark = jobs.sparkSession
    todo = jobs
    if exists(spark, path):
        todo = jobs.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    waves = -(-todo.select(*keys).distinct().count() // wave)
    for k in range(waves):
        part = todo.filter(F.pmod(F.xxhash64(*keys), F.lit(waves)) == k)
        run(part).write.mode("append").parquet(path)
    if not waves and not exists(spark, path):
        run(todo).write.parquet(path)
    return spark.read.parquet(path)
