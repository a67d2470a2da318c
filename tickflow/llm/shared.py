"""The shared folder of a session, tables written to it, and chunked Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI under ``spark.checkpoint.dir``; a local one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.gettempdir() + "/tickflow-shared"
    return f"{root.rstrip('/')}/tickflow-{uuid.uuid4().hex}"


def written(df: DataFrame, **options) -> DataFrame:
    """``df`` as a table in the shared folder: cuts its lineage and is computed once."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``max_bytes`` of ``column``; never less than a row."""
    for batch in batches:
        at, n = 0, batch.num_rows
        col = batch.column(batch.schema.get_field_index(column))
        if col.nbytes <= max_bytes:
            if n:
                yield batch
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        while at < n:
            end, total = at, 0
            while end < n and (end == at or total + sizes[end] <= max_bytes):
                total += int(sizes[end])
                end += 1
            yield batch.slice(at, end - at)
            at = end


def give_back() -> None:
    """Returns this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # a C library without it
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over the batches of a task, whose free memory goes back to the system at its end.

    Spark keeps the Python workers of earlier tasks and deals tasks to them in turn: an idle one would keep
    what its largest task took.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def aside(docs: DataFrame, *named: str) -> tuple[DataFrame, list]:
    """``docs`` with every column under a name of its position, and ``named`` columns under their own names too.

    The second value gives the first columns back: no name that an operator uses can clash with one of the table.
    """
    places = [f"__at{k}" for k in range(len(docs.columns))]
    moved = docs.toDF(*places)
    at = {c: p for c, p in zip(docs.columns, places, strict=True)}
    moved = moved.select(*places, *[F.col(at[c]).alias(c) for c in named])
    return moved, [F.col(p).alias(c) for c, p in at.items()]
