"""Small helpers shared by the query modules."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Rows of an Arrow batch where rows are whole texts: some 8 MB of them, where Spark's default would make 40.
BATCH_ROWS, STAGE_ROWS = 2048, 512
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SCAN = "spark.sql.parquet.columnarReaderBatchSize"


def plainly(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, whatever is in their names, under numbers, since Arrow functions take only plain names."""
    return df.select(*(F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(columns)))


def with_fields(df: DataFrame, **kinds: str) -> StructType:
    """The schema with more fields, by their types."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in kinds.items())).fields])


def unused(columns: list[str], name: str) -> str:
    """The name, with as many marks as no column has."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def for_texts(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """The session with Arrow batches of at most so many rows. Results that a query returns are computed after it has
    returned, so this can't be undone there."""
    spark.conf.set(_KEY, str(min(rows, int(spark.conf.get(_KEY)))))
    return spark


def for_stages(spark: SparkSession) -> SparkSession:
    """``for_texts`` where many stages follow each other in the same executors, with batches of STAGE_ROWS rows and scans
    by twice as many. Freed buffers of over 4 MB aren't pooled but left to the C library, which keeps much of them."""
    spark.conf.set(_SCAN, str(min(2 * STAGE_ROWS, int(spark.conf.get(_SCAN)))))
    return for_texts(spark, STAGE_ROWS)


def give_back() -> None:
    """To the system, what Arrow and the C library (if it is GNU's) keep of freed memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def frugal(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, giving back what it has freed when a task ends: workers stay for the tasks of later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return for_texts(spark).read.parquet(f"{sf_dir}/{table}.parquet")
