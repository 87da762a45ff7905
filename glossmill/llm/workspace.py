"""Intermediate tables in the folder that the cluster shares, and the release of what is no longer read."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from glossmill.shared import delete, shared_dir

_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Workspace:
    """Tables of one operator run. ``cut`` writes a DataFrame as Parquet and reads it back, which ends its
    lineage: a lost executor costs only the running job. ``drop`` removes a table that is no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def cut(self, df: DataFrame, label: str, release: bool = False, batch_rows: int = 2048) -> DataFrame:
        """batch_rows: of the Arrow batches meanwhile; texts are large rows, so there are fewer of them than usual."""
        out = self.path(label)
        schema = df.schema
        with self.small_batches(batch_rows):
            df.write.parquet(out)
        del df
        if release:
            self.release()
        back = self.spark.read.schema(schema).parquet(out)
        back._glossmill_path = out
        return back

    @contextmanager
    def small_batches(self, rows: int = 2048) -> Iterator[None]:
        usual = self.spark.conf.get(_KEY)
        self.spark.conf.set(_KEY, str(min(rows, int(usual))))
        try:
            yield
        finally:
            self.spark.conf.set(_KEY, usual)

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_glossmill_path", None)
        if path:
            delete(self.spark, path)

    def release(self) -> None:
        """Lets the driver forget finished DataFrames, so that Spark's cleaner deletes their shuffle files."""
        gc.collect()
        self.spark._jvm.System.gc()
