"""The log of lookups as a stream: appended events in, counts by window and word, and words without direct repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "user_id long, word string, ts timestamp"


def source(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of events as they come."""
    return spark.readStream.schema(EVENTS).parquet(path)


def counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Lookups of each word by window; events that come later than ``late`` are left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), "word")
    return grouped.agg(F.count("*").alias("lookups")).select("window.start", "word", "lookups")


def without_repeats(events: DataFrame) -> DataFrame:
    """Each user's words without direct repeats. What is kept of a user is the last word."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "word"], kind="stable")
        before = rows["word"].shift(1)
        before.iloc[0] = last
        state.update((rows["word"].iloc[-1],))
        yield rows[rows["word"] != before][["user_id", "word", "ts"]]

    return events.groupBy("user_id").applyInPandasWithState(step, EVENTS, "last string", "append", GroupStateTimeout.NoTimeout)
