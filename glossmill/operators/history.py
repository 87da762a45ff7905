"""The log of lookups and the bookmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HISTORY = 100
PERSISTED = 10 * HISTORY


def recent(log: DataFrame, limit: int = HISTORY) -> DataFrame:
    """The newest entries (word, ts, seq), newest first."""
    return log.orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def without_repeats(log: DataFrame, by: str = "user_id") -> DataFrame:
    """Leaves out a word that directly follows itself."""
    last = F.lag("word").over(Window.partitionBy(by).orderBy("ts", "seq"))
    return log.withColumn("__last", last).where(~F.col("word").eqNullSafe(F.col("__last")) | F.col("__last").isNull()).drop("__last")


def logged(found: DataFrame) -> DataFrame:
    """Number of dictionaries with the word, for the log; found comes from an exact lookup of several words."""
    return found.groupBy("word").agg(F.count_distinct("dict_id").alias("dict_count"))


def bookmarks_added(bookmarks: DataFrame, new: DataFrame) -> DataFrame:
    """Adds bookmarks (headword, dictionary, ts) whose pair isn't there yet; of several new ones the earliest."""
    first = new.groupBy("headword", "dictionary").agg(F.min("ts").alias("ts"))
    fresh = first.join(bookmarks.select("headword", "dictionary"), ["headword", "dictionary"], "left_anti")
    return bookmarks.unionByName(fresh)


def bookmarks_removed(bookmarks: DataFrame, headword: str) -> DataFrame:
    """Removes the newest bookmark of a headword, whatever its dictionary."""
    gone = bookmarks.where(F.col("headword") == headword).orderBy(F.desc("ts"), "dictionary").limit(1)
    return bookmarks.join(gone, ["headword", "dictionary"], "left_anti")


LOG = "word string, ts double, dict_count long, seq long"
MARKS = "headword string, dictionary string, ts double, path string"


def save(rows: DataFrame, path: str) -> None:
    """Replaces the file of a log (whose newest PERSISTED entries stay) or of bookmarks, as JSON lines."""
    rows = recent(rows, PERSISTED) if "word" in rows.columns else rows
    rows.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """A log or bookmarks, newest first. If any line is malformed or lacks its word, all are dropped, as one that was
    cut off in the middle can't be told from a changed one."""
    key = "headword" if "headword" in schema else "word"
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    bad = F.col("_corrupt_record").isNotNull() | F.col(key).isNull() | F.col("ts").isNull()
    whole = rows.select(F.col("_corrupt_record"), key, "ts").agg(F.coalesce(F.max(bad), F.lit(False)).alias("bad")).first()["bad"] is False
    return rows.where(F.lit(whole)).drop("_corrupt_record").orderBy(F.desc("ts"))


def shown(log: DataFrame) -> DataFrame:
    """The log as it is listed: time to the minute, word, number of dictionaries; newest first."""
    stamp = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm")
    return log.orderBy(F.desc("ts")).select(stamp.alias("time"), "word", "dict_count")


class Navigation:
    """Back and forward over the words looked up, as a browser has it: a new word ends what lay ahead."""

    def __init__(self, limit: int = HISTORY):
        self.words, self.at, self.limit = [], -1, limit

    def push(self, word: str) -> None:
        if self.at >= 0 and self.words[self.at] == word:
            return
        self.words = [*self.words[: self.at + 1], word][-self.limit :]
        self.at = len(self.words) - 1

    def back(self) -> str | None:
        if self.at <= 0:
            return None
        self.at -= 1
        return self.words[self.at]

    def forward(self) -> str | None:
        if self.at >= len(self.words) - 1:
            return None
        self.at += 1
        return self.words[self.at]
