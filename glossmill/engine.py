"""One user's dictionaries as a whole: found once, indexed where their files have changed, asked by word."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.text import normalize_word
from glossmill.operators import index, lookup, scope
from glossmill.shared import exists
from glossmill.sources import scan
from glossmill.sources.registry import Registry

_ENTRIES = "entry_seq long, headword string, headword_normalized string, byte_offset long, byte_length long, entry_key string, dict_id string"
_METADATA = "dict_id string, key string, value string, seq long"


class Engine:
    """Dictionaries below some directories, and those that formats find themselves, with their index in a folder."""

    def __init__(self, spark: SparkSession, directories: Sequence[str], store: str, registry: Registry | None = None, priorities: DataFrame | None = None):
        self.spark, self.directories, self.store = spark, list(directories), store
        self.registry, self.priorities = registry or scan.standard(), priorities
        self._known: DataFrame | None = None

    def dictionaries(self) -> DataFrame:
        """All dictionaries that can be read, in order of discovery; they are looked for once, and again after ``refresh``."""
        if self._known is None:
            files = scan.discover(self.spark, self.directories, self.registry).where("error is null").withColumn("priority", F.lit(0))
            columns = ("dict_id", "path", "format_name", "name", "source_lang", "target_lang", "group", "priority", "mtime")
            hooked = scan.hooked(self.spark, self.registry).withColumn("mtime", F.lit(None).cast("long"))
            found = files.select(*columns).unionByName(hooked.select(*columns))
            rows = found.collect()  # one row each, of one user's dictionaries
            known = self.spark.createDataFrame(rows, found.schema)
            known = known if self.priorities is None else scope.with_priorities(known, self.priorities)
            self._known = scope.discovered(known, "path")
        return self._known

    def refresh(self) -> None:
        self._known = None

    def _read(self, part: str, schema: str) -> DataFrame:
        path = f"{self.store}/{part}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def stale(self) -> DataFrame:
        """(dict_id, stale, why) of the dictionaries that are indexed at all."""
        counts = index.entry_counts(self._read("entries", _ENTRIES))
        return index.staleness(index.to_index(self.dictionaries(), self.registry).where("mtime is not null"), self._read("metadata", _METADATA), counts)

    def ensure_indexed(self) -> int:
        """Indexes what is new or has changed, and returns how many dictionaries that were. Times are noted last, so an
        indexing that breaks off is done again."""
        ids = [r["dict_id"] for r in self.stale().where("stale").select("dict_id").collect()]
        if ids:
            rows = scan.entries(self.spark, self.directories, self.registry, only=ids)
            index.store(index.indexed(rows), f"{self.store}/entries")
            noted = self.dictionaries().where(F.col("dict_id").isin(ids)).select("dict_id", F.lit("mtime").alias("key"), F.col("mtime").cast("string").alias("value"), F.unix_micros(F.current_timestamp()).alias("seq"))
            noted.write.mode("append").parquet(f"{self.store}/metadata")
        return len(ids)

    def lookup(self, words: Sequence[str]) -> DataFrame:
        """(word, rank, dict_id, name, entry_seq, headword, entry_key): exact matches in the order of results. Dictionaries
        whose formats answer words themselves are asked beside the index."""
        columns = ("word", "dict_id", "entry_seq", "headword", "entry_key")
        stored = lookup.exact_batch(self._read("entries", _ENTRIES), words).select(*columns)
        told = scan.asked(self.spark, self.registry, self.dictionaries(), [w for w in words if normalize_word(w)])
        told = told.select("word", "dict_id", F.lit(None).cast("long").alias("entry_seq"), F.col("word").alias("headword"), "entry_key")
        found = lookup.ranked(stored.unionByName(told), self.dictionaries())
        return found.select("word", "rank", "dict_id", "name", "entry_seq", "headword", "entry_key")
