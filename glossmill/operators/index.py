"""Building and keeping the index: entries, metadata, staleness, the listing of dictionaries, resources.

Tables are Parquet partitioned by dict_id. Replacing a dictionary overwrites its own partitions only, in one commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.functions.text import normalized, plain_text, thousands
from glossmill.shared import exists

ENTRIES = "dict_id string, entry_seq long, headword string, headword_normalized string, byte_offset long, byte_length long, entry_key string"


def indexed(rows: DataFrame) -> DataFrame:
    """Entries with their normalised headwords; rows: (dict_id, entry_seq, headword, byte_offset, byte_length)."""
    rows = rows.where("headword is not null")
    key = F.col("entry_key") if "entry_key" in rows.columns else F.lit(None).cast("string")
    return rows.select("dict_id", "entry_seq", "headword", normalized(F.col("headword")).alias("headword_normalized"), "byte_offset", "byte_length", key.alias("entry_key"))


def store(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """Replaces the dictionaries that rows have. Files of a dictionary are sorted by normalised headword, so a
    lookup reads the row groups that can have the word. A dictionary is spread over range partitions by headword,
    so a very large one isn't one task's."""
    spread = rows.repartitionByRange(partitions, "dict_id", "headword_normalized") if partitions else rows.repartitionByRange("dict_id", "headword_normalized")
    ordered = spread.sortWithinPartitions("dict_id", "headword_normalized", "entry_seq")
    ordered.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("dict_id").parquet(path)


def create(spark: SparkSession, name: str, path: str) -> None:
    """The entry table in the catalogue; nothing happens if it is there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ENTRIES}) USING parquet PARTITIONED BY (dict_id) LOCATION '{path}'")


def clear(spark: SparkSession, path: str, dict_ids: list[str] | None = None) -> None:
    """Deletes the stored entries of some dictionaries, or all."""
    jvm = spark._jvm
    for place in [path] if dict_ids is None else [f"{path}/dict_id={d}" for d in dict_ids]:
        p = jvm.org.apache.hadoop.fs.Path(place)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    spark.catalog.refreshByPath(path)


def headword_count(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_distinct("headword").alias("headwords"))


def documents(bodies: DataFrame) -> DataFrame:
    """Full-text rows of bodies (dict_id, entry_seq, headword, raw, markup): those with any plain text."""
    plain = bodies.withColumn("definition", plain_text(F.col("raw"), F.col("markup")))
    return plain.where(F.col("definition") != "").select("dict_id", "entry_seq", "headword", "definition")


def latest(metadata: DataFrame) -> DataFrame:
    """The last value of each (dict_id, key) by seq."""
    return metadata.groupBy("dict_id", "key").agg(F.max_by("value", "seq").alias("value"))


def metadata_map(metadata: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    return latest(metadata).groupBy("dict_id").agg(F.map_from_entries(pairs).alias("metadata"))


def reset(metadata: DataFrame, dict_ids: DataFrame) -> DataFrame:
    """Metadata after a reset: the mark that full text is indexed goes, the rest stays."""
    marked = dict_ids.select("dict_id", F.lit("fts-indexed").alias("key"))
    return metadata.join(marked, ["dict_id", "key"], "left_anti")


def entry_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("dict_id").agg(F.count("*").alias("entries"))


def staleness(files: DataFrame, metadata: DataFrame, counts: DataFrame) -> DataFrame:
    """(dict_id, stale, why) of files (dict_id, path, mtime; mtime null if the file is gone): not indexed, file
    missing, changed, or without entries. Formats that skip indexing (skip_index) are never stale."""
    stored = latest(metadata).where("key = 'mtime'").select("dict_id", F.expr("try_cast(value as bigint)").alias("stored"))
    both = files.join(stored, "dict_id", "left").join(counts, "dict_id", "left")
    why = (
        F.when(F.col("stored").isNull(), "not indexed").when(F.col("mtime").isNull(), "file missing")
        .when(F.col("stored") != F.col("mtime"), "changed").when(F.coalesce("entries", F.lit(0)) == 0, "no entries")
    )
    why = F.when(F.coalesce(F.col("skip_index"), F.lit(False)), None).otherwise(why) if "skip_index" in files.columns else why
    return both.select("dict_id", why.isNotNull().alias("stale"), why.alias("why"))


def stale_quickly(files: DataFrame, indexes: DataFrame) -> DataFrame:
    """By times alone: no index, or one older than the dictionary's file."""
    both = files.join(indexes.select("dict_id", F.col("mtime").alias("index_mtime")), "dict_id", "left")
    return both.select("dict_id", (F.col("index_mtime").isNull() | (F.col("index_mtime") < F.col("mtime"))).alias("stale"))


def listing(dictionaries: DataFrame, counts: DataFrame, stale: DataFrame) -> DataFrame:
    """The table of dictionaries, by name."""
    both = dictionaries.join(counts, "dict_id", "left").join(stale, "dict_id", "left")
    status = F.when(F.coalesce("entries", F.lit(0)) == 0, "Not indexed").when(F.coalesce("stale", F.lit(True)), "Needs reindex").otherwise("Indexed")
    pair = F.concat_ws(" → ", F.when(F.col("source_lang") != "", F.col("source_lang")), F.when(F.col("target_lang") != "", F.col("target_lang")))
    return both.select("name", F.upper("format_name").alias("format"), pair.alias("languages"), thousands(F.coalesce("entries", F.lit(0))).alias("entries"), status.alias("status"), "path").orderBy("name", "path")


def marked_fulltext(metadata: DataFrame, dict_ids: DataFrame) -> DataFrame:
    """Metadata with the mark that the full text of these dictionaries is stored."""
    mark = dict_ids.select("dict_id", F.lit("fts-indexed").alias("key"), F.lit("yes").alias("value"), F.unix_micros(F.current_timestamp()).alias("seq"))
    return metadata.unionByName(mark)


def backfill(bodies: DataFrame, metadata: DataFrame, path: str, build: bool = True) -> DataFrame:
    """Stores the full text of the dictionaries of bodies that have no mark yet, and returns the metadata with their
    marks. Without ``build``, the switch for full text, nothing is done."""
    if not build:
        return metadata
    missing = without_fulltext(bodies.select("dict_id").distinct(), metadata).select("dict_id")
    rows = documents(bodies.join(missing, "dict_id", "left_semi"))
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("dict_id").parquet(path)
    return marked_fulltext(metadata, missing)


def to_index(dictionaries: DataFrame, registry) -> DataFrame:
    """The dictionaries that an indexing run takes: without those of formats that skip indexing."""
    return dictionaries.where(~F.col("format_name").isin([f.name for f in registry.formats if f.skip_index]))


class Run:
    """One indexing run into a store: dictionary by dictionary, with their outcomes. ``stop`` cancels the jobs of the
    one at work; those after it are left as they are."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.stopped, self.rows = spark, path, False, []
        self.group = f"indexing-{uuid.uuid4().hex}"

    def index(self, dict_id: str, read: Callable[[], DataFrame]) -> None:
        error, entries = None, None
        if self.stopped:
            error = "stopped"
        else:
            self.spark.sparkContext.setJobGroup(self.group, f"indexing {dict_id}", interruptOnCancel=True)
            try:
                rows = indexed(read())
                store(rows, self.path)
                entries = rows.count()
            except Exception as e:  # a broken dictionary ends neither the run nor the others
                error = "stopped" if self.stopped else str(e)[:500]
            finally:
                self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        self.rows.append((dict_id, error, entries))

    def stop(self) -> None:
        self.stopped = True
        self.spark.sparkContext.cancelJobGroup(self.group)

    def outcomes(self) -> DataFrame:
        """(dict_id, error, entries), as ``totals`` takes them."""
        return self.spark.createDataFrame(self.rows, "dict_id string, error string, entries long")


def without_fulltext(dictionaries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Dictionaries whose full text isn't indexed yet."""
    marked = latest(metadata).where("key = 'fts-indexed' and value = 'yes'")
    return dictionaries.join(marked, "dict_id", "left_anti")


def totals(outcomes: DataFrame) -> DataFrame:
    """Of an indexing run: dictionaries processed, failed, and entries; outcomes: (dict_id, error, entries)."""
    failed = F.col("error").isNotNull()
    return outcomes.agg(F.count_if(~failed).alias("processed"), F.count_if(failed).alias("errors"), F.coalesce(F.sum(F.when(~failed, F.col("entries"))), F.lit(0)).alias("entries"))


def resource(keys: DataFrame, resources: DataFrame) -> DataFrame:
    """Looks resources up by (dict_id, key): lower-cased, with / for \\, as given and else with a leading /. Returns the
    content, null where there is none, which is remembered as missing."""
    form = lambda c: F.lower(F.translate(c, "\\", "/"))
    held = resources.select("dict_id", form(F.col("key")).alias("form"), "content")
    asked = keys.select("*", F.posexplode(F.array(form(F.col("key")), F.concat(F.lit("/"), form(F.col("key"))))).alias("attempt", "form"))
    found = asked.join(held, ["dict_id", "form"], "left").where("content is not null")
    best = found.groupBy("dict_id", "key").agg(F.min_by("content", "attempt").alias("content"))
    return keys.join(best, ["dict_id", "key"], "left").withColumn("missing", F.col("content").isNull())


def cache_resources(keys: DataFrame, resources: DataFrame, path: str) -> DataFrame:
    """``resource`` with a stored cache (dict_id, key, content, missing): only keys that it hasn't are looked up, and
    what isn't there is remembered as missing."""
    spark = keys.sparkSession
    schema = "dict_id string, key string, content binary, missing boolean"
    keys = keys.select("dict_id", "key").distinct()
    held = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    new = keys.join(held.select("dict_id", "key"), ["dict_id", "key"], "left_anti")
    resource(new, resources).select("dict_id", "key", "content", "missing").write.mode("append").parquet(path)
    return keys.join(spark.read.schema(schema).parquet(path), ["dict_id", "key"])


def running(blocks: DataFrame) -> DataFrame:
    """Total unpacked size by dictionary."""
    return blocks.groupBy("dict_id").agg(F.sum("size").alias("total"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """entry_seq from 0 within each dictionary."""
    return rows.withColumn("entry_seq", (F.row_number().over(Window.partitionBy("dict_id").orderBy(order)) - 1).cast("long"))
