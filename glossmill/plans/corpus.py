"""Dictionary tables derived from the general tables, on which the registered queries run.

Each different (source, lang) of documents is a dictionary and its texts' tokens are the entries; parts are the
entries of their brands; pages are HTML bodies; events are the log of lookups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.text import group_label
from glossmill.operators import index
from glossmill.operators.fulltext import Postings, postings, store_postings
from glossmill.operators.lookup import completions, rebuild_completions
from glossmill.operators.scope import discovered
from glossmill.shared import built, partitions_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    named = pairs.select(
        F.concat("source", F.lit("/"), "lang").alias("dict_id"), F.concat("source", F.lit("/"), "lang").alias("name"), F.col("lang").alias("source_lang"), F.lit("en").alias("target_lang"),
        F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("priority"), F.lit("dsl").alias("format_name"), F.concat(F.lit("/dict/"), "source", F.lit("/"), "lang", F.lit(".dsl")).alias("path"),
    )
    return discovered(named.withColumn("group", group_label(F.col("source_lang"), F.col("target_lang"))))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as entries, without their normalised form."""
    docs = table(spark, sf_dir, "documents")
    each = docs.select(F.concat("source", F.lit("/"), "lang").alias("dict_id"), "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("at", "headword"))
    return each.select("dict_id", (F.col("doc_id") * 1_000_000 + F.col("at")).alias("entry_seq"), "headword", F.col("doc_id").alias("byte_offset"), F.length("headword").cast("long").alias("byte_length"))


#: Bytes of documents for a partition of what is derived from them: about a million tokens.
_SHARE = 4 << 20
_ENTRIES = "entry_seq long, headword string, headword_normalized string, byte_offset long, byte_length long, entry_key string, dict_id string"


def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries from their index, which is made when it is asked for the first time (or when the table has changed)
    and then only read."""
    table = f"{sf_dir}/documents.parquet"
    path = built(spark, "entries", table, lambda path: index.store(index.indexed(tokens(spark, sf_dir)), path, partitions_for(spark, table, _SHARE)))
    return spark.read.schema(_ENTRIES).parquet(path)


def stored_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = built(spark, "completions", f"{sf_dir}/documents.parquet", lambda path: rebuild_completions(stored_entries(spark, sf_dir), path))
    return completions(spark, path)


def stored_fulltext(spark: SparkSession, sf_dir: str) -> Postings:
    table = f"{sf_dir}/documents.parquet"
    path = built(spark, "postings", table, lambda path: store_postings(fulltext(spark, sf_dir), path, partitions_for(spark, table, _SHARE)))
    return postings(spark, path)


def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts; their names are ASCII, so lower case is their normalised form."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("dict_id"), F.col("p_partkey").alias("entry_seq"), F.col("p_name").alias("headword"), F.lower("p_name").alias("headword_normalized"), F.col("p_partkey").alias("byte_offset"), F.col("p_size").cast("long").alias("byte_length"))


def part_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dict_id"), F.col("p_brand").alias("name")).distinct()
    return discovered(brands.withColumn("priority", F.regexp_extract("name", "([0-9])$", 1).cast("int")))


def fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("dict_id"), F.col("doc_id").alias("entry_seq"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("headword"), F.col("text").alias("definition"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", "user_id", F.col("event_type").alias("word"))
