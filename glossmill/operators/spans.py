"""Joins by position: ordinals, record spans, blocks that hold an offset, and chains of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINK_DEPTH = 5
BLOCK_BYTES = 1 << 16


def synonyms(synonyms: DataFrame, index: DataFrame) -> DataFrame:
    """(dict_id, headword, ordinal) with the extent of the entry of that ordinal; ordinals out of range are dropped."""
    return synonyms.join(index.select("dict_id", "ordinal", "byte_offset", "byte_length"), ["dict_id", "ordinal"])


def index_rows(main: DataFrame, other: DataFrame) -> DataFrame:
    """Main entries in file order, then synonyms, with one running number."""
    both = main.select("dict_id", "headword", "byte_offset", "byte_length", F.lit(0).alias("part"), F.col("ordinal").alias("at")).unionByName(
        other.select("dict_id", "headword", "byte_offset", "byte_length", F.lit(1).alias("part"), F.col("syn_seq").alias("at"))
    )
    return both.withColumn("entry_seq", F.row_number().over(Window.partitionBy("dict_id").orderBy("part", "at")).cast("long")).drop("part", "at")


def record_spans(records: DataFrame, totals: DataFrame) -> DataFrame:
    """Each record's end is the next different offset of its dictionary, or the dictionary's total size."""
    offsets = records.select("dict_id", "byte_offset").distinct()
    following = F.lead("byte_offset").over(Window.partitionBy("dict_id").orderBy("byte_offset"))
    ends = offsets.withColumn("next", following).join(totals, "dict_id", "left").select("dict_id", "byte_offset", F.coalesce("next", "total").alias("end_offset"))
    return records.join(ends, ["dict_id", "byte_offset"])


def block_starts(blocks: DataFrame) -> DataFrame:
    """Running starts of blocks (dict_id, block, packed, size) in the unpacked stream and in the file."""
    before = Window.partitionBy("dict_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("begin", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("file_begin", F.coalesce(F.sum("packed").over(before), F.lit(0)))


def blocks_of(records: DataFrame, blocks: DataFrame, cell: int = BLOCK_BYTES) -> DataFrame:
    """Joins records (dict_id, byte_offset) with the block [begin, begin + size) that holds the offset.

    Both sides are cut into cells of the stream, so the range join is an equi-join on dictionary and cell: a block
    is copied to the cells that it meets, a record falls into one.
    """
    cells = F.sequence(F.floor(F.col("begin") / cell), F.floor((F.col("begin") + F.col("size") - 1) / cell))
    spread = blocks.where("size > 0").withColumn("cell", F.explode(cells))
    placed = records.withColumn("cell", F.floor(F.col("byte_offset") / cell))
    inside = (F.col("byte_offset") >= F.col("begin")) & (F.col("byte_offset") < F.col("begin") + F.col("size"))
    return placed.join(spread, ["dict_id", "cell"]).where(inside).drop("cell")


def resolve_links(entries: DataFrame, starts: DataFrame, depth: int = LINK_DEPTH) -> DataFrame:
    """Follows redirects. entries: (dict_id, headword_normalized, entry_seq, body, link), link null for a body that
    is no redirect, else its target's normalised form; starts: (dict_id, start, target). At each hop an entry that
    is no redirect is preferred, else the first redirect. Returns (dict_id, start, body, error, hops)."""
    own = F.struct(F.col("link").isNotNull().alias("redirect"), "entry_seq", "body", "link")
    best = entries.groupBy("dict_id", F.col("headword_normalized").alias("target")).agg(F.min(own).alias("e"))
    pending, done = starts.select("dict_id", "start", "target"), None
    for hop in range(depth):
        met = pending.join(best, ["dict_id", "target"], "left")
        ended = met.where("e is null or e.link is null").select(
            "dict_id", "start", "e.body", F.when(F.col("e").isNull(), F.format_string('Link target "%s" not found', F.col("target"))).alias("error"), F.lit(hop + 1).alias("hops")
        )
        done = ended if done is None else done.unionByName(ended)
        pending = met.where("e.link is not null").select("dict_id", "start", F.col("e.link").alias("target"))
    looped = pending.select("dict_id", "start", F.lit(None).cast("string").alias("body"), F.format_string("redirect loop for %s", F.col("target")).alias("error"), F.lit(depth).alias("hops"))
    return looped if done is None else done.unionByName(looped)


def with_abbreviations(tags: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Tag texts with their long forms from the side table (dict_id, key, seq, expansion), where there is one; the
    first definition of a key counts."""
    first = abbreviations.groupBy("dict_id", F.col("key").alias("tag")).agg(F.min_by("expansion", "seq").alias("expansion"))
    return tags.join(first, ["dict_id", "tag"], "left")


def first_source(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each wanted key the candidate of the least rank: (key, rank, place)."""
    return wanted.join(candidates.groupBy("key").agg(F.min_by("place", "rank").alias("place")), "key", "left")


def audio_sources(wanted: DataFrame, files: DataFrame, resources: DataFrame) -> DataFrame:
    """Where the sound of each (key, directory, dict_id, name) is: the file itself, its dictionary's own archive, or
    any archive of the directory, in this order; files: (directory, name, place), resources: (directory, dict_id,
    name, place)."""
    own = wanted.select("key", "directory", "dict_id", "name")
    direct = own.join(files, ["directory", "name"]).select("key", F.lit(0).alias("rank"), "place")
    packed = own.withColumnRenamed("dict_id", "asker").join(resources, ["directory", "name"])
    packed = packed.select("key", F.when(F.col("dict_id") == F.col("asker"), 1).otherwise(2).alias("rank"), "place")
    return first_source(wanted, direct.unionByName(packed))
