"""Headword lookup over an entry table: exact, prefix and wildcard search, completion, cross-references.

Entries are (dict_id, entry_seq, headword, headword_normalized, ...); dictionaries are (dict_id, dict_seq, name,
priority, ...), one row each. A query's words are normalised on the driver, so predicates compare the stored column
with literals and are pushed to the scan; tables partitioned by dict_id are pruned by the joined dictionaries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.functions.text import literal_prefix, normalize_word, wildcard_regex
from glossmill.shared import delete, exists, put

PREFIX_LIMIT = 100
WILDCARD_LIMIT = 200
COMPLETION_LIMIT = 200
COMPLETION_MINIMUM = 3


def exact(entries: DataFrame, word: str) -> DataFrame:
    """All entries of a word; duplicates stay."""
    return entries.where(F.col("headword_normalized") == normalize_word(word))


def exact_batch(entries: DataFrame, words: Iterable[str]) -> DataFrame:
    """Entries of many words, with the word that asked. The words are a table made of an argument, so it is small
    by construction; their normalised forms are also pushed to the scan."""
    rows = [(w, normalize_word(w)) for w in dict.fromkeys(words)]
    asked = entries.sparkSession.createDataFrame(rows, "word string, word_normalized string")
    forms = sorted({n for _, n in rows})
    found = entries.where(F.col("headword_normalized").isin(forms)) if len(forms) <= 1000 else entries
    return found.join(asked, F.col("headword_normalized") == F.col("word_normalized")).drop("word_normalized")


def ranked(found: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """Adds each entry's dictionary, in the order of results: priority, then discovery, then place in the
    dictionary. ``rank`` numbers the dictionaries that have the word. It is made of words and dictionaries alone, so a
    common word's entries aren't one task's."""
    order = Window.partitionBy("word").orderBy("priority", "dict_seq")
    pairs = found.select("word", "dict_id").distinct().join(dictionaries.select("dict_id", "dict_seq", "name", "priority"), "dict_id")
    numbered = pairs.withColumn("rank", F.dense_rank().over(order)).withColumnsRenamed({"word": "_word", "dict_id": "_dict_id"})
    return found.join(numbered, F.col("word").eqNullSafe(F.col("_word")) & (F.col("dict_id") == F.col("_dict_id"))).drop("_word", "_dict_id")


def by_dictionary(found: DataFrame) -> DataFrame:
    """One row per word and dictionary with its matches in order; found comes from ``ranked``."""
    match = F.struct("entry_seq", "headword", "byte_offset", "byte_length")
    return found.groupBy("word", "rank", "dict_id", "name", "priority").agg(F.array_sort(F.collect_list(match)).alias("matches"))


def contents(ranked_rows: DataFrame) -> DataFrame:
    """The names of a word's dictionaries in the order of results, where there is more than one."""
    names = F.transform(F.array_sort(F.collect_set(F.struct("rank", "name"))), lambda x: x["name"])
    return ranked_rows.groupBy("word").agg(names.alias("contents")).where(F.size("contents") > 1)


def sections(rendered: DataFrame, size: int = 1) -> Iterator[list]:
    """The first result as soon as it is there, then the others by ``size``, in the order of rank and entry; one
    partition at a time is fetched ahead."""
    rows, waiting, first = rendered.orderBy("rank", "entry_seq").toLocalIterator(prefetchPartitions=True), [], True
    for row in rows:
        waiting.append(row)
        if first or len(waiting) == size:
            yield waiting
            waiting, first = [], False
    if waiting:
        yield waiting


def named(dictionaries: DataFrame) -> DataFrame:
    """The first dictionary of each name."""
    return dictionaries.groupBy("name").agg(F.min_by("dict_id", "dict_seq").alias("dict_id"))


def exact_in(entries: DataFrame, dictionaries: DataFrame, name: str, word: str) -> DataFrame:
    """Entries of a word in the first dictionary of a name."""
    return exact(entries, word).join(named(dictionaries.where(F.col("name") == name)).select("dict_id"), "dict_id", "left_semi")


def prefix(entries: DataFrame, text: str, limit: int = PREFIX_LIMIT) -> DataFrame:
    """Different headwords that begin with the text, in normalised order; none for an empty text."""
    start = normalize_word(text)
    found = entries.where(F.col("headword_normalized").startswith(start)) if start else entries.limit(0)
    return found.select("headword", "headword_normalized").distinct().orderBy("headword_normalized", "headword").limit(limit).select("headword")


def matches(pattern: str) -> Column:
    """Wildcard condition: the literal beginning as a pushable prefix, then the whole pattern."""
    regex, start = wildcard_regex(pattern), literal_prefix(pattern)
    if regex is None:
        return F.lit(False)
    whole = F.col("headword_normalized").rlike(regex)
    return F.col("headword_normalized").startswith(start) & whole if start else whole


def wildcard(entries: DataFrame, pattern: str, limit: int = WILDCARD_LIMIT) -> DataFrame:
    """Different headwords that match, by first entry."""
    found = entries.where(matches(pattern)).groupBy("headword").agg(F.min("entry_seq").alias("first"))
    return found.orderBy("first", "headword").limit(limit).select("headword")


def wildcard_everywhere(entries: DataFrame, pattern: str, limit: int = WILDCARD_LIMIT) -> DataFrame:
    """Different headwords that match among each dictionary's first ``limit``."""
    firsts = entries.where(matches(pattern)).groupBy("dict_id", "headword").agg(F.min("entry_seq").alias("first"))
    place = F.row_number().over(Window.partitionBy("dict_id").orderBy("first", "headword"))
    return firsts.withColumn("place", place).where(F.col("place") <= limit).select("headword").distinct()


def completion_index(entries: DataFrame) -> DataFrame:
    """Every different headword with the number of dictionaries that have its normalised form. Entries are made
    different first, in the tasks that read them; a form then meets its headwords and dictionaries, which are few."""
    different = entries.select("dict_id", "headword", "headword_normalized").distinct()
    forms = different.groupBy("headword_normalized").agg(F.collect_set("headword").alias("headwords"), F.size(F.collect_set("dict_id")).cast("long").alias("dict_count"))
    return forms.select(F.explode("headwords").alias("headword"), "headword_normalized", "dict_count")


def rebuild_completions(entries: DataFrame, path: str) -> None:
    """Stores the completion index of the entries in place of an older one, which readers keep until the new one is
    whole: each is a folder of its own, and a small file names the one that counts."""
    spark, name = entries.sparkSession, uuid.uuid4().hex
    rows = completion_index(entries).repartitionByRange("headword_normalized").sortWithinPartitions("headword_normalized", "headword")
    rows.write.parquet(f"{path}/{name}")
    old = _current(spark, path)
    put(spark, f"{path}/current", name.encode())
    if old:
        delete(spark, f"{path}/{old}")


def _current(spark: SparkSession, path: str) -> str | None:
    return spark.read.text(f"{path}/current").first()["value"] if exists(spark, f"{path}/current") else None


def completions(spark: SparkSession, path: str) -> DataFrame:
    """The stored completion index as it is now."""
    return spark.read.schema("headword string, headword_normalized string, dict_count long").parquet(f"{path}/{_current(spark, path)}")


def complete(completions: DataFrame, text: str, limit: int = COMPLETION_LIMIT, minimum: int = COMPLETION_MINIMUM) -> DataFrame:
    """Headwords of a completion index that begin with the text, of at least ``minimum`` characters as typed, with
    the note that is shown where more than one dictionary has the word."""
    start = normalize_word(text) if len(text) >= minimum else ""
    found = completions.where(F.col("headword_normalized").startswith(start)) if start else completions.limit(0)
    note = F.when(F.col("dict_count") > 1, F.concat(F.lit(" ("), F.col("dict_count").cast("string"), F.lit(" dicts)"))).otherwise("")
    return found.orderBy("headword_normalized", "headword").limit(limit).select("headword", "dict_count", note.alias("note"))


def complete_without_index(entries: DataFrame, text: str, limit: int = COMPLETION_LIMIT) -> DataFrame:
    """The same from entries: each dictionary's first headwords of the prefix, and how many dictionaries have each."""
    start = normalize_word(text) if len(text) >= COMPLETION_MINIMUM else ""
    found = entries.where(F.col("headword_normalized").startswith(start)) if start else entries.limit(0)
    found = found.select("dict_id", "headword", "headword_normalized").distinct()
    place = F.row_number().over(Window.partitionBy("dict_id").orderBy("headword_normalized", "headword"))
    found = found.withColumn("place", place).where(F.col("place") <= limit)
    return found.groupBy("headword").agg(F.count_distinct("dict_id").alias("dict_count"))


class Completion:
    """Completion while a word is typed: the index is asked again only if the text doesn't extend the last one, or
    if the last answer was cut at the limit; else the last answer is narrowed on the driver."""

    def __init__(self, completions: DataFrame, limit: int = COMPLETION_LIMIT):
        self.completions, self.limit, self.last, self.rows = completions, limit, None, []

    def __call__(self, text: str) -> list[tuple[str, int]]:
        if len(text) < COMPLETION_MINIMUM:
            return []
        if self.last is None or not text.startswith(self.last) or len(self.rows) >= self.limit:
            self.rows = [(r["headword"], r["dict_count"]) for r in complete(self.completions, text, self.limit).collect()]
            self.last = text
        start = normalize_word(text)
        return [(w, n) for w, n in self.rows if normalize_word(w).startswith(start)]


def _own_first(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """Entries of the references' own dictionaries, and of all for references of which no row has an own one. What a
    dictionary has is told by its different headwords, so only the entries that are returned are joined."""
    has = entries.select(F.col("dict_id").alias("from_dict"), F.col("headword_normalized").alias("target_normalized")).distinct()
    own = asked.join(has, ["from_dict", "target_normalized"], "left_semi")
    near = own.join(entries.withColumn("from_dict", F.col("dict_id")).withColumn("target_normalized", F.col("headword_normalized")), ["from_dict", "target_normalized"])
    far = asked.join(own.select(F.col("ref_id").alias("_own")).distinct(), F.col("ref_id").eqNullSafe(F.col("_own")), "left_anti").join(entries, F.col("target_normalized") == F.col("headword_normalized"))
    return near.select("ref_id", *entries.columns).unionByName(far.select("ref_id", *entries.columns))


def follow(entries: DataFrame, dictionaries: DataFrame, references: DataFrame, scope: str = "all") -> DataFrame:
    """Entries that references (ref_id, dict_id, target_normalized) lead to: in all dictionaries, or in the same
    one with all as the way out where it has none."""
    asked = references.select("ref_id", F.col("dict_id").alias("from_dict"), "target_normalized")
    found = asked.join(entries, F.col("target_normalized") == F.col("headword_normalized"))
    if scope == "same":
        found = _own_first(entries, asked)
    known = dictionaries.select("dict_id", "dict_seq", "priority")
    return found.join(known, "dict_id").select("ref_id", "dict_id", "priority", "dict_seq", "entry_seq", "headword")
