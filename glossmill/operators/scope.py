"""Which dictionaries take part: groups, languages, priorities, and the order that another program keeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.text import goldendict_normalize


def in_scope(dictionaries: DataFrame, groups: Mapping[str, Sequence[str]] | None = None, group: str | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
    """A named group's dictionaries; else those of the languages that are set; else all."""
    if group is not None:
        names = dictionaries.sparkSession.createDataFrame([(n,) for n in (groups or {}).get(group, ())], "name string")
        return dictionaries.join(names, "name", "left_semi")
    if source is not None:
        dictionaries = dictionaries.where(F.col("source_lang") == source)
    if target is not None:
        dictionaries = dictionaries.where(F.col("target_lang") == target)
    return dictionaries


def languages(dictionaries: DataFrame, side: str = "source", source: str | None = None) -> DataFrame:
    """Different languages of one side, in order; of the target side those that go with a source, if given."""
    column = f"{side}_lang"
    if side == "target" and source is not None:
        dictionaries = dictionaries.where(F.col("source_lang") == source)
    return dictionaries.where(F.col(column) != "").select(column).distinct().orderBy(column)


def with_priorities(dictionaries: DataFrame, priorities: DataFrame) -> DataFrame:
    """Priorities (name, priority, seq) by name, of several the first; 0 where there is none."""
    first = priorities.groupBy("name").agg(F.min_by("priority", "seq").alias("priority"))
    return dictionaries.drop("priority").join(first, "name", "left").withColumn("priority", F.coalesce("priority", F.lit(0)))


def ordered_as(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """Names (name, seq) in the order of another program's (name, seq), one use each: by the very name, else by the
    first name of the same normalised form; the rest follow in their own order. Returns (position, name, matched).

    Which name is used up depends on those before it, so the last step walks over the names on the driver; both
    lists are the dictionaries of one user."""
    have = names.select("name", goldendict_normalize(F.col("name")).alias("form"), "seq").orderBy("seq").collect()
    asked = wanted.select("name", goldendict_normalize(F.col("name")).alias("form"), "seq").orderBy("seq").collect()
    first = {}
    for r in have:
        first.setdefault(r["form"], r["name"])
    left, out = dict.fromkeys(r["name"] for r in have), []
    for r in asked:
        match = r["name"] if r["name"] in left else first.get(r["form"])
        if match in left:
            del left[match]
            out.append(match)
    rows = [(n, name, n < len(out)) for n, name in enumerate([*out, *left])]
    return names.sparkSession.createDataFrame(rows, "position int, name string, matched boolean")


def priorities_of(ordered: DataFrame) -> DataFrame:
    """Positions as priorities."""
    return ordered.select("name", F.col("position").alias("priority"), F.col("position").alias("seq"))


def discovered(dictionaries: DataFrame, key: str = "dict_id") -> DataFrame:
    """Numbers dictionaries in order of discovery. There are as many rows as dictionaries."""
    return dictionaries.withColumn("dict_seq", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)))
