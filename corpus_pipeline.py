"""The training-data pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import decontaminate, langid, packing, substrings
from glossmill.llm.jaccard import JaccardJoin
from glossmill.llm.session import for_stages, read, unused
from glossmill.llm.workspace import Workspace


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models accept, learned from the labelled two thirds of them.

    Null texts, and texts without letters, go; so do all if nothing is labelled. Rows are judged each on their own, so
    repeated ones stay or go together. No rows: no rows. Columns keep their values, whatever their names.
    """
    for_stages(spark)
    models = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    names = tuple(unused(docs.columns, f"__{x}") for x in ("lang", "score", "rejected"))
    return langid.identify(docs, models, names).where(~F.col(names[2])).select(_own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the least doc_id.

    Rows that repeat a doc_id and a text stay once; rows without a doc_id, with null, empty or wordless texts stay. No
    rows: no rows. Columns keep their values, whatever their names.
    """
    for_stages(spark)
    work = Workspace(spark, "near-duplicates")
    rows = work.cut(JaccardJoin().groups(docs), "groups")
    # Both lists are written first, so Spark broadcasts them if they are small and else shuffles.
    dropped = work.cut(rows.where("component_id <> doc_id").select("doc_id").distinct(), "dropped")
    kept = docs.join(dropped, "doc_id", "left_anti").select(_own(docs))
    repeated = work.cut(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(_own(docs)).unionByName(once.select(_own(docs)))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words and more that an earlier one has.

    Null and empty texts stay as they are, as do rows without a doc_id; a text may become empty, and its row stays.
    n_chars follows the text. Of repeated rows each keeps its words, or loses them to a smaller doc_id. No rows: no
    rows. Other columns keep their values, whatever their names.
    """
    for_stages(spark)
    out = substrings.dedup(docs, counts=(unused(docs.columns, "__words"), unused(docs.columns, "__removed")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(_own(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts stay, as do rows without a doc_id; rows that repeat a doc_id go if one of them has a passage. No
    rows: no rows. Columns keep their values, whatever their names.
    """
    for_stages(spark)
    found = Workspace(spark, "leaks").cut(decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark")), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(_own(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences of 2048 tokens.

    A null or empty text is a document of its end token; rows that repeat a doc_id are packed each on their own, and a
    null doc_id stays null. No rows: no rows. Columns other than doc_id and text are left out.
    """
    for_stages(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language models and token ids have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.cut(stage(spark, docs, sf_dir), name, release=True)
    return STAGES[-1][1](spark, docs, sf_dir)
