"""Stages of the pipeline, each on its own input, against brute force."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossmill.llm import bits, html_text, session, tokens  # noqa: F401  the subpackage is there
from tests.conftest import SF, SMALL
from tests.llm.test_operators import EDGES, deduplicated, grouped

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def edges(spark, empty=False):
    return spark.createDataFrame([] if empty else [(i, t, "en", "s", len(t) if t else None) for i, t in EDGES], COLUMNS)


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("stage", range(5))
def test_stages_on_edges(spark, stage, empty):
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, edges(spark, empty), SMALL)
    assert out.count() == 0 if empty else out.count() > 0
    assert stage == 4 or out.columns == [c.split()[0] for c in COLUMNS.split(", ")]


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_clashing_columns(spark, stage):
    """Columns with names that the operators use come through with their own values."""
    names = ("doc", "score", "rejected", "lang_pred", "n_words", "n_removed", "key", "at", "class", "size", "component_id", "__key", "__lang", "__words", "a b", "x.y")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")
    for n, c in enumerate(names):
        docs = docs.withColumn(c, F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")))
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SMALL)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{n}-{r['doc_id']}" for r in rows for n, c in enumerate(names))


def test_language_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars").unionAll(docs.limit(1).withColumn("doc_id", F.lit(-2).cast("long")).withColumn("text", F.lit("123 %%% 456")))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionAll(extra), SF).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_one_of_each_group_stays(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {i for i, _, c in grouped(pairs) if i == c}
    assert {str(r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()} == want
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, edges(spark), SMALL).collect()) == sorted(
        ["None", "None", *({i for i, _, c in grouped(EDGES) if i == c and i != "None"})]
    )


def test_repeated_passages_go(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = corpus_pipeline.substring_dedup(spark, docs, SMALL).collect()
    assert sorted((str(r["doc_id"]), b" ".join(r["text"].encode().split())) for r in got) == [(i, k) for i, _, _, k in deduplicated(pairs)]
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_whole_pipeline(spark):
    """The stages one after another give what run() gives: every piece of every document that is left."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    want = sorted(tuple(r[c] for c in key) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect())
    assert sorted(tuple(r[c] for c in key) for r in corpus_pipeline.run(spark, SMALL).collect()) == want


def test_stages_send_small_batches(spark):
    """Five stages share the executors' memory, so each sets batches that hold some megabytes of texts at most."""
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    rows = [(i, f"some words of text {i}", "en", "s", 20 + i) for i in range(6)]
    for name, stage in corpus_pipeline.STAGES:
        other = spark.newSession()
        docs = other.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        stage(other, docs, SMALL)
        sent = other.range(3000, numPartitions=1).mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]
        assert sent <= 512 and int(other.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 1024, name


def test_tasks_end_by_giving_memory_back(spark, monkeypatch):
    """Workers stay for the next stages: what a task has freed goes back, also if its rows aren't read to the end."""
    gone = []
    monkeypatch.setattr(session, "give_back", lambda: gone.append(1))
    assert list(session.frugal(lambda rows: (2 * x for x in rows))(iter([1, 2]))) == [2, 4] and len(gone) == 1
    some = session.frugal(lambda rows: (x for x in rows))(iter([1, 2]))
    assert next(some) == 1
    some.close()
    assert len(gone) == 2


def test_packing_needs_no_second_kind_of_worker(spark):
    """Rows of Python would be read by workers of a daemon of their own."""
    packed = corpus_pipeline.best_fit_packing(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert packed.count() > 0 and "ExistingRDD" not in packed._jdf.queryExecution().toString()


def test_plain_texts_load_one_vocabulary(monkeypatch):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = tokenizers.Tokenizer.from_file(path).encode("some plain text", add_special_tokens=False).ids
    monkeypatch.setattr(tokenizers, "Tokenizer", None)
    assert tokens.encoder.__wrapped__(path)("some plain text").tolist() == want


def test_a_filter_comes_in_small_batches(spark):
    """One of 4 MB from a task was one batch, and so is one buffer that the JVM doesn't pool."""
    sent = []

    class Keys:
        sparkSession = spark

        def mapInArrow(self, f, _):
            sent.extend(f(iter([pa.RecordBatch.from_arrays([pa.array(range(100_000), pa.int64())], ["key"])])))
            return spark.createDataFrame(pa.Table.from_batches(sent), "k int, bits binary")

    found = bits.build(Keys(), 1 << 22)
    assert max(b.nbytes for b in sent) < 2 << 20 and sum(b.num_rows for b in sent) == 64
    assert bits.contains(found.value, np.arange(100_000, dtype=np.uint64)).all()
