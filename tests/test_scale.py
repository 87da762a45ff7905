"""Steps whose time or memory a task grew faster than the input."""

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from glossmill.functions import text
from glossmill.operators import fulltext, index, lookup
from glossmill.plans import corpus


def test_normalized_equals_its_model(spark):
    random.seed(5)
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    odd = "ΣσςAa1ʰ'’.·́̈ͅİIiß한글ﬁǅ Éñ𝅗𝅥ⁱ"
    words = every + ["".join(random.choices(odd, k=random.randint(0, 7))) for _ in range(20_000)] + [None, "", "ΟΔΥΣΣΕΥΣ", "ΑΣ ΒΣ", "x" * 100_000 + "É"]
    got = spark.createDataFrame([(n, w) for n, w in enumerate(words)], "n long, word string").select("n", text.normalized(F.col("word")).alias("form")).collect()
    assert [(words[r["n"]], r["form"]) for r in got if r["form"] != text.normalize_word(words[r["n"]])] == [] and len(got) == len(words)


def test_entries_are_indexed_without_python(spark):
    rows = spark.createDataFrame([("d", 1, "Élan", 0, 4)], "dict_id string, entry_seq long, headword string, byte_offset long, byte_length long")
    found = index.indexed(rows)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and found.first()["headword_normalized"] == "elan"


def test_common_words_are_not_one_tasks(spark):
    e = spark.createDataFrame([(d, n, w, w) for n, (d, w) in enumerate([("d1", "a"), ("d1", "a"), ("d2", "a"), ("d3", "b"), ("d2", "b"), ("d3", "")])], "dict_id string, entry_seq long, headword string, headword_normalized string")
    d = spark.createDataFrame([("d1", 1, "One", 5), ("d2", 2, "Two", 5), ("d3", 3, "Three", 1)], "dict_id string, dict_seq int, name string, priority int")
    found = lookup.ranked(lookup.exact_batch(e, ["a", "b", None]), d)
    got = sorted((r["word"] or "", r["rank"], r["name"], r["entry_seq"]) for r in found.collect())
    assert got == [("", 1, "Three", 5), ("a", 1, "One", 0), ("a", 1, "One", 1), ("a", 2, "Two", 2), ("b", 1, "Three", 3), ("b", 2, "Two", 4)]
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Window [")
    assert len(above) == 2 and "Aggregate [word" in above[1]


def test_references_meet_only_what_they_return(spark):
    random.seed(3)
    entries = [(f"d{random.randint(1, 4)}", n, f"w{random.randint(1, 9)}") for n in range(60)]
    asked = [(random.choice(["r1", "r2", "r3", None]), f"d{random.randint(1, 5)}", f"w{random.randint(1, 12)}") for _ in range(12)]
    e = spark.createDataFrame([(d, n, w, w) for d, n, w in entries], "dict_id string, entry_seq long, headword string, headword_normalized string")
    d = spark.createDataFrame([(f"d{n}", n, n) for n in range(1, 5)], "dict_id string, dict_seq int, priority int")
    found = lookup.follow(e, d, spark.createDataFrame(asked, "ref_id string, dict_id string, target_normalized string"), "same")
    whole = [(r, f, d, n) for r, f, t in asked for d, n, w in entries if t == w]
    own = {r for r, f, d, n in whole if f == d}
    want = sorted((r or "", d, n) for r, f, d, n in whole if r not in own or f == d)
    assert sorted((r["ref_id"] or "", r["dict_id"], r["entry_seq"]) for r in found.collect()) == want
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_postings_and_hits_equal_their_model(spark, tmp_path, monkeypatch):
    random.seed(4)
    words = ["red", "Réd", "skin", "of", "the", "É", "·"]
    docs = [(f"d{n % 3}", n, random.choice(["h", "", None, "red skin"]), random.choice([None, "", " ".join(random.choices(words, k=random.randint(1, 40)))])) for n in range(300)] + [("d", 1000, "h", "red " * 20_000)]
    frame = spark.createDataFrame(docs, "dict_id string, entry_seq long, headword string, definition string")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    fulltext.store_postings(frame.repartition(3), str(tmp_path / "index"), 5)
    stored = fulltext.postings(spark, str(tmp_path / "index"))
    assert spark.conf.get(setting) == before and sorted(p.name for p in (tmp_path / "index").iterdir()) == ["documents", "entries", "totals"]
    names = {(d, n): fulltext._python_tokens(h or "") + [""] + fulltext._python_tokens(t or "") for d, n, h, t in docs}
    want = sorted((w, *key, [i for i, x in enumerate(tokens) if x == w]) for key, tokens in names.items() for w in set(tokens) - {""})
    assert sorted(map(tuple, stored.entries.collect())) == want
    assert sorted((r["dict_id"], r["entry_seq"], r["length"]) for r in stored.documents.collect()) == sorted((*key, len(tokens) - 1) for key, tokens in names.items())
    for query in (["red"], ["red", "skin"], ["red", "red"], ["of", "the", "of"], ["absent", "red"]):
        hits = {key: n for key, tokens in names.items() if (n := sum(tokens[i : i + len(query)] == query for i in range(len(tokens))))}
        assert {(r["dict_id"], r["entry_seq"]): r["hits"] for r in fulltext._hits(stored.entries, query).collect()} == hits
    assert "explode" not in fulltext._hits(stored.entries, ["of", "the"])._jdf.queryExecution().optimizedPlan().toString()


def test_documents_of_one_id_share_their_postings(spark, tmp_path):
    frame = spark.createDataFrame([("d", 1, "h", "red skin"), ("d", 1, "h", "red"), ("d", 2, "h", "red")], "dict_id string, entry_seq long, headword string, definition string")
    fulltext.store_postings(frame, str(tmp_path / "index"))
    got = fulltext.postings(spark, str(tmp_path / "index")).entries.where("token = 'red'").collect()
    assert sorted((r["entry_seq"], r["at"]) for r in got) == [(1, [2, 2]), (2, [2])]


def test_snippets_shuffle_no_texts(spark, tmp_path):
    frame = spark.createDataFrame([("d", 1, "h", "red skin")], "dict_id string, entry_seq long, headword string, definition string")
    frame.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found = fulltext.snippets(spark.createDataFrame([("d", 1)], "dict_id string, entry_seq long"), docs, "skin")
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString() and found.first()["snippet"] == "red >>>skin<<<"


def test_partitions_grow_with_the_table(spark):
    from glossmill.shared import partitions_for

    table = "/root/testdata/sf0.01/documents.parquet"
    assert partitions_for(spark, table, 1 << 40) == 4 and partitions_for(spark, table, 10_000) > 100
    entries = corpus.stored_entries(spark, "/root/testdata/sf0.001")
    assert entries.count() > 0
