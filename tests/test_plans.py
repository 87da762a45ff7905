"""Physical plans: what reaches the scan, and what isn't shuffled."""

import pytest

from glossmill.operators import fulltext, index, lookup, scope, spans


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "entries")
    rows = spark.range(2000).selectExpr("concat('d', id % 4) as dict_id", "id as entry_seq", "concat('Word', id) as headword", "id as byte_offset", "1L as byte_length")
    index.store(index.indexed(rows), path)
    return spark.read.parquet(path)


def test_lookup_is_pushed_down(stored):
    p = plan(lookup.exact(stored, "WORD7").select("headword"))
    assert "EqualTo(headword_normalized,word7)" in p and "Exchange" not in p and "byte_offset" not in p.split("ReadSchema")[1]


def test_prefixes_are_pushed_down(stored):
    assert "StringStartsWith(headword_normalized,word1)" in plan(lookup.prefix(stored, "Word1"))
    assert "StringStartsWith(headword_normalized,wo)" in plan(lookup.wildcard(stored, "wo?d*9"))
    assert "In(headword_normalized" in plan(lookup.exact_batch(stored, ["word1", "word2"]))


def test_partitions_are_pruned(spark, stored):
    known = spark.createDataFrame([(f"d{n}", n, f"n{n}", "en", "de") for n in range(4)], "dict_id string, dict_seq int, name string, source_lang string, target_lang string")
    inside = scope.in_scope(known, {"g": ["n1"]}, group="g")
    assert lookup.exact(stored, "word1").join(inside, "dict_id", "left_semi").count() == 1
    assert "PartitionFilters: [isnotnull(dict_id" in plan(stored.where("dict_id = 'd1'"))


def test_limits_are_top_n(stored):
    assert "TakeOrderedAndProject" in plan(lookup.prefix(stored, "word"))


def test_search_joins_no_postings_with_each_other(spark):
    docs = spark.createDataFrame([("d", 1, "h", "red skin")], "dict_id string, entry_seq long, headword string, definition string")
    p = plan(fulltext._hits(fulltext._as_postings(docs, ["red", "skin"]).entries, ["red", "skin"]))
    assert "Join" not in p and "Python" not in p


def test_a_search_reads_its_own_postings(spark, tmp_path):
    docs = spark.createDataFrame([("d", 1, "red", "skin red skin"), ("d", 2, "h", "blue skin")], "dict_id string, entry_seq long, headword string, definition string")
    fulltext.store_postings(docs, str(tmp_path / "index"))
    stored = fulltext.postings(spark, str(tmp_path / "index"))
    assert "In(token, [red,skin])" in plan(fulltext._hits(stored.entries, ["red", "skin"])) and "definition" not in plan(fulltext.search(stored, "red skin"))
    for query in ("red skin", "skin", "red red", "skin red skin", "absent"):
        assert sorted(map(tuple, fulltext.search(stored, query).collect())) == sorted(map(tuple, fulltext.search(docs, query).collect()))
    assert [r["entry_seq"] for r in fulltext.search(stored, "red skin red").collect()] == []


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace as Fake

    from glossmill.shared import built, delete, exists, shared_dir

    session = lambda master, folder=None: Fake(conf=Fake(get=lambda key, other: folder or other), sparkContext=Fake(master=master))
    assert shared_dir(session("local[4]")).startswith("file:") and shared_dir(session("spark://x:1", "hdfs://y/z")) == "hdfs://y/z"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://x:1"))
    made = []
    build = lambda path: (made.append(path), spark.range(3).write.parquet(path))
    first = built(spark, "threes", "/root/testdata/sf0.001/region.parquet", build)
    assert built(spark, "threes", "/root/testdata/sf0.001/region.parquet", build) == first and len(made) == 1 and spark.read.parquet(first).count() == 3
    assert built(spark, "threes", "/root/testdata/sf0.01/region.parquet", build) != first
    delete(spark, first)
    assert not exists(spark, first)


def test_range_join_is_an_equi_join(spark):
    blocks = spans.block_starts(spark.createDataFrame([("d", 0, 5, 70_000), ("d", 1, 5, 10)], "dict_id string, block int, packed int, size int"))
    records = spark.createDataFrame([("d", 69_999), ("d", 70_000), ("d", 70_010)], "dict_id string, byte_offset long")
    found = spans.blocks_of(records, blocks)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert sorted((r["byte_offset"], r["block"]) for r in found.collect()) == [(69_999, 0), (70_000, 1)]
