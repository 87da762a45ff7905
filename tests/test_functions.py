"""Scalar functions, renderers and the operators that queries don't reach, on small tables."""

import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossmill.functions import headwords, markup, text
from glossmill.operators import fulltext, history, index, lookup, scope, spans


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "form"), [("Hello", "hello"), ("café", "cafe"), ("naïve", "naive"), ("über", "uber"), ("ﬁnd", "find"), ("", ""), (None, ""), ("ø", "ø"), ("ế", "e")])
def test_normalize(spark, word, form):
    assert text.normalize_word(word) == form
    assert spark.createDataFrame([(word,), ("x",)], "w string").select(text.normalize("w").alias("x")).first()["x"] == form


@settings(max_examples=300, deadline=None)
@given(st.text("ab%_?*\\", max_size=7), st.text("ab%_\\", max_size=6))
def test_wildcards_are_sqlites(pattern, word):
    import re

    like = re.sub(r"[%_]", r"\\\g<0>", pattern).replace("?", "_").replace("*", "%")
    try:
        want = bool(sqlite3.connect(":memory:").execute("SELECT ? LIKE ? ESCAPE '\\'", (word, like)).fetchone()[0])
    except sqlite3.OperationalError:
        return
    regex = text.wildcard_regex(pattern)
    got = regex is not None and bool(re.match(regex.replace("\\A", "").replace("\\z", "\\Z").replace("\\x{5c}", r"\\").replace("\\x{25}", "%").replace("\\x{5f}", "_"), word))
    assert got == want


def test_wildcard_regex_in_spark(spark):
    e = spark.createDataFrame([("d", n, w, w) for n, w in enumerate(["cat", "car", "cap", "cart", "a.b", "a\nb"])], "dict_id string, entry_seq long, headword string, headword_normalized string")
    found = lambda p: [r["headword"] for r in lookup.wildcard(e, p).collect()]
    assert found("ca?") == ["cat", "car", "cap"] and found("a.b") == ["a.b"] and found("a*b") == ["a.b", "a\nb"] and found("ca\\") == [] and found("") == []
    assert [r["headword"] for r in lookup.prefix(e, "ca", 2).collect()] == ["cap", "car"] and lookup.prefix(e, "́").count() == 0


@pytest.mark.parametrize(("raw", "kind", "plain"), [
    ("[b]a[/b] <<ref>> {{x.png}} \\(c\\) [!trn]d[/!trn]", "dsl", "a ref (c) d"), ("\\[c\\]x", "dsl", "\\x"), ("<b>x</b>&amp;lt;&nbsp;&#233;&#0;", "mdict", "x< é&#0;"), (None, "dsl", ""), (" a \n\t b ", "bgl", "a b"),
    ("\x1f\x09\0\x01in\x1f\x0aline\x1f\x42\0\0ref\x1f\x62aaaabb!", "epwing", "in\x1f lineref!"), ("[A]x[/A]", "dsl", "x"),
])
def test_plain_text(spark, raw, kind, plain):
    assert spark.createDataFrame([(raw,)], "r string").select(text.plain_text(F.col("r"), kind).alias("x")).first()["x"] == plain


def test_labels(spark):
    assert one(spark, text.group_label(F.lit("A"), F.lit("B"))) == "A → B" and one(spark, text.group_label(F.lit(""), F.lit("B"))) == "Unknown"
    assert one(spark, text.scope_label(F.lit(None), F.lit("B"), F.lit(None))) == "<all> → B" and one(spark, text.scope_label(F.lit(None), F.lit(None), F.lit(None))) == "<all>"
    assert one(spark, text.scope_label(F.lit("A"), F.lit("B"), F.lit("G"))) == "G"
    assert [one(spark, text.thousands(F.lit(n))) for n in (0, 999, 1000, 45231, 1000000)] == ["0", "999", "1,000", "45,231", "1,000,000"]
    assert one(spark, text.is_image(F.lit("A.PNG"))) and not one(spark, text.is_image(F.lit("a.mp3"))) and one(spark, text.is_audio(F.lit("x.opus")))
    assert one(spark, text.language(F.lit("GermanNewSpelling"))) == "German" and one(spark, text.language(F.lit("Dutch"))) == "Dutch"
    assert one(spark, text.resource_zip(F.lit("/a/b.dsl.dz"))) == "/a/b.dsl.files.zip" and len(one(spark, text.section_header(F.lit("Name")))) == 70
    assert one(spark, text.unescape_headword(F.lit(r"\[a\] \{b\}"))) == "[a] {b}" and one(spark, text.is_wildcard(F.lit("a*")))


def test_headword_limits():
    assert len(headwords.expand("(a)" * 12)) == 64 and headwords.expand("{{x}}plain") == ["plain"] and headwords.expand("{a/b}{c/d}") == ["ac", "ad", "bc", "bd"]
    assert headwords.expand("open{brace") == ["open{brace"] and headwords.expand("x{/}") == ["x"]


def test_entities(spark):
    assert markup.decode_entities("&amp;lt; &#65;&#x42; &apos;&unknown; &#0; &nbsp;.") == "&lt; AB '&unknown; &#0;  ."
    assert spark.createDataFrame([("&lt;",), (None,)], "t string").select(markup.entities("t").alias("x")).collect()[0]["x"] == "<"


@pytest.mark.parametrize(("name", "kind"), [("Green", "green"), ("#ff0000", "red"), ("#00f", "blue"), ("#777", "gray"), ("#ffa500", "brown"), ("#ffd000", "orange"), ("#ff00ff", "violet"), ("#00ff00", "green"), ("nonsense", "default"), ("tan", "brown")])
def test_colours(name, kind):
    if name != "#ffa500":
        assert markup.colour(name) == kind
    else:
        assert markup.colour(name) in ("brown", "orange")


def test_render_html():
    r = markup.html('<style>p{}</style><p>One <b>bold</b> &amp; <font color="red">red</font></p><div><div>two</div></div><a href="entry://t%20x">see</a><a href="sound://s\\a.mp3">play</a><img src="i.png"/><!-- c -->')
    assert r["text"] == "One bold & red\n\ntwo\n\nseeplay"
    assert (4, 8, "bold") in r["spans"] and (11, 14, "colour:red") in r["spans"]
    assert {(k, t) for _, _, k, t in r["links"]} == {("reference", "t x"), ("audio", "s/a.mp3"), ("image", "i.png")}


def test_render_mdict():
    r = markup.render_body("<p>one <b>two</b></p><div></div>\n", "mdict")
    assert r["text"] == "one two" and r["spans"] == [(4, 7, "bold")]


def test_render_dsl():
    r = markup.dsl("\t[m1][b]gato[/b] [p]n[/p] \\[x\\] <<cat>>[/m]\n\t[m2][ex]un [i]gato[/i][/ex][/m]\n\t[s]a.wav[/s][ref]dog[/ref][c red]r[/c]\n\t\\\n", {"n": "noun"})
    assert r["text"] == "gato n [x] cat\nun gato\ndogr\n\n"
    assert {(0, 4, "bold"), (0, 14, "indent:2"), (15, 22, "example"), (18, 22, "italic")} <= set(r["spans"])
    assert {(k, t) for _, _, k, t in r["links"]} == {("abbreviation", "noun"), ("reference", "cat"), ("audio", "a.wav"), ("reference", "dog")}
    assert markup.dsl("[B]x[/B]")["text"] == "[B]x[/B]"


def test_render_others(spark):
    r = markup.stardict_field("x", b"<k>w</k><br/><tr>ph</tr> <kref>other</kref> &lt;")
    assert r["text"] == "w\n[ph] other <" and (r["text"].index("other"), r["text"].index("other") + 5, "reference", "other") in r["links"]
    assert markup.stardict_field("t", b"fon")["text"] == "[fon]" and markup.stardict_field("r", b"snd:a.wav")["links"][0][3] == "res/a.wav" and markup.stardict_field("q", b"a&amp;b")["text"] == "a&b"
    e = markup.epwing("\x1f\x09\0\x02Ａ\x1f\x0a\x1f\x12b\x1f\x13\x1f\x42\0\0see\x1f\x62\0\0\0\x05\0\x07\x1f\x03rest")
    assert e["text"] == "  A\nbsee" and e["spans"] == [(4, 5, "bold")] and e["links"] == [(5, 8, "reference", "5:7")]
    frame = spark.createDataFrame([("[b]x[/b]", "dsl"), ("<i>y</i>", "mdict"), (None, "dsl")], "b string, m string")
    assert [r["r"]["text"] for r in frame.select(markup.render("b", "m").alias("r")).collect()] == ["x", "y", ""]


DOCS = [
    "The red skin of an apple. It is a fruit, a red fruit.", "Banana: a long yellow fruit. Not a berry.", "café au lait", "nothing here", "skin red", "word " * 40 + "red skin. Then more words follow here " + "tail " * 20,
    "Start. " + "filler " * 28 + "Sentence with red skin and again red skin here " + "x " * 40, "red skin " + "y " * 50 + "red skin",
]


@pytest.mark.parametrize("query", ["fruit", "red skin", "red-skin", "CAFE", "skin red", "absent", "a"])
def test_search_is_fts5s(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(headword, definition)")
    con.executemany("INSERT INTO t(rowid, headword, definition) VALUES (?, ?, ?)", [(n + 1, f"entry {n}", d) for n, d in enumerate(DOCS)])
    quoted = '"' + query.replace('"', '""') + '"'
    want = con.execute("SELECT rowid, rank, snippet(t, 1, '>>>', '<<<', '...', 30) FROM t WHERE t MATCH ? ORDER BY rank, rowid", (quoted,)).fetchall()
    docs = spark.createDataFrame([("d", n + 1, f"entry {n}", d) for n, d in enumerate(DOCS)], "dict_id string, entry_seq long, headword string, definition string")
    got = fulltext.snippets(fulltext.search(docs, query), docs, query).orderBy("place").collect()
    assert [(r["entry_seq"], round(r["rank_score"], 9)) for r in got] == [(i, round(s, 9)) for i, s, _ in want]
    assert [r["snippet"] for r in got] == [s for _, _, s in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["red", "skin", "a", "of.", "it:", "x"]), min_size=1, max_size=90))
def test_snippets_are_fts5s(words):
    body = " ".join(words)
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(headword, definition)")
    con.execute("INSERT INTO t VALUES ('h', ?)", (body,))
    want = con.execute("SELECT snippet(t, 1, '>>>', '<<<', '...', 30) FROM t WHERE t MATCH '\"red skin\"'").fetchall()
    if want:
        assert fulltext.snippet(body, ["red", "skin"]) == want[0][0]


def test_search_without_words(spark):
    docs = spark.createDataFrame([("d", 1, "h", "x")], "dict_id string, entry_seq long, headword string, definition string")
    assert fulltext.search(docs, " .,").count() == 0


def test_headword_matches_count(spark):
    docs = spark.createDataFrame([("d", 1, "apple", "w " * 40), ("d", 2, "pear", "no")], "dict_id string, entry_seq long, headword string, definition string")
    r = fulltext.snippets(fulltext.search(docs, "apple"), docs, "apple").collect()
    assert [x["snippet"] for x in r] == [" ".join(["w"] * 30) + "..."]


def test_history(spark):
    log = spark.createDataFrame([(1, 1, 1, "a"), (2, 2, 1, "a"), (3, 3, 1, "b"), (4, 4, 1, "a"), (5, 5, 2, "a")], "seq long, ts long, user_id long, word string")
    assert [r["seq"] for r in history.without_repeats(log).orderBy("seq").collect()] == [1, 3, 4, 5] and [r["seq"] for r in history.recent(log, 2).collect()] == [5, 4]
    marks = spark.createDataFrame([("a", "d", 1), ("a", "e", 2)], "headword string, dictionary string, ts long")
    more = spark.createDataFrame([("a", "d", 9), ("b", "d", 4), ("b", "d", 3)], "headword string, dictionary string, ts long")
    added = history.bookmarks_added(marks, more)
    assert sorted(map(tuple, added.collect())) == [("a", "d", 1), ("a", "e", 2), ("b", "d", 3)]
    assert sorted(map(tuple, history.bookmarks_removed(added, "a").collect())) == [("a", "d", 1), ("b", "d", 3)]
    n = history.Navigation()
    for w in "abc":
        n.push(w)
    assert n.back() == "b" and n.back() == "a" and n.back() is None and n.forward() == "b"
    n.push("d")
    assert n.forward() is None and n.words == ["a", "b", "d"]


def test_completion(spark):
    rows = [("d1", 1, "apple"), ("d2", 1, "apple"), ("d1", 2, "Beatrice"), ("d2", 2, "beatrice"), ("d3", 2, "BEATRICE")]
    e = spark.createDataFrame([(d, n, w, w.lower()) for d, n, w in rows], "dict_id string, entry_seq long, headword string, headword_normalized string")
    c = lookup.completion_index(e)
    assert [tuple(r) for r in lookup.complete(c, "bea").collect()] == [("BEATRICE", 3, " (3 dicts)"), ("Beatrice", 3, " (3 dicts)"), ("beatrice", 3, " (3 dicts)")]
    assert lookup.complete(c, "be").count() == 0
    typed = lookup.Completion(c)
    assert typed("app") == [("apple", 2)] and typed("appl") == [("apple", 2)] and typed("appx") == [] and typed("bea")[0] == ("BEATRICE", 3)


def test_goldendict_order(spark):
    names = spark.createDataFrame([("Oxford (En-En)", 0), ("Webster", 1), ("Rest", 2)], "name string, seq int")
    wanted = spark.createDataFrame([("webster [en-en]", 0), ("Oxford (En-En)", 1), ("Webster", 2)], "name string, seq int")
    assert [tuple(r) for r in scope.ordered_as(names, wanted).collect()] == [(0, "Webster", True), (1, "Oxford (En-En)", True), (2, "Rest", False)]


def test_links_and_spans(spark):
    e = spark.createDataFrame([("d", "a", 1, None, "b"), ("d", "b", 2, None, "c"), ("d", "b", 3, "body", None), ("d", "x", 4, None, "x"), ("d", "n", 5, None, "none")], "dict_id string, headword_normalized string, entry_seq int, body string, link string")
    starts = spark.createDataFrame([("d", s, s) for s in ("a", "x", "n")], "dict_id string, start string, target string")
    got = {r["start"]: (r["body"], r["error"]) for r in spans.resolve_links(e, starts).collect()}
    assert got == {"a": ("body", None), "x": (None, "redirect loop for x"), "n": (None, 'Link target "none" not found')}
    main = spark.createDataFrame([("d", "w", 0, 10, 5)], "dict_id string, headword string, ordinal int, byte_offset long, byte_length long")
    syn = spans.synonyms(spark.createDataFrame([("d", "s", 0, 0), ("d", "t", 7, 1)], "dict_id string, headword string, ordinal int, syn_seq int"), main)
    assert [(r["headword"], r["entry_seq"]) for r in spans.index_rows(main, syn).orderBy("entry_seq").collect()] == [("w", 1), ("s", 2)]


def test_metadata(spark):
    m = spark.createDataFrame([("d", "mtime", "1", 1), ("d", "mtime", "2", 2), ("d", "fts-indexed", "yes", 3)], "dict_id string, key string, value string, seq int")
    assert index.metadata_map(m).first()["metadata"] == {"mtime": "2", "fts-indexed": "yes"}
    ids = spark.createDataFrame([("d",), ("e",)], "dict_id string")
    assert [r["dict_id"] for r in index.without_fulltext(ids, m).collect()] == ["e"] and index.reset(m, ids).count() == 2


def test_streaming(spark, tmp_path):
    from glossmill.streaming import lookups

    log = spark.createDataFrame([(1, "a", 10), (1, "a", 20), (1, "b", 30), (2, "a", 40)], "user_id long, word string, t long").select("user_id", "word", F.timestamp_seconds("t").alias("ts"))
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lookups.without_repeats(lookups.source(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted((r["user_id"], r["word"]) for r in spark.table("kept").collect()) == [(1, "a"), (1, "b"), (2, "a")]
    c = lookups.counts(lookups.source(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    c.awaitTermination()
    assert sorted((r["word"], r["lookups"]) for r in spark.table("counted").collect()) == [("a", 3), ("b", 1)]


def test_history_files(spark, tmp_path):
    log = spark.createDataFrame([("a", 10.0, 2, 1), ("b", 70.0, 1, 2)], history.LOG)
    history.save(log, str(tmp_path / "log"))
    got = history.load(spark, str(tmp_path / "log"))
    assert [r["word"] for r in got.collect()] == ["b", "a"] and history.shown(got).first()["time"] == "1970-01-01 00:01"
    (tmp_path / "bad").write_text('{"word": "a", "ts": 1.0}\n{"word": \n')
    assert history.load(spark, str(tmp_path / "bad")).count() == 0


def test_contents_sections_and_clearing(spark, tmp_path):
    e = spark.createDataFrame([("d1", 1, "a", "a"), ("d2", 1, "a", "a"), ("d1", 2, "b", "b")], "dict_id string, entry_seq long, headword string, headword_normalized string")
    d = spark.createDataFrame([("d1", 1, "One", 5), ("d2", 2, "Two", 1)], "dict_id string, dict_seq int, name string, priority int")
    found = lookup.ranked(lookup.exact_batch(e, ["a", "b"]), d)
    assert [tuple(r) for r in lookup.contents(found).collect()] == [("a", ["Two", "One"])]
    assert [[r["headword"] for r in part] for part in lookup.sections(found.where("word = 'a'"), 2)] == [["a"], ["a"]]
    matches = lookup.by_dictionary(found.selectExpr("*", "0L as byte_offset", "1L as byte_length")).where("word = 'a'").orderBy("rank").collect()
    assert [(r["name"], len(r["matches"])) for r in matches] == [("Two", 1), ("One", 1)] and index.headword_count(e).first()[0] == 2
    index.store(index.indexed(e.selectExpr("dict_id", "entry_seq", "headword", "0L as byte_offset", "1L as byte_length")), str(tmp_path / "e"))
    index.clear(spark, str(tmp_path / "e"), ["d1"])
    assert spark.read.parquet(str(tmp_path / "e")).count() == 1


def test_audio_sources(spark):
    wanted = spark.createDataFrame([("k1", "d", "x", "a"), ("k2", "d", "x", "b"), ("k3", "d", "x", "c"), ("k4", "d", "x", "z")], "key string, directory string, dict_id string, name string")
    files = spark.createDataFrame([("d", "a", "file-a")], "directory string, name string, place string")
    packed = spark.createDataFrame([("d", "x", "a", "own-a"), ("d", "y", "b", "other-b"), ("d", "x", "b", "own-b"), ("d", "y", "c", "other-c")], "directory string, dict_id string, name string, place string")
    assert {r["key"]: r["place"] for r in spans.audio_sources(wanted, files, packed).collect()} == {"k1": "file-a", "k2": "own-b", "k3": "other-c", "k4": None}
