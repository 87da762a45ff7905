"""Registered queries that read dictionary files, render bodies and keep an index, and their SQL.

The files are written from the nation and region tables, so the SQL tells from these what the readers must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.engine import Engine
from glossmill.functions import markup, text
from glossmill.operators import history, index, lookup, scope, spans
from glossmill.plans import library
from glossmill.plans.library import NATIONS
from glossmill.plans.registered import query, values
from glossmill.shared import fresh, put
from glossmill.sources import codecs, dictproto, scan


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(dict_id, file): the dictionaries that discovery finds, by their path below the folder."""
    return scan.discover(spark, [folder]).select("dict_id", F.regexp_extract("path", "/library-[^/]*/(.*)$", 1).alias("file"))


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    found = scan.entries(spark, [folder]).join(_files(spark, folder), "dict_id")
    return found.select("file", "entry_seq", "headword", "byte_offset", "byte_length")


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies as they are, as plain text for searching, and rendered."""
    found = scan.bodies(spark, [folder]).join(_files(spark, folder), "dict_id")
    return found.select("file", "entry_seq", "headword", "raw", text.plain_text(F.col("raw"), F.col("markup")).alias("plain"), markup.render("raw", "markup")["text"].alias("shown"))


def _spans(rendered: Column) -> Column:
    return F.array_join(F.transform(rendered["spans"], lambda s: F.format_string("%d-%d %s", s["start"], s["end"], s["style"])), "; ")


def _links(rendered: Column) -> Column:
    return F.array_join(F.transform(rendered["links"], lambda s: F.format_string("%d-%d %s %s", s["start"], s["end"], s["kind"], s["target"])), "; ")


# --- discovery


@query(values("file, format_name, name, source_lang, target_lang, grp", [
    *((f, "dsl", "Nations", "English", "Spanish", "English → Spanish") for f in ("plain.dsl", "bom.dsl", "le.dsl", "be.dsl", "packed.dsl.dz")),
    *((f"{x}.ifo", "stardict", "Nations Star", "", "", "Unknown") for x in "abcd"), *((f"{x}.mdx", "mdict", "Nations & MDict", "", "", "Unknown") for x in library.MDICT_KINDS),
    ("untitled.mdx", "mdict", "untitled", "", "", "Unknown"), ("short.bgl", "bgl", "Nations Babylon", "English", "Spanish", "English → Spanish"), ("one/NATIONS/DATA/HONMON", "epwing", "Nations", "", "", "EPWING"),
    ("two/NATIONS/DATA/HONMON.EBZ", "epwing", "Nations", "", "", "EPWING"), ("three/NATIONS/START", "epwing", "Nations", "", "", "EPWING"),
]))
def discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all formats, side tables and others among them."""
    rows = library.nations(spark, sf_dir)
    files = library.dsl_files(rows) | library.stardict_files(rows) | library.mdict_files(rows) | {"short.bgl": library.bgl(rows), "no.bgl": b"\x12\x34\x00\x03", "no.ifo": b"x", "zero.mdx": bytes(8)} | library.epwing_files(rows)
    found = scan.discover(spark, [library.written(spark, "all", files)])
    return found.select(F.regexp_extract("path", "/library-[^/]*/(.*)$", 1).alias("file"), "format_name", "name", "source_lang", "target_lang", F.col("group").alias("grp"))


@query("SELECT 'bad.ifo' AS file, NULL::VARCHAR AS name, true AS failed UNION ALL SELECT 'good.ifo', 'Nations Star', false")
def discover_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary that can't be read has an error, and the others are found."""
    ifo, idx, data = library.stardict(library.nations(spark, sf_dir))
    folder = library.written(spark, "broken", {"good.ifo": ifo, "good.idx": idx, "good.dict": data, "bad.ifo": b"  StarDict's dict ifo file!\nwordcount=1\n"})
    return scan.discover(spark, [folder]).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "name", F.col("error").isNotNull().alias("failed"))


# --- DSL

_DSL = f"""{NATIONS},
  h AS (SELECT k, w, b, CASE WHEN k % 3 = 0 THEN [w, w || 's', w] ELSE [w] END AS heads, CASE WHEN k % 3 = 0 THEN w || chr(10) || w || '(s)' || chr(10) ELSE w || chr(10) END AS t, chr(9) || '[m1]' || b || '[/m]' || chr(10) AS body FROM n),
  p AS (SELECT *, {len(library.DSL_HEADER)} + coalesce(sum(length(t) + length(body)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(t) + 1 AS pos FROM h),
  e AS (SELECT k, b, body, pos, unnest(heads) AS headword, unnest(range(len(heads))) AS j FROM p),
  r AS (SELECT *, row_number() OVER (ORDER BY k, j) - 1 AS entry_seq FROM e), f(file) AS (VALUES ('plain.dsl'), ('bom.dsl'), ('le.dsl'), ('be.dsl'), ('packed.dsl.dz'))"""


@query(f"WITH {_DSL} SELECT file, entry_seq::BIGINT AS entry_seq, headword, pos::BIGINT AS byte_offset, length(body)::BIGINT AS byte_length FROM r, f")
def dsl_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text in four encodings and packed; later headwords come first."""
    return _entries(spark, library.written(spark, "dsl", library.dsl_files(library.nations(spark, sf_dir))))


@query(f"WITH {_DSL} SELECT file, entry_seq::BIGINT AS entry_seq, headword, body AS raw, b AS plain, b || chr(10) AS shown FROM r, f")
def dsl_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, E7, E12."""
    return _bodies(spark, library.written(spark, "dsl", library.dsl_files(library.nations(spark, sf_dir))))


@query(values("tag, expansion", [("noun", "sustantivo"), ("f", "femenino"), ("adv", None)]))
def dsl_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side table of a DSL file, whose first definitions count, joined with tags."""
    side = scan.abbreviations(spark, [library.written(spark, "dsl", library.dsl_files(library.nations(spark, sf_dir)))])
    tags = side.select("dict_id").distinct().select("dict_id", F.explode(F.array(F.lit("noun"), F.lit("f"), F.lit("adv"))).alias("tag"))
    return spans.with_abbreviations(tags, side).select("tag", "expansion")


# --- codecs


@query(f"""WITH {NATIONS}, t AS (SELECT string_agg(w || ' ', '' ORDER BY k) AS t FROM n), r AS (SELECT DISTINCT (k * 37 % 290)::BIGINT AS o, (k * 13 % 90)::BIGINT AS l FROM n)
  SELECT kind, o AS begin, l AS size, substr(t, o + 1, l) AS piece FROM t, r, (VALUES ('dictzip'), ('ebzip')) k(kind)""")
def random_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of packed data, across chunks and slices."""
    names = [w for w, _ in library.nations(spark, sf_dir)]
    data = "".join(f"{w} " for w in names).encode()
    packed = {"dictzip": codecs.DictZip(codecs.dictzip(data, 50)).read, "ebzip": codecs.EbZip(codecs.ebzip(data)).read}
    asked = sorted({(k * 37 % 290, k * 13 % 90) for k in range(len(names))})
    return spark.createDataFrame([(kind, o, n, read(o, n).decode()) for kind, read in packed.items() for o, n in asked], "kind string, begin long, size long, piece string")


@query(values("message, digest", [("", "cdf26213a150dc3ecb610f18f6b38b46"), ("a", "86be7afa339d0fc7cfc785e72f578d33"), ("abc", "c14a12199c66e4ba84636b0f69144c77"), ("message digest", "9e327b3d6e523062afc1132d7df9d1b8"),
    ("abcdefghijklmnopqrstuvwxyz", "fd2aa607f71dc8f510714922b371834e"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "d1e959eb179c911faea4624c60c5c702")]))
def ripemd128(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests that the algorithm's authors publish."""
    messages = ("", "a", "abc", "message digest", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    return spark.createDataFrame([(m,) for m in messages], "message string").select("message", text.ripemd128_hex("message").alias("digest"))


@query("SELECT n_nationkey::BIGINT * 257 AS n, width, n_nationkey::BIGINT * 257 + marker AS decoded FROM nation, (VALUES (2, 0), (4, 16777216), (5, 4294967296), (8, 281474976710656)) t(width, marker)")
def integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Big-endian numbers of 16, 32, 40 and 64 bits."""
    keys = range(len(library.nations(spark, sf_dir)))
    high = {2: 0, 4: 1 << 24, 5: 1 << 32, 8: 1 << 48}
    return spark.createDataFrame([(k * 257, w, codecs.Bytes((k * 257 + m).to_bytes(w, "big")).number(w)) for k in keys for w, m in high.items()], "n long, width int, decoded long")


# --- StarDict

_STAR = f"""{NATIONS}, x AS (SELECT k, w, b, strlen(b) AS size, 3 + strlen(w) + strlen(b) + 1 AS typed FROM n),
  m AS (SELECT *, coalesce(sum(size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, coalesce(sum(typed) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS typed_pos FROM x),
  s AS (SELECT file, k AS entry_seq, w AS headword, pos AS byte_offset, size AS byte_length, b AS raw FROM m, (VALUES ('a.ifo'), ('b.ifo'), ('c.ifo')) f(file)
        UNION ALL SELECT 'b.ifo', (SELECT count(*) FROM n) + k // 2, 'syn ' || w, pos, size, b FROM m WHERE k % 2 = 0
        UNION ALL SELECT 'd.ifo', k, w, typed_pos, typed, lower(w) || chr(10) || b FROM m)"""


@query(f"WITH {_STAR} SELECT file, entry_seq::BIGINT AS entry_seq, headword, byte_offset::BIGINT AS byte_offset, byte_length::BIGINT AS byte_length FROM s")
def stardict_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three widths of offsets; synonyms behind the entries, without the one out of range."""
    return _entries(spark, library.written(spark, "star", library.stardict_files(library.nations(spark, sf_dir))))


@query(f"WITH {_STAR} SELECT file, entry_seq::BIGINT AS entry_seq, headword, raw, replace(raw, chr(10), ' ') AS plain, raw AS shown FROM s")
def stardict_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E14 and S10 through the packed file."""
    return _bodies(spark, library.written(spark, "star", library.stardict_files(library.nations(spark, sf_dir))))


STAR_FIELDS = (
    ("m", "a&amp;b", "a&b", "", ""), ("t", "fon", "[fon]", "0-5 italic", ""), ("x", "<k>w</k><br/><tr>ph</tr> <kref>other</kref>", "w\n[ph] other", "0-1 bold; 2-6 italic", "7-12 reference other"),
    ("h", "<b>x</b> y", "x y", "0-1 bold", ""), ("g", "<i>x</i>", "x", "0-1 italic", ""), ("r", "snd:a.wav", "", "", "0-0 audio res/a.wav"), ("W", "xyz", "", "", "0-0 audio wav"), ("q", "&lt;", "<", "", ""),
)


@query(values("kind, body, shown, spans, links", STAR_FIELDS))
def stardict_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by type."""
    rows = spark.createDataFrame([r[:2] for r in STAR_FIELDS], "kind string, body string")
    r = markup.render_field("kind", "body")
    return rows.select("kind", "body", r.alias("r")).select("kind", "body", F.col("r.text").alias("shown"), _spans(F.col("r")).alias("spans"), _links(F.col("r")).alias("links"))


# --- MDict

_MDICT = f"""{NATIONS}, a AS (SELECT k, w, b FROM n UNION ALL SELECT (SELECT count(*) FROM n), 'see ' || w, '@@@LINK=' || w FROM n WHERE k = 0),
  c AS (SELECT *, strlen(b) + 3 AS narrow, 2 * (length(b) + 3) AS wide FROM a),
  o AS (SELECT *, coalesce(sum(narrow) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS narrow_at, coalesce(sum(wide) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wide_at FROM c),
  s AS (SELECT kind || '.mdx' AS file, k AS entry_seq, w AS headword, CASE kind WHEN 'wide' THEN wide_at ELSE narrow_at END AS byte_offset, b || chr(13) || chr(10) AS raw FROM o, (VALUES ('plain'), ('encrypted'), ('old'), ('wide'), ('stored'), ('lzo')) t(kind)
        UNION ALL SELECT 'untitled.mdx', k, w, 0, b || chr(13) || chr(10) FROM n WHERE k = 0)"""


@query(f"WITH {_MDICT} SELECT file, entry_seq::BIGINT AS entry_seq, headword, byte_offset::BIGINT AS byte_offset, 0::BIGINT AS byte_length FROM s")
def mdict_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions 1 and 2, encrypted, in UTF-16, stored, and packed by LZO."""
    return _entries(spark, library.written(spark, "mdict", library.mdict_files(library.nations(spark, sf_dir))))


@query(f"WITH {_MDICT} SELECT file, entry_seq::BIGINT AS entry_seq, headword, raw, trim(raw, chr(13) || chr(10)) AS plain, trim(raw, chr(13) || chr(10)) AS shown FROM s")
def mdict_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several blocks, each up to the next offset."""
    return _bodies(spark, library.written(spark, "mdict", library.mdict_files(library.nations(spark, sf_dir))))


@query(f"WITH {NATIONS} SELECT 'see ' || w AS word, b AS plain, NULL::VARCHAR AS error FROM n WHERE k = 0 UNION ALL SELECT w, b, NULL FROM n")
def mdict_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects of a real file resolved."""
    folder = library.written(spark, "mdict", {"a.mdx": library.mdict_files(library.nations(spark, sf_dir))["plain.mdx"]})
    rows = scan.bodies(spark, [folder])
    target = F.when(F.col("raw").startswith("@@@LINK="), F.btrim(F.substring("raw", 9, 1_000_000), F.lit(" \r\n")))
    entries = rows.select("dict_id", text.normalize("headword").alias("headword_normalized"), "headword", "entry_seq", F.col("raw").alias("body"), F.when(target.isNotNull(), text.normalize(target)).alias("link"))
    starts = entries.select("dict_id", F.col("headword").alias("start"), F.col("headword_normalized").alias("target"))
    return spans.resolve_links(entries, starts).select(F.col("start").alias("word"), text.plain_text(F.col("body"), "mdict").alias("plain"), "error")


@query(f"WITH {NATIONS} SELECT '/img/' || lower(w) || '.png' AS key, b AS content FROM n UNION ALL SELECT 'note.txt', 'in the archive'")
def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an MDict resource file and of a companion archive."""
    files = library.mdict_files(library.nations(spark, sf_dir))
    folder = library.written(spark, "mdd", {"plain.mdx": files["plain.mdx"], "plain.mdd": files["plain.mdd"], "plain.mdx.files.zip": library.archive({"note.txt": b"in the archive"})})
    return scan.resources(spark, [folder]).select("key", F.col("content").cast("string").alias("content"))


@query(f"""WITH {NATIONS} SELECT 'IMG\\' || w || '.png' AS key, CASE WHEN k % 2 = 0 THEN b END AS content, k % 2 <> 0 AS missing FROM n""")
def resource_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in any case and with either slash, as given or with a leading one; absent ones are known as missing, also
    when they are asked for again."""
    rows = library.nations(spark, sf_dir)
    held = library.mdx([(f"\\Img\\{w}.PNG", b.encode().hex()) for w, b in rows[::2]], resources=True)
    folder = library.written(spark, "mdd", {"plain.mdx": library.mdx(rows), "plain.mdd": held})
    stored = scan.resources(spark, [folder])
    keys = stored.select("dict_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([(f"IMG\\{w}.png",) for w, _ in rows], "key string")))
    cache = fresh(spark, "resource-cache")
    index.cache_resources(keys.where("key < 'IMG\\\\NATION_2'"), stored, cache)
    return index.cache_resources(keys, stored, cache).select("key", F.col("content").cast("string").alias("content"), "missing")


# --- BGL

_BGL = f"""{NATIONS}, f(file, long) AS (VALUES ('short.bgl', false), ('long.bgl', true)),
  v AS (SELECT k, w, b, file, CASE WHEN k % 2 = 0 THEN [w] WHEN long THEN [w, w || ' two', w || ' one'] ELSE [w, w || ' one', w || ' two'] END AS heads FROM n, f),
  e AS (SELECT file, k, b, unnest(heads) AS headword, unnest(range(len(heads))) AS j FROM v), s AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k, j) - 1 AS entry_seq FROM e)"""


def _bgl(spark: SparkSession, sf_dir: str) -> str:
    rows = library.nations(spark, sf_dir)
    return library.written(spark, "bgl", {"short.bgl": library.bgl(rows), "long.bgl": library.bgl(rows, long=True)})


@query(f"WITH {_BGL} SELECT file, entry_seq::BIGINT AS entry_seq, headword, (length(b) + 4)::BIGINT AS byte_length FROM s")
def bgl_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of entry blocks, behind a broken trailer; alternatives follow their headwords."""
    return _entries(spark, _bgl(spark, sf_dir)).drop("byte_offset")


@query(f"WITH {_BGL} SELECT file, entry_seq::BIGINT AS entry_seq, headword, b AS raw, b AS plain, b AS shown FROM s")
def bgl_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without control codes, decoded by the declared character set."""
    return _bodies(spark, _bgl(spark, sf_dir))


# --- EPWING

_EPWING = f"{NATIONS}, f(file) AS (VALUES ('one/NATIONS/DATA/HONMON'), ('two/NATIONS/DATA/HONMON.EBZ'), ('three/NATIONS/START'))"


@query(f"WITH {_EPWING} SELECT file, k AS entry_seq, w AS headword, 6144 + 256 * k AS byte_offset, 0::BIGINT AS byte_length FROM n, f")
def epwing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book, the same packed, and one of the older catalogue; an index of two levels."""
    return _entries(spark, library.written(spark, "epwing", library.epwing_files(library.nations(spark, sf_dir))))


@query(f"WITH {_EPWING} SELECT file, k AS entry_seq, w AS headword, '  ' || w || chr(10) || replace(b, 'é', 'e') AS shown, '2-' || (2 + length(w)) || ' bold' AS spans FROM n, f")
def epwing_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text up to its end mark, with indentation and bold letters."""
    folder = library.written(spark, "epwing", library.epwing_files(library.nations(spark, sf_dir)))
    found = scan.bodies(spark, [folder]).join(_files(spark, folder), "dict_id").withColumn("r", markup.render("raw", "markup"))
    return found.select("file", "entry_seq", "headword", F.col("r.text").alias("shown"), _spans(F.col("r")).alias("spans"))


# --- the DICT protocol


@query(values("path, name, headword, entry_key, body", [
    ("dict://h:2628/wn", "WordNet (r) 3.0", "cat", "cat:0", "cat\n.a small pet"), ("dict://h:2628/wn", "WordNet (r) 3.0", "cat", "cat:1", "cat: a whip"), ("dict://h:2628/wn", "WordNet (r) 3.0", 'say "x"', 'say "x":0', "to utter"),
]))
def dict_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions from a server, by its transcript; one database hasn't the words."""
    spark.dataSource.register(dictproto.DictSource)
    return spark.read.format("dict").option("servers", "h").option("words", 'cat,say "x"').option("transport", "glossmill.plans.library:recorded").load()


@query(values("path, name, grp, priority, host, port, db, words", [("dict://h:2628/wn", "WordNet (r) 3.0", "DICT Servers", 100, "h", 2628, "wn", "cat,car"), ("dict://h:2628/el", "Elements", "DICT Servers", 100, "h", 2628, "el", "calcium")]))
def dict_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Databases as dictionaries, their paths taken apart, and words that begin alike, over one connection."""
    pool, rows = dictproto.Pool(library.recorded), []
    for d in dictproto.discover(["h"], True, pool.transport):
        host, port, db = dictproto.parse_path(d["path"])
        rows.append((d["path"], d["name"], d["group"], d["priority"], host, port, db, ",".join(pool.client(host, port).match(db, "prefix", "ca"))))
    return spark.createDataFrame(rows, "path string, name string, grp string, priority int, host string, port int, db string, words string")


# --- rendering

RENDERED = (
    ("html", '<style>p{}</style><p>One <b>bold</b> &amp; <font color="red">red</font></p><div><div>two</div></div>', "One bold & red\n\ntwo\n\n", "4-8 bold; 11-14 colour:red", ""),
    ("html", 'a<br>b<hr/><a href="entry://t%20x">see</a> <a href="sound://s\\a.mp3">play</a><img src="i.png"/><!-- c -->', "a\nb\nsee play", "", "4-7 reference t x; 8-12 audio s/a.mp3; 12-12 image i.png"),
    ("html", "<i>x<sup>2</sup></i> <sub>n</sub> <u>u</u>&amp;lt;", "x2 n u&lt;", "0-2 italic; 1-2 bold; 1-2 raised; 3-4 lowered; 5-6 underline", ""),
    ("mdict", "<p>one <b>two</b></p><div></div>\n", "one two", "4-7 bold", ""),
    ("dsl", "\t[m1][b]gato[/b] \\[x\\] <<cat>>[/m]\n\t[m2][ex]un [i]gato[/i][/ex][/m]\n", "gato [x] cat\nun gato\n", "0-4 bold; 0-12 indent:2; 13-20 example; 13-20 indent:4; 16-20 italic", "9-12 reference cat"),
    ("dsl", "[s]a.wav[/s][ref]dog[/ref][c red]r[/c][url]u[/url]{{x.png}}", "dogru", "3-4 colour:red", "0-0 audio a.wav; 0-3 reference dog; 4-5 url u; 5-5 image x.png"),
    ("xdxf", "<k>w</k><br/><tr>ph</tr> <kref>other</kref> &lt;", "w\n[ph] other <", "0-1 bold; 2-6 italic", "7-12 reference other"),
    ("epwing", "\x1f\x09\0\x02Ａ\x1f\x0a\x1f\x12b\x1f\x13\x1f\x42\0\0see\x1f\x62\0\0\0\x05\0\x07\x1f\x03rest", "  A\nbsee", "4-5 bold", "5-8 reference 5:7"),
)


@query(values("markup, n, shown, spans, links", [(k, n, *rest) for n, (k, _, *rest) in enumerate(RENDERED)]))
def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8-E10, E12, E13, E19, E21."""
    rows = spark.createDataFrame([(n, k, b) for n, (k, b, *_) in enumerate(RENDERED)], "n int, markup string, body string")
    r = rows.select("markup", "n", markup.render("body", "markup").alias("r"))
    return r.select("markup", "n", F.col("r.text").alias("shown"), _spans(F.col("r")).alias("spans"), _links(F.col("r")).alias("links"))


COLOUR_NAMES = (("Green", "green"), ("#ff0000", "red"), ("#00f", "blue"), ("#777", "gray"), ("#ffd000", "orange"), ("#ff00ff", "violet"), ("#00ff00", "green"), ("nonsense", "default"), ("tan", "brown"), ("#ffffffff0000", "orange"))


@query(values("name, class", COLOUR_NAMES))
def colour_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11."""
    return spark.createDataFrame([(n,) for n, _ in COLOUR_NAMES], "name string").select("name", markup.colours("name").alias("class"))


ENTITY_TEXTS = (("&amp;lt;", "&lt;"), ("&#65;&#x42;&#X43;", "ABC"), ("&apos;&quot;&nbsp;.", "'\" ."), ("&unknown; &#0; &", "&unknown; &#0; &"), ("&lt;b&gt;", "<b>"))


@query(values("body, shown", ENTITY_TEXTS))
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In one pass; what isn't known stays."""
    return spark.createDataFrame([(t,) for t, _ in ENTITY_TEXTS], "body string").select("body", markup.entities("body").alias("shown"))


@query("""SELECT n_name AS name, CASE n_nationkey % 6 WHEN 0 THEN 'English' WHEN 1 THEN 'German' WHEN 2 THEN 'Portuguese' WHEN 3 THEN 'Spanish' WHEN 4 THEN 'Spanish' ELSE n_name END AS language,
  CASE WHEN n_nationkey % 4 = 0 THEN r_name WHEN n_nationkey % 4 = 1 THEN n_name || ' → <all>' WHEN n_nationkey % 4 = 2 THEN '<all> → ' || n_name ELSE '<all>' END AS label,
  n_nationkey % 5 IN (0, 1) AS image, n_nationkey % 5 IN (2, 3) AS audio FROM nation JOIN region ON n_regionkey = r_regionkey""")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6, E26, E29."""
    n, r = library.table(spark, sf_dir, "nation"), library.table(spark, sf_dir, "region")
    k, name = F.col("n_nationkey"), F.col("n_name")
    pick = lambda *forms: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in forms]), (k % len(forms)).cast("int") + 1)
    language = pick("Egnlish", "GermanNewSpelling", "PortugueseStandard", "SpanishModernSort", "SpanishTraditionalSort", name)
    label = text.scope_label(F.when(k % 4 == 1, name), F.when(k % 4 == 2, name), F.when(k % 4 == 0, F.col("r_name")))
    file = F.concat(name, pick(".PNG", ".jpeg", ".Mp3", ".opus", ".txt"))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(name.alias("name"), text.language(language).alias("language"), label.alias("label"), text.is_image(file).alias("image"), text.is_audio(file).alias("audio"))


# --- order, history, bookmarks


@query("""WITH o AS (SELECT n_name AS name, row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS p FROM nation WHERE n_nationkey % 3 = 0), u AS (SELECT n_name AS name, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation WHERE n_nationkey % 3 <> 0)
  SELECT name, p::INTEGER AS position, true AS matched FROM o UNION ALL SELECT name, (p + (SELECT count(*) FROM o))::INTEGER, false FROM u""")
def order_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order that another program's configuration has, by loosely equal names, and what it lacks."""
    names = [w for w, _ in library.nations(spark, sf_dir)]
    listed = "".join(f'<dictionary id="{n}" name="{w.lower()} [en-en]"/>' for n, w in reversed([*enumerate(names)]) if n % 3 == 0) + '<dictionary id="x" name="Absent &amp; Co"/>'
    return scope.ordered_as(_named(spark, names), _order(spark, listed))


@query("SELECT count(*) FILTER (n_nationkey % 3 = 0) AS matched, count(*) FILTER (n_nationkey % 3 <> 0) AS unmatched, 1::BIGINT AS unknown FROM nation")
def order_import_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import by the first configuration that is there, and its counts."""
    names = [w for w, _ in library.nations(spark, sf_dir)]
    listed = "".join(f'<dictionary id="{n}" name="{w}"/>' for n, w in enumerate(names) if n % 3 == 0) + '<dictionary id="x" name="Absent"/>'
    folder = library.written(spark, "config", {"config": f"<config><dictionaryOrder>{listed}</dictionaryOrder></config>".encode()})
    return scan.import_order(spark, _named(spark, names), [f"{folder}/absent", f"{folder}/config"])[1]


def _named(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(w, n) for n, w in enumerate(names)], "name string, seq int")


def _order(spark: SparkSession, listed: str) -> DataFrame:
    folder = library.written(spark, "config", {"config": f"<config><dictionaryOrder>{listed}</dictionaryOrder></config>".encode()})
    return scan.goldendict_order(spark, f"{folder}/config")


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M') AS time, event_type AS word, user_id::BIGINT AS dict_count FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def history_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written, read again and listed; its newest thousand stay."""
    log = library.table(spark, sf_dir, "events").select(F.col("event_type").alias("word"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("micros"), F.col("user_id").cast("long").alias("dict_count"), F.col("event_id").cast("long").alias("seq"))
    folder = fresh(spark, "history")
    history.save(log.select("word", (F.col("micros") / 1e6).alias("ts"), "dict_count", "seq"), folder)
    return history.shown(history.load(spark, folder))


@query("SELECT n_name AS headword, 'd' AS dictionary, n_nationkey::DOUBLE AS ts, 2::BIGINT AS files FROM nation WHERE n_nationkey <> 3")
def bookmarks_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks written, read and one removed; a file with a malformed line is as good as none."""
    names = [w for w, _ in library.nations(spark, sf_dir)]
    folder = fresh(spark, "bookmarks")
    history.save(spark.createDataFrame([(w, "d", float(n), "/p") for n, w in enumerate(names)], history.MARKS), f"{folder}/good")
    put(spark, f"{folder}/bad/part.json", b'{"headword": "a", "dictionary": "d", "ts": 1.0}\n{"headword": \n')
    marks, bad = history.load(spark, f"{folder}/good", history.MARKS), history.load(spark, f"{folder}/bad", history.MARKS)
    return history.bookmarks_removed(marks.unionByName(bad), names[3]).select("headword", "dictionary", "ts", F.lit(2).cast("long").alias("files"))


@query(f"""WITH {NATIONS} SELECT w || '.mp3' AS key, CASE WHEN k % 4 = 0 THEN 'file ' || w WHEN k % 4 = 1 THEN 'own ' || w WHEN k % 4 = 2 THEN 'other ' || w END AS place FROM n""")
def audio_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sound beside the dictionary, in its own archive, in another one of the directory, or nowhere."""
    n = library.table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 4).alias("k"), F.col("n_name").alias("w"))
    file = F.concat("w", F.lit(".mp3"))
    wanted = n.select(file.alias("key"), F.lit("d").alias("directory"), F.lit("own").alias("dict_id"), file.alias("name"))
    at = lambda kind, keys: n.where(F.col("k").isin(keys)).select(F.lit("d").alias("directory"), F.lit(kind).alias("dict_id"), file.alias("name"), F.concat(F.lit(f"{kind} "), "w").alias("place"))
    packed = at("own", [0, 1]).unionByName(at("other", [0, 1, 2]))
    return spans.audio_sources(wanted, at("file", [0]).drop("dict_id"), packed).select("key", "place")


# --- the index


def _stored(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, str]:
    """An index of five DSL files and the same StarDict entries."""
    rows = library.nations(spark, sf_dir)
    folder = library.written(spark, "dsl", library.dsl_files(rows))
    path = fresh(spark, "entries")
    entries = index.indexed(scan.entries(spark, [folder]))
    index.store(entries, path)
    return path, _files(spark, folder), folder


@query(f"WITH {_DSL} SELECT file, headword, lower(headword) AS headword_normalized, entry_seq::BIGINT AS entry_seq FROM r, f WHERE file <> 'le.dsl'")
def index_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2, K5, K9: an index made, a dictionary of it replaced by the same entries, another one cleared; read by its table."""
    path, files, folder = _stored(spark, sf_dir)
    index.store(index.indexed(scan.entries(spark, [f"{folder}/plain.dsl"])), path)
    ids = {r["file"]: r["dict_id"] for r in files.collect()}
    index.clear(spark, path, [ids["le.dsl"]])
    name = "entries_" + path[-12:]
    index.create(spark, name, path)
    index.create(spark, name, path)
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name).join(files, "dict_id").select("file", "headword", "headword_normalized", "entry_seq")


@query("SELECT 'd' || (n_nationkey % 5) AS dict_id, n_name AS key, n_nationkey::VARCHAR AS value FROM nation")
def index_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reset takes the mark of full text away and leaves the rest."""
    n = library.table(spark, sf_dir, "nation")
    d = F.concat(F.lit("d"), (F.col("n_nationkey") % 5).cast("string")).alias("dict_id")
    held = n.select(d, F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"), F.lit(1).alias("seq"))
    ids = held.select("dict_id").distinct()
    return index.latest(index.reset(index.marked_fulltext(held, ids), ids))


@query(f"WITH {_DSL} SELECT count(DISTINCT headword) AS headwords FROM r")
def headwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return index.headword_count(spark.read.parquet(_stored(spark, sf_dir)[0]))


@query("SELECT p_brand AS dict_id, sum(p_size)::BIGINT AS total FROM part GROUP BY p_brand")
def unpacked_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return index.running(library.table(spark, sf_dir, "part").select(F.col("p_brand").alias("dict_id"), F.col("p_size").cast("long").alias("size")))


@query("SELECT lower(p_name) AS word, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS contents FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U16: the dictionaries of each word, where there are several."""
    from glossmill.plans import corpus

    e = corpus.part_entries(spark, sf_dir).withColumn("word", F.col("headword_normalized"))
    d = corpus.part_dictionaries(spark, sf_dir).withColumn("priority", F.lit(0))
    return lookup.contents(lookup.ranked(e, d)).select("word", F.array_join("contents", ", ").alias("contents"))


@query("""WITH e AS (SELECT p_name, p_brand, p_partkey, dense_rank() OVER (ORDER BY p_brand) AS rank FROM part WHERE lower(p_name) IN (SELECT min(lower(p_name)) FROM part)),
  s AS (SELECT *, row_number() OVER (ORDER BY rank, p_partkey) - 1 AS i FROM e) SELECT CASE WHEN i = 0 THEN 0 ELSE 1 + (i - 1) // 3 END::BIGINT AS part, p_brand AS dict_id, p_partkey AS entry_seq FROM s""")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first result at once, then three at a time."""
    from glossmill.plans import corpus

    e, d = corpus.part_entries(spark, sf_dir), corpus.part_dictionaries(spark, sf_dir).withColumn("priority", F.lit(0))
    word = e.agg(F.min("headword_normalized")).first()[0]
    found = lookup.ranked(lookup.exact_batch(e, [word]), d)
    rows = [(n, r["dict_id"], r["entry_seq"]) for n, part in enumerate(lookup.sections(found, 3)) for r in part]
    return spark.createDataFrame(rows, "part long, dict_id string, entry_seq long")


@query("SELECT n_name AS dict_id, 'not indexed' AS why FROM nation WHERE n_nationkey % 2 = 1")
def skipped_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13: formats that need no index are left out of an indexing run, and are never stale."""
    n = library.table(spark, sf_dir, "nation")
    found = n.select(F.col("n_name").alias("dict_id"), F.when(F.col("n_nationkey") % 2 == 0, "dict-protocol").otherwise("dsl").alias("format_name"), F.lit(1).cast("long").alias("mtime"))
    none = spark.createDataFrame([], "dict_id string, key string, value string, seq long")
    empty = spark.createDataFrame([], "dict_id string, entries long")
    return index.staleness(index.to_index(found, scan.standard()), none, empty).where("stale").select("dict_id", "why")


@query(f"WITH {NATIONS} SELECT 'n' || (k % 3) AS dict_id, k AS entry_seq, w AS headword, b AS definition FROM n WHERE k % 3 <> 0 UNION ALL SELECT 'n0', k, w, 'kept' FROM n WHERE k % 3 = 0")
def fulltext_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries whose full text isn't stored get it; those that have it keep what they have. Without the switch
    nothing is done."""
    rows = [(f"n{n % 3}", n, w, f"<p>{b}</p>") for n, (w, b) in enumerate(library.nations(spark, sf_dir))]
    bodies = spark.createDataFrame(rows, "dict_id string, entry_seq long, headword string, raw string").withColumn("markup", F.lit("html"))
    have = index.marked_fulltext(spark.createDataFrame([], "dict_id string, key string, value string, seq long"), spark.createDataFrame([("n0",)], "dict_id string"))
    path = fresh(spark, "fulltext")
    bodies.where("dict_id = 'n0'").select("entry_seq", "headword", F.lit("kept").alias("definition"), "dict_id").write.partitionBy("dict_id").parquet(path)
    index.backfill(bodies, have, path, build=False)
    index.backfill(bodies, have, path)
    return spark.read.parquet(path).select("dict_id", "entry_seq", "headword", "definition")


@query(f"WITH {NATIONS} SELECT lower(w) AS headword_normalized, w AS headword, (CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS dict_count FROM n UNION ALL SELECT lower(w), lower(w), 2 FROM n WHERE k % 2 = 0")
def completion_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored completion index, made from one dictionary and made anew when another one is there; what was read
    before is read afresh."""
    names = [w for w, _ in library.nations(spark, sf_dir)]
    rows = [("a", n, w, w.lower()) for n, w in enumerate(names)] + [("b", n, w.lower(), w.lower()) for n, w in enumerate(names) if n % 2 == 0]
    entries = spark.createDataFrame(rows, "dict_id string, entry_seq long, headword string, headword_normalized string")
    path = fresh(spark, "completions")
    lookup.rebuild_completions(entries.where("dict_id = 'a'"), path)
    lookup.rebuild_completions(entries, path)
    return lookup.completions(spark, path).select("headword_normalized", "headword", "dict_count")


@query("SELECT 'plain.dsl' AS file, 'indexed' AS outcome UNION ALL SELECT f, 'stopped' FROM (VALUES ('bom.dsl'), ('le.dsl'), ('be.dsl'), ('packed.dsl.dz')) t(f)")
def indexing_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An indexing run over sorted dictionaries that is stopped behind the first."""
    folder = library.written(spark, "dsl", library.dsl_files(library.nations(spark, sf_dir)))
    run = index.Run(spark, fresh(spark, "entries"))
    found = sorted(scan.discover(spark, [folder]).collect(), key=lambda r: (not r["path"].endswith("plain.dsl"), r["path"]))
    for d in found:
        run.index(d["path"], lambda d=d: scan.entries(spark, [d["path"]]))
        run.stop()
    return run.outcomes().select(F.regexp_extract("dict_id", "([^/]*)$", 1).alias("file"), F.when(F.col("error").isNull(), "indexed").otherwise(F.col("error")).alias("outcome"))


@query(f"""WITH {NATIONS}, e AS (SELECT w, 'Nations' AS name, 1 AS place, v.headword, v.i AS entry_seq, NULL::VARCHAR AS entry_key FROM n JOIN (SELECT *, row_number() OVER (ORDER BY k, j) - 1 AS i FROM (
    SELECT k, unnest(CASE WHEN k % 3 = 0 THEN [w, w || 's', w] ELSE [w] END) AS headword, unnest(range(CASE WHEN k % 3 = 0 THEN 3 ELSE 1 END)) AS j FROM n)) v ON v.headword = w
    UNION ALL SELECT w, 'Listed', 0, w, NULL, w || ':0' FROM n WHERE k % 2 = 0)
  SELECT w AS word, name, (dense_rank() OVER (PARTITION BY w ORDER BY place))::INTEGER AS rank, headword, coalesce(entry_seq, -1)::BIGINT AS entry_seq, entry_key, 2::BIGINT AS indexed FROM e WHERE name <> 'Twice'""")
def engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery once, indexing of what is stale (two dictionaries, one of them changed and indexed
    again), lookup in the index and by a format that answers itself, whose dictionary goes first."""
    rows = library.nations(spark, sf_dir)
    folder = library.written(spark, "engine", {"a.dsl": library.dsl(rows).encode(), "none.dsl": b'#NAME "Twice"\n\nnothing\n\tbody\n'})
    registry = scan.standard()
    registry.register(library.Listed([w for w, _ in rows][::2]))
    given = spark.createDataFrame([("Listed", -1, 0)], "name string, priority int, seq int")
    e = Engine(spark, [folder], fresh(spark, "engine-store"), registry, given)
    indexed = e.ensure_indexed()
    if e.ensure_indexed():
        raise RuntimeError("an index that is up to date was made again")
    return e.lookup([w for w, _ in rows]).select("word", "name", "rank", "headword", F.coalesce("entry_seq", F.lit(-1)).alias("entry_seq"), "entry_key", F.lit(indexed).cast("long").alias("indexed"))


@query(f"WITH {NATIONS} SELECT w AS word, 'body of ' || w AS body FROM n WHERE k % 2 = 0")
def custom_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's hooks: a format that finds its own dictionaries and answers words itself, beside stored entries."""
    names = [w for w, _ in library.nations(spark, sf_dir)]
    registry = scan.standard()
    registry.register(library.Listed(names[::2]))
    known = scan.hooked(spark, registry)
    return scan.asked(spark, registry, known, names).select("word", "body")


