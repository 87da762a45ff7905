"""Readers on files that the tests write byte by byte."""

import gzip
import struct
import zipfile
import zlib

import pytest

from glossmill.operators import index, lookup, spans
from glossmill.sources import bgl, dictproto, dsl, epwing, mdict, scan, stardict
from glossmill.sources.codecs import dictzip, ebzip
from glossmill.sources.registry import Format, Registry

DSL = """#NAME "Small English-Spanish"
#INDEX_LANGUAGE "Egnlish"
#CONTENTS_LANGUAGE "SpanishModernSort"

apple
\t[m1][trn]manzana[/trn][/m]
cat
kitty
\t[m1]gato[/m]
\t[m2]felino[/m]

colour{/}color
[m1]color[/m]
lost
"""
IFO = "StarDict's dict ifo file\nversion=2.4.2\nbookname=Small Star\nwordcount=3\nidxfilesize=1\nsametypesequence=m\n"
BODIES = {"apple": "A round fruit.", "cat": "A small pet, un félin.", "hello": "A greeting."}


def star(offset=">I", size=">I", shift=0):
    data, idx = b"", b""
    for word, body in BODIES.items():
        raw = body.encode()
        idx += word.encode() + b"\0" + struct.pack(offset, len(data) << shift) + struct.pack(size, len(raw) << shift)
        data += raw
    return data, idx


def mdx(encrypted=False, version="2.0", charset="UTF-8", bodies=BODIES, pack=2, resources=False):
    """An MDict file with one keyword block and a record block for each body."""
    width = 8 if version >= "2" else 4
    number = lambda n: n.to_bytes(width, "big")
    coded = "utf-16-le" if charset == "UTF-16" or resources else "utf-8"
    unit = 2 if coded == "utf-16-le" else 1

    def block(data):
        check = zlib.adler32(data).to_bytes(4, "big")
        return struct.pack("<I", pack) + check + (zlib.compress(data) if pack == 2 else data)

    head = f'<Dictionary GeneratedByEngineVersion="{version}" Encoding="{charset}" Title="Small MDict" Encrypted="{2 if encrypted else 0}"/>\r\n\0'.encode("utf-16-le")
    out = len(head).to_bytes(4, "big") + head + zlib.adler32(head).to_bytes(4, "little")
    raws = [b if isinstance(b, bytes) else (b + "\r\n\0").encode(coded) for b in bodies.values()]
    at, words = 0, b""
    for word, raw in zip(bodies, raws, strict=True):
        words += number(at) + word.encode(coded) + bytes(unit)
        at += len(raw)
    keys = block(words)
    names = list(bodies)
    short = lambda w: (len(w).to_bytes(2, "big") + w.encode(coded) + bytes(unit)) if width == 8 else bytes([len(w)]) + w.encode(coded)
    info = number(len(bodies)) + short(names[0]) + short(names[-1]) + number(len(keys)) + number(len(words))
    packed = block(info) if width == 8 else info
    if encrypted:
        packed = packed[:8] + mdict.encrypt(packed[8:], packed[4:8])
    section = number(1) + number(len(bodies)) + (number(len(info)) if width == 8 else b"") + number(len(packed)) + number(len(keys))
    out += section + (zlib.adler32(section).to_bytes(4, "big") if width == 8 else b"") + packed + keys
    blocks = [block(r) for r in raws]
    sizes = b"".join(number(len(b)) + number(len(r)) for b, r in zip(blocks, raws, strict=True))
    return out + number(len(blocks)) + number(len(bodies)) + number(len(sizes)) + number(sum(map(len, blocks))) + sizes + b"".join(blocks)


def bgl_file():
    def block(kind, data):
        return bytes([0x20 | kind]) + len(data).to_bytes(3, "big") + data if len(data) > 11 else bytes([((len(data) + 4) << 4) | kind]) + data

    short = lambda word, body, *others: bytes([len(word)]) + word + len(body).to_bytes(2, "big") + body + b"".join(bytes([len(o)]) + o for o in others)
    four = lambda b: len(b).to_bytes(4, "big") + b
    stream = block(3, b"\x01Small Babylon") + block(3, b"\x07\x00") + block(3, b"\x08\x01") + block(3, b"\x1a\x41") + block(3, b"\x1b\x41")
    stream += block(1, short(b"apple", b"A round\r fruit.", b"apples")) + block(1, short(b"cat", "un f\xe9lin\x14\x02\x30\x1e!".encode("latin-1")))
    stream += block(11, b"\0" + four(b"hello") + (2).to_bytes(4, "big") + four(b"hi") + four(b"hey") + four(b"A greeting."))
    return b"\x12\x34\x00\x01" + (6).to_bytes(2, "big") + gzip.compress(stream)


def epwing_files():
    jis = lambda s: bytes(b - 0x80 for b in s.encode("euc-jp"))
    wide = lambda s: "".join(chr(ord(c) + 0xFEE0) for c in s)
    book = (1).to_bytes(2, "big") + bytes(14) + b"\0\0" + jis(wide("Book")).ljust(80, b"\0") + b"TESTBOOK" + bytes(4) + (1).to_bytes(2, "big")
    texts = {"apple": b"\x1f\x09\0\x01" + jis(wide("round")) + b"\x1f\x0a\x1f\x12" + jis(wide("fruit")) + b"\x1f\x13\x1f\x03", "pear": b"\x1f\x41\0\0" + jis(wide("pear")) + b"\x1f\x41\0\0next"}
    pages = bytearray(5 * 2048)
    pages[1] = 2
    pages[16:32] = bytes([0x00, 0]) + (4).to_bytes(4, "big") + (1).to_bytes(4, "big") + bytes(6)
    pages[32:48] = bytes([0x71, 0]) + (2).to_bytes(4, "big") + (1).to_bytes(4, "big") + bytes(6)
    pages[2048:2052] = bytes([0x00, 0]) + (1).to_bytes(2, "big")
    key = jis(wide("apple"))
    node = bytes([len(key)]) + key + (3).to_bytes(4, "big")
    pages[2052 : 2052 + len(node)] = node
    leaf, at = b"", 0
    for word, raw in texts.items():
        key = jis(wide(word))
        leaf += bytes([len(key)]) + key + (4).to_bytes(4, "big") + at.to_bytes(2, "big") + bytes(6)
        pages[3 * 2048 + at : 3 * 2048 + at + len(raw)] = raw
        at += 200
    pages[4096:4100] = bytes([0x80, 0]) + (2).to_bytes(2, "big")
    pages[4100 : 4100 + len(leaf)] = leaf
    return book.ljust(16 + 164, b"\0"), bytes(pages)


def test_dsl_scan():
    f, files = dsl.Dsl(), {"a.dsl": DSL.encode()}
    m = f.metadata("a.dsl", files)
    assert (m.name, m.source_lang, m.target_lang) == ("Small English-Spanish", "English", "Spanish")
    found = list(f.entries("a.dsl", files))
    assert [e.headword for e in found] == ["apple", "kitty", "cat", "colour", "color"]
    read = f.reader("a.dsl", files)
    assert read(found[0]) == "\t[m1][trn]manzana[/trn][/m]\n" and read(found[1]) == read(found[2]) and "felino" in read(found[1])
    assert DSL[found[0].offset - 1 :].startswith("\t[m1][trn]")


@pytest.mark.parametrize("charset", ["utf-16-le", "utf-16-be", "utf-8"])
def test_dsl_charsets(charset):
    mark = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff", "utf-8": b"\xef\xbb\xbf"}[charset]
    data = mark + DSL.replace("\n", "\r\n").encode(charset)
    packed = dictzip(data, 100)
    f = dsl.Dsl()
    assert f.detect("a.dsl", data) and f.detect("A.DSL.DZ", packed) and not f.detect("a.txt", data)
    assert [e.headword for e in f.entries("a.dsl.dz", {"a.dsl.dz": packed})] == ["apple", "kitty", "cat", "colour", "color"]


def test_dsl_abbreviations():
    side = b'#NAME "x"\nnoun\n\tsustantivo\n\tmore\nf\n\t[i]femenino[/i]\nnoun\n\tother\n'
    assert dsl.Dsl().abbreviations("a.dsl", {"a.dsl": b"", "a_abrv.dsl": side}) == {"noun": "sustantivo", "f": "femenino"}


@pytest.mark.parametrize(("offset", "size", "shift", "extra"), [(">I", ">I", 0, ""), (">Q", ">I", 0, "idxoffsetbits=64\n"), (">Q", ">I", 0, ""), (">Q", ">Q", 0, ""), (">Q", ">Q", 32, "")])
def test_stardict_widths(offset, size, shift, extra):
    data, idx = star(offset, size, shift)
    syn = b"".join(w + b"\0" + n.to_bytes(4, "big") for w, n in ((b"hi", 2), (b"kitty", 1), (b"out", 9)))
    files = {"a.ifo": (IFO + extra).encode(), "a.idx.gz": gzip.compress(idx), "a.dict.dz": dictzip(data, 10), "a.syn": syn}
    f = stardict.StarDict()
    found = list(f.entries("a.ifo", files))
    assert [e.headword for e in found] == ["apple", "cat", "hello", "hi", "kitty"]
    read = f.reader("a.ifo", files)
    assert [read(e) for e in found] == [*BODIES.values(), BODIES["hello"], BODIES["cat"]]
    assert f.metadata("a.ifo", files).name == "Small Star"


def test_stardict_fields():
    assert stardict.fields(b"fon\0meaning", "tm") == [("t", b"fon"), ("m", b"meaning")]
    assert stardict.fields(b"mA common fruit.\0W\0\0\0\x03wav", None) == [("m", b"A common fruit."), ("W", b"wav")]
    with pytest.raises(ValueError):
        list(stardict.StarDict().entries("a.ifo", {"a.ifo": IFO.encode()}))
    with pytest.raises(ValueError):
        stardict.parse_idx(b"word\0\0", 3, False)


@pytest.mark.parametrize("options", [{}, {"encrypted": True}, {"version": "1.2"}, {"charset": "UTF-16"}, {"pack": 0}])
def test_mdict(options):
    files = {"a.mdx": mdx(**options)}
    f = mdict.MDict()
    assert f.detect("a.mdx", files["a.mdx"]) and f.metadata("a.mdx", files).name == "Small MDict"
    found = list(f.entries("a.mdx", files))
    read = f.reader("a.mdx", files)
    assert {e.headword: read(e).strip() for e in found} == BODIES


def test_mdict_version_3():
    with pytest.raises(ValueError):
        mdict.parse_header(mdx(version="3.0"))


def test_mdict_resources():
    files = {"a.mdx": mdx(), "a.mdd": mdx(bodies={"\\Sound\\A.mp3": b"FAKE", "\\b.png": b"PNG!"}, resources=True)}
    assert dict(mdict.MDict().resources("a.mdx", files)) == {"/sound/a.mp3": b"FAKE", "/b.png": b"PNG!"}


def test_bgl():
    data = bgl_file()
    f, files = bgl.Bgl(), {"a.bgl": data}
    m = f.metadata("a.bgl", files)
    assert f.detect("a.bgl", data) and (m.name, m.source_lang, m.target_lang) == ("Small Babylon", "English", "French")
    found = list(f.entries("a.bgl", files))
    assert [e.headword for e in found] == ["apple", "apples", "cat", "hello", "hey", "hi"]
    read = f.reader("a.bgl", files)
    assert [read(e) for e in found] == ["A round fruit.", "A round fruit.", "un félin!", "A greeting.", "A greeting.", "A greeting."]


@pytest.mark.parametrize("packed", [False, True])
def test_epwing(packed):
    catalog, book = epwing_files()
    path = "/b/TESTBOOK/DATA/HONMON" + (".EBZ" if packed else "")
    files = {"/b/CATALOGS": catalog, path: ebzip(book) if packed else book}
    f = epwing.Epwing()
    assert f.detect(path, b"") and f.metadata(path, files).name == "Book"
    found = list(f.entries(path, files))
    assert [(e.headword, e.offset, e.length) for e in found] == [("apple", 6144, 0), ("pear", 6344, 0)]
    read = f.reader(path, files)
    assert epwing.narrow(read(found[0])) == "\x1f\x09\0\x01round\x1f\x0a\x1f\x12fruit\x1f\x13"
    assert epwing.narrow(read(found[1])) == "\x1f\x41\0\0pear"


class Recorded:
    """A dictionary server by its transcript."""

    ANSWERS = {
        "SHOW DB": ["110 1 databases present", 'wn "WordNet (r) 3.0"', ".", "250 ok"],
        'DEFINE wn "cat"': ["150 1 definitions retrieved", '151 "cat" wn "WordNet"', "cat", "..a small pet", ".", "250 ok"],
        'DEFINE wn "none"': ["552 no match"],
        'MATCH wn prefix "ca"': ["152 2 matches found", 'wn "cat"', "wn car", ".", "250 ok"],
    }

    def __init__(self):
        self.lines = ["220 ready"]

    def send(self, line):
        self.lines += self.ANSWERS[line]

    def receive(self):
        return self.lines.pop(0)


def recorded(host, port):
    r = Recorded()
    return r.send, r.receive


def test_dict_client():
    c = dictproto.Client("h", 1, recorded)
    assert c.databases() == [("wn", "WordNet (r) 3.0")] and c.define("wn", "cat") == ["cat\n.a small pet"] and c.define("wn", "none") == [] and c.match("wn", "prefix", "ca") == ["cat", "car"]
    assert dictproto.parse_path("dict://h:2628/a/b") == ("h", 2628, "a/b") and dictproto.parse_path("x") is None
    assert dictproto.sanitized('a"b\\c\r\n') == 'a\\"b\\\\c'


def test_dict_discovery():
    found = dictproto.discover(["h:1"], True, recorded)
    assert [(d["path"], d["name"], d["group"], d["priority"]) for d in found] == [("dict://h:1/wn", "WordNet (r) 3.0", "DICT Servers", 100)] and dictproto.discover(["h:1"]) == []


def test_dict_source(spark):
    spark.dataSource.register(dictproto.DictSource)
    got = spark.read.format("dict").option("servers", "h:1").option("words", "cat,none").option("transport", "tests.test_sources:recorded").load().collect()
    assert [tuple(r) for r in got] == [("dict://h:1/wn", "WordNet (r) 3.0", "cat", "cat:0", "cat\n.a small pet")]


def test_registry():
    class Other(Format):
        name, extensions = "dsl", (".other",)

        def detect(self, path, head):
            return path.endswith(".other")

    r = scan.standard()
    r.register(Other())
    assert r.get("dsl").extensions == (".other",) and ".ifo" in r.extensions() and ".dsl" not in r.extensions()
    assert r.detect("x.other", b"").name == "dsl" and r.detect("x.bgl", b"") is None and Registry().detect("x", b"") is None


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    top = tmp_path_factory.mktemp("library")
    data, idx = star()
    catalog, book = epwing_files()
    files = {
        "d/a.dsl": DSL.encode(), "d/a_abrv.dsl": b"n\n\tnoun\n", "s/a.ifo": IFO.encode(), "s/a.idx": idx, "s/a.dict": data, "m/a.mdx": mdx(), "m/a.mdd": mdx(bodies={"\\x.png": b"P"}, resources=True),
        "b/a.bgl": bgl_file(), "e/CATALOGS": catalog, "e/TESTBOOK/DATA/HONMON": book, "broken/z.ifo": IFO.encode(), "other/readme.txt": b"x",
    }
    for name, content in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(content)
    with zipfile.ZipFile(top / "d/a.dsl.files.zip", "w") as z:
        z.writestr("test.mp3", b"FAKE-MP3-DATA")
    return str(top)


def test_discover(spark, library):
    found = {(r["format_name"], r["name"], r["group"]) for r in scan.discover(spark, [library]).collect()}
    assert found == {
        ("dsl", "Small English-Spanish", "English → Spanish"), ("stardict", "Small Star", "Unknown"), ("mdict", "Small MDict", "Unknown"), ("bgl", "Small Babylon", "English → French"),
        ("epwing", "Book", "EPWING"),
    }


def test_index_and_lookup(spark, library, tmp_path):
    good = [f"{library}/{x}" for x in "dsmbe"]
    rows = index.indexed(scan.entries(spark, good))
    store = str(tmp_path / "entries")
    index.store(rows, store)
    index.store(rows, store)  # replacing a dictionary doesn't add to it
    entries = spark.read.parquet(store)
    assert entries.count() == 5 + 3 + 3 + 6 + 2
    assert lookup.exact(entries, "APPLE").count() == 5
    d = scan.discover(spark, good)
    assert sorted(r["name"] for r in lookup.exact(entries, "cat").join(d, "dict_id").collect()) == ["Small Babylon", "Small English-Spanish", "Small MDict", "Small Star"]
    index.create(spark, "stored_entries", store)
    plain = {(r["headword"], r["definition"]) for r in index.documents(scan.bodies(spark, good)).collect()}
    assert {("cat", "gato felino"), ("hello", "A greeting."), ("apple", "A round fruit."), ("cat", "un félin!")} <= plain


def test_broken_file_fails_alone(spark, library):
    with pytest.raises(Exception, match="no .idx file"):
        scan.entries(spark, [f"{library}/broken"]).count()


def test_resources(spark, library):
    held = scan.resources(spark, [f"{library}/d", f"{library}/m"])
    assert {(r["key"], bytes(r["content"])) for r in held.collect()} == {("test.mp3", b"FAKE-MP3-DATA"), ("/x.png", b"P")}
    ids = held.select("dict_id").distinct().collect()
    keys = spark.createDataFrame([(r[0], k) for r in ids for k in ("X.PNG", "none")], "dict_id string, key string")
    got = index.resource(keys, held).collect()
    assert sum(not r["missing"] for r in got) == 1 and len(got) == 4


def test_abbreviations(spark, library):
    side = scan.abbreviations(spark, [f"{library}/d"])
    tags = side.selectExpr("dict_id", "'n' as tag").unionAll(side.selectExpr("dict_id", "'x' as tag"))
    assert {(r["tag"], r["expansion"]) for r in spans.with_abbreviations(tags, side).collect()} == {("n", "noun"), ("x", None)}


def test_goldendict_order(spark, tmp_path):
    p = tmp_path / "config.xml"
    p.write_text('<config><dictionaryOrder><dictionary id="1" name="B"/><dictionary id="2" name="A &amp; C"/></dictionaryOrder></config>')
    assert [tuple(r) for r in scan.goldendict_order(spark, str(p)).orderBy("seq").collect()] == [("B", 0), ("A & C", 1)]
