"""Dictionaries in every format, written from rows of (headword, definition), as the registered queries read them.

The writers are plain encoders of small dictionaries; tests use them too.
"""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import SparkSession

from glossmill.plans.corpus import table
from glossmill.shared import fresh, put
from glossmill.sources import mdict
from glossmill.sources.codecs import dictzip, ebzip
from glossmill.sources.registry import Format

Rows = Sequence[tuple[str, str]]


def nations(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """(name, definition) of each nation by key: as many rows as the world has."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).orderBy("n_nationkey").select("n_nationkey", "n_name", "r_name").collect()
    return [(x["n_name"], f"nation {x['n_nationkey']} of {x['r_name']}, région") for x in rows]


#: The same in SQL: k, w, b.
NATIONS = "n AS (SELECT n_nationkey::BIGINT AS k, n_name AS w, 'nation ' || n_nationkey || ' of ' || r_name || ', région' AS b FROM nation JOIN region ON n_regionkey = r_regionkey)"


def written(spark: SparkSession, name: str, files: Mapping[str, bytes]) -> str:
    """The folder with the files."""
    folder = fresh(spark, f"library-{name}")
    for place, content in files.items():
        put(spark, f"{folder}/{place}", content)
    return folder


DSL_HEADER = '#NAME "Nations"\n#INDEX_LANGUAGE "Egnlish"\n#CONTENTS_LANGUAGE "SpanishModernSort"\n\n'


def dsl(rows: Rows) -> str:
    """Each third headword has a second line with an optional part."""
    heads = (f"{w}\n{w}(s)\n" if n % 3 == 0 else f"{w}\n" for n, (w, _) in enumerate(rows))
    return DSL_HEADER + "".join(f"{h}\t[m1]{b}[/m]\n" for h, (_, b) in zip(heads, rows, strict=True))


def dsl_files(rows: Rows) -> dict[str, bytes]:
    text = dsl(rows)
    return {
        "plain.dsl": text.encode(), "bom.dsl": b"\xef\xbb\xbf" + text.encode(), "le.dsl": b"\xff\xfe" + text.encode("utf-16-le"), "be.dsl": b"\xfe\xff" + text.encode("utf-16-be"),
        "packed.dsl.dz": dictzip(text.encode(), 100), "plain_abrv.dsl": b'#NAME "x"\nnoun\n\tsustantivo\n\tmore\nf\n\t[i]femenino[/i]\nnoun\n\tother\n', "readme.txt": b"#NAME no dictionary",
    }


def stardict(rows: Rows, offset: str = ">I", size: str = ">I", shift: int = 0, extra: str = "sametypesequence=m\n", typed: bool = False) -> tuple[bytes, bytes, bytes]:
    """(.ifo, .idx, .dict); typed: each body is a phonetic field t and a meaning m."""
    data, idx = b"", b""
    for word, body in rows:
        raw = b"t" + word.lower().encode() + b"\0m" + body.encode() + b"\0" if typed else body.encode()
        idx += word.encode() + b"\0" + struct.pack(offset, len(data) << shift) + struct.pack(size, len(raw) << shift)
        data += raw
    return f"StarDict's dict ifo file\nversion=2.4.2\nbookname=Nations Star\nwordcount={len(rows)}\nidxfilesize={len(idx)}\n{extra}".encode(), idx, data


def stardict_files(rows: Rows) -> dict[str, bytes]:
    """32-bit offsets; 64-bit ones, packed, with synonyms of every second entry and one out of range; padded values; typed fields."""
    out: dict[str, bytes] = {}
    out["a.ifo"], out["a.idx"], out["a.dict"] = stardict(rows)
    out["b.ifo"], idx, data = stardict(rows, ">Q", extra="sametypesequence=m\nidxoffsetbits=64\n")
    out["b.idx.gz"], out["b.dict.dz"] = gzip.compress(idx), dictzip(data, 64)
    out["b.syn"] = b"".join(f"syn {w}".encode() + b"\0" + n.to_bytes(4, "big") for n, (w, _) in enumerate(rows) if n % 2 == 0) + b"none\0" + (len(rows) + 7).to_bytes(4, "big")
    out["c.ifo"], out["c.idx"], out["c.dict"] = stardict(rows, ">Q", ">Q", 32)
    out["d.ifo"], out["d.idx"], out["d.dict"] = stardict(rows, extra="", typed=True)
    return out


def lzo(data: bytes) -> bytes:
    """An LZO1X stream of literals only."""
    n = len(data)
    if 4 <= n <= 238:
        return bytes([17 + n]) + data + b"\x11\0\0"
    zeros, last = divmod(n - 18 - 1, 255)
    return b"\0" + bytes(zeros) + bytes([last + 1]) + data + b"\x11\0\0"


def mdx(rows: Rows, encrypted: bool = False, version: str = "2.0", charset: str = "UTF-8", pack: int = 2, resources: bool = False, title: str = "Nations &amp; MDict", pair: int = 3) -> bytes:
    """An MDict file with one keyword block and record blocks of ``pair`` bodies each. Bodies of resources are bytes in hexadecimal digits."""
    width = 8 if version >= "2" else 4
    number = lambda n: n.to_bytes(width, "big")
    coded = "utf-16-le" if charset == "UTF-16" or resources else "utf-8"
    unit = 2 if coded == "utf-16-le" else 1

    def block(data: bytes, pack: int) -> bytes:
        return struct.pack("<I", pack) + zlib.adler32(data).to_bytes(4, "big") + (zlib.compress(data) if pack == 2 else lzo(data) if pack == 1 else data)

    head = f'<Dictionary GeneratedByEngineVersion="{version}" Encoding="{charset}" Title="{title}" Encrypted="{2 if encrypted else 0}"/>\r\n\0'.encode("utf-16-le")
    out = len(head).to_bytes(4, "big") + head + zlib.adler32(head).to_bytes(4, "little")
    raws = [bytes.fromhex(b) if resources else (b + "\r\n\0").encode(coded) for _, b in rows]
    at, words = 0, b""
    for (word, _), raw in zip(rows, raws, strict=True):
        words += number(at) + word.encode(coded) + bytes(unit)
        at += len(raw)
    keys = block(words, 2 if pack == 1 else pack)
    short = lambda w: (len(w).to_bytes(2, "big") + w.encode(coded) + bytes(unit)) if width == 8 else bytes([len(w)]) + w.encode(coded)
    info = number(len(rows)) + short(rows[0][0]) + short(rows[-1][0]) + number(len(keys)) + number(len(words))
    packed = block(info, 2) if width == 8 else info
    if encrypted:
        packed = packed[:8] + mdict.encrypt(packed[8:], packed[4:8])
    section = number(1) + number(len(rows)) + (number(len(info)) if width == 8 else b"") + number(len(packed)) + number(len(keys))
    out += section + (zlib.adler32(section).to_bytes(4, "big") if width == 8 else b"") + packed + keys
    joined = [b"".join(raws[n : n + pair]) for n in range(0, len(raws), pair)]
    blocks = [block(r, pack) for r in joined]
    sizes = b"".join(number(len(b)) + number(len(r)) for b, r in zip(blocks, joined, strict=True))
    return out + number(len(blocks)) + number(len(rows)) + number(len(sizes)) + number(sum(map(len, blocks))) + sizes + b"".join(blocks)


MDICT_KINDS = {"plain": {}, "encrypted": {"encrypted": True}, "old": {"version": "1.2"}, "wide": {"charset": "UTF-16"}, "stored": {"pack": 0}, "lzo": {"pack": 1}}


def mdict_files(rows: Rows) -> dict[str, bytes]:
    """Every kind of file, each with a redirect from "see NAME" of the first nation, and pictures for one of them."""
    linked = [*rows, (f"see {rows[0][0]}", f"@@@LINK={rows[0][0]}")]
    out = {f"{kind}.mdx": mdx(linked, **options) for kind, options in MDICT_KINDS.items()}
    out["untitled.mdx"] = mdx(rows[:1], title="Title (No HTML code allowed)")
    out["plain.mdd"] = mdx([(f"\\Img\\{w}.PNG", b.encode().hex()) for w, b in rows], resources=True)
    return out


def bgl(rows: Rows, long: bool = False) -> bytes:
    """Short entries, or long ones; each second one has an alternative, and bodies hold a control sequence."""

    def block(kind: int, data: bytes) -> bytes:
        return bytes([0x20 | kind]) + len(data).to_bytes(3, "big") + data if len(data) > 11 else bytes([((len(data) + 4) << 4) | kind]) + data

    short = lambda x, width: len(x).to_bytes(width, "big") + x
    stream = block(3, b"\x01Nations Babylon") + block(3, b"\x07\x00") + block(3, b"\x08\x03") + block(3, b"\x1a\x41") + block(3, b"\x1b\x41")
    for n, (w, b) in enumerate(rows):
        word, body = w.encode(), b.encode("cp1252") + b"\r\x14\x02\x30"
        others = [f"{w} {x}".encode() for x in ("one", "two")] if n % 2 else []
        if long:
            stream += block(11, b"\0" + short(word, 4) + len(others).to_bytes(4, "big") + b"".join(short(o, 4) for o in others) + short(body, 4))
        else:
            stream += block(1, short(word, 1) + short(body, 2) + b"".join(short(o, 1) for o in others))
    return b"\x12\x34\x00\x01" + (6).to_bytes(2, "big") + gzip.compress(stream)[:-8] + b"badcrc!!"


def epwing(rows: Rows, eb: bool = False) -> tuple[bytes, bytes]:
    """(catalogue, text file): full-width letters, an index of two levels, bodies 256 bytes apart from the fourth page on."""
    wide = lambda s: "".join("　" if c == " " else chr(ord(c) + 0xFEE0) for c in s)
    jis = lambda s: bytes(b - 0x80 for b in wide(s).encode("euc-jp"))
    row = jis("Nations").ljust(30 if eb else 80, b"\0") + b"NATIONS".ljust(8, b"\0") + (b"" if eb else bytes(4) + (1).to_bytes(2, "big"))
    catalog = (1).to_bytes(2, "big") + bytes(14) + (b"\0\0" + row).ljust(40 if eb else 164, b"\0")
    pages = bytearray(2048 * (4 + -(-len(rows) * 256 // 2048)))
    pages[1] = 2
    pages[16:32] = bytes([0x00, 0]) + (4).to_bytes(4, "big") + (1).to_bytes(4, "big") + bytes(6)
    pages[32:48] = bytes([0x71, 0]) + (2).to_bytes(4, "big") + (1).to_bytes(4, "big") + bytes(6)
    key = jis(rows[-1][0])
    node = bytes([0x00, 0]) + (1).to_bytes(2, "big") + bytes([len(key)]) + key + (3).to_bytes(4, "big")
    pages[2048 : 2048 + len(node)] = node
    leaf = bytes([0x80, 0]) + len(rows).to_bytes(2, "big")
    for n, (w, b) in enumerate(rows):
        at = n * 256
        leaf += bytes([2 * len(w)]) + jis(w) + (4 + at // 2048).to_bytes(4, "big") + (at % 2048).to_bytes(2, "big") + bytes(6)
        raw = b"\x1f\x09\0\x02" + b"\x1f\x12" + jis(w) + b"\x1f\x13\x1f\x0a" + jis(b) + b"\x1f\x03"
        pages[3 * 2048 + at : 3 * 2048 + at + len(raw)] = raw
    pages[4096 : 4096 + len(leaf)] = leaf
    return catalog, bytes(pages)


def epwing_files(rows: Rows) -> dict[str, bytes]:
    plain = [(w, b.replace("é", "e")) for w, b in rows]
    catalog, book = epwing(plain)
    short, start = epwing(plain, eb=True)
    return {"one/CATALOGS": catalog, "one/NATIONS/DATA/HONMON": book, "two/CATALOGS": catalog, "two/NATIONS/DATA/HONMON.EBZ": ebzip(book), "three/CATALOG": short, "three/NATIONS/START": start}


def archive(files: Mapping[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


class Listed(Format):
    """A format of no files, with one dictionary of some words."""

    name = "listed"

    def __init__(self, words: Sequence[str]):
        self.words = frozenset(words)

    def discover(self) -> list[dict]:
        return [{"path": "listed:1", "format_name": "listed", "name": "Listed", "source_lang": "", "target_lang": "", "group": "Unknown", "priority": 0}]

    def query_exact(self, path: str, word: str) -> Iterator[tuple[str, str]]:
        return iter([(f"{word}:0", f"body of {word}")] if word in self.words else [])


class Recorded:
    """A dictionary server by its transcript: what it answers to each line."""

    ANSWERS = {
        "SHOW DB": ["110 2 databases present", 'wn "WordNet (r) 3.0"', "el Elements", ".", "250 ok"],
        'DEFINE wn "cat"': ["150 2 definitions retrieved", '151 "cat" wn "WordNet"', "cat", "..a small pet", ".", '151 "cat" wn "WordNet"', "cat: a whip", ".", "250 ok"],
        'DEFINE wn "say \\"x\\""': ["150 1 definitions retrieved", '151 "say" wn "WordNet"', "to utter", ".", "250 ok"],
        'DEFINE el "cat"': ["552 no match"],
        'DEFINE el "say \\"x\\""': ["552 no match"],
        'MATCH wn prefix "ca"': ["152 2 matches found", 'wn "cat"', "wn car", ".", "250 ok"],
        'MATCH el prefix "ca"': ["152 1 matches found", "el calcium", ".", "250 ok"],
    }

    def __init__(self):
        self.lines = ["220 ready"]

    def send(self, line: str) -> None:
        self.lines += self.ANSWERS[line]

    def receive(self) -> str:
        return self.lines.pop(0)


def recorded(host: str, port: int):
    r = Recorded()
    return r.send, r.receive
