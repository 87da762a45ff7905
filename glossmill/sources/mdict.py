"""MDict dictionaries (.mdx) and their resources (.mdd), versions 1 and 2."""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from glossmill.sources.codecs import Bytes, Cache, lzo1x, ripemd128
from glossmill.sources.registry import Entry, Files, Format, Metadata, base_name, stem

_CHARSETS = {
    "utf-8": "utf-8", "utf8": "utf-8", "utf-16": "utf-16-le", "utf-16le": "utf-16-le", "utf16": "utf-16-le", "gbk": "gbk", "gb2312": "gb2312", "big5": "big5",
    "iso8859-1": "latin-1", "latin1": "latin-1",
}
LINK = "@@@LINK="


@dataclass(frozen=True)
class Header:
    version: float
    width: int
    charset: str
    encrypted: int
    title: str
    end: int


def _attribute(text: str, name: str) -> str | None:
    m = re.search(rf'{name}\s*=\s*"([^"]*)"', text)
    return m and m[1]


def parse_header(data: bytes, resources: bool = False) -> Header:
    size = int.from_bytes(data[:4], "big")
    text = data[4 : 4 + size].decode("utf-16-le", "replace")
    number = re.match(r"\s*[0-9]+(?:\.[0-9]*)?", _attribute(text, "GeneratedByEngineVersion") or "2.0")
    version = float(number[0]) if number else 0.0
    if version >= 3:
        raise ValueError("MDict version 3 isn't supported")
    secret = _attribute(text, "Encrypted") or "0"
    flags = int(secret) if secret.isdigit() else 2 if secret.lower() in ("yes", "true") else 0
    charset = _CHARSETS.get((_attribute(text, "Encoding") or "utf-8").strip().lower(), "utf-8")
    return Header(version, 4 if version < 2 else 8, "utf-16-le" if resources else charset, flags, _attribute(text, "Title") or "", 8 + size)


def decrypt(data: bytes, check: bytes) -> bytes:
    """Undoes the keyword index's scrambling; the key comes from the block's checksum."""
    key, before, out = ripemd128(check + b"\x95\x36\x00\x00"), 0x36, bytearray(len(data))
    for n, b in enumerate(data):
        out[n] = (b >> 4 | (b & 15) << 4) ^ before ^ (n & 255) ^ key[n % len(key)]
        before = b
    return bytes(out)


def encrypt(data: bytes, check: bytes) -> bytes:
    """The inverse of ``decrypt``; tests write their files with it."""
    key, before, out = ripemd128(check + b"\x95\x36\x00\x00"), 0x36, bytearray(len(data))
    for n, b in enumerate(data):
        mixed = b ^ before ^ (n & 255) ^ key[n % len(key)]
        out[n] = before = mixed >> 4 | (mixed & 15) << 4
    return bytes(out)


def unpack(block: bytes, size: int | None = None) -> bytes:
    """A block: how it is packed, a checksum, data."""
    kind, data = int.from_bytes(block[:4], "little"), block[8:]
    if kind == 0:
        return data
    if kind == 1:
        if size is None:
            raise ValueError("an LZO block needs its unpacked size")
        return lzo1x(data, size)
    if kind == 2:
        return zlib.decompress(data)
    raise ValueError(f"unknown packing {kind}")


def _skip_text(at: Bytes, header: Header) -> None:
    unit = 2 if header.charset == "utf-16-le" else 1
    if header.width == 8:
        at.take((at.number(2) + 1) * unit)
    else:
        at.take(at.number(1) * unit)


def keywords(data: bytes, header: Header) -> tuple[list[tuple[str, int]], int]:
    """(headword, record offset) in file order, and where the record section begins."""
    at = Bytes(data, header.end)
    blocks, _ = at.number(header.width), at.number(header.width)
    if header.width == 8:
        at.number(8)
    index_size, total = at.number(header.width), at.number(header.width)
    if header.width == 8:
        at.take(4)
    index = at.take(index_size)
    if header.encrypted & 2:
        index = index[:8] + decrypt(index[8:], index[4:8])
    if header.width == 8:
        index = unpack(index)
    info, sizes = Bytes(index), []
    for _ in range(blocks):
        info.number(header.width)
        _skip_text(info, header)
        _skip_text(info, header)
        sizes.append((info.number(header.width), info.number(header.width)))
    end = at.at + total
    out, stop = [], b"\0\0" if header.charset == "utf-16-le" else b"\0"
    for packed, size in sizes:
        block = Bytes(unpack(at.take(packed), size))
        while block.left:
            offset = block.number(header.width)
            out.append((block.until(stop).decode(header.charset, "replace"), offset))
    return out, end


@dataclass(frozen=True)
class Records:
    """Blocks of the record section: starts in the unpacked stream, and where each block is in the file."""

    starts: list[int]
    places: list[tuple[int, int, int]]
    total: int


def records(data: bytes, header: Header, begin: int) -> Records:
    at = Bytes(data, begin)
    count, _, _, _ = (at.number(header.width) for _ in range(4))
    sizes = [(at.number(header.width), at.number(header.width)) for _ in range(count)]
    starts, places, file_at, total = [], [], at.at, 0
    for packed, size in sizes:
        starts.append(total)
        places.append((file_at, packed, size))
        file_at, total = file_at + packed, total + size
    return Records(starts, places, total)


class Stream:
    """The unpacked records, read from any offset across blocks."""

    def __init__(self, data: bytes, found: Records, cached: int = 8):
        self.data, self.records, self.cache = data, found, Cache(cached)

    def _block(self, n: int) -> bytes:
        at, packed, size = self.records.places[n]
        return self.cache.get(n, lambda: unpack(self.data[at : at + packed], size))

    def read(self, begin: int, end: int) -> bytes:
        if not self.records.starts or end <= begin:
            return b""
        n = bisect_right(self.records.starts, begin) - 1
        out, at = bytearray(), begin
        while at < end and n < len(self.records.starts):
            part = self._block(n)[at - self.records.starts[n] : end - self.records.starts[n]]
            out += part
            at, n = self.records.starts[n] + self.records.places[n][2], n + 1
        return bytes(out)


def ends(offsets: list[int], total: int) -> dict[int, int]:
    """Each offset's next different one, or the total."""
    different = sorted(set(offsets))
    return dict(zip(different, [*different[1:], total], strict=True))


class MDict(Format):
    name = "mdict"
    extensions = (".mdx",)
    markup = "mdict"

    def companions(self, path: str) -> list[str]:
        return [stem(path, ".mdx") + ".mdd"]

    def detect(self, path: str, head: bytes) -> bool:
        return path.lower().endswith(".mdx") and 0 < int.from_bytes(head[:4], "big") < 1 << 20

    def metadata(self, path: str, files: Files) -> Metadata:
        title = html.unescape(parse_header(files[path]).title).strip()
        if not title or title.startswith("<") or title == "Title (No HTML code allowed)":
            title = stem(base_name(path), ".mdx")
        return Metadata(title)

    def entries(self, path: str, files: Files) -> Iterator[Entry]:
        header = parse_header(files[path])
        yield from (Entry(word, offset, 0) for word, offset in keywords(files[path], header)[0])

    def reader(self, path: str, files: Files):
        data = files[path]
        header = parse_header(data)
        words, begin = keywords(data, header)
        found = records(data, header, begin)
        stream, stops = Stream(data, found), ends([o for _, o in words], found.total)

        def read(e: Entry) -> str:
            text = stream.read(e.offset, stops[e.offset]).decode(header.charset, "replace")
            return text.split("\0", 1)[0]

        return read

    def resources(self, path: str, files: Files) -> Iterator[tuple[str, bytes]]:
        """(key, content) of the companion .mdd; keys are lower-cased, with / for \\."""
        data = files.get(self.companions(path)[0])
        if data is None:
            return
        header = parse_header(data, resources=True)
        words, begin = keywords(data, header)
        found = records(data, header, begin)
        stream, stops = Stream(data, found), ends([o for _, o in words], found.total)
        for word, offset in words:
            yield word.lower().replace("\\", "/"), stream.read(offset, stops[offset])


def link_target(body: str) -> str | None:
    return body[len(LINK) :].strip() if body.startswith(LINK) else None
