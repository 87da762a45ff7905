"""Babylon dictionaries (.bgl): a gzip stream of typed blocks behind a short header."""

from __future__ import annotations

from collections.abc import Iterator

from glossmill.sources.codecs import Bytes, gunzip
from glossmill.sources.registry import Entry, Files, Format, Metadata

#: Languages by code.
LANGUAGES = (
    "English", "French", "Italian", "Spanish", "Dutch", "Portuguese", "German", "Russian", "Japanese", "Traditional Chinese", "Simplified Chinese", "Greek", "Korean",
    "Turkish", "Hebrew", "Arabic", "Thai", "Other",
)
#: Character sets by code; any other is UTF-8.
CHARSETS = {
    0x41: "cp1252", 0x42: "cp1252", 0x43: "cp1250", 0x44: "cp1251", 0x45: "cp932", 0x46: "cp950", 0x47: "cp936", 0x48: "cp1257", 0x49: "cp1253", 0x4A: "cp949",
    0x4B: "cp1254", 0x4C: "cp1255", 0x4D: "cp1256", 0x4E: "cp874",
}
DEFAULT = 0x41


def stream(data: bytes) -> bytes:
    return gunzip(data[int.from_bytes(data[4:6], "big") :])


def blocks(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(type, start, length): the low half of the first byte is the type; the high half is a length from 4 on, or
    else one less than the number of length bytes that follow."""
    at = 0
    while at < len(data):
        kind, high = data[at] & 15, data[at] >> 4
        at += 1
        if high < 4:
            width = high + 1
            if at + width > len(data):
                return
            length = int.from_bytes(data[at : at + width], "big")
            at += width
        else:
            length = high - 4
        yield kind, at, length
        at += length


def properties(data: bytes) -> dict[int, bytes]:
    return {data[a]: data[a + 1 : a + n] for kind, a, n in blocks(data) if kind == 3 and n >= 2}


def _charset(found: dict[int, bytes], key: int) -> str:
    return CHARSETS.get(found[key][0] if key in found else DEFAULT, "utf-8")


def _short(data: bytes, begin: int, end: int) -> list[Entry]:
    """Headword, definition and alternatives, with lengths of 1, 2 and 1 bytes. Alternatives that run over are left."""
    at = Bytes(data[:end], begin)
    try:
        word = at.take(at.number(1)).decode("utf-8", "replace")
        length = at.number(2)
        place = at.at
        at.take(length)
    except ValueError:
        return []
    out = [Entry(word, place, length)]
    while at.left:
        try:
            out.append(Entry(at.take(at.number(1)).decode("utf-8", "replace"), place, length))
        except ValueError:
            break
    return out


def _long(data: bytes, begin: int, end: int) -> list[Entry]:
    """The same with 4-byte lengths and the alternatives, by number, before the definition; they come out behind
    the headword."""
    at = Bytes(data[:end], begin + 1)
    try:
        word = at.take(at.number(4)).decode("utf-8", "replace")
        others = [at.take(at.number(4)).decode("utf-8", "replace") for _ in range(at.number(4))]
        length = at.number(4)
        place = at.at
        at.take(length)
    except ValueError:
        return []
    return [Entry(w, place, length) for w in (word, *others[::-1])]


def stripped(data: bytes) -> bytes:
    """Without control sequences: fields behind 0x14, resource marks and carriage returns."""
    out, at, n = bytearray(), 0, len(data)
    #: bytes of type, bytes of length
    shapes = {0x18: (0, 1), 0x28: (0, 2), 0x50: (1, 1), 0x60: (1, 2)}
    while at < n:
        b = data[at]
        at += 1
        if b == 0x14 and at < n:
            code = data[at]
            at += 1
            if code == 0x02:
                at += 1
            elif code in shapes:
                kind, width = shapes[code]
                if at + kind + width <= n:
                    at += kind + width + int.from_bytes(data[at + kind : at + kind + width], "big")
        elif b not in (0x14, 0x1E, 0x1F, 0x0D):
            out.append(b)
    return bytes(out)


class Bgl(Format):
    name = "bgl"
    extensions = (".bgl",)
    markup = "bgl"

    def detect(self, path: str, head: bytes) -> bool:
        return head[:3] == b"\x12\x34\x00" and head[3] in (1, 2) and 1 <= int.from_bytes(head[4:6], "big") <= 255

    def metadata(self, path: str, files: Files) -> Metadata:
        found = properties(stream(files[path]))
        name = lambda key: LANGUAGES[min(found[key][0], len(LANGUAGES) - 1)] if key in found else ""
        return Metadata(found.get(0x01, b"").decode(_charset(found, 0x1A), "replace"), name(0x07), name(0x08))

    def entries(self, path: str, files: Files) -> Iterator[Entry]:
        data = stream(files[path])
        for kind, at, n in blocks(data):
            if kind in (1, 7, 10, 13) and n >= 4:
                yield from _short(data, at, at + n)
            elif kind == 11 and n >= 10:
                yield from _long(data, at, at + n)

    def reader(self, path: str, files: Files):
        data = stream(files[path])
        charset = _charset(properties(data), 0x1B)
        return lambda e: stripped(data[e.offset : e.offset + e.length]).decode(charset, "replace")
