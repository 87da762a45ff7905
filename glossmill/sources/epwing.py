"""EPWING and EB books: a catalogue of subbooks, each with a text file that holds its own search index."""

from __future__ import annotations

from collections.abc import Iterator

from glossmill.functions.text import EPWING_ESCAPES
from glossmill.sources.codecs import Bytes, EbZip
from glossmill.sources.registry import Entry, Files, Format, Metadata, base_name

PAGE = 2048
#: Kinds of search index, the preferred first.
INDEXES = (0x71, 0x70, 0x72, 0x91, 0x90, 0x92)
TEXTS = ("HONMON", "HONMON.EBZ", "HONMON2", "HONMON2.EBZ", "START", "START.EBZ")
_WIDE = {0xFF01 + n: 0x21 + n for n in range(94)} | {0x3000: 0x20}


def narrow(text: str) -> str:
    """Full-width letters as ASCII."""
    return text.translate(_WIDE)


def _pairs(data: bytes, low: int, high: int) -> Iterator[tuple[int, int]]:
    return ((a, b) for a, b in zip(data[::2], data[1::2], strict=False) if low <= a <= high and low <= b <= high)


def _is_jis(data: bytes) -> bool:
    """Whether a pair of bytes is of a row that ASCII text hardly has first."""
    return any(a < 0x30 for a, _ in _pairs(data, 0x21, 0x7E))


def charset(catalog: bytes | None) -> str:
    """jis, euc-jp or latin-1, by the first subbook's title; jis where there is no catalogue."""
    if catalog is None:
        return "jis"
    title = catalog[18:98]
    if _is_jis(title):
        return "jis"
    return "euc-jp" if any(True for _ in _pairs(title, 0xA1, 0xFE)) else "latin-1"


def decode(data: bytes, kind: str) -> str:
    if kind == "jis":
        data, kind = bytes(b + 0x80 & 0xFF for b in data), "euc-jp"
    return data.decode(kind, "replace")


def subbooks(data: bytes, eb: bool) -> list[tuple[str, str, int]]:
    """(title, directory, index page) of each subbook; EB catalogues are shorter and have no page, which is 1."""
    size, title = (40, 30) if eb else (164, 80)
    out = []
    for n in range(int.from_bytes(data[:2], "big")):
        row = data[16 + n * size : 16 + (n + 1) * size]
        raw = row[2 : 2 + title].rstrip(b"\0")
        name = narrow(decode(raw, "jis" if _is_jis(raw) else "euc-jp")).rstrip("\0 　")
        directory = row[2 + title : 10 + title].decode("latin-1").strip("\0 ")
        out.append((name or "Unknown", directory, 1 if eb else int.from_bytes(row[14 + title : 16 + title], "big")))
    return out


class Book:
    """A subbook's text file by pages, packed or not."""

    def __init__(self, path: str, data: bytes):
        packed = path.upper().endswith(".EBZ")
        zipped = EbZip(data) if packed else None
        self.read = zipped.read if packed else lambda at, n: data[at : at + n]
        self.size = zipped.size if packed else len(data)

    def page(self, n: int) -> bytes:
        return self.read((n - 1) * PAGE, PAGE)

    def index_page(self, management: int) -> int | None:
        """First page of the preferred search index, from the table on the management page."""
        data = self.page(management)
        table = {}
        for n in range(data[1]):
            row = data[16 + 16 * n : 32 + 16 * n]
            if len(row) == 16:
                table.setdefault(row[0], int.from_bytes(row[2:6], "big"))
        return next((table[k] for k in INDEXES if k in table), None)

    def keys(self, start: int, kind: str) -> Iterator[tuple[str, int]]:
        """(headword, text position) of all leaves below a page, in order; a page is read once."""
        seen, todo = set(), [start]
        while todo:
            number = todo.pop()
            if number <= 0 or number in seen or number * PAGE > self.size + PAGE - 1:
                continue
            seen.add(number)
            data = self.page(number)
            leaf, fixed, count = bool(data[0] & 0x80), data[1], int.from_bytes(data[2:4], "big")
            at, below = Bytes(data, 4), []
            for _ in range(count):
                try:
                    key = at.take(fixed or at.number(1))
                    if leaf:
                        page, within = at.number(4), at.number(2)
                        at.take(6)
                        word = _key(key, kind)
                        if page > 0 and word:
                            yield word, (page - 1) * PAGE + within
                    else:
                        below.append(at.number(4))
                except ValueError:  # more entries announced than the page holds
                    break
            todo += below[::-1]

    def text(self, at: int) -> bytes:
        """Up to the end mark or the second keyword mark."""
        out, marks = bytearray(), 0
        scanned = 0
        while at < self.size:
            part = self.read(at, min(16 * PAGE, self.size - at))
            out += part
            at += len(part)
            while 0 <= (found := out.find(0x1F, scanned)) < len(out) - 1:
                if out[found + 1] == 0x03:
                    return bytes(out[:found])
                if out[found + 1] == 0x41:
                    marks += 1
                    if marks == 2:
                        return bytes(out[:found])
                scanned = found + 1
            scanned = max(scanned, len(out) - 1)
        return bytes(out)


def _key(raw: bytes, kind: str) -> str:
    return narrow(decode(raw.rstrip(b"\0"), kind)).strip("。．. \t\n")


def escape_length(data: bytes, at: int) -> int:
    return min(EPWING_ESCAPES.get(data[at + 1], 2) if at + 1 < len(data) else 1, len(data) - at)


def decoded(raw: bytes, kind: str) -> str:
    """Text with escapes kept, one character a byte."""
    out, at, begin = [], 0, 0
    while at < len(raw):
        if raw[at] != 0x1F:
            at += 1
            continue
        out.append(decode(raw[begin:at], kind))
        n = escape_length(raw, at)
        out.append(raw[at : at + n].decode("latin-1"))
        at = begin = at + n
    out.append(decode(raw[begin:], kind))
    return "".join(out)


class Epwing(Format):
    """The main file is a subbook's text; its catalogue is up to four directories above."""

    name = "epwing"
    extensions = tuple(x.lower() for x in TEXTS)
    markup = "epwing"

    def companions(self, path: str) -> list[str]:
        parts = path.split("/")[:-1]
        return ["/".join([*parts[: len(parts) - n], name]) for n in range(4) for name in ("CATALOGS", "CATALOG", "catalogs", "catalog") if len(parts) > n]

    def detect(self, path: str, head: bytes) -> bool:
        return base_name(path).upper() in TEXTS

    def _catalog(self, path: str, files: Files) -> tuple[str, bytes] | None:
        return next(((p, files[p]) for p in self.companions(path) if p in files), None)

    def _subbook(self, path: str, files: Files) -> tuple[str, str, int]:
        found = self._catalog(path, files)
        if found is None:
            raise ValueError(f"no catalogue above {path}")
        books = subbooks(found[1], base_name(found[0]).upper() == "CATALOG")
        upper = [p.upper() for p in path.split("/")]
        return next((b for b in books if b[1].upper() in upper), books[0])

    def metadata(self, path: str, files: Files) -> Metadata:
        return Metadata(self._subbook(path, files)[0], extra={"group": "EPWING"})

    def _open(self, path: str, files: Files) -> tuple[Book, str]:
        found = self._catalog(path, files)
        return Book(path, files[path]), charset(found and found[1])

    def entries(self, path: str, files: Files) -> Iterator[Entry]:
        book, kind = self._open(path, files)
        start = book.index_page(self._subbook(path, files)[2])
        if start is not None:
            yield from (Entry(word, at, 0) for word, at in book.keys(start, kind))

    def reader(self, path: str, files: Files):
        book, kind = self._open(path, files)
        return lambda e: decoded(book.text(e.offset), kind)
