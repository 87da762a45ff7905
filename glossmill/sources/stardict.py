"""StarDict dictionaries: .ifo, .idx, .dict and optionally .syn beside each other."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from glossmill.sources.codecs import Bytes, DictZip
from glossmill.sources.registry import Entry, Files, Format, Metadata, first_of, stem

_MAGIC = b"StarDict's dict ifo file"


def parse_ifo(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").splitlines()
    if not lines or lines[0].strip("﻿ \t") != _MAGIC.decode():
        raise ValueError("not a StarDict .ifo file")
    pairs = (line.split("=", 1) for line in lines[1:] if "=" in line)
    return {k.strip(): v.strip() for k, v in pairs}


def _rows(data: bytes, offset_width: int, size_width: int) -> list[tuple[str, int, int]]:
    out, at = [], Bytes(data)
    while at.left:
        word = at.until().decode("utf-8", "replace")
        out.append((word, at.number(offset_width), at.number(size_width)))
    return out


def parse_idx(data: bytes, count: int | None, wide: bool) -> list[tuple[str, int, int]]:
    """(word, offset, size) in file order. Unless 64-bit offsets are declared, the widths are those by which the
    declared number of words comes out; values that were padded to 8 bytes are moved down."""
    if wide:
        return _rows(data, 8, 4)
    for widths in ((4, 4), (8, 4), (8, 8)):
        try:
            rows = _rows(data, *widths)
        except ValueError:
            continue
        if count is not None and len(rows) != count:
            continue
        if widths == (8, 8) and any(o or s for _, o, s in rows) and not any((o | s) & 0xFFFFFFFF for _, o, s in rows):
            rows = [(w, o >> 32, s >> 32) for w, o, s in rows]
        return rows
    raise ValueError("the .idx file doesn't fit its .ifo file")


def parse_syn(data: bytes) -> list[tuple[str, int]]:
    out, at = [], Bytes(data)
    while at.left:
        word = at.until().decode("utf-8", "replace")
        out.append((word, at.number(4)))
    return out


def fields(data: bytes, types: str | None) -> list[tuple[str, bytes]]:
    """(type, data) of a body: with a common sequence of types the last field runs to the end; without one each
    field begins with its type. Lower-case fields end with a NUL, upper-case ones have a 32-bit size."""
    out, at = [], Bytes(data)
    todo = list(types) if types else None
    while at.left and (todo is None or todo):
        kind = todo.pop(0) if todo is not None else chr(at.take(1)[0])
        if todo is not None and not todo:
            out.append((kind, at.take(at.left)))
        elif kind.isupper():
            out.append((kind, at.take(min(at.number(4), at.left))))
        else:
            out.append((kind, at.until()))
    return out


class StarDict(Format):
    name = "stardict"
    extensions = (".ifo",)
    markup = "stardict"

    def companions(self, path: str) -> list[str]:
        base = stem(path, ".ifo")
        return [base + x for x in (".idx", ".idx.gz", ".dict", ".dict.dz", ".syn")]

    def detect(self, path: str, head: bytes) -> bool:
        return path.lower().endswith(".ifo") and _MAGIC in head[:64]

    def metadata(self, path: str, files: Files) -> Metadata:
        ifo = parse_ifo(files[path])
        return Metadata(ifo.get("bookname", ""), extra={"sametypesequence": ifo.get("sametypesequence", "")})

    def index(self, path: str, files: Files) -> list[tuple[str, int, int]]:
        base, ifo = stem(path, ".ifo"), parse_ifo(files[path])
        data = files.get(f"{base}.idx")
        if data is None and f"{base}.idx.gz" in files:
            data = gzip.decompress(files[f"{base}.idx.gz"])
        if data is None:
            raise ValueError(f"no .idx file beside {path}")
        count = int(ifo["wordcount"]) if ifo.get("wordcount", "").isdigit() else None
        return parse_idx(data, count, ifo.get("idxoffsetbits") == "64")

    def entries(self, path: str, files: Files) -> Iterator[Entry]:
        """Main entries in file order, then synonyms; ordinals out of range are dropped."""
        rows = self.index(path, files)
        yield from (Entry(*r) for r in rows)
        for word, n in parse_syn(files.get(stem(path, ".ifo") + ".syn", b"")):
            if n < len(rows):
                yield Entry(word, *rows[n][1:])

    def reader(self, path: str, files: Files):
        """Bodies as text: fields that are text, decoded, each on its own lines."""
        raw, types = self.raw_reader(path, files), parse_ifo(files[path]).get("sametypesequence")
        return lambda e: "\n".join(d.decode("utf-8", "replace") for k, d in fields(raw(e), types) if k.lower() not in "wp")

    def raw_reader(self, path: str, files: Files):
        base = stem(path, ".ifo")
        data, packed = files.get(f"{base}.dict"), first_of(files, f"{base}.dict.dz")
        if data is None and packed is None:
            raise ValueError(f"no .dict file beside {path}")
        if data is not None:
            return lambda e: data[e.offset : e.offset + e.length]
        pages = DictZip(packed)
        return lambda e: pages.read(e.offset, e.length)
