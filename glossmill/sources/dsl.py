"""DSL dictionaries: text with header lines, flush-left headwords and indented bodies, packed with dictzip or not."""

from __future__ import annotations

import re
from collections.abc import Iterator

from glossmill.functions.headwords import expand
from glossmill.functions.text import LANGUAGE_ALIASES
from glossmill.sources.codecs import DictZip
from glossmill.sources.registry import Entry, Files, Format, Metadata, stem

_MARKS = ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8"))
_HEADER = re.compile(r'^#(NAME|INDEX_LANGUAGE|CONTENTS_LANGUAGE)\s+"([^"]*)"', re.MULTILINE)
_TAG = re.compile(r"\[/?[a-z!*'][^\]]*\]", re.IGNORECASE)


def decode(data: bytes) -> str:
    """By the byte order mark; UTF-8 without one. Line ends become one character."""
    mark, charset = next(((m, c) for m, c in _MARKS if data.startswith(m)), (b"", "utf-8"))
    return data[len(mark) :].decode(charset, "replace").replace("\r\n", "\n")


def unpacked(path: str, data: bytes) -> bytes:
    return DictZip(data).read_all() if path.lower().endswith(".dz") else data


def _lines(text: str) -> Iterator[tuple[int, str]]:
    """Lines behind the header, with their offsets."""
    at, header = 0, True
    for line in text.splitlines(keepends=True) if "\x0b" not in text and "\x0c" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        plain = line.rstrip("\n")
        header = header and (plain.startswith("#") or plain in ("", "\r"))
        if not header:
            yield at, plain
        at += len(line)


def scan(text: str) -> Iterator[tuple[list[str], int, int]]:
    """(headwords, offset, length) of each body that has headwords; the last headword comes first. Offsets are
    from 1, in characters."""
    headwords: list[str] = []
    begin = end = None
    for at, line in _lines(text):
        body = line[:1] in ("\t", " ", "[")
        blank = not line.strip(" \t")
        if begin is not None and (not body):
            if headwords:
                yield headwords[::-1], begin + 1, end - begin
            headwords, begin = [], None
        if blank and begin is None:
            continue
        if body:
            begin = at if begin is None else begin
            if not blank:
                end = at + len(line) + 1
            continue
        word = line[:-1] if line.endswith("\r") else line
        if word:
            headwords.append(word)
    if begin is not None and headwords:
        yield headwords[::-1], begin + 1, min(end, len(text)) - begin


class Dsl(Format):
    name = "dsl"
    extensions = (".dsl", ".dsl.dz")
    markup = "dsl"

    def companions(self, path: str) -> list[str]:
        base = stem(path, *self.extensions)
        return [f"{base}_abrv.dsl", f"{base}_abrv.dsl.dz"]

    def detect(self, path: str, head: bytes) -> bool:
        if not path.lower().endswith(self.extensions):
            return False
        return decode(unpacked(path, head)).lstrip().startswith("#")

    def metadata(self, path: str, files: Files) -> Metadata:
        text = decode(unpacked(path, files[path])).lstrip()
        header = re.match(r"(?:#[^\n]*\n|\s*\n)*", text)[0]
        found = dict(_HEADER.findall(header)[::-1])
        plain = lambda key: LANGUAGE_ALIASES.get(v := found.get(key, ""), v)
        return Metadata(found.get("NAME", ""), plain("INDEX_LANGUAGE"), plain("CONTENTS_LANGUAGE"))

    def entries(self, path: str, files: Files) -> Iterator[Entry]:
        for headwords, offset, length in scan(decode(unpacked(path, files[path]))):
            for word in headwords:
                for variant in expand(word):
                    if variant:
                        yield Entry(variant, offset, length)

    def reader(self, path: str, files: Files):
        text = decode(unpacked(path, files[path]))
        return lambda e: text[e.offset - 1 : e.offset - 1 + e.length]

    def abbreviations(self, path: str, files: Files) -> dict[str, str]:
        """The side table: first body line without tags, by headword; the first definition counts."""
        side = next((p for p in self.companions(path) if p in files), None)
        out: dict[str, str] = {}
        word, first = None, False
        for _, line in _lines(decode(unpacked(side, files[side]))) if side else ():
            if not line.strip(" \t"):
                continue
            if line[0] in "\t ":
                if word is not None and first:
                    out.setdefault(word, _TAG.sub("", line.strip()))
                first = False
            else:
                word, first = line.rstrip("\r"), True
        return out
