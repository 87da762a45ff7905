"""Dictionary formats and their registry.

A format reads bytes that Spark has read: ``files`` maps the names of a dictionary's files (its own and those beside
it) to their content. So any store that Spark reads will do, and decoding runs in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import NamedTuple

Files = Mapping[str, bytes]


class Entry(NamedTuple):
    """A headword and where its body is; key is for formats whose bodies have no extent."""

    headword: str
    offset: int
    length: int
    key: str | None = None


@dataclass
class Metadata:
    name: str = ""
    source_lang: str = ""
    target_lang: str = ""
    extra: dict[str, str] = field(default_factory=dict)


class Format:
    """One dictionary format. ``path`` is the dictionary's main file."""

    name = ""
    extensions: tuple[str, ...] = ()
    skip_index = False
    markup = "html"

    def companions(self, path: str) -> list[str]:
        """Other files that the dictionary may have; the first of each tuple that is there counts."""
        return []

    def detect(self, path: str, head: bytes) -> bool:
        """Whether a file, by its path and beginning, is a dictionary's; formats without files have none."""
        return False

    def metadata(self, path: str, files: Files) -> Metadata:
        return Metadata()

    def entries(self, path: str, files: Files) -> Iterator[Entry]:
        raise NotImplementedError

    def bodies(self, path: str, files: Files) -> Iterator[str]:
        """Bodies in the order of ``entries``."""
        reader = self.reader(path, files)
        return (reader(e) for e in self.entries(path, files))

    def reader(self, path: str, files: Files):
        """A function from an entry to its body as text."""
        raise NotImplementedError

    def discover(self) -> list[dict]:
        """Dictionaries that aren't files, by the columns of ``scan.HOOKED``."""
        return []

    def query_exact(self, path: str, word: str) -> Iterator[tuple[str, str]] | None:
        """(key, body) of a word's entries in a dictionary, by the format itself; None where entries are stored."""
        return None


class Registry:
    """Formats by name, the latest first; a name that is registered again replaces the old format."""

    def __init__(self):
        self.formats: list[Format] = []

    def register(self, format_: Format) -> None:
        self.formats = [format_, *(f for f in self.formats if f.name != format_.name)]

    def get(self, name: str) -> Format | None:
        return next((f for f in self.formats if f.name == name), None)

    def extensions(self) -> list[str]:
        return sorted({x for f in self.formats for x in f.extensions})

    def detect(self, path: str, head: bytes) -> Format | None:
        """The first format that takes the file; one that fails on it doesn't."""
        for f in self.formats:
            try:
                if f.detect(path, head):
                    return f
            except (ValueError, IndexError, KeyError, UnicodeError):
                continue
        return None


def stem(path: str, *suffixes: str) -> str:
    """The path without the longest of the suffixes that it has."""
    lower = path.lower()
    for s in sorted(suffixes, key=len, reverse=True):
        if lower.endswith(s):
            return path[: -len(s)]
    return path


def base_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def first_of(files: Files, *names: str) -> bytes | None:
    return next((files[n] for n in names if n in files), None)
