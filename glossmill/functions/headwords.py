"""Variants of DSL headwords: alternatives, optional parts and escapes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: more variants than this come from malformed headwords.
MOST = 64
_MEDIA = re.compile(r"\{\{(?:[^}]|\}[^}])*\}\}")
_BRACE = re.compile(r"(?<!\\)\{([^}]*)\}")
_PAREN = re.compile(r"(?<!\\)\(([^)]*)\)")
_ESCAPE = re.compile(r"\\([\]\[{}()])")
_SPLIT = re.compile(r"(?<!\\)\{/\}")


def _grown(words: list[str], group: re.Pattern, forms) -> list[str]:
    """Expands the first group of each word until none has one; a group becomes its forms, in order. No more words
    are grown than can be shown, since every word yields at least one."""
    out = []
    for word in words:
        stack = [word]
        while stack and len(out) < MOST:
            now = stack.pop()
            m = group.search(now)
            if m:
                stack += [now[: m.start()] + form + now[m.end() :] for form in reversed(forms(m[1]))]
            else:
                out.append(now)
    return out


def expand(headword: str) -> list[str]:
    """{a/b} gives each alternative, {x} is x, (x) is optional, {/} separates whole headwords, {{...}} is dropped."""
    clean = _MEDIA.sub("", headword)
    parts = [p for p in clean.split("{/}") if p] if _SPLIT.search(clean) else [clean]
    words = _grown(parts or [clean], _BRACE, lambda inner: inner.split("/"))
    words = _grown(words, _PAREN, lambda inner: ["", inner])
    return [_ESCAPE.sub(r"\1", w) for w in words[:MOST]]


@F.pandas_udf(T.ArrayType(T.StringType()))
def variants(headwords: pd.Series) -> pd.Series:
    return headwords.map(lambda h: expand(h) if h is not None else [])
