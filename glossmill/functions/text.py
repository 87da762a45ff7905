"""Scalar text functions: normalised headwords, labels, plain text, and single-purpose rewrites.

All are column expressions but ``normalize``, an Arrow function with the same result as ``normalized``. Either is
meant to run once, when entries are indexed; words of a query are normalised on the driver by ``normalize_word``,
so predicates compare a stored column with a literal and reach the scan.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.sources.codecs import ripemd128


def normalize_word(word: str | None) -> str:
    """Compatibility decomposition without nonspacing marks, in lower case; null gives the empty string."""
    if not word:
        return ""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", word) if unicodedata.category(c) != "Mn").lower()


@F.pandas_udf(T.StringType())
def normalize(words: pd.Series) -> pd.Series:
    """normalize_word for a column; every different word of a batch is computed once."""
    codes, different = pd.factorize(words)
    table = [normalize_word(w) for w in different] + [""]
    return pd.Series([table[c] for c in codes], index=words.index, dtype=object)


def _characters(inside: Callable[[str], bool]) -> str:
    """The characters of a kind, as a class's inner part in a Java regular expression."""
    ranges, start = [], None
    for code in range(0x80, sys.maxunicode + 2):
        met = code <= sys.maxunicode and not 0xD800 <= code <= 0xDFFF and inside(chr(code))
        if met and start is None:
            start = code
        elif not met and start is not None:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{code - 1:x}}}")
            start = None
    return "".join(ranges)


@lru_cache(maxsize=1)
def _latin() -> tuple[str, str, str]:
    """Latin letters whose normalised form is one character: as a regular expression, those that change, and their forms."""
    simple = {c for c in map(chr, range(0x250)) if len(normalize_word(c)) == 1}
    pairs = [(c, normalize_word(c)) for c in sorted(simple) if normalize_word(c) != c]
    return rf"^[\x00-\x7f{_characters(lambda c: c in simple)}]*$", "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache(maxsize=1)
def _unicode() -> tuple[str, str, str, str]:
    """By Python's own tables: nonspacing marks, a sigma at the end of a word, and letters with their lower case."""
    marks = _characters(lambda c: unicodedata.category(c) == "Mn")
    ignored = _characters(lambda c: f"A{c}Σ".lower()[-1] == "ς" != f"{c}Σ".lower()[-1]) + "".join(rf"\x{{{ord(c):x}}}" for c in map(chr, range(0x80)) if not c.isalpha() and f"A{c}Σ".lower()[-1] == "ς")
    cased = "A-Za-z" + _characters(lambda c: f"{c}Σ".lower()[-1] == "ς")
    pairs = [(c, c.lower()) for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and c.lower() != c and len(c.lower()) == 1]
    return f"[{marks}]+", f"([{cased}][{ignored}]*)Σ(?![{ignored}]*[{cased}])", "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalized(word: Column) -> Column:
    """normalize_word as an expression of Spark's own, so no row goes to Python. Words of ASCII and of Latin letters are
    mapped letter by letter. For others ICU, which Spark holds, decomposes, and the rest follows Python's tables; there
    both may differ in characters that are newer than Python's Unicode."""
    simple, letters, forms = _latin()
    marks, final, upper, lower = _unicode()
    whole = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(word, F.lit("")), F.lit(True))
    # Java's class of marks is fast but older; Python's is asked for what Java doesn't know.
    plain = F.regexp_replace(whole, r"[\p{Mn}&&[^\u1734]]+", "")
    plain = F.when(F.rlike(plain, F.lit(r"\p{Cn}")), F.regexp_replace(plain, marks, "")).otherwise(plain)
    plain = F.when(F.contains(plain, F.lit("Σ")), F.regexp_replace(plain, final, "$1ς")).otherwise(plain)
    ascii_only = F.octet_length(word) == F.char_length(word)
    return (
        F.when(word.isNull(), "").when(ascii_only, F.lower(word)).when(F.rlike(word, F.lit(simple)), F.translate(word, letters, forms))
        .otherwise(F.translate(plain, upper, lower))
    )


@F.pandas_udf(T.StringType())
def ripemd128_hex(messages: pd.Series) -> pd.Series:
    """Digests of texts in UTF-8."""
    return messages.map(lambda m: ripemd128(m.encode()).hex() if m is not None else None)


def replaced(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements, one after another."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _code_point(digits: Column) -> Column:
    """The character of a decimal number, or null where there is none."""
    n = digits.try_cast("int") if hasattr(digits, "try_cast") else F.expr("null")
    inside = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    return F.when(inside, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def decimal_entities(text: Column) -> Column:
    """&#N; as the character N; numbers of no character stay as they are."""
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit("&#([0-9]+);"), F.lit(1)))
    put = lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), F.coalesce(_code_point(n), F.concat(F.lit("&#"), n, F.lit(";"))))
    return F.when(F.contains(text, F.lit("&#")), F.aggregate(numbers, text, put)).otherwise(text)


#: Entities that plain text decodes one after another, so &amp;lt; ends as <.
PLAIN_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'))
#: Length in bytes of EPWING escapes by command; any other is 2.
EPWING_ESCAPES = {
    **dict.fromkeys((0x09, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F, 0x41, 0x42, 0x43, 0x45, 0xE0), 4),
    **dict.fromkeys((0x4B, 0x52, 0x62, 0x63, 0x64), 8),
    0x53: 10,
    0x44: 12,
    0x4A: 18,
    **dict.fromkeys((0x3C, 0x4D), 20),
    0x4F: 34,
}


def plain_text(raw: Column, markup: Column | str) -> Column:
    """Text of an entry without its format's markup, for indexing: dsl and epwing by their own rules, any other
    format by HTML's; then entities, then white space. Null gives the empty string."""
    kind = F.lit(markup) if isinstance(markup, str) else markup
    dsl = F.regexp_replace(raw, r"(?i)\[/?[a-z!*'][^\]]*\]", "")
    dsl = F.regexp_replace(F.regexp_replace(dsl, "<<([^>]+)>>", "$1"), r"\{\{[^}]*\}\}", "")
    dsl = F.regexp_replace(dsl, r"\\([\]\[()<>{}~@\\ ])", "$1")
    # One pass, so that bytes of an escape are never taken for the next one.
    forms = "|".join(rf"\x{c:02X}.{{0,{n - 2}}}" for c, n in EPWING_ESCAPES.items())
    epwing = F.regexp_replace(raw, rf"(?s)\x1F(?:{forms}|[^\n])", "")
    text = F.when(kind == "dsl", dsl).when(kind == "epwing", epwing).otherwise(F.regexp_replace(raw, "<[^>]+>", ""))
    text = decimal_entities(replaced(text, PLAIN_ENTITIES))
    return F.coalesce(F.btrim(F.regexp_replace(text, "[ \t\n\r]+", " ")), F.lit(""))


def unescape_headword(headword: Column) -> Column:
    return F.regexp_replace(headword, r"\\([\]\[{}()])", "$1")


#: Names of languages as some dictionaries write them, and their usual form.
LANGUAGE_ALIASES = {
    "Egnlish": "English",
    "GermanNewSpelling": "German",
    "PortugueseStandard": "Portuguese",
    "SpanishModernSort": "Spanish",
    "SpanishTraditionalSort": "Spanish",
}


def language(name: Column) -> Column:
    out = name
    for alias, plain in LANGUAGE_ALIASES.items():
        out = F.when(name == alias, plain).otherwise(out)
    return out


def group_label(source: Column, target: Column) -> Column:
    """"S → T" where both are known, else Unknown."""
    return F.when((source != "") & (target != ""), F.concat(source, F.lit(" → "), target)).otherwise("Unknown")


def scope_label(source: Column, target: Column, group: Column) -> Column:
    """The scope that searches are limited to: a group's name, or "S → T", or all."""
    either = F.concat(F.coalesce(source, F.lit("<all>")), F.lit(" → "), F.coalesce(target, F.lit("<all>")))
    return F.coalesce(group, F.when(source.isNotNull() | target.isNotNull(), either), F.lit("<all>"))


def goldendict_normalize(name: Column) -> Column:
    """A dictionary's name for loose comparison."""
    s = replaced(name, (("&amp;", "&"), ("&apos;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")))
    s = F.lower(F.regexp_replace(s, "&#[0-9]+;", ""))
    s = F.regexp_replace(F.regexp_replace(s, r"\[[-a-z]+\]", ""), r"[^\p{L}\p{N} ]", "")
    return F.btrim(F.regexp_replace(s, "[ \t]+", " "))


def truncated(text: Column, limit: int = 80) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def section_header(name: Column, width: int = 70) -> Column:
    """━━ NAME and a rule up to the width; a longer name isn't cut."""
    head = F.concat(F.lit("━━ "), name, F.lit(" "))
    return F.concat(head, F.repeat(F.lit("━"), F.greatest(F.lit(0), F.lit(width) - F.length(head))))


def is_image(name: Column) -> Column:
    return F.lower(name).rlike(r"[.](?:png|jpe?g|gif|bmp|svg|tiff|webp|ico)$")


def is_audio(name: Column) -> Column:
    return F.lower(name).rlike(r"[.](?:wav|mp3|ogg|spx|opus)$")


def resource_zip(path: Column) -> Column:
    """The companion archive of a dictionary file."""
    return F.concat(F.regexp_replace(path, r"[.]dz$", ""), F.lit(".files.zip"))


def minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def dict_id(path: Column) -> Column:
    """Identity of a dictionary: the digest of its path."""
    return F.md5(path)


def links(html: Column) -> Column:
    """Targets of a page's href attributes, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def wildcard_regex(pattern: str) -> str | None:
    """A wildcard pattern (? one, * any) as an anchored regular expression over normalised headwords.

    As in LIKE with an escape: % and _ of the user are escaped, a backslash escapes what follows it, and a pattern
    that ends in a lone backslash matches nothing (None).
    """
    like = "".join({"%": "\\%", "_": "\\_", "?": "_", "*": "%"}.get(c, c) for c in normalize_word(pattern))
    out, n = [], 0
    while n < len(like):
        c = like[n]
        if c == "\\":
            if n + 1 == len(like):
                return None
            n += 1
            out.append(_literal(like[n]))
        else:
            out.append({"_": ".", "%": ".*"}.get(c) or _literal(c))
        n += 1
    return "(?s)\\A" + "".join(out) + "\\z"


def _literal(c: str) -> str:
    return c if c.isalnum() or ord(c) > 127 else f"\\x{{{ord(c):x}}}"


def literal_prefix(pattern: str) -> str:
    """What every match of a wildcard pattern begins with, as far as no special character comes."""
    word = normalize_word(pattern)
    end = next((n for n, c in enumerate(word) if c in "?*%_\\"), len(word))
    return word[:end]


def is_wildcard(pattern: Column) -> Column:
    return pattern.rlike("[?*]")
