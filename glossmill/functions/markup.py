"""Rendering of entry markup to plain text with styled spans and links.

Every renderer walks its input once and writes to a Page, which keeps the text, the open tags and the finished
spans. What the rendering needs besides the body (abbreviations, resources) is an argument, so it can be a column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions.text import EPWING_ESCAPES

#: Names of colours, by the class that they are shown in.
COLOURS = {
    "green": "green darkgreen darkolivegreen darkseagreen forestgreen limegreen mediumseagreen olive olivedrab seagreen yellowgreen",
    "red": "red darkred crimson firebrick indianred lightcoral maroon tomato",
    "blue": "blue aqua cadetblue cyan darkblue darkcyan darkturquoise dodgerblue lightblue lightseagreen mediumblue midnightblue navy royalblue skyblue steelblue teal",
    "gray": "black gray grey darkgray darkslategray dimgray lightgray lightslategray silver slategray",
    "brown": "brown burlywood chocolate coral darkgoldenrod goldenrod peru rosybrown saddlebrown sandybrown sienna tan wheat",
    "violet": "blueviolet darkmagenta darkorchid darkslateblue darkviolet deeppink fuchsia indigo magenta mediumslateblue mediumvioletred orchid palevioletred plum purple slateblue violet",
    "orange": "darkorange lightsalmon orange orangered",
}
_COLOUR_OF = {name: kind for kind, names in COLOURS.items() for name in names.split()}
#: Named entities that rendering knows.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "nbsp": " ", "quot": '"', "apos": "'"}
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]+)|#([0-9]+)|([a-zA-Z]+));")
RENDERED = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("style", T.StringType())]))),
    T.StructField("links", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("target", T.StringType())]))),
])


def decode_entities(text: str) -> str:
    """In one pass, so &amp;lt; becomes &lt;; what isn't known stays."""

    def put(m: re.Match) -> str:
        if m[3]:
            return ENTITIES.get(m[3], m[0])
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(put, text)


def colour(name: str) -> str:
    """A colour's class: by name, or by the value of #rgb, #rrggbb or #rrrrggggbbbb; else default."""
    name = name.strip().lower()
    if name in _COLOUR_OF:
        return _COLOUR_OF[name]
    m = re.fullmatch(r"#((?:[0-9a-f]{3}){1,4})", name)
    if not m:
        return "default"
    n = len(m[1]) // 3
    r, g, b = (int(m[1][k * n : (k + 1) * n], 16) * 65535 // (16**n - 1) for k in range(3))
    high, low = max(r, g, b), min(r, g, b)
    if high < 6554 or low > 58982 or high - low < high // 7:
        return "gray"
    if high == r:
        steps = ((b > high * 3 // 5, "violet"), (g > high * 7 // 10, "orange"), (g > high * 2 // 5, "brown"))
        return next((kind for holds, kind in steps if holds), "red")
    if high == g:
        return "blue" if b > high * 7 // 10 else "green"
    return "violet" if r > high * 3 // 5 else "blue"


class Page:
    """Text under construction. Runs of line ends may be limited; tags that nest wrongly close by name."""

    def __init__(self, most_line_ends: int | None = None):
        self.parts: list[str] = []
        self.at, self.ends, self.most = 0, 0, most_line_ends
        self.open: list[tuple[str, int, str]] = []
        self.spans: list[tuple[int, int, str]] = []
        self.links: list[tuple[int, int, str, str]] = []

    def write(self, text: str) -> None:
        if self.most is not None and "\n" in text:
            text = re.sub(r"\n{%d,}" % (self.most + 1), "\n" * self.most, text)
            lead = len(text) - len(text.lstrip("\n"))
            text = text[max(0, lead + self.ends - self.most) if lead else 0 :]
        if text:
            self.parts.append(text)
            self.at += len(text)
            rest = text.rstrip("\n")
            self.ends = len(text) - len(rest) + (0 if rest else self.ends)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def begin(self, name: str, arguments: str = "") -> None:
        self.open.append((name, self.at, arguments))

    def end(self, name: str) -> tuple[int, str] | None:
        """The start and arguments of the latest open tag of this name, which is closed."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                _, start, arguments = self.open.pop(k)
                return start, arguments
        return None

    def style(self, start: int, name: str) -> None:
        self.spans.append((start, self.at, name))

    def link(self, start: int, kind: str, target: str) -> None:
        self.links.append((start, self.at, kind, target))

    def since(self, start: int) -> str:
        return self.text[start : self.at]

    def result(self) -> dict:
        return {"text": self.text, "spans": sorted(self.spans), "links": sorted(self.links)}


#: What paired tags of HTML and XDXF look like.
_HTML_STYLES = {"b": ("bold",), "strong": ("bold",), "i": ("italic",), "em": ("italic",), "u": ("underline",), "sup": ("bold", "raised"), "sub": ("lowered",)}
_XDXF_STYLES = {"gr": ("italic",), "ex": ("example",), "abbr": ("italic",), "b": ("bold",), "i": ("italic",), "c": ("colour:default",), "k": ("bold",)}
_TAG = re.compile(r"<(/?)([a-zA-Z_]+)([^>]*)>")
_SOUND = re.compile(r"""href\s*=\s*["']sound://([^"']+)["']""", re.IGNORECASE)
_HREF = re.compile(r"""href\s*=\s*["'](?:bword://|entry://)?([^"']+)["']""", re.IGNORECASE)
_DROPPED = re.compile(r"<style[^>]*>.*?</style>|<script[^>]*>.*?</script>|<link[^>]*/?>|<!--.*?-->", re.IGNORECASE | re.DOTALL)
_BREAKS = (
    (re.compile(r"<br\s*/?>|<hr\s*/?>", re.IGNORECASE), "\n"),
    (re.compile(r"</p>\s*", re.IGNORECASE), "\n\n"),
    (re.compile(r"<p[^>]*>", re.IGNORECASE), ""),
    (re.compile(r"</?div[^>]*>", re.IGNORECASE), "\n"),
)
_IMAGE = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".svg", ".tiff", ".webp", ".ico")
_AUDIO = (".wav", ".mp3", ".ogg", ".spx", ".opus")


def _media(name: str) -> str | None:
    lower = name.lower()
    return "image" if lower.endswith(_IMAGE) else "audio" if lower.endswith(_AUDIO) else None


def _close_html(page: Page, name: str) -> None:
    found = page.end(name)
    if found is None:
        return
    start, attributes = found
    for style in _HTML_STYLES.get(name, ()):
        page.style(start, style)
    if name in ("font", "span"):
        m = re.search(r"""color\s*=\s*["']?([^"' >]+)""" if name == "font" else r"""(?:fore)?(?:color\s*:|ground\s*=\s*["'])\s*([^;"' >]+)""", attributes, re.IGNORECASE)
        if m:
            page.style(start, f"colour:{colour(m[1])}")
    elif name == "a":
        if m := _SOUND.search(attributes):
            page.link(start, "audio", unquote(m[1].replace("\\", "/")))
        elif m := _HREF.search(attributes):
            page.link(start, "reference", unquote(m[1]))
        else:
            page.style(start, "reference")


def _walk(page: Page, text: str, close: Callable[[Page, str], None], opened: Callable[[Page, str, str], bool] = lambda *_: False) -> None:
    at = 0
    for m in _TAG.finditer(text):
        page.write(decode_entities(text[at : m.start()]))
        at, name = m.end(), m[2].lower()
        if m[1]:
            close(page, name)
        elif not opened(page, name, m[3]):
            page.begin(name, m[3])
    page.write(decode_entities(text[at:]))


def html(body: str) -> dict:
    """HTML and Pango bodies. Images and sounds become links at their place."""
    text = _DROPPED.sub("", body.replace("\r", "").replace(" ", " "))
    for pattern, put in _BREAKS:
        text = pattern.sub(put, text)
    page = Page(most_line_ends=2)

    def opened(page: Page, name: str, attributes: str) -> bool:
        if name != "img":
            return False
        m = re.search(r"""src\s*=\s*["']([^"']+)["']""", attributes, re.IGNORECASE)
        if m and _media(m[1]):
            page.link(page.at, _media(m[1]), m[1])
        return True

    _walk(page, text, _close_html, opened)
    return page.result()


def mdict(body: str) -> dict:
    """MDict bodies: HTML without the empty lines at the end."""
    r = html(body)
    text = r["text"].rstrip()
    return {
        "text": text, "spans": [(a, min(b, len(text)), s) for a, b, s in r["spans"] if a < len(text)],
        "links": [(min(a, len(text)), min(b, len(text)), k, t) for a, b, k, t in r["links"]],
    }


def xdxf(body: str) -> dict:
    page = Page()

    def close(page: Page, name: str) -> None:
        if name == "tr" and any(t == "tr" for t, _, _ in page.open):
            page.write("]")
        found = page.end(name)
        if found is None:
            return
        for style in ("italic",) if name == "tr" else _XDXF_STYLES.get(name, ()):
            page.style(found[0], style)
        if name == "kref":
            page.link(found[0], "reference", page.since(found[0]))

    def opened(page: Page, name: str, attributes: str) -> bool:
        if name == "br":
            page.write("\n")
            return True
        if name == "tr":
            page.begin(name)
            page.write("[")
            return True
        return False

    _walk(page, body, close, opened)
    return page.result()


def stardict_field(kind: str, data: bytes) -> dict:
    """One field of a StarDict body by its type; types that aren't known are plain text."""
    page, lower = Page(), kind.lower()
    if lower == "w":
        page.link(0, "audio", "wav")
        return page.result()
    text = data.decode("utf-8", "replace")
    if lower in ("h", "g"):
        return html(text)
    if lower == "x":
        return xdxf(text)
    if lower == "t":
        page.write(f"[{text}]")
        page.style(0, "italic")
    elif lower == "r":
        if text.startswith("snd:"):
            page.link(0, "audio", f"res/{text[4:]}")
        else:
            page.write(text)
    else:
        page.write(decode_entities(text))
    return page.result()


_DSL = re.compile(r"<<([^>]+)>>|\{\{((?:[^}]|\}[^}])*)\}\}|\[(/?)([a-z!*'][^\]]*)\]|\\([\[\]()<>{}~@\\ ])")
#: What DSL tags look like.
_DSL_STYLES = {"b": ("bold",), "i": ("italic",), "u": ("underline",), "sup": ("bold", "raised"), "sub": ("lowered",), "ex": ("example",), "*": ("optional",), "com": ("comment",), "p": ("abbreviation",), "'": ("stress",), "t": ("italic",)}


def dsl(body: str, abbreviations: Mapping[str, str] | None = None) -> dict:
    """DSL bodies. Margins become spans "indent:N" to the end of their line; abbreviations with a long form become
    links to it; translations are set apart by line ends."""
    lines = [re.sub(r"^[\t ]+", "", line) for line in body.replace("\r", "").replace(" ", " ").split("\n")]
    text = "\n".join("" if line == "\\" else line for line in lines)
    page, at, indents = Page(), 0, []

    def write(plain: str) -> None:
        page.write(plain)
        if "\n" in plain:
            for start, level in indents:
                page.spans.append((start, page.at - len(plain) + plain.index("\n"), f"indent:{level}"))
            indents.clear()

    matches = iter(_DSL.finditer(text))
    for m in matches:
        if m.start() < at:
            continue
        write(text[at : m.start()])
        at = m.end()
        reference, media, ending, tag, escaped = m.groups()
        if escaped is not None:
            write(escaped)
        elif reference is not None:
            start = page.at
            write(reference)
            page.link(start, "reference", reference)
        elif media is not None:
            if _media(media) == "image":
                page.link(page.at, "image", media)
        elif ending:
            _close_dsl(page, tag, abbreviations or {})
        else:
            name, _, arguments = tag.partition(" ")
            margin = re.fullmatch(r"m([0-9]?)", name)
            if margin:
                indents.append((page.at, 2 * int(margin[1] or 0)))
            elif name == "s":
                stop = text.find("[/s]", at)
                if stop >= 0:
                    file = text[at:stop].strip().replace("\\", "/")
                    if file:
                        page.link(page.at, _media(file) or "audio", file)
                    at = stop + 4
            else:
                if name in ("trn", "!trn"):
                    _apart(page)
                page.begin(name, arguments.strip())
    write(text[at:])
    for start, level in indents:
        page.spans.append((start, page.at, f"indent:{level}"))
    return page.result()


def _apart(page: Page) -> None:
    if page.at and page.ends < 2:
        page.write("\n" * (2 - page.ends) if page.ends else "\n")


def _close_dsl(page: Page, name: str, abbreviations: Mapping[str, str]) -> None:
    found = page.end(name)
    if found is None:
        return
    start, arguments = found
    for style in _DSL_STYLES.get(name, ()):
        page.style(start, style)
    if name == "c":
        page.style(start, f"colour:{colour(arguments) if arguments else 'default'}")
    elif name == "ref":
        page.link(start, "reference", page.since(start))
    elif name == "url":
        page.link(start, "url", arguments or page.since(start))
    elif name == "lang":
        m = re.search(r"id=([0-9]+)", arguments)
        if m:
            page.style(start, f"lang:{m[1]}")
    elif name == "p" and page.since(start) in abbreviations:
        page.link(start, "abbreviation", abbreviations[page.since(start)])
    elif name in ("trn", "!trn"):
        _apart(page)


#: EPWING escapes that open and close a style.
_EPWING_OPEN = {0x06: "lowered", 0x0E: "raised", 0x12: "bold"}
_EPWING_CLOSE = {0x07: "lowered", 0x0F: "raised", 0x13: "bold"}
_EPWING_DECORATIONS = {1: "italic", 3: "bold"}


def epwing(body: str) -> dict:
    """Decoded EPWING text with its escapes. References are links "page:offset"."""
    from glossmill.sources.epwing import narrow

    page, at = Page(), 0
    number = lambda a, n: int.from_bytes(bytes(min(ord(c), 255) for c in body[a : a + n]), "big")
    while at < len(body):
        stop = body.find("\x1f", at)
        page.write(narrow(body[at : stop if stop >= 0 else len(body)]))
        if stop < 0 or stop + 1 >= len(body):
            break
        command = ord(body[stop + 1])
        if command == 0x03:
            break
        size = EPWING_ESCAPES.get(command, 2)
        whole = stop + size <= len(body)
        if command in _EPWING_OPEN:
            page.begin(_EPWING_OPEN[command])
        elif command in _EPWING_CLOSE:
            if found := page.end(_EPWING_CLOSE[command]):
                page.style(found[0], _EPWING_CLOSE[command])
        elif command == 0x0A:
            page.write("\n")
        elif command == 0x09 and whole:
            page.write(" " * min(number(stop + 2, 2), 20))
        elif command == 0x42:
            page.begin("reference")
        elif command == 0x62:
            if found := page.end("reference"):
                page.link(found[0], "reference", f"{number(stop + 2, 4)}:{number(stop + 6, 2)}" if whole else page.since(found[0]))
        elif command == 0xE0 and whole:
            if style := _EPWING_DECORATIONS.get(number(stop + 2, 2)):
                page.begin(f"decoration:{style}")
        elif command == 0xE1:
            for style in ("bold", "italic"):
                if found := page.end(f"decoration:{style}"):
                    page.style(found[0], style)
        at = stop + size
    return page.result()


RENDERERS: dict[str, Callable[[str], dict]] = {"dsl": dsl, "epwing": epwing, "mdict": mdict, "xdxf": xdxf}


def render_body(body: str | None, markup: str | None) -> dict:
    """A body by its markup; what isn't named otherwise is HTML."""
    return RENDERERS.get(markup or "", html)(body or "")


@F.pandas_udf(RENDERED)
def render(bodies: pd.Series, markups: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([render_body(b, m) for b, m in zip(bodies, markups, strict=True)], columns=["text", "spans", "links"])


@F.pandas_udf(RENDERED)
def render_field(kinds: pd.Series, bodies: pd.Series) -> pd.DataFrame:
    """StarDict fields by their types."""
    return pd.DataFrame([stardict_field(k, b.encode()) for k, b in zip(kinds, bodies, strict=True)], columns=["text", "spans", "links"])


@F.pandas_udf(T.StringType())
def colours(names: pd.Series) -> pd.Series:
    return names.map(lambda n: colour(n) if n is not None else None)


@F.pandas_udf(T.StringType())
def entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: decode_entities(t) if t is not None else None)
