"""Main text of web pages by two passes of block rules.

A linear scanner cuts the page into blocks at block-level tags and notes for each its link text, whether it is a
heading, whether it is in an article or main element, and whether a container around it is marked (by tag, role or
class) as something beside the article. Elements that never are text (scripts, styles, menus, asides, controls) are
left out.

Pass 1 decides blocks: link density, length and the density of stop words make a block good or bad, or leave it open;
blocks of marked containers are bad. Pass 2 gives an open block the label of its nearest decided neighbour (a tie is
good; none decided: good in an article or main element, else bad). Where such an element has text, only blocks inside
it count, and there an open block without links is dropped only between two neighbours that are bad.

Two things overrule: a container around an article or main element isn't marked, nor is, on a page with no other
running text, one of three blocks or more that isn't of reader comments. Stop words judge a page only if they make up
a fair part of its running text; in other languages length and sentence marks decide alone.

Cases: null or empty html gives an empty text. Tags that are never closed end with their parent or the page, an
unclosed link with its block; an unclosed comment, script or style runs to the end of the page. Every page is scanned
in time linear in its length, whatever is broken in it. Repeated rows give repeated rows, no rows none. Other columns
pass through; text and n_chars are replaced.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from glossmill.llm.session import plainly, with_fields

#: The most frequent function words of some languages, by which running text is told.
STOP_WORDS = frozenset(
    "the of and to in is that it for was with as "  # English
    "de la le et les des en un une que est dans pour "  # French
    "der die und den das von zu mit ist nicht ein auf "  # German
    "el los y las del por se con no su al lo "  # Spanish
    "di e il che per non si da del della "  # Italian
    "o do não um uma os em para com "  # Portuguese
    "het een van dat op te zijn voor "  # Dutch
    "och att som på är av det för den "  # Swedish
    "og i er til på at ikke med "  # Danish, Norwegian
    "w z na do się nie że jest "  # Polish
    "v je se že to ale jako "  # Czech, Slovak
    "a az és hogy nem egy "  # Hungarian
    "ja on ei se että oli "  # Finnish
    "și în la nu că cu este "  # Romanian
    "ve bir bu da için ile "  # Turkish
    "yang dan di dengan untuk ini "  # Indonesian, Malay
    "và của là các có trong được "  # Vietnamese
    "и в не на что с по это как от на за "  # Russian, Bulgarian
    "і у та що є до не з "  # Ukrainian
    "και το να η του της με για "  # Greek
    "في من على و أن إلى التي "  # Arabic
    "و در به از که را است "  # Persian
    "של את על לא הוא עם "  # Hebrew
    "के में है की को से और ".split()  # Hindi
)
#: Frequent particles of scripts without spaces, and last syllables of Korean words with particles.
PARTICLES = frozenset("的了是在和不有の は を に が で と も た".replace(" ", ""))
SYLLABLES = tuple("은는이가을를의에다도로")
#: Elements whose content isn't markup.
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noframes"))
#: Elements that are never the article.
NEVER = frozenset("head nav footer aside menu noscript template dialog select button iframe object svg canvas audio video map fieldset datalist".split())
#: Elements that are marked as what isn't the article.
BESIDE = frozenset(("header", "form"))
CONTAINERS = frozenset("html body article main section div ul ol dl table tbody thead tfoot tr td th li dd dt blockquote figure details center p h1 h2 h3 h4 h5 h6".split()) | NEVER | BESIDE
BLOCKS = CONTAINERS | frozenset("pre hr address figcaption caption summary legend option title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of class or id, and roles, that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side menu menubar nav navbar navigation breadcrumb breadcrumbs header masthead footer foot share sharing social related recommended newsletter subscribe signup login search widget pagination pager toolbar".split()
)
COMMENTS = frozenset(("comment", "comments", "respond", "disqus"))
#: Words that may follow a mark in a name, and words by which a name only says that something has it.
GENERIC = frozenset("area bar block body box container content inner item items left link links list panel right section slot text top bottom unit wrap wrapper".split())
HAVING = frozenset(("has", "with", "no", "is", "not", "without"))
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_PLAIN_ATTRIBUTES = re.compile(r"[^>]*+>")
_MARK = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++)""", re.IGNORECASE)
_HREF = re.compile(r"""(?:^|[\s"'/])href\s*+=""", re.IGNORECASE)
_NUMBER = re.compile(r"&#0*+([0-9]*+)(;?)")
_CLOSES_P = BLOCKS - {"option", "title", "td", "th", "tr", "li", "caption", "legend"}
_WORD = re.compile(r"\b[^\W\d_]++\b")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_SENTENCE = re.compile(r"[.!?…。！？।؟]['\"»”’)\]]*+(?:\s|$)|[。！？।]")


@dataclass(eq=False)
class Mark:
    """A container beside the article (kind: beside, comments or header), until something shows that it isn't."""

    kind: str
    parent: Mark | None
    holds: bool = True
    seen: str = ""  # what it is known to be around
    size: int = 0  # in blocks

    def around(self, tag: str) -> None:
        """It and those above it hold an article or main element."""
        m = self
        while m is not None and m.seen not in (tag, "main"):
            m.seen = tag
            m.holds = m.holds and m.kind == "comments" and tag == "article"
            m = m.parent


@dataclass
class Block:
    text: str
    linked: int
    article: bool
    heading: bool
    mark: Mark | None = None
    label: str = field(default="open")


def _kind(attributes: str) -> str | None:
    """What class, id or role say: comments, beside, or nothing."""
    found = None
    for kind, value in _MARK.findall(attributes):
        value = value.strip("\"'")
        if kind.lower() == "role":
            if not ROLES.isdisjoint(value.lower().split()):
                found = "beside"
            continue
        for name in value.split():
            words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
            if not words or words[0] in HAVING:
                continue
            for marks, label in ((COMMENTS, "comments"), (MARKS, "beside")):
                # The whole name, its last word, or its first with nothing but generic words behind it.
                if words[-1] in marks or words[0] in marks and all(w in GENERIC or w[0].isdigit() for w in words[1:]):
                    if label == "comments":
                        return label
                    found = label
    return found


def _decoded(text: str) -> str:
    """Character references as characters; numbers of any length."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _NUMBER.sub(lambda m: "�" if len(m[1]) > 7 else f"&#{m[1] or '0'}{m[2]}" if m[0][2:3].isdigit() else m[0], text)
    return html.unescape(text)


def _tags(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before, whether an end tag, name in lower case, attributes) of each tag; the last one has no name.
    Contents of comments and raw elements are left out. No character is looked at more than a few times."""
    at, n, quoted = 0, len(page), True
    begin = 0  # of the text that hasn't been given yet
    pieces: list[str] = []
    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= n:
            break
        c = page[at + 1]
        if c in "!?" or c == "/" and not page[at + 2 : at + 3].isascii() or c == "/" and not page[at + 2 : at + 3].isalpha():
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 2)
                end = stop + 3 if stop >= 0 else n
            else:
                stop = page.find(">", at)
                end = stop + 1 if stop >= 0 else n
            pieces.append(page[begin:at])
            begin = at = end
            continue
        ending = c == "/"
        name = _NAME.match(page, at + 1 + ending) if ending or c.isascii() and c.isalpha() else None
        if name is None:
            at += 1  # a < of the text
            continue
        rest = _ATTRIBUTES.match(page, name.end()) if quoted else None
        if rest is None:
            quoted = False  # some quote is never closed; from here on > ends a tag
            rest = _PLAIN_ATTRIBUTES.match(page, name.end())
            if rest is None:  # no > is left, so there is no tag any more
                break
        pieces.append(page[begin:at])
        tag = name[0].lower()
        yield "".join(pieces), ending, tag, rest[0][:-1]
        pieces = []
        begin = at = rest.end()
        if tag in RAW and not ending:
            end = re.compile(rf"</{tag}(?![a-z0-9-])", re.IGNORECASE).search(page, at)
            stop = page.find(">", end.start()) if end else -1
            begin = at = stop + 1 if stop >= 0 else n
    pieces.append(page[begin:])
    yield "".join(pieces), False, "", ""


class _Tree:
    """The open containers, with the last place of each name at hand."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, Mark | None]] = []  # name, never text, in the article, innermost mark
        self.places: dict[str, list[int]] = defaultdict(list)

    def top(self) -> tuple[str, bool, bool, Mark | None]:
        return self.stack[-1] if self.stack else ("", False, False, None)

    def push(self, *entry) -> None:
        self.places[entry[0]].append(len(self.stack))
        self.stack.append(entry)

    def close(self, name: str) -> None:
        if not self.places[name]:
            return
        at = self.places[name][-1]
        if name in ("div", "section", "p", "span") and any(self.places[x] and self.places[x][-1] > at for x in ("article", "main")):
            return  # a stray end tag doesn't end the article
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()


def blocks(page: str) -> tuple[list[Block], list[Mark]]:
    """The blocks of a page in order, without those of elements that are never text, and the marks, outer ones first."""
    found: list[Block] = []
    all_marks: list[Mark] = []
    tree = _Tree()
    parts: list[str] = []
    linked, heading, link = 0, False, False
    open_at = 0  # blocks found when the open link began; it counts in later ones only if it has an end

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            _, never, article, inner = tree.top()
            if text and not never:
                found.append(Block(text, linked, article, heading, inner))
            parts = []
        linked = 0

    def mark(kind: str, parent: Mark | None) -> Mark:
        all_marks.append(Mark(kind, parent))
        return all_marks[-1]

    for text, ending, tag, attributes in _tags(page):
        if text and not tree.top()[1]:
            text = _decoded(text)
            parts.append(text)
            if link and len(found) == open_at:
                linked += len("".join(text.split()))
        if not tag or tag in RAW:
            if tag in BLOCKS:
                flush()
            continue
        if tag == "a":
            if ending and link and len(found) > open_at:
                flush()
                for b in found[open_at + 1 :]:
                    b.linked = len(b.text.replace(" ", ""))
            link = not ending and bool(_HREF.search(attributes))
            open_at = len(found)
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            if tag in ("span", "a", "ins") and not ending and (kind := _kind(attributes)):
                flush()
                _, never, article, inner = tree.top()
                tree.push(tag, never, article, mark(kind, inner))
                open_at = len(found)
            elif ending and tree.top()[0] == tag:
                flush()
                tree.close(tag)
            continue
        flush()
        heading = not ending and tag in HEADINGS
        if tag in VOID or tag not in CONTAINERS:
            continue
        if ending:
            tree.close(tag)
            continue
        top = tree.top()[0]
        if tag in _CLOSES_P and top == "p":
            tree.close("p")
        elif tag == "li" == top or tag in ("td", "th") and top in ("td", "th") or tag in ("dd", "dt") and top in ("dd", "dt"):
            tree.close(top)
        if attributes.endswith("/") and tag in ("svg", "iframe"):
            continue
        _, never, article, inner = tree.top()
        if tag in ("article", "main"):
            article = True
            if inner is not None:
                inner.around(tag)
        kind = _kind(attributes) if attributes and tag not in ("html", "body", "article", "main") else None
        kind = kind or {"form": "beside", "header": "header"}.get(tag)
        if kind:
            inner = mark(kind, inner)
        tree.push(tag, never or tag in NEVER, article, inner)
    flush()
    return found, all_marks


def _stops(text: str) -> float:
    """The share of stop words, or of particles where words aren't set apart."""
    words = [w.lower() for w in _WORD.findall(text)]
    wide = _CJK.findall(text)
    if 2 * len(wide) > sum(map(len, words)):
        return 2 * sum(c in PARTICLES for c in wide) / len(wide)
    return sum(w in STOP_WORDS or len(w) > 1 and "가" <= w[0] <= "힣" and w.endswith(SYLLABLES) for w in words) / max(1, len(words))


def _beside(found: list[Block], marks: list[Mark]) -> list[bool]:
    """By block, whether it is in a marked container; a heading of the article may be in its header."""
    held, strict = {id(None): False}, {id(None): False}
    for m in marks:
        held[id(m)] = m.holds or held[id(m.parent)]
        strict[id(m)] = m.holds and m.kind != "header" or strict[id(m.parent)]
    return [(strict if b.heading and b.article else held)[id(b.mark)] for b in found]


def first_pass(found: list[Block], marks: list[Mark]) -> None:
    """Labels what density and length decide."""
    sizes = [len(b.text) + 2 * len(_CJK.findall(b.text)) for b in found]
    density = [b.linked / max(1, len(b.text.replace(" ", ""))) if b.linked else 0.0 for b in found]
    stops = [_stops(b.text) if size >= 70 else 0.0 for b, size in zip(found, sizes, strict=True)]
    running = sum(s for s, d in zip(sizes, density, strict=True) if s >= 70 and d < 0.2)
    told = sum(s for s, d, x in zip(sizes, density, stops, strict=True) if s >= 70 and d < 0.2 and x >= 0.06)
    known = 5 * told >= running  # the language of the running text

    def decide() -> bool:
        """Whether any block is good, or in the article and not bad."""
        for b, size, linked, share, beside in zip(found, sizes, density, stops, _beside(found, marks), strict=True):
            if beside:
                b.label = "beside"
            elif linked > 0.5 and not b.heading:
                b.label = "bad"
            elif known and (size >= 70 and share >= 0.12 or size >= 200 and share >= 0.06):
                b.label = "good"
            elif not known and (size >= 200 or size >= 70 and _SENTENCE.search(b.text)):
                b.label = "good"
            elif size >= 70 and share < 0.03 and not b.article:
                b.label = "bad"
            else:
                b.label = "open"
        return any(b.label == "good" or b.article and b.label == "open" for b in found)

    if decide() or not marks:
        return
    for b in found:
        if b.mark is not None:
            b.mark.size += 1
    for m in reversed(marks):
        if m.parent is not None:
            m.parent.size += m.size
    for m in marks:
        m.holds = m.holds and (m.kind == "comments" or m.size < 3)
    decide()


def second_pass(found: list[Block]) -> None:
    """Open blocks take their nearest decided neighbour's label."""
    labels = ["bad" if b.label == "beside" else b.label for b in found]
    before, after = _nearest(labels), _nearest(labels[::-1])[::-1]
    for b, (left, near), (right, far) in zip(found, before, after, strict=True):
        if b.label != "open":
            continue
        if near is None and far is None:
            b.label = "good" if b.article else "bad"
        elif b.article and not b.linked:
            b.label = "bad" if near == far == "bad" and left == right == 1 else "good"
        elif near is None or far is None:
            b.label = far if near is None else near
        else:
            b.label = near if left < right else far if right < left else "good" if "good" in (near, far) else "bad"


def _nearest(labels: list[str]) -> list[tuple[int, str | None]]:
    out, last, at = [], None, 0
    for n, x in enumerate(labels):
        out.append((n - at, last))
        if x != "open":
            last, at = x, n
    return out


def classify(found: list[Block], marks: list[Mark]) -> list[Block]:
    """The blocks that count, labelled good or bad: those of article and main elements, if any of these may be good."""
    first_pass(found, marks)
    if any(b.article and b.label in ("good", "open") for b in found):
        found = [b for b in found if b.article and b.label != "beside"]
    second_pass(found)
    return found


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by an empty line."""
    return "\n\n".join(b.text for b in classify(*blocks(page or "")) if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """Pages with text and n_chars (its code points) in place of html."""
    others = [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]
    rows = plainly(pages, [*others, "html"])
    columns = rows.columns[: len(others)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(others))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*columns, "text", "n_chars"])

    schema = with_fields(rows.select(*columns), text="string", n_chars="long")
    return rows.mapInArrow(read, schema).toDF(*others, "text", "n_chars")
