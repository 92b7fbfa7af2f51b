"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped to a list of lines, one per block element, empty where only tags stood. The text
length of a line block is the sum over a sliding window of lines; tags around a single line or a table row add no
further empty lines to the one before it. The curve surges where the main
text begins and dives where it ends; the lines between are kept. Lines inside elements that never
hold main text (menus, headers, footers, adverts, comments, ...) count as empty. The names of an element only
lean: one around the marked article, or a form or an element of a compound name that holds most of the page's text, is a
wrapper and no noise.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.base import slices


@dataclass(frozen=True)
class Settings:
    window: int = 3  # lines of a block
    surge: int = 80  # characters a block must reach somewhere between its surge and its dive
    links: float = 0.6  # share of linked characters from which a stretch of lines is a menu
    wrapper: float = 0.6  # share of the page's text from which an element of a compound name is a wrapper


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Element names of the HTML standard, and words sites use in class, id and role.
_RAW = set("script style noscript template textarea title iframe svg math object xmp".split())
_HIDDEN = set("head nav header footer aside button select dialog menu datalist".split())
_VOID = set("area base br col embed hr img input link meta source track wbr param".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSED_BY_BLOCK = set("p li dt dd tr td th option".split())
_NOISE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar aside header masthead footer copyright comment comments respond disqus reply "
    "replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations widget pagination pager toolbar search "
    "form complementary contentinfo banner skip legal disclaimer".split()
)
_COMMENTS = set("comment comments respond disqus reply replies".split())
# Words that also occur in the names of an article's own parts, so that there only a whole name tells.
_WEAK = set("alert aside disclaimer form header legal menu notice notices search skip social widget".split())
# What a class says of the page and not of the element, as in has-sidebar.
_STATES = set("has have is no not with without".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_MAIN = set("article main".split())
_MAIN_NAMES = set("articlebody main".split())  # as a role, or as the whole value of class, id or itemprop


@dataclass
class Marks:
    words: set[str] = field(default_factory=set)  # of class, id, role, itemprop and aria-label
    tokens: set[str] = field(default_factory=set)  # whole classes, roles and ids
    parts: set[str] = field(default_factory=set)  # words of classes and roles
    hidden: bool = False
    main: bool = False  # named as the main element

    def noise(self, name: str, inside_main: bool) -> set[str]:
        """The noise words of an element's names.

        Ids of sections and headings are made of their titles, so there only whole ones tell; of classes inside the main element
        the words that are not common in articles do too.
        """
        if inside_main or name in _HEADINGS:
            return (self.tokens & _NOISE) | (self.parts & (_NOISE - _WEAK))
        return self.words & _NOISE


def _marks(attributes: str) -> Marks:
    out = Marks()
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role", "itemprop", "aria-label"):
            out.main |= key != "aria-label" and value.strip().lower() in _MAIN_NAMES
            out.words.add(value.lower())
            for token in value.split():
                words = [w.lower() for w in _NAME_PART.findall(token)]
                if key == "class" and words and words[0] in _STATES:
                    continue
                out.words.update(words)
                if key in ("class", "role"):
                    out.tokens.add(token.lower())
                    out.parts.update(words)
            if key == "id":
                out.tokens.add(value.strip().lower())
        elif key == "hidden":
            out.hidden = True
        elif key == "style" and "display:none" in value.replace(" ", "").lower():
            out.hidden = True
        elif key == "aria-hidden" and value.lower() == "true":
            out.hidden = True
    return out


@dataclass
class Element:
    first: int  # text lines before it
    last: int = 0  # and up to its end

    @property
    def single(self) -> bool:
        return self.last - self.first < 2


@dataclass
class Lean:
    """An element whose names lean towards noise: what it holds decides."""

    parent: Lean | None
    whole: bool  # a noise word is a name by itself
    comments: bool  # it, or an element around it, is named after comments
    size: int = 0
    holds_main: bool = False

    def noise(self, most: float) -> bool:
        return not self.holds_main and (self.whole or self.comments or self.size <= most)


@dataclass
class Line:
    text: str = ""
    linked: int = 0
    main: bool = False
    lean: Lean | None = None  # the innermost one it lies in
    element: Element | None = None  # whose tag made the line; None also for a closing tag of what is closed, as of a row after its cells


def _tidy(raw: str) -> str:
    return _SPACE.sub(" ", html.unescape(raw)).strip()


def lines_of(page: str, wrapper: float = Settings.wrapper) -> tuple[list[Line], bool]:
    """Lines of a page, and whether it marks its main element."""
    lines: list[Line] = []
    pieces: list[str] = []
    linked: list[str] = []
    open_tags: list[tuple[str, bool, bool, Element | None, Lean | None]] = []  # (name, starts noise, starts main, block element, lean around it)
    open_names: Counter[str] = Counter()
    leans: list[Lean] = []
    lean: Lean | None = None
    noise = main = links = n_text = 0
    any_main = False

    def flush() -> None:
        nonlocal n_text
        text = _tidy("".join(pieces))
        if noise and not text:  # what is left out leaves no gap in the lines
            return
        lines.append(Line(text, min(len(text), len(_tidy("".join(linked)))), main > 0, lean))
        if lean:
            lean.size += len(text)
        n_text += bool(text)
        pieces.clear()
        linked.clear()

    def close(upto: int) -> None:
        nonlocal noise, main, lean
        while len(open_tags) > upto:
            name, was_noise, was_main, element, lean = open_tags.pop()
            open_names[name] -= 1
            if element:
                element.last = n_text
            noise -= was_noise
            main -= was_main

    at, end = 0, len(page)
    while at < end:
        tag = _TOKEN.search(page, at)
        text = page[at : tag.start() if tag else end]
        if text and not noise:
            pieces.append(text)
            if links:
                linked.append(text)
        if not tag:
            break
        at = tag.end() if tag.end() > tag.start() else tag.start() + 1
        if tag[1] is None:
            if tag[0].startswith("<![CDATA[") and not noise:
                pieces.append(html.escape(tag[0][9:].removesuffix("]]>")))
            continue
        name, closing = tag[1].lower(), tag[0].startswith("</")
        if name == "a":
            links = 0 if closing else 1
        if name in _RAW:
            if not closing and not tag[0].endswith("/>"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if name in _INLINE:
            if name not in _VOID and not closing:
                marks = _marks(tag[2]) if tag[2] else Marks()
                if marks.hidden or marks.noise(name, main > 0):
                    open_tags.append((name, True, False, None, lean))
                    open_names[name] += 1
                    noise += 1
                    continue
            if closing and open_tags and open_tags[-1][0] == name:
                close(len(open_tags) - 1)
            continue
        at_line = len(lines)
        flush()
        if name in _VOID:
            continue
        if closing:
            if open_names[name]:  # else there is nothing to look for
                k = next(k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == name)
                if len(lines) > at_line:
                    lines[-1].element = open_tags[k][3]
                close(k)
            continue
        links = 0
        while open_tags and (open_tags[-1][0] in _INLINE or open_tags[-1][0] in _CLOSED_BY_BLOCK and name in _CLOSED_BY_BLOCK):
            close(len(open_tags) - 1)
        if tag[0].endswith("/>"):
            continue
        marks = _marks(tag[2]) if tag[2] else Marks()
        found = marks.noise(name, main > 0)
        starts_noise = marks.hidden or name in _HIDDEN and not (name == "header" and main)
        leaning = None
        if not starts_noise and name not in ("body", "html") and (name == "form" or found):
            if not (name in _MAIN or marks.main) or found & _COMMENTS:
                comments = bool(found & _COMMENTS) or bool(lean and lean.comments)
                leaning = Lean(lean, bool(found & marks.tokens), comments)
        starts_main = (name in _MAIN or marks.main) and not starts_noise and leaning is None
        starts_main &= not (lean and lean.comments)
        if starts_main and not noise:
            around = lean
            while around and not around.holds_main:
                around.holds_main = True
                around = around.parent
            any_main = True
        element = Element(n_text)
        if len(lines) > at_line:
            lines[-1].element = element
        open_tags.append((name, starts_noise, starts_main, element, lean))
        open_names[name] += 1
        noise += starts_noise
        main += starts_main
        if leaning:
            leans.append(leaning)
            lean = leaning
    flush()
    close(0)
    for one in reversed(leans):  # inner ones come after those around them
        if one.parent:
            one.parent.size += one.size
    most = wrapper * sum(len(x.text) for x in lines)
    dropped: dict[int, bool] = {}
    for one in leans:
        dropped[id(one)] = one.noise(most) or bool(one.parent and dropped[id(one.parent)])
    lines = [x for x in lines if not (x.lean and dropped[id(x.lean)])]
    return _without_wrappers(lines), any_main


def _without_wrappers(lines: list[Line]) -> list[Line]:
    """One empty line in place of several that only tags of single lines and of table rows have made."""
    out: list[Line] = []
    at = 0
    while at < len(lines):
        stop = at
        while stop < len(lines) and not lines[stop].text:
            stop += 1
        gap = lines[at:stop]
        out += gap[:1] if all(x.element is None or x.element.single for x in gap) else gap
        out += lines[stop : stop + 1]
        at = stop + 1
    return out


def main_lines(lines: list[Line], any_main: bool, s: Settings) -> list[str]:
    """The lines between each surge and dive of the block lengths.

    A stretch runs from where the blocks leave zero to where they return to it. It counts if its
    blocks reach ``surge`` somewhere and it is not mostly links; shorter ones between two that count belong to the text. A page in which no stretch does gives the
    longest one, so that a short article is not lost. On a page that marks its main element, lines outside count as empty
    and all stretches inside count.
    """
    size = [len(x.text) if x.main or not any_main else 0 for x in lines]
    blocks = [sum(size[i : i + s.window]) for i in range(len(size))]
    stretches, start = [], None
    for i, block in enumerate([*blocks, 0]):
        if block and start is None:
            start = i
        elif not block and start is not None:
            stretches.append((start, i))
            start = None
    inside = lambda a, b: [lines[i] for i in range(a, min(b + s.window, len(lines))) if size[i]]
    share = lambda a, b: sum(x.linked for x in inside(a, b)) / max(1, sum(len(x.text) for x in inside(a, b)))
    prose = [x for x in stretches if share(*x) <= s.links]
    if any_main:  # the page itself says where the text is; short sections and lists of links belong to it
        kept = stretches
    else:
        surges = [k for k, (a, b) in enumerate(prose) if max(blocks[a:b]) >= s.surge]
        kept = prose[surges[0] : surges[-1] + 1] if surges else sorted(prose, key=lambda x: -sum(size[x[0] : x[1]]))[:1]
    out, done = [], 0
    for a, b in kept:
        for i in range(max(a, done), min(b + s.window, len(lines))):
            if size[i]:
                out.append(lines[i].text)
            done = i + 1
    return out


def main_text(page: str | None, s: Settings = Settings()) -> str:
    if not page:
        return ""
    return "\n".join(main_lines(*lines_of(page, s.wrapper), s))


def extract(pages: DataFrame, html_col: str = "html", name: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``pages`` with its main text in place of the HTML; '' for NULL, empty and text-free pages.

    All other columns stay. A page is handled by itself, whole, in one pass.
    """
    place = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([main_text(x, settings) for x in batch.column(place).to_pylist()], type=pa.string())
            columns = [texts if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [name if i == place else c for i, c in enumerate(pages.columns)]
    kinds = [f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, pages.schema.fields, strict=True)]
    return pages.mapInArrow(run, ", ".join(kinds))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars)."""
    texts = extract(pages.select("page_id", "url", F.col("html")))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
