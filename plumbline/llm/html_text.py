"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides a block by link density (blocks of links are
out, and so are copyright lines), by length and by stop-word density (long blocks with many stop words are text);
short blocks, and long ones of few stop words, stay open. In the second pass each open block gets the label of the
nearest decided block before or behind it in the same element, and where that has none of the nearest on the page;
between two as near, being text wins. Where the first pass finds no text at all (a short page, or a language of other stop
words), the element with a heading, else the one with most words outside links, is taken for text first.

Names are evidence beside that: a block inside what a tag, role or class calls a sidebar, notice, advert, form, reader
comments or the like cannot become text, since prose that a reader wrote looks like the article's; as it says nothing of
what stands around it, it is no neighbour either. Menus have no names here: they are found by their links. Pages whose
names are taken away keep nearly all their blocks (the tests say how many).

Defined results: a null or empty page, or one without main text, has the empty text; unclosed and misplaced
tags, comments and character references are read as browsers read them, as far as blocks go; pages of any
length are read whole, in time that grows with their length; repeated rows and ids are treated alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ship

#: Words from which a block is long; stop-word share from which a long block is text; link share from which a block is links.
LONG_WORDS, TEXT_STOPS, LINKS = 16, 0.15, 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements by their part in a page, and words of classes and ids.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg canvas math audio video select textarea button title head datalist map".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
OUTSIDE = frozenset("header footer aside form dialog".split())
OUTSIDE_ROLES = frozenset("banner contentinfo complementary search form alert alertdialog dialog".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "sidebar aside header masthead topbar footer share sharing social related recommended recommendations widget widgets toolbar search".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
CLOSES_ITSELF = {"p": "p", "li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "option": "option"}
STOP_WORDS = frozenset(
    "the of and to in is that it for was on are as with be at by this from or an not have but his her they which you we a "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "de la le et les des en un du une que est pour qui dans par plus au sur ne pas se avec il ce sont ou "
    "el los las y del se por con no una su al lo como más pero sus le ya o este para es".split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOPS = re.compile("[<>\"']")
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {tag: re.compile(f"</{tag}", re.IGNORECASE) for tag in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Block:
    text: str
    link_chars: int
    outside: bool  # what its names say
    inside_of: int = 0  # the element that holds the block's own, by its number in the page
    heading: bool = False

    @property
    def is_links(self) -> bool:
        return self.link_chars > LINKS * (len(self.text) - self.text.count(" "))


def tags_of(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Every tag and comment: start, end, is it a closing one, name (empty: a comment), attributes; each character is read once.

    A tag ends at its > outside quotes; if a quote never closes, at the next >; if another tag begins first, there."""
    at, last = 0, page.rfind(">")
    unclosed = {'"': len(page), "'": len(page)}  # from here on that quote does not come again
    while (start := page.find("<", at)) >= 0 and start < last:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, False, "", ""
            continue
        closing = page.startswith("/", start + 1)
        name = _NAME.match(page, start + 1 + closing)
        if name is None:
            if page[start + 1:start + 2] in ("!", "?", "/"):
                at = page.find(">", start) + 1
                yield start, at, False, "", ""
            else:
                at = start + 1
            continue
        end = name.end()
        while True:
            stop = _STOPS.search(page, end)
            if stop is None:
                end = len(page)
                break
            end, mark = stop.start(), stop.group()
            if mark in "<>":
                break
            close = page.find(mark, end + 1) if end < unclosed[mark] else -1
            if close < 0:
                unclosed[mark] = min(unclosed[mark], end)
                end = min(x if x >= 0 else len(page) for x in (page.find(">", end), page.find("<", end)))
                break
            end = close + 1
        at = end + (page[end:end + 1] == ">")
        yield start, at, closing, name.group().lower(), page[name.end():end]
    if 0 <= start and start >= last and page.startswith("<!--", start):
        yield start, len(page), False, "", ""


def _kind_of(tag: str, attributes: str) -> str:
    """outside, comments or nothing, by tag and attributes."""
    found = ""
    if attributes and not attributes.isspace():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                words = {w.lower() for part in _CAMEL.split(value) for w in _WORD.findall(part)}
                if words & COMMENT_WORDS:
                    return "comments"
                if words & OUTSIDE_WORDS and tag not in ("html", "body", "main", "article"):
                    found = "outside"
            elif name == "role" and value.lower() in OUTSIDE_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
                found = "outside"
    if tag == "aside":
        return "comments"  # like reader comments, it may hold articles of its own
    return "outside" if tag in OUTSIDE else found


def blocks_of(page: str) -> list[Block]:
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag; is what stands here out by name; is it among reader comments
    outer: list[tuple[int, int]] = []  # the open block elements: place in the stack, number in the page
    count: Counter[str] = Counter()  # open tags by name
    parts: list[str] = []
    link_chars = at = elements = 0
    endless: set[str] = set()  # raw elements that end no more

    def end_block() -> None:
        nonlocal parts, link_chars
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, link_chars, bool(stack) and stack[-1][1], outer[-2][1] if len(outer) > 1 else 0, bool(outer) and stack[outer[-1][0]][0] in HEADINGS))
        parts, link_chars = [], 0

    def add(raw: str) -> None:
        nonlocal link_chars
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if count["a"]:
                link_chars += len("".join(text.split()))

    def close(tag: str) -> None:
        while stack:
            gone = stack.pop()[0]
            count[gone] -= 1
            if gone == tag:
                break
        while outer and outer[-1][0] >= len(stack):
            outer.pop()

    for start, end, closing, tag, attributes in tags_of(page):
        if start < at:
            continue  # inside what a raw element holds
        add(page[at:start])
        at = end
        if not tag:
            continue
        if not closing and tag in RAW:
            found = None if tag in endless else _RAW_END[tag].search(page, at)
            over = page.find(">", found.end()) if found else -1
            if over < 0:
                endless.add(tag)
            if tag in ("title", "textarea"):
                end_block()
            at = over + 1 if over >= 0 else len(page)
            continue
        if tag in ("br", "td", "th"):
            parts.append(" ")
            if tag == "br":
                continue
        if tag in BLOCKS:
            end_block()
        if closing:
            if count[tag]:
                close(tag)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in CLOSES_ITSELF and count[tag]:
            if outer and stack[outer[-1][0]][0] == tag:
                close(tag)
        kind = _kind_of(tag, attributes)
        outside, comments = stack[-1][1:] if stack else (False, False)
        if tag in ("article", "main") and kind != "comments" and not comments:
            outside = False  # an article ends what was left open before it
        elif kind or tag in SILENT:
            outside = True
        if tag in BLOCKS:
            elements += 1
            outer.append((len(stack), elements))
        stack.append((tag, outside, comments or kind == "comments"))
        count[tag] += 1
    add(page[at:])
    end_block()
    return blocks


def first_pass(blocks: list[Block]) -> list[bool | None]:
    """True: text, False: not, None: open."""
    labels = [_decide(b) for b in blocks]
    if True not in labels:
        held: Counter[int] = Counter()
        headed = {b.inside_of for b, label in zip(blocks, labels, strict=True) if b.heading and label is None and not b.outside}
        for b, label in zip(blocks, labels, strict=True):
            if label is None and not b.outside and (b.inside_of in headed or not headed):
                held[b.inside_of] += b.text.count(" ") + 1
        best = max(held, key=lambda e: (held[e], -e), default=None)
        labels = [True if label is None and not b.outside and b.inside_of == best else label for b, label in zip(blocks, labels, strict=True)]
    return labels


def _decide(block: Block) -> bool | None:
    if block.is_links or block.text[:1] == "©":
        return False
    if block.outside or block.text.count(" ") + 1 < LONG_WORDS:
        return None
    words = _WORD.findall(block.text.lower())
    return sum(w in STOP_WORDS for w in words) >= max(1, TEXT_STOPS * len(words)) or None


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Open blocks take the label of the nearest decided one, of the same element first; between two as near, and without any,
    being text wins."""
    seen = [i for i, b in enumerate(blocks) if labels[i] is not None or not b.outside]
    near: dict[int, list[tuple[bool, int, bool]]] = {i: [] for i in seen if labels[i] is None}  # not in its element, steps, not text
    for order in (seen, seen[::-1]):
        last: dict[int, tuple[int, bool]] = {}  # by element, the last decided block in it; under -1 that of any
        for step, i in enumerate(order):
            own = blocks[i].inside_of
            if labels[i] is not None:
                last[own] = last[-1] = (step, labels[i])
            else:
                near[i] += [(e < 0, step - at, not label) for e in (own, -1) if e in last for at, label in (last[e],)]
    return [label if label is not None else i in near and (not near[i] or not min(near[i])[-1]) for i, label in enumerate(labels)]


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, second_pass(blocks, first_pass(blocks)), strict=True) if keep)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [main_text(page) for page in batch["html"].tolist()]
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page: page_id, url, text, n_chars."""
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInPandas(_extract, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast(kind))
