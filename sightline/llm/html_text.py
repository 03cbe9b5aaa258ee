"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element, each with its length of text outside
links; furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments)
weighs nothing. The lengths are summed over a sliding window of lines. The text surges where
the sum passes a threshold and dives where it falls to nothing; what lies between is kept.
Where a page marks its article, lines of the article always pass the threshold and lines
outside weigh nothing.

A class or id names furniture by the last part of one of its words, place and number aside
('sidebar', 'main-menu', 'related-posts', but not 'related-work'), unless the word speaks of
the page's layout ('with-sidebar'); 'header' names the page's head outside articles only. Attributes
are read as whole names and values, left to right. A block that holds most of the page's text outside links
is no furniture by such a name; adverts, consents and comments are, since they may well be
longer than the text. Elements whose end tag may be left out end as HTML says.

Defined cases: null or empty html gives an empty text; html without any tag is one line;
unclosed furniture ends where an article begins or the page ends; what is left out whole
(titles, lists of options, drawings, templates) ends at its own end tag, or where that is
missing, at the next tag of a block; an unclosed script or style ends with the page; repeated
rows get equal texts; pages of any length are read whole; other columns are never read.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import batches, texts_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>[^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*)>"
    r"|</?(?P<odd>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
# One attribute after the other: a whole name, and its value as one piece, so neither is found inside another's.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?")
# Left out whole: in the first three a tag is plain text; the others may hold their like.
RAW_TEXT = frozenset("title textarea iframe".split())
RAW = RAW_TEXT | frozenset("noscript template select svg object".split())
BOUND = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?:(?P<name>title|textarea|iframe|noscript|template|select|svg|object)"
    r"|address|article|aside|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header"
    r"|hgroup|hr|html|li|main|menu|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)(?=[\s/>])[^>]*>",
    re.S | re.I,
)
NAME_PART = re.compile(r"[A-Za-z]+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button fieldset".split())
ARTICLE = frozenset(("article", "main"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs masthead footer cookie cookies consent notice notices popup modal overlay newsletter subscribe "
    "subscription share sharing social related comment comments disqus respond replies login signup search widget pagination pager "
    "toolbar gdpr copyright disclaimer legal alert alerts topbar colophon".split()
)
# Names the page's head outside an article only, and not the head of a text.
HEAD = frozenset(("header",))
TEXT_PARTS = frozenset("article entry post section story title chapter".split())
# Named for what they are, not for their place: these may be longer than the text.
LONG_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr comment comments disqus respond replies".split()
)
COMMENT = frozenset(("comment", "comments"))
# Parts of a class that say where or how furniture stands, and parts that speak of the layout around it.
PLACES = frozenset(
    "left right top bottom upper lower first second third primary secondary main inner outer small large mobile desktop area bar block box "
    "button buttons column container form group holder icon icons inner item items link links list module outer panel post posts section slot "
    "stories story strip unit wrap wrapper".split()
)
LAYOUT = frozenset("with without no not has have layout page content".split())
# Elements whose end tag may be left out: the opening tags that end them, and the elements that may hold their like.
ROWS = frozenset("tbody thead tfoot".split())
SIBLINGS = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option", "optgroup")),
    "td": frozenset(("td", "th", "tr")) | ROWS, "th": frozenset(("td", "th", "tr")) | ROWS, "tr": frozenset(("tr",)) | ROWS,
    "tbody": ROWS, "thead": ROWS, "tfoot": ROWS,
}
HOLDERS = frozenset("ul ol menu dir dl table datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())


@dataclass(frozen=True)
class LineBlocks:
    """``window`` lines are summed; a sum of ``surge`` characters begins the text."""

    window: int = 3
    surge: int = 20
    most_links: float = 0.5


def named(value: str, words: frozenset[str]) -> bool:
    """Whether one word of a class or id names furniture out of ``words``."""
    for token in value.split():
        parts = NAME_PART.findall(token)
        if words.isdisjoint(parts) or not LAYOUT.isdisjoint(parts):
            continue
        while len(parts) > 1 and parts[-1] in PLACES and parts[-1] not in words:
            parts.pop()
        if parts[-1] in words:
            return True
    return False


def furniture(name: str, rest: str) -> int:
    """0: the element is no furniture; 1: it is by its class or id, unless it holds most of the text; 2: it is;
    3: as 1, but only outside articles."""
    if name in FURNITURE:
        return 2
    if not rest or name in ("html", "head", "body"):
        return 0
    found = 0
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return 2
        if key in ("class", "id"):
            if named(value, COMMENT if name in ARTICLE else LONG_WORDS):
                return 2
            if name not in ARTICLE and named(value, WORDS):
                found = 1
            elif not found and name not in ARTICLE and any(named(t, HEAD) and TEXT_PARTS.isdisjoint(NAME_PART.findall(t)) for t in value.split()):
                found = 3
    return found


class RawEnds:
    """Where each element of RAW ends: behind its own end tag, or if that is missing, at the next tag of a block."""

    def __init__(self, page: str):
        self.page = page
        self.pairs: dict[int, int] | None = None
        self.blocks: list[int] = []

    def of(self, name: str, start: int, end: int) -> int:
        """End of the element ``name`` whose opening tag is ``page[start:end]``."""
        if name == "svg" and self.page[end - 2] == "/":
            return end
        if self.pairs is None:
            # Most hold neither a block nor their like: the first tag that matters is their end tag.
            for m in BOUND.finditer(self.page, end):
                found = (m.group("name") or "").lower()
                if found == name and m.group("end"):
                    return m.end()
                if found == name or (m.group("end") is not None and not found):
                    break
            self._pair()
        if start in self.pairs:
            return self.pairs[start]
        k = bisect_left(self.blocks, end)
        return self.blocks[k] if k < len(self.blocks) else len(self.page)

    def _pair(self) -> None:
        """Gives each opening tag of the page its end tag; one without gets none."""
        self.pairs = {}
        still: dict[str, list[tuple[int, int]]] = {name: [] for name in RAW}
        for m in BOUND.finditer(self.page):
            if m.group("end") is None:
                continue
            name = (m.group("name") or "").lower()
            if not name:
                self.blocks.append(m.start())
            elif m.group("end"):
                if still[name]:
                    self.pairs[still[name].pop()[0]] = m.end()
            elif name == "svg" and m.group().endswith("/>"):
                continue
            elif name not in RAW_TEXT or not still[name] or still[name][-1][1] < len(self.blocks):
                still[name].append((m.start(), len(self.blocks)))


def large_blocks(page: str, raw_ends: RawEnds) -> set[int]:
    """Where the elements begin that are furniture by class or id, but hold most of the page's text outside links."""
    total = in_link = at = 0
    stack: list[tuple[str, int, int]] = []
    places: dict[str, list[int]] = {}
    held: list[tuple[int, int]] = []

    def last(names: frozenset[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def end(k: int) -> None:
        while len(stack) > k:
            name, start, before = stack.pop()
            places[name].pop()
            if start >= 0:
                held.append((start, total - before))

    while (m := TOKEN.search(page, at)) is not None:
        if not in_link:
            total += len("".join(page[at : m.start()].split()))
        at = m.end()
        name = (m.group("name") or m.group("odd") or "").lower()
        opening = not (m.group("end") or page[m.start() + 1] == "/")
        if name == "a":
            in_link = max(0, in_link + (1 if opening else -1))
        elif opening and name in RAW:
            at = raw_ends.of(name, m.start(), at)
        elif name and name not in VOID:
            if opening:
                enders = [n for n, opened in SIBLINGS.items() if name in opened and places.get(n)]
                if enders:
                    outer = last(HOLDERS)
                    over = [k for n in enders for k in places[n][-1:] if k > outer]
                    if over:
                        end(min(over))
                places.setdefault(name, []).append(len(stack))
                stack.append((name, m.start() if furniture(name, m.group("rest") or "") in (1, 3) else -1, total))
            elif places.get(name):
                end(places[name][-1])
    if not in_link:
        total += len("".join(page[at:].split()))
    end(0)
    return {start for start, n in held if 2 * n > total}


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters inside links, whether in an article) of each line; furniture is left out."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = 0
    in_link = article = 0
    skipped, depth, heading = "", 0, 0
    inside: dict[str, int] = {}
    large: set[int] | None = None

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                lines.append((text, linked, article > 0))
            parts.clear()
        linked = 0

    def is_article(name: str, m: re.Match) -> bool:
        return name in ARTICLE and not furniture(name, m.group("rest") or "")

    def add(piece: str) -> None:
        nonlocal linked
        if piece and (not skipped or heading):
            parts.append(piece)
            if in_link:
                linked += len(piece)

    at = 0
    raw_ends = RawEnds(page)
    while (m := TOKEN.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        name = m.group("name") or m.group("odd")
        if name is None:
            continue
        name = name.lower()
        opening = not (m.group("end") or page[m.start() + 1] == "/")
        if opening and name in RAW:
            at = raw_ends.of(name, m.start(), at)
            continue
        if skipped:
            # Furniture ends with its own end tag, or where an article begins; a header inside an article keeps its headings.
            if skipped in SIBLINGS:
                # Its end tag may be missing: a sibling's opening tag or the end tag of an element around it ends it too.
                nested = any(inside.get(h) for h in HOLDERS)
                if not opening and name == skipped and not nested:
                    close()
                    skipped, heading = "", 0
                    continue
                if name in INLINE or name in VOID or name == "p":
                    continue
                if opening:
                    if (nested or name not in SIBLINGS[skipped]) and not is_article(name, m):
                        inside[name] = inside.get(name, 0) + 1
                        continue
                elif inside.get(name):
                    inside[name] -= 1
                    continue
                elif nested and name in SIBLINGS:
                    continue
                close()
                skipped, heading = "", 0
            elif name == skipped:
                depth += 1 if opening else -1
                if depth <= 0 or (skipped == "p" and opening):
                    close()
                    skipped, heading = "", 0
                continue
            elif skipped == "header" and article and name in HEADING:
                close()
                heading = int(opening)
                continue
            elif not (opening and is_article(name, m)) and not (skipped == "p" and name not in INLINE and name not in VOID):
                continue
            close()
            skipped, heading = "", 0
        if name not in INLINE:
            if name == "br":
                parts.append(" ")
                continue
            close()
        if opening:
            sort = 0 if name in VOID else furniture(name, m.group("rest") or "")
            if sort == 3:
                sort = 0 if article else 1
            if sort == 1 and large is None:
                large = large_blocks(page, raw_ends)
            if sort == 2 or (sort == 1 and m.start() not in large):
                close()
                skipped, depth, inside = name, 1, {}
                continue
            if name in ARTICLE:
                article += 1
            elif name == "a":
                in_link += 1
        elif name in ARTICLE:
            article = max(0, article - 1)
        elif name == "a":
            in_link = max(0, in_link - 1)
    add(page[at:])
    close()
    return lines


def main_text(page: str, spec: LineBlocks) -> str:
    """The lines between surges and dives of the page, joined by one space."""
    lines = lines_of(page)
    if not lines:
        return ""
    marked = any(a for _, _, a in lines)
    weight = np.array(
        [
            (max(len(t), spec.surge) if a else 0) if marked else (0 if n > spec.most_links * len(t) else len(t) - n)
            for t, n, a in lines
        ],
        np.int64,
    )
    total = np.concatenate([[0], np.cumsum(weight)])
    ends = np.minimum(np.arange(len(weight)) + spec.window, len(weight))
    block = total[ends] - total[:-1]
    keep = np.zeros(len(weight), bool)
    inside = False
    for k, sum_ in enumerate(block.tolist()):
        inside = sum_ > 0 if inside else sum_ >= spec.surge
        keep[k] = inside and weight[k] > 0
    if not marked and not keep.any():
        keep = weight > 0
    return " ".join(t for (t, _, _), k in zip(lines, keep, strict=True) if k)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", spec: LineBlocks | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``; nothing is shuffled."""
    spec = spec or LineBlocks()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows(batch: pa.RecordBatch) -> dict:
        found = [main_text(h, spec) for h in texts_of(batch.column(2))]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": found, "n_chars": [len(t) for t in found]}

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(batches(schema, rows), "page_id long, url string, text string, n_chars long")
