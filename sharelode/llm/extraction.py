"""Main text of web pages by scoring the element tree.

Elements that are never part of an article by their tag, role or being hidden are left out with
all that is in them. What a class or id only hints at is decided by the text inside: see `_settle`. Each
paragraph gives points for its length and its commas to the elements around it, less
with each level. An element's points are discounted by the share of its text that is in
links. The best element, or the article or main element it lies in, and those of its
siblings that score well are kept, with all their blocks in page order.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sharelode.llm.common import only, slices

# What is a paragraph worth looking at, in characters.
_LONG = 25
_LEVELS = 5

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)", re.S)
# One attribute: its name up to white space, "=", "/" or the end, and its value with the quotes.
_ATTRIBUTE = re.compile(r"""([^\s/][^\s/=]*+)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s"'][^\s]*+)?)?""")
_HINTS = {"class", "id", "role", "hidden", "aria-hidden", "style"}
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_COMMAS = re.compile("[,，、،]")
_BLANKS = re.compile(r"\s+")

_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_LEFT_OUT = {
    "nav", "header", "footer", "aside", "menu", "dialog", "button", "select", "option", "head",
    "object", "applet", "audio", "video", "canvas", "map", "label", "fieldset", "search",
}
_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "status",
    "menu", "menubar", "toolbar", "form", "note",
}
_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adslot", "banner",
    "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "disqus", "discussion", "replies", "reply",
    "respond", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "footer", "foot",
    "header", "masthead", "topbar", "menu", "nav", "navbar", "navigation", "newsletter", "subscribe", "subscription",
    "signup", "login", "paywall", "popup", "modal", "overlay", "lightbox", "promo", "promos", "promotion", "promoted",
    "sponsor", "sponsored", "sponsors", "related", "recommended", "recommendations", "share", "sharing", "social",
    "sidebar", "sidenav", "side", "rail", "widget", "widgets", "toolbar", "pager", "pagination", "skip", "outbrain",
    "taboola", "teaser", "teasers", "feedback", "disclaimer", "copyright", "legal",
}
# Of these, the ones that mean something else as the first part of a longer name (side-effects, legal-news).
_AMBIGUOUS = {
    "ad", "ads", "alert", "banner", "copyright", "disclaimer", "discussion", "feedback", "foot", "footer", "header",
    "legal", "login", "menu", "nav", "navigation", "notice", "notices", "notification", "overlay", "promotion", "rail",
    "recommended", "related", "replies", "reply", "respond", "share", "sharing", "side", "sidebar", "skip", "social",
    "subscription", "teaser", "teasers", "toolbar", "widget", "widgets",
}
# A last part that makes a box of what is named before it (share-buttons, sidebar-inner).
_BOXES = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "form", "group", "holder",
    "icon", "icons", "inner", "item", "items", "label", "left", "link", "links", "list", "outer", "panel", "posts", "right",
    "row", "section", "slot", "text", "title", "top", "unit", "wrap", "wrapper", "zone",
}
# Parts by which a name tells of the page around, not of the element: before and after it.
_BEFORE = {"has", "with", "no", "is", "without", "not", "hide", "show", "non"}
_AFTER = {"open", "closed", "free", "fixed", "sticky", "enabled", "disabled", "active", "visible", "on", "off", "loaded"}
_SIDES = {"left", "right", "top", "bottom"}
# A name that says the opposite of the names above, and names of what goes round a page.
_CONTENT = {"article", "content", "main", "story", "post", "entry", "body"}
_ROUND = _CONTENT | {"page", "layout", "site", "wrap", "wrapper", "container"}
# These hold no article, however long they are.
_NO_ARTICLE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adslot", "comment",
    "comments", "commentlist", "disqus", "discussion", "replies", "reply", "respond", "cookie", "cookies", "consent", "gdpr",
    "newsletter", "popup", "sponsor", "sponsored", "sponsors", "outbrain", "taboola",
}
_NEVER_OUT = {"html", "body", "article", "main"}
# What a class or id makes of an element: a hint, furniture that may be round the page, and furniture in any case.
_HINTED, _FURNITURE, _NEVER = 1, 2, 3
_BLOCKS = {
    "html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li",
    "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure",
    "figcaption", "address", "center", "details", "summary", "hr", "hgroup", "form", *_LEFT_OUT,
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# An open element that ends where one of these starts, up to an element that holds it in.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_HOLDS = {"ul", "ol", "dl", "table", "article", "body", "td", "th", "tbody", "thead", "tfoot"}


class _Element:
    __slots__ = ("tag", "parent", "out", "hint", "link", "points", "chars", "linked", "first", "last")

    def __init__(self, tag, parent, out, hint, link, place):
        self.tag, self.parent, self.out, self.hint, self.link = tag, parent, out, hint, link
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.first = self.last = place


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html",
            keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The main text of every page: `page_id`, the columns in `keep`, `text`, `n_chars`.

    Left out are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
    markup and reader comments. Character references are decoded, white space
    within a block is one space, blocks are trimmed, empty ones dropped, and the rest joined by a line
    end. `n_chars` counts code points.

    A form, or an element whose class or id names a sidebar, header or the like, is kept where it is round
    the page: where it holds four times the prose of all that stays otherwise. Names such as
    `has-sidebar`, `comments-open` or `legal-news` are hints: such an element goes only if it has no
    paragraph or much of it is links. An `article` goes by its name only if it is a comment.

    A null page, an empty one and one without text give an empty text. Whole pages are read,
    and broken markup is read as far as it goes. One row is returned per input row,
    repeated rows and null ids included; an empty table gives an empty result.
    """
    rows = only(pages, page_id=id_column, html=html_column, **{f"_keep{i}": c for i, c in enumerate(keep)})
    rows = rows.withColumn("html", F.col("html").cast("string"))
    kept = [f for f in rows.schema.fields if f.name != "html"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", text string, n_chars long"
    found = rows.mapInArrow(_extracted, schema)
    return found.select("page_id", *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(page or "") for page in batch.column("html").to_pylist()]
        others = [n for n in batch.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in others), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=[*others, "text", "n_chars"])


def main_text(page: str) -> str:
    elements, blocks = _read(page)
    _settle(elements, blocks)
    blocks = [block for block in blocks if not block[0].out]
    if not blocks:
        return ""
    for element, text, linked in blocks:
        element.chars += len(text)
        element.linked += linked
        if len(text) >= _LONG:
            points = 1 + len(_COMMAS.findall(text)) + min(len(text) // 100, 3)
            # A paragraph's points go to what is around it; text that is directly in a
            # container counts for that container.
            around, level = (element.parent if element.tag in ("p", "pre", "td", "blockquote", "li") else element), 1
            while around is not None and level <= _LEVELS:
                around.points += points / level
                around, level = around.parent, level + 1
    for element in reversed(elements):
        if element.parent is not None:
            element.parent.chars += element.chars
            element.parent.linked += element.linked

    def score(element: _Element) -> float:
        bonus = 1.25 if element.tag in ("article", "main") else 1.0
        bonus *= 0.75 if element.hint else 1.0
        return bonus * element.points * (1 - element.linked / element.chars) if element.chars else 0.0

    best = max(elements, key=lambda e: (score(e), -e.first))
    spans: list[tuple[int, int]] = []
    if score(best) <= 0:
        best = next((e for e in elements if e.tag in ("article", "main") and e.chars and not e.out), None)
        if best is None:
            return "\n".join(text for _, text, linked in blocks if 2 * linked < len(text))
        spans.append((best.first, best.last))
    else:
        around = best
        while around is not None and around.tag not in ("article", "main"):
            around = around.parent
        if around is not None and 2 * around.linked < around.chars:
            best = around
        enough = max(10.0, 0.2 * score(best))
        for element in elements:
            if element.parent is best.parent and not element.out:
                if element is best or score(element) >= enough or _goes_along(element):
                    spans.append((element.first, element.last))
        if best.parent is None:
            spans.append((best.first, best.last))
    kept, place = [], 0
    for element, text, _ in blocks:
        while place < len(spans) and spans[place][1] < element.first:
            place += 1
        if place < len(spans) and spans[place][0] <= element.first <= spans[place][1]:
            kept.append(text)
    return "\n".join(kept)


def _goes_along(element: _Element) -> bool:
    """A paragraph or heading beside the best element that reads like part of it."""
    if not element.chars:
        return False
    density = element.linked / element.chars
    if element.tag in _HEADINGS:
        return density < 0.25
    return element.tag == "p" and (density < 0.25 and element.chars > 80 or not element.linked and element.chars > 20)


def _hints(attributes: str) -> Iterator[tuple[str, str]]:
    """Name and value of each attribute that can tell what an element is; the first of a name counts."""
    seen = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in _HINTS and name not in seen:
            seen.add(name)
            yield name, value.strip("\"'")


def _is_out(tag: str, attributes: str, parent: _Element) -> bool:
    """Whether tag, role or being hidden leave the element out, whatever is in it."""
    if tag in _LEFT_OUT:
        # The header of an article holds its title.
        return not (tag == "header" and _within(parent, "article"))
    if not attributes:
        return False
    for name, value in _hints(attributes):
        if name == "role":
            if value.lower() in _ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            if tag not in _NEVER_OUT:
                return True
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) and tag not in _NEVER_OUT:
                return True
    return False


def _hint(tag: str, attributes: str) -> int:
    """What the names in class and id make of the element; 0 is nothing."""
    found = _FURNITURE if tag == "form" else 0
    if not attributes or tag in ("html", "body", "main"):
        return found
    for name, value in _hints(attributes):
        if name not in ("class", "id"):
            continue
        names = [_SPLIT.split(_CAMEL.sub("-", one).lower()) for one in value.split()]
        for place, parts in enumerate(names):
            kind = _named([p for p in parts if p], [p for other in names[:place] + names[place + 1:] for p in other])
            if tag != "article" or kind == _NEVER and not {"comment", "comments"}.isdisjoint(parts):
                found = max(found, kind)
    return found


def _named(parts: list[str], others: list[str]) -> int:
    """What one name, cut into parts, makes of an element whose other names have the parts `others`."""
    comment = "comment" in parts or "comments" in parts
    if not comment and not _CONTENT.isdisjoint(parts):
        return 0
    found = 0
    for i, part in enumerate(parts):
        if part not in _NAMES or i and parts[i - 1] in _BEFORE:
            continue
        after = parts[i + 1:]
        sure = _NEVER if part in _NO_ARTICLE else _FURNITURE
        if after and after[0] in _AFTER:
            sure = _HINTED
        elif after and after[-1] in _SIDES and not _ROUND.isdisjoint(others):
            sure = 0
        elif after and part in _AMBIGUOUS and after[-1] not in _BOXES and after[-1] not in _NAMES and not after[-1].isdigit():
            sure = _HINTED
        found = max(found, sure)
    return found


def _settle(elements: list[_Element], blocks: list[tuple[_Element, str, int]]) -> None:
    """Decide which of the elements with hints are out, and tell it to all that is in them.

    A hinted element is out if it has no paragraph or a third of its text is links. Furniture is out unless
    it holds four times the prose of all that stays, and a heading or article, or three paragraphs where
    nothing that stays has one. The one with most prose is looked at first, then what is in it.
    """
    sizes = [[0, 0, 0, 0, 0] for _ in elements]  # characters, linked ones, prose, paragraphs, marks
    for element, text, linked in blocks:
        own = sizes[element.first]
        own[0] += len(text)
        own[1] += linked
        if len(text) >= _LONG and 2 * linked < len(text):
            own[2] += len(text) - linked
            own[3] += 1
        own[4] += element.tag == "h1"
    whole = [list(own) for own in sizes]
    for element in reversed(elements):
        own = whole[element.first]
        own[4] += element.tag in ("article", "main") and own[2] > 0
        if element.parent is not None:
            around = whole[element.parent.first]
            for i, value in enumerate(own):
                around[i] += value
    waiting: list[tuple[int, int]] = []
    stays, marks = 0, 0

    def enter(first: int, last: int) -> None:
        nonlocal stays, marks
        while first <= last:
            element = elements[first]
            chars, linked, prose, _, _ = whole[first]
            if element.hint == _HINTED and (not prose or 3 * linked >= chars):
                element.out = True
            elif element.hint >= _FURNITURE:
                element.out = True
                if element.hint == _FURNITURE:
                    heapq.heappush(waiting, (-prose, first))
                first = element.last + 1
                continue
            if not element.out:
                stays += sizes[first][2]
                marks += sizes[first][4] + (element.tag in ("article", "main") and prose > 0)
                first += 1
            else:
                first = element.last + 1

    enter(0, len(elements) - 1)
    while waiting:
        prose, first = heapq.heappop(waiting)
        _, _, _, paragraphs, marked = whole[first]
        if -prose > 4 * stays and (marked or paragraphs >= 3 and not marks):
            element = elements[first]
            element.out, element.hint = False, _HINTED
            stays += sizes[first][2]
            marks += sizes[first][4]
            enter(first + 1, element.last)
    for element in elements:
        if element.parent is not None and element.parent.out:
            element.out = True


def _within(element: _Element | None, tag: str) -> bool:
    while element is not None:
        if element.tag == tag:
            return True
        element = element.parent
    return False


def _read(page: str) -> tuple[list[_Element], list[tuple[_Element, str, int]]]:
    """All elements in page order, and the blocks of text outside those that are out in any case."""
    root = _Element("html", None, False, 0, False, 0)
    elements, stack, opened = [root], [root], Counter({"html": 1})
    blocks: list[tuple[_Element, str, int]] = []
    pieces: list[str] = []
    linked = 0
    holder = root  # the block the pieces are in

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _BLANKS.sub(" ", "".join(pieces)).strip()
            if text:
                blocks.append((holder, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        top = stack[-1]
        if not top.out and raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if top.link:
                linked += len(_BLANKS.sub(" ", text).strip())

    def settle() -> None:
        nonlocal holder
        for element in reversed(stack):
            if element.tag in _BLOCKS:
                holder = element
                return

    def close(count: int) -> None:
        ends_block = False
        for _ in range(count):
            element = stack.pop()
            opened[element.tag] -= 1
            element.last = len(elements) - 1
            ends_block = ends_block or element.tag in _BLOCKS
        if ends_block:
            flush()
            settle()

    def close_open(tags: set[str], bounds: set[str]) -> None:
        """Close the nearest open element with one of these tags, if nothing holds it in."""
        if not any(opened[t] > 0 for t in tags):
            return
        for depth in range(1, len(stack)):
            tag = stack[-depth].tag
            if tag in tags:
                close(depth)
                return
            if tag in bounds:
                return

    at = 0
    for match in _TOKEN.finditer(page):
        start = match.start()
        if start < at:
            continue  # within raw text that has been passed
        add(page[at:start])
        at = match.end()
        tag = match[2] or match[5]
        if tag is None:
            continue
        tag, attributes = tag.lower(), match[3] if match[2] else match[6]
        if match[1] or match[4]:
            if opened[tag] > 0 and tag != "html":
                close_open({tag}, set())
            elif tag in ("p", "br"):
                flush() if tag == "p" else pieces.append(" ")
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                at = end.start() if end else len(page)
                closing = page.find(">", at)
                at = closing + 1 if end and closing >= 0 else len(page) if not end else at
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _BLOCKS:
            close_open({"p"}, {"table", "td", "th", "article", "body"})
            if tag in _HEADINGS:
                close_open(_HEADINGS, _HOLDS | {"div", "section"})
            if tag in _ENDS:
                close_open(_ENDS[tag], _HOLDS - _ENDS[tag])
            flush()
        if tag in ("html",):
            continue
        parent = stack[-1]
        hint = _hint(tag, attributes)
        # Text of an inline element is part of a block, so it is decided here.
        out = parent.out or _is_out(tag, attributes, parent) or hint >= _FURNITURE and tag not in _BLOCKS
        element = _Element(tag, parent, out, hint if tag in _BLOCKS else 0, parent.link or tag == "a", len(elements))
        elements.append(element)
        if attributes.endswith("/") and tag not in _BLOCKS:
            continue
        stack.append(element)
        opened[tag] += 1
        if tag in _BLOCKS:
            holder = element
    add(page[at:])
    flush()
    while stack:
        stack.pop().last = len(elements) - 1
    return elements, blocks
