"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element, in page order. A line of a menu, header, footer, sidebar, notice, advert, form
or of reader comments counts as empty, like the lines of nothing between blocks. Where a page marks its article, lines outside it count as
empty and all others are kept.

Otherwise lines that are mostly links count as empty too. Text lengths are summed over windows of ``WINDOW`` lines; a region starts where
the sum rises from nothing and ends where it dives to nothing, and is text if it surges to ``SURGE`` characters (or to the page's greatest
sum, if that is less), whatever the length of the other regions. From the first to the last such region all filled lines are kept, also
those of regions without a surge. A region without a surge before the first or after the last one is kept if it has a line in the same
element (not the body) as a line of a region with one.

Cases: null or empty html gives an empty text; a page cut off inside a tag loses that tag; unclosed elements end with their parent, and a
head, title, frame, object, drawing, button or choice also at the next block; one closed in its own tag is empty; comments, scripts, styles
and text areas without an end go on to the end of the page; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW, SURGE = 3, 80

RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<![^>]*>|<\?[^>]*>", re.S | re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[a-zA-Z/!])[^>]*\Z")
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("p div section article main body h1 h2 h3 h4 h5 h6 ul ol li table thead tbody tr td th dl dt dd blockquote pre figure figcaption address details summary hr header footer nav aside form fieldset menu dialog".split())
HEADS = frozenset("base link meta".split())
#: Elements whose text is dropped from the line around them.
DROPPED = frozenset("title noscript template svg iframe object select button".split())
UNQUOTED = re.compile(r"=\s*[^\s\"']+/\Z")
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
#: Words in class, id or role that mark what is no part of an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall signup login "
    "sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs toolbar topbar masthead header footer copyright legal comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations "
    "widget pagination pager tags search contentinfo complementary skip".split())


def _marked(attributes: str) -> bool:
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        if MARKS.intersection(w.lower() for w in NAME.findall(a or b or c)):
            return True
    return False


def _ends(tags: list[re.Match]) -> dict[int, int]:
    """Place of the closing tag of every dropped element that is closed before its parent ends."""
    ends: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    counts: Counter = Counter()
    for i, tag in enumerate(tags):
        name = (tag[2] or "").lower()
        if name not in DROPPED and (name not in BLOCKS or name in VOID):
            continue
        if not tag[1]:
            if name in BLOCKS or not _closed(tag[3]):
                opened.append((name, i))
                counts[name] += 1
        elif counts[name]:
            while True:
                other, at = opened.pop()
                counts[other] -= 1
                if other == name:
                    break
            if name in DROPPED:
                ends[at] = i
    return ends


def _closed(attributes: str) -> bool:
    return attributes.endswith("/") and not UNQUOTED.search(attributes)


def lines_of(page: str) -> list[tuple[str, bool, bool, bool, int]]:
    """(text, counts as content, inside the article, mostly links, number of the element around the block) of every block in page order."""
    page = RAW.sub(" ", page)
    lines: list[tuple[str, bool, bool, bool, int]] = []
    stack: list[tuple[str, bool, bool, int]] = []         # element, outside the content, in the article, number (0: html and body)
    text: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal text, linked
        line = " ".join(entities.unescape("".join(text)).split())
        if line:
            outside, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            blocks = [x[3] for x in stack if x[0] in BLOCKS]
            lines.append((line, not outside, article, linked > 0.5 * len(line), blocks[-2] if len(blocks) > 1 else 0))
        text, linked = [], 0

    def close(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                if name in BLOCKS:
                    flush()
                del stack[i:]
                return

    def loose() -> int | None:
        """Place of the lowest open element, above the last block, whose text is dropped."""
        found = None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in BLOCKS:
                break
            if stack[i][0] == "head" or stack[i][0] in DROPPED:
                found = i
        return found

    def add(part: str) -> None:
        nonlocal linked
        if stack and stack[-1][0] == "head" and part.strip():
            stack.pop()
        if loose() is not None:
            text.append(" ")
            return
        text.append(part)
        if anchor:
            linked += len(" ".join(part.split()))

    anchor = 0
    tags = list(TAG.finditer(page))
    ends = _ends(tags)
    until = -1
    for place, tag in enumerate(tags):
        if place <= until:
            at = tag.end()
            continue
        if tag.start() > at:
            add(page[at: tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if tag[1]:
            if name == "a":
                anchor = max(0, anchor - 1)
            elif name in BLOCKS and not any(x[0] == name for x in stack):
                flush()
            else:
                close(name)
            continue
        if name in DROPPED:
            text.append(" ")
            if name in ("button", "select"):              # neither holds another of its kind
                close(name)
            if place in ends:
                until = ends[place]
            elif not _closed(tag[3]):
                stack.append((name, True, stack[-1][2] if stack else False, place + 1))
            continue
        if name == "head":
            stack.append((name, True, False, place + 1))
            continue
        if stack and stack[-1][0] == "head" and name not in HEADS:
            stack.pop()
        if name in BLOCKS and (i := loose()) is not None:
            del stack[i:]
        if name == "br":
            text.append(" ")
            continue
        if name == "a":
            anchor = 1
            continue
        if name in BLOCKS:
            flush()
            anchor = 0
            if stack and any(x[0] == "p" for x in stack):    # a block ends an open paragraph, with the inline elements left open in it
                close("p")
            if name in ("li", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == name:
                stack.pop()
        if name in VOID:
            continue
        outside, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name in ("article", "main") and not outside:
            article = True
        if name in OUTSIDE or name == "header" and not article or name not in ("html", "body", "article", "main") and _marked(tag[3]) or name == "article" and _marked(tag[3]) and stack and stack[-1][2]:
            outside = True
        if name in BLOCKS or outside != (stack[-1][1] if stack else False):
            stack.append((name, outside, article, 0 if name in ("html", "body") else place + 1))
        if name == "hr":
            lines.append(("", False, False, False, 0))
    if at < len(page):
        add(page[at:])
    flush()
    return lines


def main_text(page: str | None) -> str:
    """The blocks between surge and dive points, a line end between them."""
    lines = lines_of(page or "")
    if any(content and inside and not links for _, content, inside, links, _ in lines):
        return "\n".join(text for text, content, inside, _, _ in lines if content and inside)
    sizes = [len(text) if content and not links else 0 for text, content, _, links, _ in lines]
    sums = [sum(sizes[i: i + WINDOW]) for i in range(len(sizes))]
    least = min(SURGE, max(sums, default=0))
    regions, start = [], None
    for i, total in enumerate([*sums, 0]):
        if total and start is None:
            start = i
        if not total and start is not None:
            regions.append((start, i))
            start = None
    surged = [max(sums[a:b]) >= least for a, b in regions]
    if not any(surged):
        return ""
    first, last = surged.index(True), len(surged) - 1 - surged[::-1].index(True)
    around = {lines[i][4] for (a, b), s in zip(regions, surged) if s for i in range(a, b) if sizes[i]} - {0}
    kept = [r for k, r in enumerate(regions) if first <= k <= last or any(sizes[i] and lines[i][4] in around for i in range(*r))]
    return "\n".join(lines[i][0] for a, b in kept for i in range(a, b) if sizes[i])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(rows, "page_id bigint, url string, text string, n_chars bigint")
