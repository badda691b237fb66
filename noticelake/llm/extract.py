"""Main text of web pages by tag-path ratios.

A page is read once from left to right into blocks: runs of text between block-level
tags, each under its path of open elements from the root (a step is a tag with its
class and id). For every path, the length of the text outside links and its punctuation
are summed and divided by its blocks, and fused into one score; the scores are smoothed
over the page's blocks in order with a Gaussian window, and the smoothed and own score
of a path are fused again. Paths whose score passes a share of the page's mean are
content. The content element is then sought from the root down: the article
or main element that holds most content, with its sibling articles that hold at least
``SIBLING`` of as much, or else the deepest element that holds nearly all content.

Within it the scores decide by path: content paths stay; a path below the threshold that
is mostly links goes; any other short path stays in an article or main element, and
elsewhere between content blocks or as a heading. Names only add to that: elements that are by
their tag, role, class or id no part of an article (menus, headers, footers, sidebars,
notices, adverts, forms, reader comments) go. A class, id or role that only hints at this, and
a form, skip nothing that holds the only article or nearly all of the content. Inline
elements go if they are hidden or named as adverts; scripts and styles split nothing.

Character references are decoded, white space in a block is one blank, blocks are
joined by a line feed. Broken markup never fails: an unclosed comment, script or tag
runs to the end of the page, an element that is left open is closed by its parent.
Null and empty pages, and pages without text, give an empty text. Pages are read one by
one: repeated rows and ids and further columns do not matter."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noticelake.llm.common import slices

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Raw text that does not end the block around it.
UNSPLIT = frozenset("script style iframe noembed noframes textarea".split())
SKIPPED = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math canvas object audio "
                    "video select option button datalist dialog nav header footer aside menu".split())
FORMS = frozenset("form fieldset".split())
NAMED = frozenset("article main".split())
CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
WHOLE = frozenset("html body article main".split())
HINTS = frozenset("ad ads adbox adsense advert advertisement adverts advertising sponsor sponsored promo promotion nav navbar "
                  "navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside notice notices notification "
                  "cookie cookies consent gdpr privacy banner popup modal overlay newsletter subscribe subscription signup paywall "
                  "comment comments commentlist disqus respond replies discussion related recommended share sharing social widget "
                  "pagination pager login search toolbar disclaimer alert form".split())
#: Names of adverts, which count on inline elements too.
ADVERTS = frozenset("ad ads adbox adsense adsbygoogle advert advertisement adverts advertising sponsor sponsored".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: A start tag closes these open elements, up to the nearest of the second set.
CLOSES = {t: (frozenset(c.split()), frozenset(s.split())) for t, c, s in (
    ("li", "li", "ul ol menu"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"),
    ("td", "td th", "tr table"), ("th", "td th", "tr table"), ("option", "option", "select"))}
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
#: A sibling of the article is part of it from this share of its content on.
SIBLING = 0.2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements nested deeper are read as part of the one around them, as browsers do.
DEPTH = 512
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"(?:=\s*)?[\"']|>")  # a quote opens a value only after an equals sign
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


class Block(NamedTuple):
    text: str
    path: str
    elements: tuple[int, ...]  # numbers of the open elements, from the root
    skipped: bool
    linked: int = 0  # characters inside links


def _found(source: str) -> dict[str, str]:
    """Attributes of a tag; the first of a name counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _unseen(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(found.get("style", "")) is not None


def _names(found: dict[str, str]) -> list[str]:
    return re.split(r"[\s_-]+", f"{found.get('class', '')} {found.get('id', '')}".lower())


def _attributes(tag: str, source: str) -> tuple[str, bool, bool]:
    """The path step of an element, whether it is no part of an article, and whether it seems so."""
    if not source or source.isspace():
        return tag, tag in SKIPPED, tag in FORMS
    found = _found(source)
    label = f"{found.get('class', '')} {found.get('id', '')}".lower().strip()
    out, hinted = tag in SKIPPED, False
    if tag not in WHOLE and not out:
        out = _unseen(found)
        hinted = tag in FORMS or not HINTS.isdisjoint(_names(found)) or found.get("role", "").lower() in ROLES
    return f"{tag}.{label}" if label else tag, out, hinted


class Inline:
    """An open inline element that mutes or links what it holds, up to its end tag or the
    end of the block around it."""

    def __init__(self) -> None:
        self.tag, self.depth, self.nested = "", 0, 0

    def open(self, tag: str, depth: int) -> None:
        self.tag, self.depth, self.nested = tag, depth, 1

    def start(self, tag: str) -> None:
        self.nested += tag == self.tag

    def end(self, tag: str) -> None:
        if tag == self.tag:
            self.nested -= 1
            if not self.nested:
                self.tag = ""

    def rise(self, depth: int) -> None:
        if depth < self.depth:
            self.tag = ""


def blocks(page: str) -> tuple[list[Block], dict[int, str], set[int]]:
    """The page's blocks in order, the tags of its elements by number, and the elements
    that seem no part of an article."""
    out: list[Block] = []
    hints: set[int] = set()
    tags: dict[int, str] = {}
    stack: list[tuple[str, str, int, bool]] = []  # tag, step, number, skipped
    deep: list[str] = []  # tags of the elements that are open below the last of the stack
    n_deep: Counter[str] = Counter()
    parts: list[str] = []
    gone: set[str] = set()  # ends of raw text and quotes that do not occur any more
    lower, at, size = None, 0, len(page)
    mute, link, hidden, linked = Inline(), Inline(), False, 0

    def add(text: str) -> None:
        nonlocal linked
        if not mute.tag:
            parts.append(text)
            if link.tag:
                linked += len(text.strip())

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(text, "/".join(s for _, s, _, _ in stack), tuple(n for _, _, n, _ in stack),
                                 bool(stack) and stack[-1][3], min(linked, len(text))))
            linked = 0

    def close(to: int) -> None:
        flush()
        del stack[to:]
        deep.clear()
        n_deep.clear()
        mute.rise(to)
        link.rise(to)

    def rise() -> str:
        tag = deep.pop()
        n_deep[tag] -= 1
        return tag

    while at < size:
        low = page.find("<", at)
        if low < 0:
            low = size
        if low > at:
            add(page[at:low])
        if low == size:
            break
        if page.startswith("<!--", low):
            end = page.find("-->", low + 4)
            at = size if end < 0 else end + 3
            continue
        name = _NAME.match(page, low + 1)
        if not name:
            if page[low + 1:low + 2] in ("!", "?", "/"):
                end = page.find(">", low)
                at = size if end < 0 else end + 1
            else:
                add("<")
                at = low + 1
            continue
        end = name.end()
        while True:
            stop = _STOP.search(page, end)
            if not stop:
                end = size
                break
            end = stop.end()
            if stop[0] == ">":
                break
            quote = stop[0][-1]
            if stop[0][0] == "=" and quote not in gone:
                other = page.find(quote, end)
                if other < 0:
                    gone.add(quote)
                else:
                    end = other + 1
        tag, source, at = name[0].lower(), page[name.end():end].rstrip(">"), end
        if tag[0] == "/":
            tag = tag[1:]
            if tag not in INLINE and n_deep[tag]:
                flush()
                while rise() != tag:
                    pass
            elif tag not in INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if stack[i][0] in ("td", "th") and tag not in ("table", "tr", "tbody", "body", "html"):
                        break
                else:
                    flush()
            elif tag == "br":
                parts.append(" ")
            else:
                mute.end(tag)
                link.end(tag)
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag not in VOID:
                if mute.tag:
                    mute.start(tag)
                elif source:
                    found = _found(source)
                    hidden = _unseen(found)
                    if hidden or not ADVERTS.isdisjoint(_names(found)):
                        mute.open(tag, len(stack))
                if link.tag:
                    link.start(tag)
                elif tag == "a":
                    link.open(tag, len(stack))
            continue
        if tag not in UNSPLIT:
            flush()
        if deep and (deep[-1] == "p" and tag in _ENDS_P or tag in CLOSES and deep[-1] in CLOSES[tag][0]):
            rise()
        if tag in _ENDS_P and not deep:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in CONTAINERS or stack[i][0] == "li":
                    break
        if tag in CLOSES and not deep:
            ends, bounds = CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in bounds:
                    break
                if stack[i][0] in ends:
                    close(i)
                    if tag != "tr":
                        break
        if tag in RAW:
            if lower is None:
                lower = page.lower()
                if len(lower) != size:  # a few letters change their length
                    lower = re.sub(r"[A-Z]", lambda m: m[0].lower(), page)
            end = -1 if tag in gone else lower.find(f"</{tag}", at)
            if end < 0:
                gone.add(tag)
                at = size
            else:
                at = end
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            continue
        if tag in VOID or source.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in ("html", "body") and any(t == tag for t, *_ in stack):
            continue
        if len(stack) >= DEPTH:
            deep.append(tag)
            n_deep[tag] += 1
            continue
        step, skipped, hinted = _attributes(tag, source)
        if mute.tag:  # blocks in a muted inline element
            skipped, hinted = skipped or hidden, True
        number = len(tags)
        tags[number] = tag
        if hinted:
            hints.add(number)
        stack.append((tag, step, number, skipped or bool(stack) and stack[-1][3]))
    flush()
    return out, tags, hints


def scores(found: list[Block], radius: int = 2) -> np.ndarray:
    """The score of each block's path: its fused ratios, and these smoothed over the blocks."""
    paths = {path: i for i, path in enumerate(dict.fromkeys(b.path for b in found))}
    of = np.array([paths[b.path] for b in found], np.int64)
    n = np.bincount(of, minlength=len(paths))
    free = np.array([len(b.text) - b.linked for b in found], float)
    marks = np.array([len(_PUNCTUATION.findall(b.text)) for b in found], float)
    marks[2 * free < [len(b.text) for b in found]] = 0
    mean = lambda x: np.bincount(of, x, len(paths)) / n
    own = np.sqrt(mean(free) * (mean(marks) + 1))
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * (radius / 2) ** 2))
    smooth = own[of]
    if len(found) >= len(kernel):
        smooth = np.convolve(smooth, kernel, "same") / np.convolve(np.ones(len(found)), kernel, "same")
    return np.sqrt(own * mean(smooth))[of]


def selected(found: list[Block], content: np.ndarray, whole: bool) -> list[Block]:
    """The blocks whose paths stay: content; of the others those not mostly links, and
    unless ``whole`` only between content blocks or as headings."""
    size: Counter[str] = Counter()
    linked: Counter[str] = Counter()
    for b in found:
        size[b.path] += len(b.text)
        linked[b.path] += b.linked
    at = np.flatnonzero(content)
    low, high = (at[0], at[-1]) if len(at) else (0, len(found))
    return [b for i, b in enumerate(found) if content[i] or 2 * linked[b.path] <= size[b.path] and (
        whole or low < i < high or b.path.rpartition("/")[2].partition(".")[0] in HEADINGS)]


def believed(found: list[Block], tags: dict[int, str], hints: set[int], share: float, hold: float) -> set[int]:
    """Those of the hinted elements that are skipped, by the scores of all blocks."""
    fused = scores(found)
    content = [b for b, score in zip(found, fused) if score >= share * fused.mean()]
    total = sum(len(b.text) for b in content)
    held: Counter[int] = Counter()
    before: dict[int, tuple[int, ...]] = {}  # element -> the elements around it
    for b in content:
        for at, number in enumerate(b.elements):
            held[number] += len(b.text)
            if (number in hints or tags[number] in NAMED) and number not in before:
                before[number] = b.elements[:at]
    named = {n for n in before if tags[n] in NAMED}
    is_open = any(hints.isdisjoint(b.elements) and not named.isdisjoint(b.elements) for b in content)
    left = {n for n in hints if held[n] < hold * total or is_open and named.isdisjoint(before[n])}
    if named and not is_open:
        left -= set(before[max(named, key=lambda n: (held[n], n))])
    return left if any(left.isdisjoint(b.elements) for b in content) else set()


def main_text(page: str | None, share: float = 0.5, hold: float = 0.8) -> str:
    """The text of the article of a page."""
    found, tags, hints = blocks(page or "")
    found = [b for b in found if not b.skipped]
    if hints and found:
        hints = believed(found, tags, hints, share, hold)
        found = [b for b in found if hints.isdisjoint(b.elements)]
    if not found:
        return ""
    fused = scores(found)
    content = fused >= share * fused.mean()
    held: dict[int, float] = {}
    for b, is_content in zip(found, content):
        for number in b.elements:
            held[number] = held.get(number, 0) + len(b.text) * bool(is_content)
    total = sum(len(b.text) for b, is_content in zip(found, content) if is_content)
    named = [n for n in held if tags[n] in NAMED and held[n] > 0]
    if named:
        best = max(held[n] for n in named)
        first = max(n for n in named if held[n] == best)  # the innermost of equals
        around = {n: b.elements[:b.elements.index(n)] for b in found for n in b.elements if n in held and tags[n] in NAMED}
        chosen = {n for n in named if n == first or tags[n] == tags[first] == "article"
                  and around[n] == around[first] and held[n] >= SIBLING * best}
    else:
        chosen = {max((n for n in held if tags[n] in CONTAINERS and held[n] >= hold * total), default=-1)}
    inside = [chosen == {-1} or not chosen.isdisjoint(b.elements) for b in found]
    kept = selected([b for b, i in zip(found, inside) if i], content[inside], bool(named))
    return "\n".join(b.text for b in kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            texts = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("h"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
