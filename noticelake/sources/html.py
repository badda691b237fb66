"""Table cells of an HTML payload. The only Python of the parse job:
everything after the cells and labels is Column expressions
(:mod:`noticelake.sources.parse`)."""

from __future__ import annotations

import gzip
import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

CELL = T.StructType([
    T.StructField("texts", T.ArrayType(T.StringType())),       # NFC text nodes in order
    T.StructField("link_texts", T.ArrayType(T.StringType())),  # text nodes of the first <a>
    T.StructField("hrefs", T.ArrayType(T.StringType())),
])
FIELDS = T.MapType(T.StringType(), T.StringType())
TOKENIZED = [
    T.StructField("rows", T.ArrayType(T.ArrayType(CELL))),
    T.StructField("fields", FIELDS),    # detail pages: label without white space -> value
    T.StructField("error", T.StringType()),
]
_TEXTS = pa.list_(pa.string())
_ROWS = pa.list_(pa.list_(pa.struct([("texts", _TEXTS), ("link_texts", _TEXTS), ("hrefs", _TEXTS)])))
_MAP = pa.map_(pa.string(), pa.string())
LOT_CELLS = 6  # Fixed value: width of the lot table of a detail page.
#: Cells of the payloads that a task holds as Python objects at a time.
CELLS_AT_ONCE = 50_000

# Fixed value: marks the page the portal answers with instead of results.
EXPIRED_MARK = "Session Expired"


_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_STOP = re.compile(r"[>\"']")
# A tag whose end no quote, comment or script can move.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*+)([^<>"']*+(?:"[^"<>]*+"[^<>"']*+|'[^'<>]*+'[^<>"']*+)*+)>""")
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _text(data: str) -> str:
    if "&" in data:
        data = unescape(data)
    return data if data.isascii() else unicodedata.normalize("NFC", data)


def _href(attributes: str) -> str:
    found = _HREF.search(attributes)
    return unescape(next((g for g in found.groups() if g is not None), "")) if found else ""


def _marks(html: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """Comments, scripts and tags as (start, end, closing, tag, attributes); what lies
    between two of them is one text node.

    One pass from left to right: what was once looked for in vain to the end of the
    page (the end of a script, a second quote) is not looked for again."""
    at, size, gone, lower = 0, len(html), set(), None
    while (low := html.find("<", at)) >= 0:
        if html.startswith("<!--", low):
            end = html.find("-->", low + 4)
            at = size if end < 0 else end + 3
            yield low, at, False, None, ""
            continue
        name = _TAG.match(html, low)
        if not name:
            at = low + 1
            if html[at:at + 1] in ("!", "?") and "declaration" not in gone:
                end = html.find(">", low)
                if end < 0:
                    gone.add("declaration")
                else:
                    at = end + 1
                    yield low, at, False, None, ""
            continue
        tag, closing = name[2].lower(), bool(name[1])
        if tag in ("script", "style") and not closing and tag not in gone:
            lower = lower or re.sub("[A-Z]", lambda m: m[0].lower(), html)
            end = lower.find(f"</{tag}", name.end())
            end = html.find(">", end) if end >= 0 else -1
            if end >= 0:
                at = end + 1
                yield low, at, False, None, ""
                continue
            gone.add(tag)
        end = name.end()
        while stop := _STOP.search(html, end):
            end = stop.end()
            if stop[0] == ">":
                break
            if stop[0] not in gone:
                other = html.find(stop[0], end)
                if other < 0:
                    gone.add(stop[0])
                else:
                    end = other + 1
        else:
            # Quotes swallowed the rest: from here on they count as ordinary signs.
            gone |= {"'", '"'}
            end = html.find(">", name.end()) + 1
            if not end:
                return
        at = end
        yield low, end, closing, tag, html[name.end():end - 1]


def _nodes(html: str) -> Iterator[tuple[str, bool, str | None, str]]:
    """(text before a mark, closing, tag, attributes) of all marks, and the text after the last.

    Pages of plain tags only, which most are, are split in one step."""
    parts = _PLAIN.split(html)
    if len(parts) // 4 == html.count("<"):
        tags = [t.lower() for t in parts[2::4]]
        if "script" not in tags and "style" not in tags:
            yield from zip(parts[::4], map(bool, parts[1::4]), tags, parts[3::4])
            yield parts[-1], False, None, ""
            return
    end = 0
    for start, stop, closing, tag, attributes in _marks(html):
        yield html[end:start], closing, tag, attributes
        end = stop
    yield html[end:], False, None, ""


def table_cells(html: str) -> list[list[dict]]:
    """Every <tr> with all <td> below it, nested tables included.

    Markup omits closing tags freely, so a new cell closes an open one and a new
    row closes an open row of the same table. List payloads are bare <tr> runs, so
    the page counts as the inside of a table."""
    depth = 1
    rows: list[list[dict]] = []
    open_rows: list[tuple[int, list[dict]]] = []
    open_cells: list[tuple[int, dict]] = []
    link_owners: list[dict] = []
    as_is = "&" not in html and html.isascii()

    def leave(cells_from: int, rows_from: int) -> None:
        link_owners.clear()
        while open_cells and open_cells[-1][0] >= cells_from:
            open_cells.pop()
        while open_rows and open_rows[-1][0] >= rows_from:
            open_rows.pop()

    for text, closing, tag, attributes in _nodes(html):
        if text and open_cells:
            text = text if as_is else _text(text)
            for _, cell in open_cells:
                cell["texts"].append(text)
            for cell in link_owners:
                cell["link_texts"].append(text)
        if tag == "td":
            leave(depth, depth + 1)
            if not closing and open_rows:
                cell = {"texts": [], "link_texts": None, "hrefs": []}
                for _, row in open_rows:
                    row.append(cell)
                open_cells.append((depth, cell))
        elif tag == "tr":
            leave(depth, depth)
            if not closing:
                rows.append([])
                open_rows.append((depth, rows[-1]))
        elif tag == "table":
            if not closing:
                depth += 1
            elif depth > 1:
                leave(depth, depth)
                depth -= 1
        elif tag == "a":
            link_owners.clear()
            if not closing and open_cells:
                href = _href(attributes)
                for _, cell in open_cells:
                    cell["hrefs"].append(href)
                    if cell["link_texts"] is None:
                        cell["link_texts"] = []
                        link_owners.append(cell)
    return rows


def cells_of(content: bytes) -> list[list[dict]]:
    """Rows of cells of one payload; a session page has none."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    html = content.decode("utf-8", errors="replace")
    if EXPIRED_MARK in html:
        return []
    return table_cells(html)


def labelled(rows: list[list[dict]]) -> dict[str, str]:
    """Label -> value of a detail page: a cell ending in ':' labels the next cell.

    Cells pair up by position, so added or reordered rows do no harm; the first
    occurrence of a label wins. Line breaks inside a label vary, so labels are
    compared without white space."""
    fields: dict[str, str] = {}
    for row in rows:
        label = None
        for cell in row:
            if label is None:
                text = " ".join(cell["texts"]).rstrip()
                if text.endswith(":"):
                    label = "".join(text.rstrip(":").split()).lower()
                continue
            if label and label not in fields:
                lines = (" ".join(x.split()) for x in "\n".join(cell["texts"]).split("\n"))
                fields[label] = "\n".join(x for x in lines if x)
            label = None
    return fields


def _read(content: bytes, kind: str) -> tuple:
    rows = cells_of(content)
    if kind != "detail":
        return rows, None, None
    lots = [r for r in rows if len(r) == LOT_CELLS]
    return lots, list(labelled(rows).items()), None


def read_payload(content: bytes, kind: str) -> tuple:
    """(rows, labels, error) of one payload; what cannot be read is an error, not a failure."""
    try:
        return _read(content, kind)
    except Exception as exc:  # noqa: BLE001
        return None, None, f"{type(exc).__name__}: {exc}"


# Pages of rows of cells side by side, each closed, with plain tags and at most one link in a cell.
_INLINE = ("abbr|b|big|br|center|cite|code|div|em|font|form|h[1-6]|hr|i|img|input|label|li|nobr|ol|p|pre|s|small|span|"
           "strong|sub|sup|tt|u|ul")
_ATTRIBUTES = r"""(?:[\s/](?:[^<>"']|"[^"<>]*"|'[^'<>]*')*)?"""
_NODES = rf"(?:[^<]|</?(?:{_INLINE}){_ATTRIBUTES}>|</a{_ATTRIBUTES}>)*"
_FLAT = (rf"(?i)\A[^<]*(?:<tr{_ATTRIBUTES}>[^<]*(?:<td{_ATTRIBUTES}>{_NODES}(?:<a{_ATTRIBUTES}>{_NODES})?(?-i:</td>)[^<]*)*"
         r"(?-i:</tr>)[^<]*)*\z")
_LINK = r"(?is)^.*?<a(?P<attributes>(?:[\s/][^<>]*)?)>(?P<body>.*)$"
_LINK_END = r"(?i)</a(?:[\s/][^<>]*)?>"


def _unpacked(content: bytes | None) -> bytes | None:
    """The page; as it is when it cannot be unpacked, which reading it will tell."""
    if content is None or content[:2] != b"\x1f\x8b":
        return content
    try:
        return gzip.decompress(content)
    except Exception:  # noqa: BLE001
        return content


def _as_text(content: bytes | None) -> str | None:
    try:
        return content.decode() if content is not None else None
    except UnicodeDecodeError:
        return None


def _flat_pages(pages: list[bytes | None], kinds: pa.Array) -> tuple[pa.Array, list[bool]]:
    """(the pages as texts, which of them `_flat_rows` reads as :func:`table_cells` does)."""
    try:
        texts = pa.array(pages, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # some page is no UTF-8
        texts = pa.array(map(_as_text, pages), pa.string())
    flat = pc.and_(pc.match_substring_regex(texts, _FLAT), pc.invert(pc.match_substring(texts, EXPIRED_MARK)))
    listed = pc.fill_null(pc.not_equal(kinds, "detail"), True)
    return texts, pc.and_(pc.fill_null(flat, False), listed).to_pylist()


def _but_last(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """(values, offsets) of lists without the last value of each; none is empty."""
    offsets = lists.offsets.to_numpy()
    keep = np.ones(len(lists.values), bool)
    keep[offsets[1:] - 1] = False
    return lists.values.filter(pa.array(keep)), offsets - np.arange(len(offsets), dtype=offsets.dtype)


def _text_lists(parts: pa.ListArray, dropped: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(text nodes, offsets) of texts split at their tags: without empty nodes and those at ``dropped``."""
    keep = pc.binary_length(parts.values).to_numpy(zero_copy_only=False) > 0
    keep[dropped] = False
    nodes = parts.values.filter(pa.array(keep))
    odd = pc.or_(pc.match_substring(nodes, "&"), pc.invert(pc.string_is_ascii(nodes)))
    if pc.any(odd).as_py():
        nodes = pc.replace_with_mask(nodes, odd, pa.array(map(_text, nodes.filter(odd).to_pylist()), pa.string()))
    return nodes, np.concatenate([[0], np.cumsum(keep)]).astype("int32")[parts.offsets.to_numpy()]


def _flat_rows(pages: pa.Array) -> pa.Array:
    """:func:`table_cells` of flat pages, all at once: rows, cells and text nodes are split
    column by column, no cell is a Python object."""
    tags = "<[^<>]*>"
    rows, row_offsets = _but_last(pc.split_pattern(pages, "</tr>"))
    cells, cell_offsets = _but_last(pc.split_pattern(rows, "</td>"))
    parts = pc.split_pattern_regex(cells, tags)
    # What stands before the <td> and, in the first cell of a row, before the <tr>.
    at = parts.offsets.to_numpy()[:-1]
    first = cell_offsets[:-1][np.diff(cell_offsets) > 0]
    texts, text_offsets = _text_lists(parts, np.concatenate([at, at[first] + 1]))
    linked = pc.match_substring_regex(cells, r"(?i)<a[\s/>]")
    has_link = linked.to_numpy(zero_copy_only=False)
    link = pc.extract_regex(cells.filter(linked), _LINK)
    body = pc.list_element(pc.split_pattern_regex(link.field("body"), _LINK_END, max_splits=1), 0)
    link_texts, offsets = _text_lists(pc.split_pattern_regex(body, tags), np.array([], "int32"))
    counts = np.zeros(len(cells), "int32")
    counts[has_link] = np.diff(offsets)
    starts = lambda n: np.concatenate([[0], np.cumsum(n)]).astype("int32")
    hrefs = [_href(a) for a in link.field("attributes").to_pylist()]
    cell = pa.StructArray.from_arrays([
        pa.ListArray.from_arrays(text_offsets, texts),
        pa.ListArray.from_arrays(starts(counts), link_texts, mask=pc.invert(linked)),
        pa.ListArray.from_arrays(starts(has_link), pa.array(hrefs, pa.string()))], names=["texts", "link_texts", "hrefs"])
    return pa.ListArray.from_arrays(row_offsets, pa.ListArray.from_arrays(cell_offsets, cell))


def _columns(texts: pa.Array, read: list[tuple | None]) -> list[pa.Array]:
    """``rows``, labels and errors of pages; those without an entry in ``read`` are flat."""
    flat = [i for i, one in enumerate(read) if one is None]
    slow = [i for i, one in enumerate(read) if one is not None]
    _, fields, errors = zip(*[one or (None, None, None) for one in read])
    parts = ([_flat_rows(texts.take(pa.array(flat)))] if flat else []) + (
        [pa.array([read[i][0] for i in slow], _ROWS)] if slow else [])
    rows = parts[0]
    if len(parts) > 1:
        rows = pa.concat_arrays(parts).take(pa.array(np.argsort(flat + slow)))
    return [rows, pa.array(fields, _MAP), pa.array(errors, pa.string())]


def tokenize_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: ``content`` -> ``rows`` and labels, or an ``error``.

    A broken payload never fails the task; its error travels with its row. Cells take many
    times the room of their page, so a batch leaves in slices of ``CELLS_AT_ONCE``. Flat
    pages, which most lists are, are split together; the others one by one."""
    for batch in batches:
        kinds, contents = batch.column("kind"), batch.column("content")
        pages, start, held = [], 0, 0
        for at in range(batch.num_rows):
            pages.append(_unpacked(contents[at].as_py()))
            held += pages[-1].count(b"</td>") if pages[-1] else 0
            if held >= CELLS_AT_ONCE or at + 1 == batch.num_rows:
                yield from _slices(batch.slice(start, len(pages)), pages, kinds.slice(start, len(pages)))
                pages, start, held = [], at + 1, 0


def _slices(batch: pa.RecordBatch, pages: list[bytes | None], kinds: pa.Array) -> Iterator[pa.RecordBatch]:
    kept = [n for n in batch.schema.names if n != "content"]
    texts, flat = _flat_pages(pages, kinds)
    read, start, held = [], 0, 0
    for at, content in enumerate(pages):
        read.append(None if flat[at] else read_payload(content, kinds[at].as_py()))
        held += sum(map(len, read[-1][0] or ())) if read[-1] else 0
        if held >= CELLS_AT_ONCE or at + 1 == len(pages):
            yield pa.RecordBatch.from_arrays(
                [batch.column(n).slice(start, len(read)) for n in kept] + _columns(texts.slice(start, len(read)), read),
                names=kept + [f.name for f in TOKENIZED])
            read, start, held = [], at + 1, 0
