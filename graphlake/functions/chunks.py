"""Documents to chunks: headings, paragraphs and tables in reading order become
sections, short ones join the next, long ones are split."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.sources.workspace import tidied

HEADING = re.compile(r"^(#{1,6})[ \t]+(.+)$", re.M)
MIN_CHARS, MAX_CHARS = 800, 4000
BATCH_CHARS = 2_000_000  # of texts, after which a worker hands on its chunks
SCHEMA = "doc_id long, chunk_no int, kind string, heading string, page_from int, page_to int, text string"


@dataclass(frozen=True)
class Item:
    """A heading (with its level), a paragraph, or a table of cell texts."""

    kind: str
    text: str = ""
    level: int = 0
    grid: tuple[tuple[str, ...], ...] = ()
    pages: tuple[int, int] | None = None


@dataclass(frozen=True)
class Chunk:
    kind: str
    text: str
    heading: str
    pages: tuple[int, int] | None = None


def _span(*pages: tuple[int, int] | None) -> tuple[int, int] | None:
    known = [p for p in pages if p]
    return (min(a for a, _ in known), max(b for _, b in known)) if known else None


def markdown_items(text: str) -> list[Item]:
    """Headings, and what stands before, between and after them."""
    parts = HEADING.split(text)  # prose, then (marks, title, prose) of each heading
    out = [Item("paragraph", parts[0].strip())]
    for marks, title, prose in zip(parts[1::3], parts[2::3], parts[3::3]):
        out += [Item("heading", title.strip(), len(marks)), Item("paragraph", prose.strip())]
    return [i for i in out if i.text]


def cell_text(text: str | None) -> str:
    return (text or "").replace("|", r"\|").replace("\r", " ").replace("\n", " ").strip()


def structured_items(document: dict) -> list[Item]:
    """Items of a converted document, by its references in reading order: each is
    taken once, so a cycle ends; page headers and footers are left out."""
    held = {kind: {x["self_ref"]: x for x in document.get(kind) or [] if x and x.get("self_ref")} for kind in ("texts", "tables", "groups")}
    out: list[Item] = []
    seen: set[str] = set()
    stack = [iter((document.get("body") or {}).get("children") or [])]
    while stack:
        ref = next(stack[-1], stack)
        if ref is stack:
            stack.pop()
            continue
        ref = (ref or {}).get("$ref")
        if ref is None or ref in seen:
            continue
        seen.add(ref)
        if ref in held["groups"]:
            stack.append(iter(held["groups"][ref].get("children") or []))
            continue
        source = held["tables"].get(ref) or held["texts"].get(ref) or {}
        pages = _span(*((p["page_no"],) * 2 for p in source.get("prov") or [] if p and p.get("page_no") is not None))
        if ref in held["tables"]:
            rows = (source.get("data") or {}).get("grid") or []
            grid = tuple(tuple(cell_text((c or {}).get("text")) for c in row) for row in rows if row is not None)
            out += [Item("table", grid=grid, pages=pages)] if grid else []
        elif (text := (source.get("text") or "").strip()) and (label := source.get("label") or "") not in ("page_header", "page_footer"):
            if label in ("title", "section_header"):
                out.append(Item("heading", text, 0 if label == "title" else max(1, source.get("level") or 1), pages=pages))
            else:
                out.append(Item("paragraph", text, pages=pages))
    return out


def table_windows(grid: tuple[tuple[str, ...], ...], high: int = MAX_CHARS) -> list[str]:
    """The table as Markdown in windows of at most ``high`` characters, but one row
    at least; each repeats the header row. A header alone is one window."""
    if not grid:
        return []
    line = lambda cells: f"| {' | '.join(cells)} |"
    head = f"{line(grid[0])}\n|{' --- |' * max(1, len(grid[0]))}"
    out, window = [], head
    for row in map(line, grid[1:]):
        if window != head and len(window) + 1 + len(row) > high:
            out.append(window)
            window = head
        window += "\n" + row
    return [*out, window]


def sections(items: list[Item], high: int = MAX_CHARS) -> list[Chunk]:
    """One text chunk per heading with its paragraphs (the heading's own text leads),
    tables apart; a chunk's heading is the path of those it stands under."""
    out: list[Chunk] = []
    path: list[tuple[int, str]] = []
    said: list[Item] = []
    under = lambda: " > ".join(title for _, title in path)

    def close() -> None:
        if said:
            out.append(Chunk("text", "\n\n".join(i.text for i in said), under(), _span(*(i.pages for i in said))))
            said.clear()

    for item in items:
        if item.kind == "paragraph":
            said.append(item)
            continue
        close()
        if item.kind == "heading":
            path[:] = [p for p in path if p[0] < item.level] + [(item.level, item.text)]
            said.append(item)
        else:
            out += [Chunk("table", window, under(), item.pages) for window in table_windows(item.grid, high)]
    close()
    return out


def merged(chunks: list[Chunk], low: int = MIN_CHARS) -> list[Chunk]:
    """A text chunk below ``low`` characters takes in the text chunk after it, and
    again while it is short; it keeps its own heading."""
    out: list[Chunk] = []
    for c in chunks:
        if out and out[-1].kind == c.kind == "text" and len(out[-1].text) < low:
            out[-1] = replace(out[-1], text=f"{out[-1].text}\n\n{c.text}", pages=_span(out[-1].pages, c.pages))
        else:
            out.append(c)
    return out


def _pieces(paragraph: str, high: int) -> Iterator[str]:
    """Parts of a paragraph that is too long, cut at the last white space that is
    within the bound, or at the bound."""
    while len(paragraph) > high:
        cut = max(paragraph.rfind(c, 0, high) for c in " \n\t")
        cut = cut if cut > 0 else high
        yield paragraph[:cut].rstrip()
        paragraph = paragraph[cut:].lstrip()
    if paragraph:
        yield paragraph


def split_long(chunk: Chunk, high: int = MAX_CHARS) -> list[Chunk]:
    """Whole paragraphs while they fit, as separate chunks of the same heading."""
    if chunk.kind != "text" or len(chunk.text) <= high:
        return [chunk]
    out: list[str] = []
    for piece in (p for paragraph in chunk.text.split("\n\n") if paragraph for p in _pieces(paragraph, high)):
        if out and len(out[-1]) + 2 + len(piece) <= high:
            out[-1] += "\n\n" + piece
        else:
            out.append(piece)
    return [replace(chunk, text=t) for t in out]


def assembled(items: list[Item], low: int = MIN_CHARS, high: int = MAX_CHARS) -> list[Chunk]:
    return [part for c in merged(sections(items, high), low) for part in split_long(c, high)]


def chunk(docs: DataFrame, low: int = MIN_CHARS, high: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text", structured: bool = False) -> DataFrame:
    """(doc_id, chunk_no, kind, heading, page_from, page_to, text) of Markdown, or
    with ``structured`` of converted documents as JSON. Null and blank texts have no
    chunk; a chunk under no heading has the empty one."""

    fields = pa.schema([("doc_id", pa.int64()), ("chunk_no", pa.int32()), ("kind", pa.string()), ("heading", pa.string()), ("page_from", pa.int32()), ("page_to", pa.int32()), ("text", pa.string())])
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for b in batches:
            for doc, text in zip(*(b.column(c) for c in ("doc_id", "text"))):  # one text at a time leaves Arrow's memory
                doc, text = doc.as_py(), text.as_py()
                items = [] if not (text or "").strip() else structured_items(json.loads(text)) if structured else markdown_items(text)
                rows += [(doc, n, c.kind, c.heading, *(c.pages or (None, None)), c.text) for n, c in enumerate(assembled(items, low, high))]
                chars += len(text or "")
                if rows and chars >= BATCH_CHARS:
                    yield batch(rows)
                    rows, chars = [], 0
        if rows:
            yield batch(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), SCHEMA)
