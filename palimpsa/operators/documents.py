"""Documents to blocks and chunks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import windows

#: Ends of sentences and paragraphs, with the white space after them (fixed values of the language).
BOUNDARY = re.compile(r"\n\s*\n|[。！？!?；;]\s*")
#: Starts of sections: Markdown headings and numbered articles; numbered points only where no article is (fixed values).
_NUMERALS = "一二三四五六七八九十百千万零〇两"
_LINE = r"(?m)^[ \t]*(?:\*\*|__)?"
MARKDOWN_HEADING = re.compile(r"(?m)^[ \t]*#{1,6}[ \t]+")
ARTICLE = re.compile(rf"{_LINE}(?:第[{_NUMERALS}\d]+[章节条]|[{_NUMERALS}]+[、．.])")
POINT = re.compile(rf"{_LINE}(?:[（(][{_NUMERALS}\d]+[）)]|\d+[、．.]\s*)")
#: Characters of chunks that a task holds before it passes them on.
OUTPUT = 2 << 20


def fixed_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1800, overlap: int = 200) -> DataFrame:
    return docs.select(F.col(id_col), F.explode(windows(F.col(text_col), size, overlap)).alias("c")).select(
        id_col, "c.ordinal", "c.start", "c.stop", F.col("c.text").alias("chunk")
    )


def section_starts(text: str) -> list[int]:
    """Where sections begin; the text itself begins one."""
    articles = [m.start() for m in ARTICLE.finditer(text)]
    inner = articles or [m.start() for m in POINT.finditer(text)]
    return sorted({0, *inner, *(m.start() for m in MARKDOWN_HEADING.finditer(text))})


def cut_points(text: str, size: int, overlap: int, strategy: str) -> list[tuple[int, int]]:
    """Spans of paragraph or structural chunks; each next one begins ``overlap`` before the end of the last.

    Paragraph chunks end at the last boundary that is more than ``overlap`` behind
    their start; structural ones have a fixed size within a section.
    """
    if not text:
        return []
    if strategy == "structural":
        starts = section_starts(text)
        areas, ends = list(zip(starts, [*starts[1:], len(text)], strict=True)), []
    else:
        areas, ends = [(0, len(text))], [m.end() for m in BOUNDARY.finditer(text)]
    out = []
    for start, stop in areas:
        while start < stop:
            end = min(start + size, stop)
            if end < stop and (k := bisect_right(ends, end)) and ends[k - 1] > start + overlap:
                end = ends[k - 1]
            out.append((start, end))
            start = stop if end == stop else end - overlap
    return out


def chunked(batches: Iterator[pa.RecordBatch], strategy: str, size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """``id, ordinal, start, stop, chunk`` of ``id, text``; one text at a time is a string, and chunks leave at OUTPUT characters."""
    names, types = ["id", "ordinal", "start", "stop", "chunk"], (pa.int32(), pa.int32(), pa.int32(), pa.string())

    def made(ids: pa.Array, rows: list[int], spans: list[tuple]) -> pa.RecordBatch:
        columns = map(pa.array, zip(*spans, strict=True), types)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *columns], names=names)

    for batch in batches:
        rows, spans, held = [], [], 0
        for row, text in enumerate(batch.column(1)):
            text = text.as_py() or ""
            for n, (a, b) in enumerate(cut_points(text, size, overlap, strategy)):
                rows.append(row)
                spans.append((n, a, b, text[a:b]))
                held += b - a
                if held >= OUTPUT:
                    yield made(batch.column(0), rows, spans)
                    rows, spans, held = [], [], 0
        if rows:
            yield made(batch.column(0), rows, spans)


def chunks(docs: DataFrame, id_col: str, text_col: str, strategy: str, size: int = 1800, overlap: int = 200) -> DataFrame:
    """Chunks by ``paragraph`` or ``structural`` boundaries."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        lambda batches: chunked(batches, strategy, size, overlap), f"id {kind}, ordinal int, start int, stop int, chunk string"
    )


def neighbours(chunked: DataFrame, doc: str, order: list[str], hit: DataFrame, key: list[str], radius: int) -> DataFrame:
    """Chunks up to ``radius`` places around each hit of the same document."""
    placed = chunked.withColumn("place", F.row_number().over(W.partitionBy(doc).orderBy(*order)))
    centres = placed.join(hit, key, "left_semi").select(doc, F.col("place").alias("centre"))
    near = placed.join(centres, doc).filter(F.abs(F.col("place") - F.col("centre")) <= radius)
    return near.withColumn("offset", F.col("place") - F.col("centre"))


class _Blocks(HTMLParser):
    """Text blocks of a page; scripts and styles are left out."""

    BREAKS = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "ul", "ol", "title"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.held: list[str] = []
        self.tag, self.hidden = "p", 0

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.blocks.append((self.tag, text))
        self.held = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in self.BREAKS:
            self.flush()
            self.tag = tag

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag in self.BREAKS:
            self.flush()
            self.tag = "p"

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.held.append(data)


def html_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id, ordinal, tag, text`` of the visible blocks of pages."""
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, html in zip(pdf["id"], pdf["html"], strict=True):
                parser = _Blocks()
                parser.feed(html or "")
                parser.close()
                parser.flush()
                rows += [(i, n, tag, text) for n, (tag, text) in enumerate(parser.blocks)]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "tag", "text"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(run, f"id {kind}, ordinal int, tag string, text string")


def markdown_blocks(text: str) -> list[tuple[str, int, int, str, str]]:
    """``(kind, first line, last line, heading path, text)`` of a Markdown text."""
    out, path, held, begin, fence = [], [], [], 0, False
    lines = text.split("\n")

    def flush(end: int, kind: str = "paragraph") -> None:
        if held:
            table = all(x.lstrip().startswith("|") for x in held)
            out.append(("table" if table and kind == "paragraph" else kind, begin, end, " / ".join(p for _, p in path), "\n".join(held)))
            held.clear()

    for n, line in enumerate(lines):
        if line.lstrip().startswith("```"):
            if fence:
                held.append(line)
                flush(n, "code")
            else:
                flush(n - 1)
                begin = n
                held.append(line)
            fence = not fence
        elif fence:
            held.append(line)
        elif line.startswith("#") and (m := re.match(r"(#{1,6})\s+(.*\S)", line)):
            flush(n - 1)
            while path and path[-1][0] >= len(m[1]):
                path.pop()
            path.append((len(m[1]), m[2]))
            out.append(("heading", n, n, " / ".join(p for _, p in path), m[2]))
        elif not line.strip():
            flush(n - 1)
        else:
            if not held:
                begin = n
            held.append(line)
    flush(len(lines) - 1, "code" if fence else "paragraph")
    return out


def marked_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, ordinal, kind, first, last, path, text``: Markdown blocks of each document."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, *b) for i, text in zip(pdf["id"], pdf["text"], strict=True) for n, b in enumerate(markdown_blocks(text or ""))]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "kind", "first", "last", "path", "text"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"id {kind}, ordinal int, kind string, first int, last int, path string, text string"
    )


def table_parts(lines: list[str], size: int) -> tuple[str, list[tuple[int, int, int, int, str]]]:
    """A Markdown table as one text, and its parts ``(start, stop, first row, row after the last, chunk)``.

    A table over ``size`` is cut between rows, and every part repeats the header;
    offsets are those of the part's own rows. A row longer than ``size`` stays whole.
    """
    split = lambda x: re.split(r"(?<!\\)\|", x) if "\\" in x else x.split("|")
    cells = [" | ".join(c.strip() for c in split(x.strip().removeprefix("|").removesuffix("|"))) for x in lines]
    header, rows = cells[0], cells[1:]
    if rows and re.fullmatch(r"[\s|:-]+", lines[1]):
        rows = rows[1:]
    whole = "\n".join([header, *rows])
    if len(whole) <= size or not rows:
        return whole, [(0, len(whole), 0, len(rows), whole)]
    out, first, at = [], 0, len(header) + 1
    while first < len(rows):
        last, used = first + 1, len(header) + 1 + len(rows[first])
        while last < len(rows) and used + 1 + len(rows[last]) <= size:
            used += 1 + len(rows[last])
            last += 1
        body = "\n".join(rows[first:last])
        out.append((at, at + len(body), first, last, f"{header}\n{body}"))
        first, at = last, at + len(body) + 1
    return whole, out


def block_parts(text: str, size: int, overlap: int) -> list[tuple[str, int, int, int | None, int | None, str, str]]:
    """``(kind, start, stop, first row, row after the last, heading path, chunk)`` of a Markdown text.

    Blocks between two tables share paragraph windows; tables have chunks of their
    own. Offsets are those in all blocks joined by an empty line.
    """
    out, at = [], 0
    for is_table, run in groupby(markdown_blocks(text), key=lambda b: b[0] == "table"):
        if is_table:
            for _, _, _, path, body in run:
                whole, parts = table_parts(body.split("\n"), size)
                out += [("table", at + a, at + b, i, j, path, chunk) for a, b, i, j, chunk in parts]
                at += len(whole) + 2
            continue
        pieces, begins, paths, held = [], [], [], 0
        for kind, first, _, path, body in run:
            line = text.split("\n", first + 1)[first] if kind == "heading" else ""
            pieces.append(line[: len(line) - len(line.lstrip("#"))] + " " + body if line else body)
            begins.append(held)
            paths.append(path)
            held += len(pieces[-1]) + 2
        prose = "\n\n".join(pieces)
        for a, b in cut_points(prose, size, overlap, "paragraph"):
            out.append(("prose", at + a, at + b, None, None, paths[bisect_right(begins, a) - 1], prose[a:b]))
        at += len(prose) + 2
    return out


def block_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1800, overlap: int = 200) -> DataFrame:
    """``id, ordinal, kind, start, stop, first_row, row_stop, path, chunk``: block-aware chunks of Markdown documents.

    Null and empty texts have no chunks.
    """
    kind = dict(docs.dtypes)[id_col]
    names = ["id", "ordinal", "kind", "start", "stop", "first_row", "row_stop", "path", "chunk"]
    types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())

    def made(ids: pa.Array, rows: list[int], parts: list[tuple]) -> pa.RecordBatch:
        columns = map(pa.array, zip(*parts, strict=True), types)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, held = [], [], 0
            for row, text in enumerate(batch.column(1)):
                for n, part in enumerate(block_parts(text.as_py() or "", size, overlap)):
                    rows.append(row)
                    parts.append((n, *part))
                    held += len(part[-1])
                    if held >= OUTPUT:
                        yield made(batch.column(0), rows, parts)
                        rows, parts, held = [], [], 0
            if rows:
                yield made(batch.column(0), rows, parts)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, ordinal int, kind string, start int, stop int, first_row int, row_stop int, path string, chunk string"
    )


def located(text: str, evidence: str) -> tuple[int, int, str] | None:
    """Span of an evidence in a text, exactly or apart from white space."""
    at = text.find(evidence)
    if evidence and at >= 0:
        return at, at + len(evidence), "exact"
    pattern = r"\s*".join(re.escape(c) for c in "".join(evidence.split()))
    m = re.search(pattern, text) if pattern else None
    return (m.start(), m.end(), "whitespace") if m else None
