"""Parsing raw files into elements: routing by type, HTML, Markdown, CSV and plain text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ordered import last_seen

#: File types by extension.
TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "doc": "application/msword",
    "ppt": "application/vnd.ms-powerpoint",
    "xls": "application/vnd.ms-excel",
    "html": "text/html",
    "htm": "text/html",
    "md": "text/markdown",
    "csv": "text/csv",
    "adoc": "text/asciidoc",
    "txt": "text/plain",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "bmp": "image/bmp",
    "gif": "image/gif",
    "webp": "image/webp",
}
ELEMENT = "path string, element_order int, element_type string, heading_level int, section_path string, content_text string"


def mime_type(name: Column) -> Column:
    """Type of a file by its name's extension, whatever its case; octet-stream if unknown."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv)), ext), F.lit("application/octet-stream"))


def route(mime: Column) -> Column:
    """Which parser takes a type: the converter for all known types but plain text, an extractor by kind for others (pdf, word, image, text), or none."""
    converted = sorted(set(TYPES.values()) - {"text/plain"})
    legacy = F.when(mime.contains("pdf"), "pdf").when(mime.contains("wordprocessingml") | mime.contains("msword"), "word").when(mime.contains("image"), "image").when(mime.contains("text"), "text")
    return F.when(mime.isin(*converted), "converter").otherwise(F.coalesce(legacy, F.lit("none")))


class _Html(HTMLParser):
    BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 td th pre blockquote div".split())

    def __init__(self) -> None:
        super().__init__()
        self.out: list[tuple[str, int | None, str]] = []
        self.tag, self.text, self.row, self.rows, self.skip = "p", "", [], [], 0

    def flush(self) -> None:
        t = " ".join(self.text.split())
        if t:
            level = int(self.tag[1]) if self.tag[0] == "h" and self.tag[1:].isdigit() else None
            if self.tag in ("td", "th"):
                self.row.append(t)
            else:
                self.out.append(("heading" if level else "text", level, t))
        self.text = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        if tag in self.BLOCKS:
            self.flush()
            self.tag = tag
        if tag == "img":
            self.flush()
            self.out.append(("image", None, dict(attrs).get("alt") or ""))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag in self.BLOCKS:
            self.flush()
            self.tag = "p"
        if tag == "tr" and self.row:
            self.rows.append(" | ".join(self.row))
            self.row = []
        if tag == "table" and self.rows:
            self.out.append(("table", None, "\n".join(self.rows)))
            self.rows = []

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text += data


def html_elements(text: str) -> list[tuple[str, int | None, str]]:
    p = _Html()
    p.feed(text)
    p.close()
    p.flush()
    return p.out


def markdown_elements(text: str, ascii_doc: bool = False) -> list[tuple[str, int | None, str]]:
    out: list[tuple[str, int | None, str]] = []
    for block in text.split("\n\n"):
        b = block.strip()
        if not b:
            continue
        lines = b.split("\n")
        sign = "=" if ascii_doc else "#"
        mark = len(lines[0]) - len(lines[0].lstrip(sign))
        if b == "<!-- image -->":
            out.append(("image", None, ""))
        elif 0 < mark < 7 and lines[0][mark : mark + 1] == " ":
            out.append(("heading", mark, lines[0][mark:].strip()))
            if len(lines) > 1:
                out.append(("text", None, "\n".join(lines[1:])))
        elif b.startswith("$$") and b.endswith("$$"):
            out.append(("equation", None, b))
        elif len(lines) > 1 and all("|" in x for x in lines):
            out.append(("table", None, b))
        else:
            out.append(("text", None, b))
    return out


def with_sections(rows: list[tuple[str, int | None, str]]) -> list[tuple[int, str, int | None, str | None, str]]:
    """(order, type, level, section path, text): headings open a section that ends at the next heading of its level or above."""
    stack: list[tuple[int, str]] = []
    out = []
    for i, (kind, level, text) in enumerate(rows):
        if kind == "heading" and level:
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, text))
        out.append((i, kind, level, " > ".join(t for _, t in stack) or None, text))
    return out


def decode(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def parse(files: DataFrame) -> DataFrame:
    """Elements of files (path string, content binary), in their order; types without a parser here give none.

    Text is read as UTF-8, else as Latin-1. Empty files have no elements.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                text, ext = decode(bytes(content or b"")), path.rsplit(".", 1)[-1].lower()
                if ext in ("html", "htm"):
                    found = html_elements(text)
                elif ext == "csv":
                    import csv

                    found = [("table", None, "\n".join(" | ".join(c.strip() for c in r) for r in csv.reader(text.splitlines())))] if text.strip() else []
                elif ext in ("md", "txt", "adoc"):
                    found = markdown_elements(text, ext == "adoc")
                else:
                    found = []
                rows += [(path, *r) for r in with_sections(found)]
            out = pd.DataFrame(rows, columns=["path", "element_order", "element_type", "heading_level", "section_path", "content_text"])
            yield out.astype({"element_order": "Int32", "heading_level": "Int32"})

    return files.select("path", "content").mapInPandas(run, ELEMENT)


def section_paths(elements: DataFrame, levels: int = 6) -> DataFrame:
    """`elements` (document_id, element_order, id, element_type, heading_level, content_text) with `path`: the headings above each, by level, its own included.

    A heading ends those of its level and below. Level by level the last heading
    counts if none of a higher level came after it, so a document is cut into
    spans like any running value. Null levels count as 1, levels beyond `levels`
    as that.
    """
    level = F.least(F.greatest(F.coalesce("heading_level", F.lit(1)), F.lit(1)), F.lit(levels))
    out = elements.withColumn("__l", F.when(F.col("element_type") == "heading", level))
    place = F.struct(F.coalesce("element_order", F.lit(0)).alias("o"), "id", F.col("content_text").alias("t"))
    out = last_seen(out, ["document_id"], "element_order", ["id"], {f"__h{k}": F.when(F.col("__l") == k, place) for k in range(1, levels + 1)})
    open_, above = [], None
    for k in range(1, levels + 1):
        h = F.col(f"__h{k}")
        at = F.struct(h["o"].alias("o"), h["id"].alias("id"))
        open_.append(F.when(h.isNotNull() & (F.lit(True) if above is None else F.coalesce(at > above, F.lit(True))), h["t"]))
        high = F.when(h.isNotNull(), at)
        above = high if above is None else F.greatest(above, high)
    path = F.array_join(F.filter(F.array(*open_), lambda x: x.isNotNull()), " > ")
    return out.withColumn("path", F.nullif(path, F.lit(""))).drop("__l", *(f"__h{k}" for k in range(1, levels + 1)))
