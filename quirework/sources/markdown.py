"""Markdown documents to metadata and spans. One row in, its spans out; the parse is a scan of lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "doc_id string, block_no int, span_no int, kind string, level int, text string, label string"
MARK = re.compile(r"<!--(.*?)-->", re.S)
FIELDS = {"title": "title", "author": "author", "language": "language", "lang": "language", "source": "source", "pages": "pages", "generator": "generator"}


class MarkdownError(ValueError):
    pass


def unquote(text: str) -> str:
    t = text.strip()
    return t[1:-1].replace('\\"', '"').replace("\\\\", "\\") if len(t) >= 2 and t[0] == t[-1] == '"' else t


def front_matter(lines: list[str]) -> tuple[dict, list[str]]:
    """(metadata, the lines after it)."""
    meta = {"title": "", "author": None, "language": "", "source": None, "pages": None, "generator": None}
    if lines and lines[0].strip() == "---":
        end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
        if end is None:
            raise MarkdownError("line 1: front matter opened with `---` but never closed")
        for key, sep, value in (x.partition(":") for x in lines[1:end]):
            if sep and (name := FIELDS.get(key.strip().lower())):
                meta[name] = unquote(value)
        lines = lines[end + 1 :]
    if meta["pages"] is not None:
        meta["pages"] = int(meta["pages"]) if re.fullmatch(r"\+?\d+", meta["pages"]) else None
    meta["title"] = meta["title"] if meta["title"].strip() else "Untitled"
    meta["language"] = meta["language"] if meta["language"].strip() else "und"
    return meta, lines


def is_separator(line: str) -> bool:
    return re.fullmatch(r"\*{3,}|-{3,}|_{3,}", re.sub(r"\s", "", line)) is not None


def emphasis(text: str) -> list[tuple]:
    """Text and emphasis spans of a run without markers."""
    text, out = text.replace("\\#", "#"), []
    while (m := re.search(r"\*([^*]*)\*", text)) and m[1] and "\n" not in m[1]:
        out += [("text", None, text[: m.start()], None)] * bool(m.start()) + [("emphasis", None, m[1], None)]
        text = text[m.end() :]
    return out + [("text", None, text, None)] * bool(text)


def inline(text: str) -> list[tuple]:
    """Spans (kind, level, text, label) of a paragraph; a comment that isn't a page marker ends the search for markers."""
    out, at = [], 0
    for m in MARK.finditer(text):
        if not (label := re.fullmatch(r"\s*page:(.*)", m[1], re.S)):
            break
        out += emphasis(text[at : m.start()]) + [("page_break", None, None, label[1].strip())]
        at = m.end()
    return out + emphasis(text[at:])


def parse(markdown: str) -> tuple[dict, list[list[tuple]]]:
    """(metadata, blocks as lists of spans)."""
    meta, lines = front_matter(re.split(r"\r?\n", markdown))
    blocks: list[list[tuple]] = []
    run: list[str] = []

    def close():
        spans = inline(" ".join(run)) if run else []
        run.clear()
        if spans and all(s[0] == "page_break" for s in spans):
            blocks.extend([s] for s in spans)
        elif any(s[0] != "page_break" and s[2].strip() for s in spans):
            blocks.append(spans)

    i = 0
    while i < len(lines):
        line, under = lines[i].strip(), lines[i + 1].strip() if i + 1 < len(lines) else ""
        i += 1
        if not line:
            close()
        elif m := re.match(r"(#{1,6})(?: (.*)|$)", line):
            close()
            blocks.append([("heading", len(m[1]), (m[2] or "").strip().rstrip("#").strip(), None)])
        elif not run and re.fullmatch("={2,}", under):
            blocks.append([("heading", 1, line, None)])
            i += 1
        elif not run and re.fullmatch("-{2,}", under) and not is_separator(line):
            blocks.append([("heading", 2, line, None)])
            i += 1
        elif is_separator(line):
            close()
            blocks.append([("separator", None, None, None)])
        else:
            run.append(line)
    close()
    return meta, blocks


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), markdown of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("markdown"))


def spans(documents: DataFrame) -> DataFrame:
    """doc_id, block_no, span_no, kind, level, text, label. documents: doc_id, markdown."""

    def each(batches):
        for pdf in batches:
            rows = [(d, b, s, *span) for d, md in zip(pdf.doc_id, pdf.markdown) for b, block in enumerate(parse(md or "")[1]) for s, span in enumerate(block)]
            out = pd.DataFrame(rows, columns=["doc_id", "block_no", "span_no", "kind", "level", "text", "label"])
            yield out.astype({"level": "Int32"})

    return documents.select("doc_id", "markdown").mapInPandas(each, SPANS)


def metadata(documents: DataFrame) -> DataFrame:
    """doc_id, title, author, language, source, pages, generator."""

    def each(batches):
        for pdf in batches:
            rows = [(d, *(m := front_matter(re.split(r"\r?\n", md or ""))[0]).values()) for d, md in zip(pdf.doc_id, pdf.markdown)]
            yield pd.DataFrame(rows, columns=["doc_id", "title", "author", "language", "source", "pages", "generator"]).astype({"pages": "Int32"})

    return documents.select("doc_id", "markdown").mapInPandas(each, "doc_id string, title string, author string, language string, source string, pages int, generator string")
