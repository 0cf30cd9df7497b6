"""A conversion's results as files, for a few documents on one machine."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from ..operators import assemble
from . import epub, markdown, report


def stem(doc_id: str) -> str:
    return os.path.splitext(os.path.basename(doc_id.removeprefix("file:")))[0]


def write(conversion, config, folder: str, with_report: bool = False) -> tuple[list[str], list[str]]:
    """(files, warnings): <stem>.md, .proofread.md, .epub, .mobi, .azw3 and .json of every document, and one report.md.

    A Kindle format is made of an EPUB, which stays only if it is asked for; a failed
    conversion to it is a warning.
    """
    os.makedirs(folder, exist_ok=True)
    made, files, warnings = conversion.outputs(config), [], []
    if "md" in made:
        proofread = ".proofread" if conversion.corrections is not None else ""
        files += markdown.write_files(made["md"], folder, lambda d: stem(d) + proofread)
    kindle = [k for k in ("mobi", "azw3") if k in config.formats]
    for row in made["epub"].select("doc_id", "epub").toLocalIterator() if "epub" in made else ():
        target = os.path.join(folder, f"{stem(row.doc_id)}.epub")
        if "epub" in config.formats:
            with open(target, "wb") as f:
                f.write(bytes(row.epub))
            files.append(target)
        for kind in kindle:
            out = os.path.join(folder, f"{stem(row.doc_id)}.{kind}")
            try:
                with tempfile.TemporaryDirectory() as own:
                    source = os.path.join(own, f"{stem(row.doc_id)}.epub")
                    with open(source, "wb") as f:
                        f.write(bytes(row.epub))
                    epub.to_kindle(source, out, kind)
                files.append(out)
            except (RuntimeError, OSError) as e:
                warnings.append(f"no {kind} of {stem(row.doc_id)}: {e}")
    for row in made["json"].orderBy("doc_id", "page_index").toLocalIterator() if "json" in made else ():
        target = os.path.join(folder, f"{stem(row.doc_id)}.json")
        first = target not in files
        with open(target, "w" if first else "a", encoding="utf-8") as f:
            f.write(row.layout + "\n")
        if first:
            files.append(target)
    if with_report:
        counts = assemble.document_counts(conversion.spans).agg(*[F.sum(c).alias(c) for c in ("paragraphs", "headings", "page_breaks", "chars")]).first().asDict()
        dropped = conversion.dropped
        if dropped is None:
            dropped = conversion.spans.sparkSession.createDataFrame([], "text string, reason string, n long")
        else:
            dropped = dropped.groupBy("text", "reason").agg(F.count("*").alias("n"))
        target = os.path.join(folder, "report.md")
        with open(target, "w", encoding="utf-8") as f:
            f.write(report.render(counts, dropped, conversion.corrections, conversion.joins, warnings=warnings, files=files))
        files.append(target)
    return files, warnings
