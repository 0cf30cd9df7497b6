"""Which reader an input path gets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKDOWN = ("md", "markdown", "mdown", "mkd")


def input_kind(path: Column) -> Column:
    """Pdf or Markdown by the lower-cased extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "pdf", "Pdf").when(ext.isin(*MARKDOWN), "Markdown")
