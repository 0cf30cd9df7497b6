"""Glyphs to words.

Filters and page statistics are column expressions; only the fold itself, whose state
is the left edge of the word being built, runs page by page in Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORDS = "doc_id string, page_index int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, conf double, bold boolean"


def usable_glyphs(glyphs: DataFrame) -> DataFrame:
    """Without control characters (but U+0002), and without the marks that a synthesised layer leaves."""
    blank = F.col("ch").rlike(r"(?U)^\s$")
    control = F.col("ch").rlike(r"^[\p{Cc}&&[^\x02]]$")
    phantom = ((F.col("x1") - F.col("x0")) < 0.1) | ((F.col("y1") - F.col("y0")) < 0.5)
    return glyphs.withColumn("blank", blank).filter(~control & (F.col("blank") | ((F.col("size") > 1.0) & ~phantom)))


def with_gap_limit(glyphs: DataFrame) -> DataFrame:
    """Adds the page's median size and the gap that ends a word; narrow where the page's spaces are missing."""
    page = Window.partitionBy("doc_id", "page_index")
    med = F.greatest(F.coalesce(F.median(F.when(~F.col("blank"), F.col("size"))).over(page), F.lit(0.0)), F.lit(1.0))
    missing = F.count_if(F.col("blank")).over(page) * 12 < F.count_if(~F.col("blank")).over(page)
    return glyphs.withColumn("med", med).withColumn("gap_limit", F.col("med") * F.when(missing, 0.28).otherwise(1.1))


def fold_page(page: pd.DataFrame) -> pd.DataFrame:
    """Words of one page's glyphs, in glyph order."""
    page = page.sort_values("glyph_no")
    out, word, before = [], [], None

    def close():
        if word and "".join(g.ch for g in word).strip():
            out.append(("".join(g.ch for g in word), min(g.x0 for g in word), min(g.y0 for g in word), max(g.x1 for g in word), max(g.y1 for g in word), float(np.median([g.size for g in word])), 2 * sum(g.bold for g in word) > len(word)))
        word.clear()

    def band(g):
        half, middle = max(g.size * 0.6, 0.5), (g.y0 + g.y1) / 2
        return middle - half, middle + half

    for g in page.itertuples():
        if g.blank:
            close()
        else:
            if before is not None:
                (a0, a1), (b0, b1) = band(g), band(before)
                apart = min(a1, b1) - max(a0, b0) < 0.4 * max(min(a1 - a0, b1 - b0), 0.1)
                back = bool(word) and g.x0 < min(w.x0 for w in word) - 0.5 * g.med
                if apart or back or g.x0 - before.x1 > g.gap_limit:
                    close()
            word.append(g)
        before = g
    close()
    rows = [(page.doc_id.iloc[0], page.page_index.iloc[0], i, t, x0, y0, x1, y1, fs, None, b) for i, (t, x0, y0, x1, y1, fs, b) in enumerate(out)]
    return pd.DataFrame(rows, columns=["doc_id", "page_index", "word_no", "text", "x0", "y0", "x1", "y1", "font_size", "conf", "bold"])


def glyphs_to_words(glyphs: DataFrame) -> DataFrame:
    """glyphs: doc_id, page_index, glyph_no, ch, x0, y0, x1, y1, size, bold."""
    return with_gap_limit(usable_glyphs(glyphs)).groupBy("doc_id", "page_index").applyInPandas(fold_page, WORDS)
