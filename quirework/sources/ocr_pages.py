"""Whole documents of recognised words: TSV files with a page row for each page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ocr_tsv


def read(spark: SparkSession, path: str, dpi: float = 300) -> tuple[DataFrame, DataFrame]:
    """(words, page sizes) of TSV files; a file is a document, its path the doc_id.

    Words are numbered by their place in the page's blocks, paragraphs and lines. A page
    without a page row is as large as its words reach.
    """
    d = ocr_tsv.read_lines(spark, path).withColumnRenamed("path", "doc_id")
    f = F.split("line", "\t")
    number = lambda i: F.expr(f"try_cast(trim(f[{i}]) AS INT)")
    d = d.withColumn("f", f).filter(F.size("f") >= 12).withColumns({"page_index": number(1) - 1, "_block": number(2), "_par": number(3), "_line": number(4), "_word": number(5)}).filter("page_index IS NOT NULL")
    scale = 72.0 / max(dpi, 1.0)
    given = d.filter(F.col("f")[0] == "1").select("doc_id", "page_index", (number(8) * scale).alias("w"), (number(9) * scale).alias("h"))
    order = F.struct("_block", "_par", "_line", "_word")
    w = ocr_tsv.words(d.withColumn("at", order).select("doc_id", "page_index", "at", "line"), dpi)
    from pyspark.sql import Window

    numbered = w.withColumn("word_no", F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("at", "x0", "y0")) - 1).drop("at")
    reach = numbered.groupBy("doc_id", "page_index").agg(F.max("x1").alias("x"), F.max("y1").alias("y"))
    sizes = given.groupBy("doc_id", "page_index").agg(F.max("w").alias("w"), F.max("h").alias("h")).join(reach, ["doc_id", "page_index"], "full")
    return numbered, sizes.select("doc_id", "page_index", F.coalesce("w", "x").cast("double").alias("width_pt"), F.coalesce("h", "y").cast("double").alias("height_pt"))
