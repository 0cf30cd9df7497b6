"""Recognised words from tab-separated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line of every line of TSV files; quotes have no meaning."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def words(lines: DataFrame, dpi: float = 300) -> DataFrame:
    """lines: any columns and ``line``. Words (level 5) in points: text, box, font_size (the height), conf.

    A negative confidence drops the row, one that isn't a number is null.
    """
    scale = 72.0 / max(dpi, 1.0)
    f = F.split("line", "\t")
    number = lambda i: F.expr(f"try_cast(trim(f[{i}]) AS DOUBLE)")
    d = lines.withColumn("f", f).filter((F.size("f") >= 12) & (F.col("f")[0] == "5"))
    d = d.withColumns({"text": F.regexp_replace(F.col("f")[11], r"(?U)^\s+|\s+$", ""), "conf": number(10), "_l": number(6), "_t": number(7), "_w": number(8), "_h": number(9)})
    d = d.filter((F.col("text") != "") & (F.col("conf").isNull() | (F.col("conf") >= 0)) & F.col("_l").isNotNull() & F.col("_t").isNotNull() & F.col("_w").isNotNull() & F.col("_h").isNotNull())
    keep = [c for c in lines.columns if c != "line"]
    x0, y0 = F.col("_l") * scale, F.col("_t") * scale
    return d.select(*keep, "text", x0.alias("x0"), y0.alias("y0"), ((F.col("_l") + F.col("_w")) * scale).alias("x1"), ((F.col("_t") + F.col("_h")) * scale).alias("y1"), (F.col("_h") * scale).alias("font_size"), "conf", F.lit(False).alias("bold"))
