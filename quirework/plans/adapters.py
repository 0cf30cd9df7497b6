"""Tables of the driver's data in this domain's shapes.

Geometry made here is invented by arithmetic (names start with ``syn``): it says
nothing about real pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_WORDS, PAGE_LINES = 10, 6
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, line_no, text of every line of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def book_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source as a book, its documents as pages: doc_id (the source), page_index, line_no, text, signature."""
    from ..functions import text as T

    d = document_lines(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_index"), "line_no", "text")
    return d.withColumn("signature", T.signature("text"))


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("doc_id")).agg(F.count_distinct("doc_id").alias("n_pages"))


def wrapped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books: doc_id, page_index, line_no (of the page), i (of the line), text; 10 words a line, 6 lines a page."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"\s+")).alias("pos", "text")).filter("text <> ''")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "pos")) - 1
    d = words.withColumn("n", n)
    return d.select(
        F.col("conv_id").cast("string").alias("doc_id"), F.floor(F.col("n") / (LINE_WORDS * PAGE_LINES)).cast("int").alias("page_index"),
        (F.floor(F.col("n") / LINE_WORDS) % PAGE_LINES).cast("int").alias("line_no"), (F.col("n") % LINE_WORDS).cast("int").alias("i"), "text",
    )


def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_index, line_no, text, first_word, last_word."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"])
    d = wrapped_words(spark, sf_dir).groupBy("doc_id", "page_index", "line_no").agg(ordered.alias("w"))
    return d.select("doc_id", "page_index", "line_no", F.array_join("w", " ").alias("text"), F.element_at("w", 1).alias("first_word"), F.element_at("w", -1).alias("last_word"))


def wrapped_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(items: one paragraph a page; pages) of the wrapped conversations."""
    from ..functions import text as T
    from ..operators.paragraphs import joined_text

    lines = wrapped_lines(spark, sf_dir)
    pages = lines.groupBy("doc_id", "page_index").agg(F.count("*").cast("int").alias("n_lines"))
    items = joined_text(lines, ["doc_id", "page_index"]).select(
        "doc_id", "page_index", F.lit(0).alias("item_no"), F.lit("para").alias("kind"), F.lit(None).cast("int").alias("level"), "text", F.lit(False).alias("starts_indented"),
        T.ends_sentence("text").alias("ends_sentence"), F.lit(False).alias("ends_hyphenated"),
    )
    return items, pages.withColumn("label", (F.col("page_index") + 1).cast("string"))


def syn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of wrapped pages with boxes by character offset; odd pages have a second column, every third line an indent."""
    w = Window.partitionBy("doc_id", "page_index", "line_no").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    d = wrapped_words(spark, sf_dir).withColumn("o", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))
    two = (F.col("page_index") % 2 == 1) & (F.col("i") >= 5)
    x0 = (36 + 3 * F.col("o") + F.when(two, 150).otherwise(0) + F.when(F.col("line_no") % 3 == 0, 9).otherwise(0)).cast("double")
    y0 = (72 + 14 * F.col("line_no") + F.when(F.col("line_no") >= 4, 10).otherwise(0)).cast("double")
    return d.select(
        "doc_id", "page_index", (F.col("line_no") * LINE_WORDS + F.col("i")).alias("word_no"), "line_no", "text", x0.alias("x0"), y0.alias("y0"), (x0 + 3 * F.length("text")).alias("x1"), (y0 + 12).alias("y1"),
        F.lit(12.0).alias("font_size"), F.lit(None).cast("double").alias("conf"), (F.col("line_no") == 0).alias("bold"), F.lit(PAGE_WIDTH).alias("width_pt"), F.lit(PAGE_HEIGHT).alias("height_pt"),
    )


def syn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the invented pages as one column a page."""
    d = syn_words(spark, sf_dir).groupBy("doc_id", "page_index", "line_no").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.median("font_size").alias("font_size"), (2 * F.count_if("bold") > F.count("*")).alias("bold"), F.count("*").cast("int").alias("n_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ").alias("text"), F.min_by("text", "word_no").alias("first_word"), F.max_by("text", "word_no").alias("last_word"),
    )
    return d.withColumns({"column_no": F.lit(0), "conf": F.lit(None).cast("double")})


def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty parts a column: four times a short line (bold, centred, a chapter's label or small print) and four full ones."""
    d = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    i = (F.col("k") % 20).cast("int")
    d = d.withColumns({"doc_id": F.expr("CAST(k div 20 AS STRING)"), "line_no": i, "block": F.floor(i / 5).cast("int"), "j": i % 5})
    kind = F.when(F.col("j") > 0, -1).otherwise((F.expr("k div 20") + F.col("block")) % 4)
    d = d.withColumn("kind", kind.cast("int"))
    x0 = F.when(F.col("kind").isin(1, 2, 3), 200.0).otherwise(30.0)
    x1 = F.when(F.col("kind") == 0, 150.0).when(F.col("kind").isin(1, 2, 3), 300.0).otherwise(470.0)
    y0 = (100 + 20 * F.col("line_no") + 30 * F.col("block") + F.when(F.col("j") > 0, 12).otherwise(0)).cast("double")
    text = F.when(F.col("kind") == 2, F.concat(F.lit("Chapter "), F.col("p_partkey"))).otherwise(F.col("p_name"))
    words = F.split(text, " ")
    return d.select(
        "doc_id", F.lit(0).alias("page_index"), F.lit(0).alias("column_no"), "line_no", text.alias("text"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 12).alias("y1"), F.when(F.col("kind") == 3, 8.0).otherwise(12.0).alias("font_size"),
        (F.col("kind") == 0).alias("bold"), F.lit(None).cast("double").alias("conf"), F.element_at(words, 1).alias("first_word"), F.element_at(words, -1).alias("last_word"),
    )


def furnished_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty parts a book of five pages: a header, body, a page number; a rule on each second page, a note in the margin on each third."""
    d = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    d = d.withColumns({"doc_id": F.expr("CAST(k div 60 AS STRING)"), "page_index": F.expr("CAST((k % 60) div 12 AS INT)"), "line_no": (F.col("k") % 12).cast("int")})
    n, page = F.col("line_no"), F.col("page_index")
    kind = F.when(n == 0, "header").when(n == 11, "number").when((n == 1) & (page == 1), "rule").when((n == 10) & (page == 2), "note").otherwise("body")
    d = d.withColumn("kind", kind)
    pick = lambda header, number, rule, note, body: F.when(F.col("kind") == "header", header).when(F.col("kind") == "number", number).when(F.col("kind") == "rule", rule).when(F.col("kind") == "note", note).otherwise(body)
    text = pick(F.lit("The Running Title of a Book"), (page + 41).cast("string"), F.lit("_"), F.lit("note"), F.col("p_name"))
    y0 = pick(F.lit(30.0), F.lit(780.0), F.lit(100.0), F.lit(50.0), (150 + 20 * n).cast("double"))
    lit = lambda *v: pick(*map(F.lit, v))
    d = d.select(
        "doc_id", "page_index", "line_no", text.alias("text"), lit(60.0, 290.0, 60.0, 2.0, 60.0).alias("x0"), y0.alias("y0"), lit(300.0, 310.0, 540.0, 20.0, 540.0).alias("x1"),
        (y0 + F.when(F.col("kind") == "rule", 1).otherwise(12)).alias("y1"), F.lit(600.0).alias("width_pt"), F.lit(800.0).alias("height_pt"),
    )
    return d.join(d.groupBy("doc_id").agg(F.count_distinct("page_index").alias("n_pages")), "doc_id")


def name_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of part names as glyphs of pages of ten names; some tiny, some without width, some control characters."""
    d = table(spark, sf_dir, "part").select(F.col("p_partkey"), F.posexplode(F.split(F.col("p_name"), "")).alias("i", "ch")).filter("ch <> ''")
    no = F.col("p_partkey") * 1000 + F.col("i")
    ch = F.when(no % 17 == 0, F.lit("\u0002")).when(no % 19 == 0, F.lit("\u0001")).otherwise(F.col("ch"))
    x0 = (6.0 * F.col("i")).cast("double")
    y0 = (20.0 * (F.col("p_partkey") % 10)).cast("double")
    return d.select(
        F.expr("CAST(p_partkey div 10 AS STRING)").alias("doc_id"), F.lit(0).alias("page_index"), no.alias("glyph_no"), ch.alias("ch"), x0.alias("x0"), y0.alias("y0"), (x0 + F.when(no % 13 == 0, 0.0).otherwise(5.0)).alias("x1"), (y0 + 10).alias("y1"),
        F.when(no % 11 == 0, 1.0).otherwise(8.0 + F.col("p_partkey") % 3).cast("double").alias("size"), (F.col("p_partkey") % 2 == 0).alias("bold"),
    )
