"""Registered queries of the document-reconstruction operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import stats as ST
from ..functions import text as T
from ..functions.stats import column_stats
from ..operators import assemble, chrome, columns, correct, lines, metadata, pages, paragraphs, words
from ..sinks import epub, markdown
from ..sources import markdown as markdown_source
from ..sources import ocr_tsv
from . import adapters as A
from .config import Config
from .convert import from_words
from .oracle import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The sources' lines repeat on fewer pages than a book's headers do.
BOOK_SHARE = 0.10


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def normalise_spaces(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", T.normalise_spaces(F.replace("text", F.lit(", "), F.lit("  , "))).alias("clean"))


@query
def line_signature(spark, sf):
    return A.document_lines(spark, sf).select("doc_id", "line_no", T.signature("text").alias("signature"))


def _repeated(spark, sf):
    s = A.book_signatures(spark, sf).filter(F.octet_length("signature") >= T.SIGNATURE_BYTES)
    return chrome.exact_repeats(s, A.book_pages(spark, sf), BOOK_SHARE)


@query
def repeated_lines(spark, sf):
    return _repeated(spark, sf).select(F.col("doc_id").alias("source"), "signature", "n")


@query
def fuzzy_repeated_lines(spark, sf):
    s = A.book_signatures(spark, sf).filter(F.octet_length("signature") >= T.SIGNATURE_BYTES)
    return chrome.fuzzy_repeats(s, A.book_pages(spark, sf), BOOK_SHARE).select(F.col("doc_id").alias("source"), "signature", "n")


@query
def drop_repeated_lines(spark, sf):
    s = A.book_signatures(spark, sf)
    again = _repeated(spark, sf).select("doc_id", "signature", F.lit(True).alias("dropped"))
    return s.join(again, ["doc_id", "signature"], "left").select(F.col("page_index").alias("doc_id"), "line_no", F.coalesce("dropped", F.lit(False)).alias("dropped"))


@query
def dropped_summary_topk(spark, sf):
    s = A.book_signatures(spark, sf)
    gone = s.join(_repeated(spark, sf), ["doc_id", "signature"], "left_semi")
    number = T.page_number("text").isNotNull()
    return chrome.dropped_summary(gone.select("text", F.when(number, "PageNumber").otherwise("RunningHeader").alias("reason")), 30)


@query
def page_number_lines(spark, sf):
    i = F.col("doc_id")
    text = F.when(i % 5 == 0, F.concat(F.lit("- "), i, F.lit(" -"))).when(i % 5 == 1, F.concat(F.lit("page "), i)).when(i % 5 == 2, F.concat(F.lit("·"), i, F.lit("....."))).when(i % 5 == 3, F.concat(F.lit(" "), i + 99000, F.lit(" "))).otherwise(F.lit("*"))
    return A.table(spark, sf, "documents").select("doc_id", T.page_number(text).alias("label"))


@query
def sentence_end_flags(spark, sf):
    return A.document_lines(spark, sf).select("doc_id", "line_no", T.ends_sentence("text").alias("ends_sentence"))


@query
def suspicious_lines(spark, sf):
    return A.document_lines(spark, sf).select("doc_id", "line_no", T.suspicious("text").alias("suspicious"))


@query
def chapter_labels(spark, sf):
    k, name = F.col("p_partkey"), F.col("p_name")
    text = F.when(k % 6 == 0, F.concat(F.lit("Chapter "), name)).when(k % 6 == 1, F.lit("XIV.")).when(k % 6 == 2, F.concat(k, F.lit(" -"))).when(k % 6 == 3, F.concat(F.lit("  Bölüm "), k)).when(k % 6 == 4, F.repeat(name, F.lit(9))).otherwise(name)
    return A.table(spark, sf, "part").select("p_partkey", T.chapter_label(text).alias("is_label"))


@query
def separator_lines(spark, sf):
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, "* * *").when(k % 5 == 1, "--").when(k % 5 == 2, " _ __ ").when(k % 5 == 3, "-*-").otherwise(F.repeat(F.lit("-"), k.cast("int") % 7))
    return A.table(spark, sf, "part").select("p_partkey", T.separator_line(text).alias("is_separator"))


@query
def hyphen_kinds(spark, sf):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat("p_name", F.lit("-"))).when(k % 4 == 1, F.concat("p_name", F.lit("¬"))).when(k % 4 == 2, F.concat("p_name", F.lit("‐"))).otherwise(F.col("p_name"))
    return A.table(spark, sf, "part").select("p_partkey", T.hyphen_kind(text).alias("kind"))


def _pairs(d):
    t, k = F.col("text"), F.col("doc_id") % 6
    edited = (
        F.when(k == 0, t).when(k == 1, F.concat(F.lit("zz"), F.substr(t, F.lit(3)))).when(k == 2, F.concat(t, F.lit(" and more"))).when(k == 3, F.expr("left(text, length(text) div 2)"))
        .when(k == 4, F.concat(F.lit("new words at the start, "), F.substr(t, F.lit(2)))).otherwise(F.reverse(t))
    )
    return d.withColumn("edited", edited)


@query
def drift_reasons(spark, sf):
    """Lines where DuckDB's distance, which is by bytes, agrees with ours; drift_reasons_all_lines has all."""
    d = A.document_lines(spark, sf).filter((F.octet_length("text") == F.length("text")) & (F.length("text") >= 20))
    return _pairs(d).select("doc_id", "line_no", T.drift_reason("text", "edited").alias("reason"))


@query
def drift_reasons_all_lines(spark, sf):
    return _pairs(A.document_lines(spark, sf)).select("doc_id", "line_no", T.drift_reason("text", "edited").alias("reason"))


@query
def markup_functions(spark, sf):
    d = A.document_lines(spark, sf)
    t = F.concat(F.when(F.col("line_no") % 3 == 0, F.lit("# ")).when(F.col("line_no") % 3 == 1, F.lit('"<&')).otherwise(F.lit("")), F.col("text"))
    return d.select("doc_id", "line_no", T.escape_inline(t).alias("inline"), T.escape_xml(t).alias("xml"), T.yaml_scalar(t).alias("yaml"), T.short(t).alias("short"), T.sanitise_id(F.concat(F.col("doc_id"), F.lit("-"), F.col("source"))).alias("id"), T.page_marker(F.col("doc_id").cast("string")).alias("marker"))


@query
def text_line_stats(spark, sf):
    return A.document_lines(spark, sf).groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.max(F.length("text")).alias("longest"), F.count_distinct("doc_id").alias("pages"))


@query
def page_decisions(spark, sf):
    n = F.when(F.col("doc_id") % 10 == 0, F.lit(0)).otherwise(F.col("n_chars"))
    return A.table(spark, sf, "documents").select("doc_id", *[pages.decision(n, m).alias(m) for m in ("auto", "always", "never")], pages.ocr_wins(n, F.col("doc_id")).alias("ocr_wins"))


@query
def page_range_scan(spark, sf):
    d = A.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"))
    return pages.page_range(d, 2, 5)


@query
def language_lookup(spark, sf):
    code = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "fr", "fra").when(F.col("lang") == "de", "deu").otherwise("xxx")
    d = A.table(spark, sf, "documents").select("doc_id", code.alias("code"))
    return metadata.with_language(d, "code").select("doc_id", "language_label", "language")


@query
def cropped_words(spark, sf):
    inside, gone = pages.cropped(A.syn_words(spark, sf), top=0.10, left=0.1)
    kept = inside.groupBy("doc_id", "page_index").agg(F.count("*").alias("kept"))
    return gone.select("doc_id", "page_index", F.col("n").alias("dropped")).join(kept, ["doc_id", "page_index"], "full").fillna(0, ["dropped", "kept"])


@query
def syn_words(spark, sf):
    return A.syn_words(spark, sf).select("doc_id", "page_index", "word_no", "text", "x0", "y0", "x1", "y1")


@query
def syn_line_bbox(spark, sf):
    return A.syn_lines(spark, sf).select("doc_id", "page_index", "line_no", "x0", "y0", "x1", "y1", "bold", "n_words", "first_word", "last_word")


@query
def syn_column_stats(spark, sf):
    keys = ["doc_id", "page_index", "column_no"]
    s = column_stats(A.syn_lines(spark, sf), keys)
    return s.select("doc_id", "page_index", "column_font", F.round("margin", 6).alias("margin"), "right_edge", "leading")


@query
def syn_row_occupancy(spark, sf):
    return columns.row_occupancy(A.syn_words(spark, sf))


@query
def syn_candidate_gutters(spark, sf):
    return columns.candidate_gutters(A.syn_words(spark, sf)).withColumn("gutter", F.round("gutter", 4))


@query
def syn_column_plan(spark, sf):
    w = A.syn_words(spark, sf)
    return columns.column_plan(columns.candidate_gutters(w), w).select("doc_id", "count", F.array_join(F.transform("positions", lambda x: F.round(x, 3).cast("string")), ",").alias("positions"))


@query
def syn_column_assign(spark, sf):
    w = A.syn_words(spark, sf)
    kept, _ = columns.split_columns(w, columns.page_gutters(w))
    return kept.groupBy("doc_id", "page_index", "column_no").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def _stripped(spark, sf):
    d = A.furnished_lines(spark, sf)
    return chrome.strip(d, chrome.exact_repeats(chrome.band_signatures(d), d.select("doc_id", "n_pages").distinct()))


@query
def syn_strip(spark, sf):
    return _stripped(spark, sf).select("doc_id", "page_index", "line_no", "reason", "shown", "printed_label")


@query
def strip_summary(spark, sf):
    return chrome.dropped_summary(_stripped(spark, sf).filter("reason IS NOT NULL").select(F.col("shown").alias("text"), "reason"))


@query
def geometry_boxes(spark, sf):
    d = A.table(spark, sf, "lineitem")
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    d = G.normalised(d.select("l_orderkey", "l_linenumber", (q * 10).alias("x0"), (n * 100).alias("y0"), (n * 80).alias("x1"), (q * 12).alias("y1"), (q % 7).alias("size"), (n % 4).alias("cap"), (F.col("l_orderkey") % 900).alias("weight")))
    top, bottom = G.band(F.col("size"), F.col("cap"))
    return d.select(
        "l_orderkey", "l_linenumber", "x0", "y0", "x1", "y1", G.width().alias("width"), G.height().alias("height"), G.center_x().alias("centre"), G.x_overlap(F.col("x0"), F.col("x1"), F.lit(100.0), F.lit(300.0)).alias("overlap"), G.flipped(F.lit(800.0), F.col("y0")).alias("flipped"),
        F.round(top, 6).alias("band_top"), F.round(bottom, 6).alias("band_bottom"), G.is_bold(F.col("weight")).alias("bold"), G.page_label(F.when(F.col("l_linenumber") > 3, F.lit("iv")), F.col("l_linenumber")).alias("label"), G.in_top_band(F.lit(800.0)).alias("in_top"), G.in_bottom_band(F.lit(500.0)).alias("in_bottom"),
    )


@query
def robust_stats(spark, sf):
    d = A.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("double").alias("v"))
    return ST.mad(d, ["l_orderkey"], "v").join(ST.typical_size(d, ["l_orderkey"], "v"), "l_orderkey").select("l_orderkey", F.round("mad", 4).alias("mad"), F.round("typical", 4).alias("typical"))


@query
def usable_glyphs(spark, sf):
    d = words.with_gap_limit(words.usable_glyphs(A.name_glyphs(spark, sf)))
    return d.select("doc_id", "glyph_no", "blank", F.round("med", 4).alias("med"), F.round("gap_limit", 4).alias("gap_limit"))


def _decided(spark, sf):
    d = A.table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_index"), F.when(F.col("doc_id") % 10 == 0, 0).otherwise(F.col("n_chars")).alias("n"))
    return d.select("doc_id", "page_index", pages.decision(F.col("n")).alias("decision"))


@query
def decision_totals(spark, sf):
    return pages.decision_counts(_decided(spark, sf)).withColumnRenamed("doc_id", "source")


@query
def settled_pages(spark, sf):
    d = A.table(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_index"), F.coalesce("text", F.lit("")).alias("text"))
    own = d.filter("page_index % 10 <> 0")
    seen = d.filter("page_index % 3 <> 0").withColumn("text", F.when(F.col("page_index") % 2 == 0, F.concat("text", "text")).otherwise(F.expr("left(text, 5)")))
    return pages.settled_words(_decided(spark, sf), own, seen).select(F.col("doc_id").alias("source_name"), "page_index", "source", F.length("text").alias("chars"))


@query
def cached_corrections(spark, sf):
    """Which paragraphs a cache answers, and what the accepted replies make of the spans."""
    d = A.document_lines(spark, sf).filter("trim(text) <> ''")
    keyed = d.select("doc_id", "line_no", T.fingerprint(F.lit("prompt"), "text").alias("key"), "text")
    cache = keyed.filter("line_no % 2 = 0").select("key", F.concat(F.lit("fixed: "), "text").alias("reply")).distinct()
    joined = keyed.join(cache, "key", "left")
    return joined.select("doc_id", "line_no", "key", F.col("reply").isNotNull().alias("cached"), F.coalesce("reply", "text").alias("text"))


@query
def syn_paragraphs(spark, sf):
    d = paragraphs.numbered(paragraphs.with_stats(A.syn_lines(spark, sf)))
    return d.select("doc_id", "page_index", "line_no", "para_no")


@query
def syn_headings(spark, sf):
    d = paragraphs.headings(paragraphs.paragraphs(A.heading_lines(spark, sf)))
    return d.select("doc_id", "page_index", "para_no", "n_lines", "text", "starts_indented", F.coalesce("heading_level", F.lit(0)).alias("heading_level"))


@query
def assembled_lines(spark, sf):
    return lines.words_to_lines(A.syn_words(spark, sf).drop("line_no")).select("doc_id", "page_index", "line_no", "text", "n_words")


@query
def converted_words(spark, sf):
    """A whole conversion of the invented words: what each book's spans come to."""
    w = A.syn_words(spark, sf).drop("line_no")
    sizes = w.select("doc_id", "page_index", "width_pt", "height_pt").distinct()
    return assemble.document_counts(from_words(w, sizes, Config()).spans)


@query
def cross_page_join(spark, sf):
    items, pages_ = A.wrapped_items(spark, sf)
    return assemble.document_counts(assemble.spans(items, pages_))


@query
def continuing_pages(spark, sf):
    return assemble.continued(*A.wrapped_items(spark, sf)).select("doc_id", "page_index", "continues", "group_no")


@query
def page_markers(spark, sf):
    s = assemble.spans(*A.wrapped_items(spark, sf)).filter("kind = 'page_break'")
    return s.select("doc_id", "block_no", "span_no", "label", "inline")


def _book(spark, sf):
    """Spans of documents as books: every seventh line a heading, every fifth a page marker."""
    d = A.document_lines(spark, sf)
    n = F.col("line_no")
    kind = F.when(n % 7 == 3, "heading").when(n % 5 == 2, "page_break").otherwise("text")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), n.alias("block_no"), F.lit(0).alias("span_no"), kind.alias("kind"), F.when(kind == "heading", 1 + n % 2).cast("int").alias("level"), F.when(kind != "page_break", F.col("text")).alias("text"), F.when(kind == "page_break", (n % 20).cast("string")).alias("label"))


def _meta(spark, sf):
    return A.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Book: "), F.col("source")).alias("title"), F.lit(None).cast("string").alias("author"), F.col("lang").alias("language"), F.col("source"), F.lit(7).alias("pages"), F.lit(None).cast("string").alias("generator"))


@query
def chapters(spark, sf):
    return assemble.chapters(_book(spark, sf), _meta(spark, sf))


@query
def page_anchor_dedupe(spark, sf):
    s = _book(spark, sf)
    return assemble.page_anchors(s, assemble.chapters(s, _meta(spark, sf))).select("doc_id", "chapter_no", "block_no", "id", "label")


@query
def markdown_export(spark, sf):
    return markdown.markdown(_book(spark, sf), _meta(spark, sf))


@query
def markdown_round_trip(spark, sf):
    return markdown_source.spans(markdown.markdown(_book(spark, sf), _meta(spark, sf)))


@query
def plain_text(spark, sf):
    return assemble.plain_text(_book(spark, sf))


@query
def epub_chapters(spark, sf):
    return epub.chapter_pages(_book(spark, sf), _meta(spark, sf)).select("doc_id", "chapter_no", "title", F.length("xhtml").alias("n"))


@query
def ocr_tsv_words(spark, sf):
    d = A.table(spark, sf, "lineitem")
    cell = [F.when(F.col("l_linenumber") == 2, "4").otherwise("5"), *[F.lit("1")] * 5, F.col("l_linenumber") * 10, F.lit(20), F.col("l_quantity").cast("int"), F.lit(30), F.when(F.col("l_linenumber") == 3, "n/a").otherwise((F.col("l_quantity").cast("int") - 5).cast("string")), F.when(F.col("l_quantity") > 45, "  ").otherwise(F.concat(F.lit(" "), F.col("l_returnflag")))]
    made = d.select("l_orderkey", "l_linenumber", F.concat_ws("\t", *[c.cast("string") for c in cell]).alias("line"))
    return ocr_tsv.words(made).select("l_orderkey", "l_linenumber", "text", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1", "font_size")], "conf")


def _fix(texts: list[str]) -> list[str]:
    """A stand-in corrector that depends on nothing but the text: repairs, rewrites or blanks it by its length."""
    if len(texts) > 1 and sum(map(len, texts)) % 11 == 0:
        return texts[:-1]  # a reply of the wrong length
    return [t.replace("th", "tb", 1) if len(t) % 3 == 0 else "" if len(t) % 3 == 1 else t for t in texts]


@query
def correction_pass(spark, sf):
    d = A.document_lines(spark, sf)
    s = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("line_no").alias("block_no"), F.lit(0).alias("span_no"), F.lit("text").alias("kind"), "text")
    done, _ = correct.corrections(s, "prompt", None, _fix)
    return done.select("doc_id", "block_no", "accepted", "reason")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return {k: v for k, v in SQL.items() if k in QUERIES}
