import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirework.operators import assemble, chrome, columns, correct, lines, pages, paragraphs, words
from quirework.operators.correct import ask, parse_reply

WORD = "doc_id string, page_index int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, conf double, bold boolean"
LINE = "doc_id string, page_index int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, width_pt double, height_pt double, n_pages int"


def word_rows(spark, rows, size=12.0):
    return spark.createDataFrame([("d", 0, i, *r[:5], float(r[5]) if len(r) > 5 else size, None, False) for i, r in enumerate(rows)], WORD)


def test_page_decisions(spark):
    df = spark.createDataFrame([(1700,), (0,), (27,), (118,), (120,)], "n int")
    got = df.select(pages.decision(F.col("n")), pages.decision(F.col("n"), "always"), pages.decision(F.col("n"), "never")).collect()
    assert [tuple(r) for r in got] == [("Text", "Ocr", "Text"), ("Ocr", "Ocr", "Empty"), ("Compare", "Ocr", "Text"), ("Compare", "Ocr", "Text"), ("Text", "Ocr", "Text")]


def test_page_range_is_clamped(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)], "doc_id string, page_index int")
    of = lambda a, b: sorted(r.page_index for r in pages.page_range(df, a, b).collect())
    assert (of(1, 2), of(3, 99), of(50, 60)) == ([1, 2], [3, 4], [4])
    with pytest.raises(ValueError):
        pages.page_range(df, 3, 1)


def test_best_of_two(spark):
    one = lambda t: spark.createDataFrame([("d", 0, 0, t, 0.0, 0.0, 1.0, 1.0, 9.0, None, False)], WORD)
    for decision, a, b, want in (("Compare", "abc", "abcdef", "Ocr"), ("Compare", "abcde", "abcdef", "Text"), ("Text", "a", "abcdef", "Text"), ("Ocr", "a", "b", "Ocr")):
        d = spark.createDataFrame([("d", 0, decision)], "doc_id string, page_index int, decision string")
        assert [r.source for r in pages.settled_words(d, one(a), one(b)).collect()] == [want]


def test_glyphs_to_words(spark):
    def glyph(i, ch, x, size=10.0, y=100.0):
        return ("d", 0, i, ch, x, y, x + 5, y + 10, size, False)

    rows = [glyph(i, c, 6.0 * i) for i, c in enumerate("ab cd")] + [glyph(5, "e", 30.0), glyph(6, "x", 36.0, 1.0), glyph(7, "f", 36.0, 10.0, 140.0)]
    schema = "doc_id string, page_index int, glyph_no int, ch string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean"
    got = words.glyphs_to_words(spark.createDataFrame(rows, schema)).orderBy("word_no").collect()
    assert [r.text for r in got] == ["ab", "cde", "f"]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("plain", 40.0, 200.0, 72.0, 213.0), ("g", 75.0, 204.0, 79.0, 218.0), ("words", 82.0, 200.0, 118.0, 213.0)], ["plain g words"]),
        ([("second", 70.5, 240.0, 118.0, 252.0), ("third", 121.0, 240.0, 150.0, 252.0), ("first", 40.0, 244.8, 68.0, 256.8)], ["first second third"]),
        ([("one", 50.0, 300.0, 90.0, 313.0), ("two", 50.0, 325.0, 90.0, 338.0), ("three", 50.0, 350.0, 90.0, 363.0)], ["one", "two", "three"]),
    ],
)
def test_lines(spark, rows, want):
    df = word_rows(spark, rows)
    assert [r.text for r in lines.words_to_lines(df).orderBy("line_no").collect()] == want


def test_lines_do_not_depend_on_row_order():
    rows = [(f"w{i}", float(10 * (i % 7)), 100.0 + 14 * (i // 7) + (i % 3), i) for i in range(42)]
    frame = lambda rs: pd.DataFrame([dict(word_no=r[3], x0=r[1], y0=r[2], y1=r[2] + 12, font_size=12.0) for r in rs])
    base = dict(zip([r[3] for r in rows], lines.assign_lines(frame(rows))))
    shuffled = random.Random(1).sample(rows, len(rows))
    assert dict(zip([r[3] for r in shuffled], lines.assign_lines(frame(shuffled)))) == base


def grid(spark, xs, n=30, width=48.0):
    return word_rows(spark, [("w", float(x), 100.0 + 14 * i, x + width, 110.0 + 14 * i) for i in range(n) for x in xs])


def test_columns(spark):
    two, one = grid(spark, (30, 90, 200, 260)), grid(spark, (30, 85, 140, 195), width=54.0)
    assert columns.candidate_gutters(two).count() == 1 and columns.candidate_gutters(one).count() == 0
    kept, noise = columns.split_columns(two, columns.page_gutters(two))
    assert {r.column_no: r["count"] for r in kept.groupBy("column_no").count().collect()} == {0: 60, 1: 60} and noise.count() == 0
    plan = columns.column_plan(columns.candidate_gutters(two), two).first()
    assert plan["count"] == 1 and len(plan.positions) == 1


def test_reconcile(spark):
    df = spark.createDataFrame([([100.0, 200.0, 300.0], [0.5])], "g array<double>, p array<double>")
    got = df.select(columns.reconciled(F.col("g"), F.col("p"), F.lit(0.0), F.lit(380.0), F.lit(1))).first()[0]
    assert got == [200.0]


def page_lines(spark, rows, n_pages=1, w=595.0, h=800.0, page=0):
    return spark.createDataFrame([("d", page, i, r[0], *map(float, r[1:]), w, h, n_pages) for i, r in enumerate(rows)], LINE)


def test_running_headers(spark):
    rows = []
    for p in range(10):
        rows += [("d", p, 0, "A QUIET ll HARBOUR TALE", 30.0, 30.0, 300.0, 42.0, 500.0, 800.0, 10), ("d", p, 1, "Body text stands here in the middle.", 30.0, 400.0, 300.0, 412.0, 500.0, 800.0, 10), ("d", p, 2, f"·{41 + p} -", 30.0, 780.0, 60.0, 792.0, 500.0, 800.0, 10)]
    df = spark.createDataFrame(rows, LINE)
    n = spark.createDataFrame([("d", 10)], "doc_id string, n_pages int")
    repeated = chrome.fuzzy_repeats(chrome.band_signatures(df), n)
    out = chrome.strip(df, repeated).orderBy("page_index", "line_no").collect()
    assert [r.reason for r in out[:3]] == ["RunningHeader", None, "PageNumber"] and {r.printed_label for r in out} == {str(41 + p) for p in range(10)}
    assert chrome.fuzzy_repeats(chrome.band_signatures(df.filter("page_index < 3")), n.withColumn("n_pages", F.lit(3))).count() == 0
    summary = chrome.dropped_summary(chrome.strip(df, repeated).filter("reason is not null").select("text", "reason")).collect()
    assert [(r.text, r.n) for r in summary] == [("(page numbers)", 10), ("A QUIET ll HARBOUR TALE", 10)]


def test_rules_and_margins(spark):
    body = [("Body words fill this line of the page", 100, 120 + 20 * i, 700, 132 + 20 * i) for i in range(14)]
    rows = [("Header", 100, 40, 300, 52), ("_", 14, 59.5, 828, 61), *body, ("Back", 2, 700, 30, 712)]
    df = page_lines(spark, rows, w=842.0, h=720.0)
    empty = spark.createDataFrame([], "doc_id string, signature string")
    out = chrome.strip(df, empty).orderBy("line_no").collect()
    assert out[0].reason == "Chrome" and out[1].shown == "(rule of 814 pt)" and out[-1].reason == "Chrome"
    assert all(r.reason is None for r in out[2:-1])


def column(spark, rows, size=12.0):
    data = [("d", 0, 0, i, r[0], *map(float, r[1:5]), size, bool(r[5]) if len(r) > 5 else False, None, r[0].split()[0], r[0].split()[-1]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id string, page_index int, column_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, bold boolean, conf double, first_word string, last_word string")


def test_paragraphs(spark):
    rows = [("An indented start of text", 43, 100, 468, 112), ("goes on and on to sum-", 31, 122, 468, 134), ("mer and ends here.", 31, 144, 200, 156), ("Another one begins", 43, 166, 468, 178), ("and it ends too.", 31, 188, 300, 200)]
    got = paragraphs.paragraphs(column(spark, rows)).orderBy("para_no").collect()
    assert [r.text for r in got] == ["An indented start of text goes on and on to summer and ends here.", "Another one begins and it ends too."]
    assert got[0].ambiguous_joins == ["sum|mer"] and got[0].starts_indented and got[0].ends_sentence and got[0].n_lines == 3


def test_hyphens_at_the_end(spark):
    rows = [("first dock-", 31, 100, 468, 112), ("Yards and­", 31, 122, 468, 134)]
    assert paragraphs.paragraphs(column(spark, rows)).first().text == "first dock- Yards and"


def test_headings(spark):
    text = [("plain body text that fills the whole of the line", 31, y, 468, y + 12) for y in (240, 262, 284, 306)]
    rows = [("17", 236, 90, 262, 102), ("Harbour", 225, 170, 273, 182), *text]
    got = paragraphs.headings(paragraphs.paragraphs(column(spark, rows))).orderBy("para_no").collect()
    assert [r.heading_level for r in got][:2] == [1, 2] and got[-1].heading_level is None


def items(spark, rows):
    return spark.createDataFrame([("d", p, i, k, 1 if k == "heading" else None, t, False, t.rstrip().endswith("."), t.endswith("-")) for p, i, k, t in rows], "doc_id string, page_index int, item_no int, kind string, level int, text string, starts_indented boolean, ends_sentence boolean, ends_hyphenated boolean")


def test_assembly(spark):
    made = items(spark, [(0, 0, "heading", "One"), (0, 1, "para", "It goes on"), (1, 0, "para", "and ends."), (3, 0, "para", "New.")])
    page = spark.createDataFrame([("d", p, 6 if p != 2 else 0, str(p + 1)) for p in range(4)], "doc_id string, page_index int, n_lines int, label string")
    got = [(r.block_no, r.kind, r.text or r.label) for r in assemble.spans(made, page).orderBy("block_no", "span_no").collect()]
    assert got == [(0, "page_break", "1"), (1, "heading", "One"), (2, "text", "It goes on"), (2, "page_break", "2"), (2, "text", " and ends."), (3, "page_break", "3"), (4, "page_break", "4"), (5, "text", "New.")]
    short = page.withColumn("n_lines", F.lit(4))
    assert assemble.spans(made, short).filter("inline").count() == 0
    assert assemble.spans(made, page, "none").filter("inline").count() == 1 and assemble.spans(made, page, "none", strict_parity=True).filter("inline").count() == 0
    counts = assemble.document_counts(assemble.spans(made, page)).first()
    assert (counts.paragraphs, counts.headings, counts.page_breaks) == (2, 1, 4)


def test_replies():
    assert parse_reply('["a", " b "]') == ["a", "b"] and parse_reply('{"corrected": ["x"]}') == ["x"]
    assert parse_reply('{"other": ["y", 3]}') == ["y", ""] and parse_reply('{"paragraphs": ["cut') == [""] and parse_reply("bare text ") == ["bare text"]


def test_failing_corrector():
    def sometimes(texts):
        if len(texts) > 1:
            return texts[:-1]
        if texts[0] == "bad":
            raise OSError("gone")
        return [texts[0].upper()]

    assert ask(sometimes, ["a", "bad", "c"]) == (["A", None, "C"], True)


def test_corrections(spark):
    s = spark.createDataFrame([("d", i, 0, "text", t) for i, t in enumerate(["tbe cat sat there", "fine as it is", "left out wholly", " "])], "doc_id string, block_no int, span_no int, kind string, text string")
    fix = lambda ts: [t.replace("tbe", "the") if "cat" in t else ("" if "left" in t else t) for t in ts]
    done, fresh = correct.corrections(s, "p", None, fix)
    got = {r.block_no: (r.accepted, r.reason) for r in done.collect()}
    assert got == {0: (True, None), 1: (False, None), 2: (False, "model returned nothing")}
    assert [r.text for r in correct.applied(s, done).orderBy("block_no").collect()][0] == "the cat sat there"

    def never(_):
        raise AssertionError("asked although cached")

    again, _ = correct.corrections(s, "p", fresh, never)
    assert again.filter("cached").count() == 3 and correct.run_stats(again).first().changed == 1
    assert correct.corrections(s, "p", None, fix, mode="auto", any_ocr=False)[0].count() == 0
