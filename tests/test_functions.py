import pytest
from pyspark.sql import functions as F

from quirework.functions import geometry as G
from quirework.functions import stats as S
from quirework.functions import text as T


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


def test_page_numbers(spark):
    texts = ["41", "- 41 -", "·41 -", "page 41", "123456", "", "4.......1", "*"]
    assert values(spark, texts, T.page_number("t")) == ["41", "41", "41", None, None, None, None, None]


def test_sentence_ends(spark):
    texts = ["End.", "Quote.”", "No", "Dots…", "List:", 'He said "so!"', ""]
    assert values(spark, texts, T.ends_sentence("t")) == [True, True, False, True, True, True, False]


def test_hyphens(spark):
    assert values(spark, ["num-", "num\u0002", "num­", "num", "num‐"], T.hyphen_kind("t")) == ["literal", "explicit", "explicit", None, "literal"]


def test_chapter_labels(spark):
    texts = ["44", "I.", "XIV", "II —", "Chapter One", "BÖLÜM 3", "Dear reader", "", "x" * 61, "MIX"]
    assert values(spark, texts, T.chapter_label("t")) == [True, True, True, True, True, True, False, False, False, False]


def test_normalise_spaces(spark):
    assert values(spark, ["a  b c", "so , it", " x ! "], T.normalise_spaces("t")) == ["a b c", "so, it", "x!"]


def test_signatures_match(spark):
    df = spark.createDataFrame([("janecorryyazar", "janecorryyazan", True), ("short", "short", False), ("abcdefghij", "zyxwvutsrq", False)], "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(T.signatures_match("a", "b"), "want").collect())


def test_suspicious(spark):
    texts = ["Plain words here.", "bad | mark", "a" * 25, "a b c d e f g h", "a normal line of words that is long"]
    assert values(spark, texts, T.suspicious("t")) == [False, True, True, True, False]


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("the cat sat on the mat", "", "empty"),
        ("the cat", "the cat sat", "only adds text at the start or end"),
        ("the cat", "see the cat", "only adds text at the start or end"),
        ("tbe cat sat", "the cat sat", None),
        ("one two three four five six", "one two", "length changed by 74%"),
        ("abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba", "only 0% similar to the original"),
    ],
)
def test_drift(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.drift_reason("a", "b")).first()[0] == want


def test_markup(spark):
    assert values(spark, ["# x", "a # b"], T.escape_inline("t")) == ["\\# x", "a # b"]
    assert values(spark, ["a: b", "plain", "", 'q"x:'], T.yaml_scalar("t")) == ['"a: b"', "plain", '""', '"q\\"x:"']
    assert values(spark, ["<a & 'b'>"], T.escape_xml("t")) == ["&lt;a &amp; &#39;b&#39;&gt;"]
    assert values(spark, ["41", "iv", "a b", ""], T.sanitise_id("t")) == ["n41", "iv", "a_b", "n"]
    assert values(spark, ["x" * 111], T.short("t")) == ["x" * 107 + "…"]
    assert values(spark, ["* * *", "--", "____", "-*-"], T.separator_line("t")) == [True, False, True, False]


def test_medians_and_modes(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (28.5, 28.7, 28.774, 40, 55)], "k string, x double")
    assert df.groupBy("k").agg(S.median(F.col("x"))).first()[1] == 28.774
    assert S.mode_within(df, ["k"], "x", F.lit(0.5)).first()[1] == pytest.approx((28.5 + 28.7 + 28.774) / 3)
    assert S.mad(df, ["k"], "x").first()[1] == pytest.approx(0.274)
    assert S.typical_size(df, ["k"], "x").first()[1] == pytest.approx(28.7)
    assert df.limit(0).agg(S.median(F.col("x"))).first()[0] == 0.0


@pytest.mark.parametrize("n, want", [(1, 0), (7, 5), (8, 6), (9, 7), (10, 8)])
def test_nearest_rank(spark, n, want):
    got = spark.range(1).select(S.nearest_rank(F.array([F.lit(float(i)) for i in range(n)]), 0.9)).first()[0]
    assert got == want


def test_leading(spark):
    rows = [(1, i, 30.0, y, 80.0, y + 12) for i, y in enumerate((100.0, 122.0, 144.0))] + [(2, 0, 30.0, 10.0, 80.0, 20.0)]
    df = spark.createDataFrame(rows, "p int, line_no int, x0 double, y0 double, x1 double, y1 double")
    assert dict(map(tuple, S.median_leading(df, ["p"], "line_no").collect())) == {1: 22.0, 2: 12.0}


def test_boxes(spark):
    df = spark.createDataFrame([(5.0, 9.0, 1.0, 2.0)], "x0 double, y0 double, x1 double, y1 double")
    r = G.normalised(df).select("*", G.width().alias("w"), G.height().alias("h"), G.center_x().alias("c"), G.points(F.lit(854.0), 300).alias("pt"), *[b.alias(n) for b, n in zip(G.band(F.lit(10.0), F.lit(5.0)), ("a", "b"))]).first()
    assert (r.x0, r.y0, r.x1, r.y1, r.w, r.h, r.c) == (1, 2, 5, 9, 4, 7, 3)
    assert r.pt == pytest.approx(204.96) and (r.a, r.b) == (2.5, 8.5)
