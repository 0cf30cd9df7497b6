import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quirework.plans.config import Config, from_environment
from quirework.plans.convert import from_markdown, from_words, proofread
from quirework.sinks import epub, markdown
from quirework.sources import dispatch, env, external, ocr_tsv, prompts
from quirework.sources import markdown as md

META = "doc_id string, title string, author string, language string, source string, pages int, generator string"


def test_input_kinds(spark):
    df = spark.createDataFrame([("a/B.PDF",), ("b.md",), ("c.MKD",), ("d.txt",), ("e",)], "p string")
    assert [r[0] for r in df.select(dispatch.input_kind(F.col("p"))).collect()] == ["Pdf", "Markdown", "Markdown", None, None]


def test_recognised_rows(spark):
    rows = ["level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext", "5\t1\t1\t1\t1\t1\t612\t80\t60\t40\t91.5\tQuay", "4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t", "5\t1\t1\t1\t1\t2\t900\t100\t50\t30\t-1\tgone", "5\t1\t1\t1\t1\t3\t1\t1\t1\t1\tx\tkept", "5\t1\t1\t1\t1\t4\t1\t1\t1\t1\t50\t  ", "5\tshort"]
    got = ocr_tsv.words(spark.createDataFrame([(r,) for r in rows], "line string")).collect()
    assert [(r.text, r.conf) for r in got] == [("Quay", 91.5), ("kept", None)] and got[0].x0 == pytest.approx(146.88) and got[0].font_size == pytest.approx(9.6)


@pytest.mark.parametrize(
    "text, want",
    [
        ("# One\n\nA line\nand more.\n", [("heading", 1, "One"), ("text", None, "A line and more.")]),
        ("Title\n===\nSub\n---\nx", [("heading", 1, "Title"), ("heading", 2, "Sub"), ("text", None, "x")]),
        ("a\n\n* * *\n\nb", [("text", None, "a"), ("separator", None, None), ("text", None, "b")]),
        ("it *is* so * lone", [("text", None, "it "), ("emphasis", None, "is"), ("text", None, " so * lone")]),
        ("\\# no heading", [("text", None, "# no heading")]),
        ("#hash no heading", [("text", None, "#hash no heading")]),
    ],
)
def test_markdown_blocks(text, want):
    assert [s[:3] for b in md.parse(text)[1] for s in b] == want


def test_markers_and_front_matter():
    meta, blocks = md.parse('---\ntitle: "A: b"\nlang: tr\npages: 12\nodd: 1\n---\n\n<!-- page: 4 -->\n\ntext <!-- page: 5 -->goes <!-- other --> on <!-- page: 6 -->')
    assert (meta["title"], meta["language"], meta["pages"]) == ("A: b", "tr", 12)
    assert blocks[0] == [("page_break", None, None, "4")] and blocks[1][1] == ("page_break", None, None, "5") and len(blocks[1]) == 3
    assert md.parse("x")[0]["title"] == "Untitled"
    with pytest.raises(md.MarkdownError):
        md.parse("---\ntitle: x\n")


def book(spark, n=40, seed=3):
    rng, rows = random.Random(seed), []
    for b in range(n):
        kind = rng.choice(["text", "text", "heading", "page_break", "separator"])
        word = lambda: "".join(rng.choice("abcde'&<\"é") for _ in range(5))
        rows.append(("d", b, 0, kind, rng.randint(1, 6) if kind == "heading" else None, " ".join(word() for _ in range(4)) if kind in ("text", "heading") else None, str(b % 7) if kind == "page_break" else None))
    meta = spark.createDataFrame([("d", "The: Title", "An Author", "en", "s.pdf", 3, None)], META)
    return spark.createDataFrame(rows, "doc_id string, block_no int, span_no int, kind string, level int, text string, label string"), meta, rows


def test_round_trip(spark):
    spans, meta, rows = book(spark)
    out = markdown.markdown(spans, meta)
    again = md.spans(out).orderBy("block_no", "span_no").collect()
    assert [(r.kind, r.level, r.text, r.label) for r in again] == [r[3:] for r in rows]
    assert md.metadata(out).first().title == "The: Title"


def test_epub(spark):
    spans, meta, rows = book(spark)
    r = epub.packages(spans, meta).first()
    z = zipfile.ZipFile(io.BytesIO(bytes(r.epub)))
    assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and bytes(r.epub)[30:58] == b"mimetypeapplication/epub+zip"
    html = "".join(z.read(n).decode() for n in z.namelist() if n.endswith(".xhtml") and "nav" not in n)
    labels = {x[6] for x in rows if x[3] == "page_break"}
    assert html.count('epub:type="pagebreak"') == len(labels) and all(f'id="page_n{x}"' for x in labels) and "<hr " in html
    assert 'page-list' in z.read("OEBPS/nav.xhtml").decode() and "The: Title" in z.read("OEBPS/content.opf").decode()
    assert bytes(epub.packages(spans, meta).first().epub) == bytes(r.epub)
    none = zipfile.ZipFile(io.BytesIO(bytes(epub.packages(spans, meta, "none").first().epub)))
    assert "pagebreak" not in "".join(none.read(n).decode() for n in none.namelist() if "ch" in n and n.endswith("xhtml"))


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# c\nexport A=1\nB='two words'\nC=\n")
    (tmp_path / "in").mkdir()
    assert env.value("A", start=tmp_path / "in") == "1" and env.value("B", start=tmp_path) == "two words" and env.value("C", "z", tmp_path) == "z"
    monkeypatch.setenv("A", "9")
    assert env.value("A", start=tmp_path) == "9"
    assert env.formats("epub, md,epub") == ["epub", "md"] and env.server_urls("a:1/, http://b,a:1") == ["http://a:1", "http://b", "http://a:1"]
    assert env.page_span("3-5") == (2, 4) and env.safe_name("gemma4:e4b") == "gemma4_e4b"
    for bad in ("0", "5-3", "x"):
        with pytest.raises(ValueError):
            env.page_span(bad)
    with pytest.raises(ValueError):
        env.formats("doc")
    assert from_environment(lang="tur").language == "tr" and Config(lang="zzz").language == "und"
    with pytest.raises(ValueError):
        Config(ocr="maybe")


def test_prompts(tmp_path):
    text = prompts.load("tur")
    assert "Turkish" in text and "\n0. " in text and text.index("0. ") < text.index("Never") and prompts.load("zzz").count("The text is in") == 0
    (tmp_path / "languages").mkdir()
    (tmp_path / "languages" / "tur.md").write_text("# T\n## rules\n- keep the dotless i\n  as it is\n### note\n- second\n")
    assert "keep the dotless i as it is" in prompts.load("tur", str(tmp_path))
    s = prompts.parse("intro lost\n## a\nlead\nin\n- one\n  more\n- two\n## b\n")
    assert (s["a"].lead_in, s["a"].rules, s["b"].rules) == ("lead in", ["one more", "two"], [])


def test_external():
    assert external.has_model(["gemma4:latest"], "gemma4") and external.has_model(["x:1"], "x") and not external.has_model(["xy"], "x")
    assert external.raster_size(841, 595, 300) == (3504, 2479)
    external.check_languages("eng+tur", ["eng", "tur"])
    with pytest.raises(RuntimeError):
        external.check_languages("eng+tur", ["eng"])
    with pytest.raises(RuntimeError):
        external.live_servers(["http://127.0.0.1:9"], "m", 0.2)


def test_conversion_of_words(spark):
    rows, n = [], 0
    for p in range(5):
        lines = [("A QUIET HARBOUR TALE", 60.0, 30.0)] + [(f"line {p} {i} goes on over the measure of it" if i < 19 else "and it stops here", 60.0, 120.0 + 20 * i) for i in range(20)] + [(str(41 + p), 290.0, 770.0)]
        for text, x, y in lines:
            for w in text.split():
                rows.append(("d", p, n, w, x, y, x + 9.0 * len(w), y + 12.0, 12.0, None, False))
                x, n = x + 9.0 * (len(w) + 1), n + 1
    words = spark.createDataFrame(rows, "doc_id string, page_index int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, conf double, bold boolean")
    sizes = spark.createDataFrame([("d", p, 600.0, 800.0) for p in range(5)], "doc_id string, page_index int, width_pt double, height_pt double")
    c = from_words(words, sizes, Config())
    assert {(r.reason, r["count"]) for r in c.dropped.groupBy("reason").count().collect()} == {("RunningHeader", 5), ("PageNumber", 5)}
    spans = c.spans.collect()
    assert sorted(r.label for r in spans if r.kind == "page_break") == ["41", "42", "43", "44", "45"] and any(r.inline for r in spans)
    assert c.outputs(Config(formats=("md", "json")))["json"].count() == 5


def test_conversion_of_markdown(spark):
    docs = spark.createDataFrame([("/x/my-book.md", "# One\n\ntbe text\n\n# Two\n\nmore")], "doc_id string, markdown string")
    c = from_markdown(docs, Config(formats=("md", "epub"), lang="tur"))
    assert c.meta.first().title == "my-book" and c.meta.first().language == "tr"
    fixed = proofread(c, Config(llm="always"), lambda ts: [t.replace("tbe", "the") for t in ts], any_ocr=False)
    assert "the text" in fixed.outputs(Config(formats=("md",)))["md"].first().markdown
    assert proofread(c, Config(llm="auto"), None, any_ocr=False) is c
    with pytest.raises(ValueError):
        from_markdown(docs, Config(formats=("json",)))


def test_stream(spark, tmp_path):
    from quirework.streaming.folder import convert

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\ntext")
    for expected in (1, 2):
        convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out" / "md")).count() == expected
        (tmp_path / "in" / "b.md").write_text("# B\n\ntext")


def test_command_line(spark, tmp_path):
    from quirework.__main__ import crop, main

    rows = ["level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"]
    for page in (1, 2, 3):
        rows.append(f"1\t{page}\t0\t0\t0\t0\t0\t0\t2500\t3300\t-1\t")
        for line in range(8):
            rows += [f"5\t{page}\t1\t1\t{line + 1}\t{i + 1}\t{200 + 300 * i}\t{600 + 80 * line}\t280\t50\t95\tword{page}" for i in range(7)]
    (tmp_path / "scan.tsv").write_text("\n".join(rows) + "\n")
    out = tmp_path / "out"
    assert main([str(tmp_path / "scan.tsv"), "--out", str(out), "--format", "md,epub,json", "--pages", "1-2", "--report", "--title", "A Scan"]) == 0
    text = (out / "scan.md").read_text()
    assert text.count("word1") == 56 and text.count("word2") == 56 and "word3" not in text and "A Scan" in text
    assert zipfile.ZipFile(out / "scan.epub").testzip() is None and (out / "scan.json").read_text().count("\n") == 2
    report = (out / "report.md").read_text()
    assert "page breaks: 2" in report and "scan.epub" in report
    assert crop("0.1,0,0,0.05").right == 0.05
    with pytest.raises(ValueError):
        crop("0.6,0,0,0")
