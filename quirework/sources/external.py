"""Optional engines behind plain protocols: PDF parsers, recognisers, model servers.

None of them is needed by the tables' operators; each is found at run time.
"""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import tempfile
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GLYPHS = "doc_id string, page_index int, glyph_no int, ch string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, width_pt double, height_pt double"


def pdf_glyphs(spark: SparkSession, path: str, parser: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """Glyphs of PDF files by a parser that yields (page_index, glyph_no, ch, x0, y0, x1, y1, size, bold, width_pt, height_pt), origin at the top left."""

    def each(batches):
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                yield pd.DataFrame([(name, *g) for g in parser(bytes(content))], columns=[c.split()[0] for c in GLYPHS.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "content").mapInPandas(each, GLYPHS)


def page_survey(glyphs: DataFrame) -> DataFrame:
    """doc_id, page_index, width_pt, height_pt, text_chars of pages with glyphs."""
    return glyphs.groupBy("doc_id", "page_index").agg(F.first("width_pt").alias("width_pt"), F.first("height_pt").alias("height_pt"), F.count_if(~F.col("ch").rlike(r"^\p{Cc}$")).alias("text_chars"))


def raster_size(width_pt: float, height_pt: float, dpi: float) -> tuple[int, int]:
    return max(1, round(width_pt * dpi / 72)), max(1, round(height_pt * dpi / 72))


def recogniser_languages() -> list[str]:
    """Languages of the installed recogniser; none if there isn't one."""
    if not shutil.which("tesseract"):
        return []
    said = subprocess.run(["tesseract", "--list-langs"], capture_output=True, text=True, timeout=60)
    return [x.strip() for x in (said.stdout or said.stderr).splitlines()[1:] if x.strip()]


def check_languages(code: str, installed: list[str]) -> None:
    if missing := [c for c in code.split("+") if c not in installed]:
        raise RuntimeError(f"the recogniser has no data for {', '.join(missing)}")


def recognise(image_png: bytes, lang: str, dpi: float) -> str:
    """The recogniser's rows for one image. The file's name is unique, as attempts of a task may run at once."""
    with tempfile.NamedTemporaryFile(suffix=".png", delete=False) as f:
        f.write(image_png)
    try:
        return subprocess.run(["tesseract", f.name, "stdout", "-l", lang, "--psm", "1", "--dpi", str(int(dpi)), "tsv"], capture_output=True, text=True, check=True, timeout=600).stdout
    finally:
        os.unlink(f.name)


def ocr_lines(images: DataFrame, engine: Callable[[bytes], str]) -> DataFrame:
    """doc_id, page_index, line of an engine's rows; images: doc_id, page_index, png. A page that fails has no rows."""

    def each(batches):
        for pdf in batches:
            rows = []
            for d, p, png in zip(pdf.doc_id, pdf.page_index, pdf.png):
                try:
                    rows += [(d, p, line) for line in engine(bytes(png)).splitlines()]
                except (OSError, subprocess.SubprocessError):
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "line"])

    return images.mapInPandas(each, "doc_id string, page_index int, line string")


def has_model(names: list[str], model: str) -> bool:
    """Exactly, by its name before the tag, or as the latest."""
    return any(n == model or n == f"{model}:latest" or n.split(":")[0] == model for n in names)


def live_servers(urls: list[str], model: str, timeout: float = 10) -> list[str]:
    """Servers that answer and have the model; an error if none does."""

    def ok(url: str) -> bool:
        try:
            with urllib.request.urlopen(f"{url}/api/tags", timeout=timeout) as r:
                return has_model([m.get("name", "") for m in json.load(r).get("models", [])], model)
        except (OSError, ValueError):
            return False

    with ThreadPoolExecutor(max(1, len(urls))) as pool:
        found = [u for u, good in zip(urls, pool.map(ok, urls)) if good]
    if not found:
        raise RuntimeError(f"no server has {model}")
    return found


def request_body(model: str, prompt: str, texts: list[str]) -> dict:
    return {"model": model, "stream": False, "think": False, "format": "json", "options": {"temperature": 0, "num_predict": 4096}, "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": json.dumps({"paragraphs": texts}, ensure_ascii=False)}]}


def http_corrector(url: str, model: str, prompt: str, timeout: float = 300) -> Callable[[list[str]], list[str]]:
    """A corrector that asks one server."""
    from ..operators.correct import parse_reply

    def call(texts: list[str]) -> list[str]:
        body = json.dumps(request_body(model, prompt, texts)).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{url}/api/chat", body, {"Content-Type": "application/json"}), timeout=timeout) as r:
            return parse_reply(json.load(r)["message"]["content"])

    return call
