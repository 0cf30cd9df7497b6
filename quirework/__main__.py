"""Command line: python -m quirework INPUT.md|INPUT.tsv --out FOLDER [options]."""

from __future__ import annotations

import argparse
import sys

from .plans import convert
from .plans.config import Crop, from_environment
from .sinks import files
from .sources import env, external, ocr_pages, prompts
from .sources import markdown as source


def crop(text: str) -> Crop:
    """top,bottom,left,right as shares of the page."""
    shares = [float(x) for x in text.split(",")]
    if len(shares) != 4 or not all(0 <= x < 0.5 for x in shares):
        raise ValueError("a crop is four shares from 0 to 0.5")
    return Crop(*shares)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quirework", description="Convert markdown documents, or recognised words (TSV), to markdown, EPUB and Kindle files.")
    p.add_argument("input")
    p.add_argument("--out", required=True, help="folder for the files")
    p.add_argument("--format", type=lambda x: tuple(env.formats(x)))
    p.add_argument("--lang")
    p.add_argument("--page-breaks", choices=("anchors", "hard", "none"))
    p.add_argument("--title")
    p.add_argument("--author")
    p.add_argument("--pages", type=env.page_span, help="first-last, from 1")
    p.add_argument("--crop", type=crop, help="top,bottom,left,right, as shares of the page")
    p.add_argument("--dpi", type=int, help="resolution of recognised words")
    p.add_argument("--llm", choices=("auto", "always", "suspicious", "never"), default="never")
    p.add_argument("--prompts", help="folder with prompt files")
    p.add_argument("--report", action="store_true")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from .shipping import ship

    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    given = dict(formats=a.format, lang=a.lang, page_breaks=a.page_breaks, title=a.title, author=a.author, pages=a.pages, crop=a.crop, dpi=a.dpi, llm=a.llm, prompts=a.prompts)
    config = from_environment(**given)
    recognised = a.input.lower().endswith(".tsv")
    if recognised:
        made = convert.from_words(*ocr_pages.read(spark, a.input, config.dpi), config)
    else:
        made = convert.from_markdown(source.read(spark, a.input), config)
    if config.llm != "never":
        servers = external.live_servers(list(config.servers), config.llm_model)
        made = convert.proofread(made, config, external.http_corrector(servers[0], config.llm_model, prompts.load(config.lang, config.prompts)), recognised)
    _, warnings = files.write(made, config, a.out, a.report)
    for w in warnings:
        print(w, file=sys.stderr)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
