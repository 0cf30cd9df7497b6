"""Defaults from the environment and the nearest ``.env`` file: flag, environment, file, built-in, in this order."""

from __future__ import annotations

import os
import re
from pathlib import Path

LINE = re.compile(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$")


def parse(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        if (m := LINE.match(line)) and not line.lstrip().startswith("#"):
            value = m[2]
            quoted = len(value) >= 2 and value[0] == value[-1] and value[0] in "'\""
            out[m[1]] = value[1:-1] if quoted else value
    return out


def locate(start: Path | None = None) -> Path | None:
    here = (start or Path.cwd()).resolve()
    return next((d / ".env" for d in (here, *here.parents) if (d / ".env").is_file()), None)


def value(key: str, fallback: str | None = None, start: Path | None = None) -> str | None:
    """A setting; an empty one counts as unset."""
    if own := os.environ.get(key, ""):
        return own
    found = locate(start)
    return (parse(found.read_text()).get(key) if found else None) or fallback


def formats(text: str) -> list[str]:
    """Output formats of a comma list."""
    out = []
    for x in (x.strip().lower() for x in text.split(",") if x.strip()):
        if x not in ("md", "epub", "mobi", "azw3", "json"):
            raise ValueError(f"unknown format {x}")
        out += [x] * (x not in out)
    if not out:
        raise ValueError("no format given")
    return out


def server_urls(text: str) -> list[str]:
    """Servers of a comma list; the scheme is added, a last slash removed, repeats stay."""
    out = [x.strip().rstrip("/") for x in text.split(",") if x.strip()]
    if not out:
        raise ValueError("no server given")
    return [x if "://" in x else f"http://{x}" for x in out]


def page_span(text: str) -> tuple[int, int]:
    """``a-b`` (from 1, inclusive) or ``a`` as zero-based first and last page."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", text)
    if not m or int(m[1]) < 1 or int(m[2] or m[1]) < int(m[1]):
        raise ValueError(f"not a page range: {text}")
    return int(m[1]) - 1, int(m[2] or m[1]) - 1


def safe_name(model: str) -> str:
    """A model's name as a folder's."""
    return "".join(c if c.isalnum() else "_" for c in model)
