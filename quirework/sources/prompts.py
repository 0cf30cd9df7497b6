"""Prompt files: sections with a lead-in and rules, rendered to one system prompt."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from ..operators.metadata import LANGUAGES

#: The order in which sections with rules are rendered.
ORDER = ("rule-zero", "rules", "language-rules", "limits")
BUILT_IN = """
## intro
{language_sentence}You repair recognition errors in paragraphs of a book.
## language-sentence
The text is in {language}.
## rule-zero
Above all:
- If a paragraph has no error, return it as it is.
## rules
Repair only:
- Letters that were taken for others.
- Words that were split or run together.
## language-rules
For {language}:
## limits
Never:
- Add, drop, translate or reorder words.
## trailer
Answer with JSON: {"paragraphs": [...]}, one text for each paragraph.
"""


@dataclass
class Section:
    lead_in: str = ""
    rules: list[str] = field(default_factory=list)


def parse(text: str) -> dict[str, Section]:
    sections: dict[str, list[list[str]]] = {}
    parts: list[list[str]] | None = None
    for line in text.splitlines():
        if line.startswith("## "):
            parts = sections[line[3:].strip()] = [[]]
        elif parts is not None and not line.lstrip().startswith("#"):
            if line.lstrip().startswith("- "):
                parts.append([line.lstrip()[2:]])
            else:
                parts[-1].append(line)
    one = lambda lines: " ".join(" ".join(lines).split())
    return {name: Section(one(p[0]), [one(r) for r in p[1:]]) for name, p in sections.items()}


def language_pack(code: str, folder: str | None) -> tuple[str | None, list[str]]:
    """(label, rules) of a language: from its file, else the label that is known for it."""
    label = next((name for name, c, _ in LANGUAGES if c == code), None)
    if folder and code.isascii() and code.isalnum() and (file := Path(folder) / "languages" / f"{code}.md").is_file():
        pack = parse(file.read_text())
        own = pack.get("label", Section()).lead_in or pack.get("language", Section()).lead_in
        return own or label, pack.get("rules", Section()).rules
    return label, []


def render(general: dict[str, Section], label: str | None = None, language_rules: list[str] = ()) -> str:
    name = label or ""
    fill = lambda s: s.replace("{language}", name)
    said = general.get("language-sentence")
    sentence = f"{fill(said.lead_in).strip()} " if label and said and said.lead_in else ""
    out = [fill(general.get("intro", Section()).lead_in.replace("{language_sentence}", sentence))]
    number = 0
    for section in ORDER:
        if section not in general:
            continue
        rules = general[section].rules + (list(language_rules) if section == "language-rules" and label else [])
        if rules:
            out.append("\n".join([fill(general[section].lead_in), *(f"{number + i}. {r}" for i, r in enumerate(rules))]))
            number += len(rules)
    if general.get("trailer", Section()).lead_in:
        out.append(general["trailer"].lead_in)
    return "\n\n".join(out)


def load(code: str, folder: str | None = None) -> str:
    """The rendered prompt: of the folder's file if it is usable, else the built-in one."""
    file = Path(folder) / "proofread.md" if folder else None
    general = parse(file.read_text()) if file and file.is_file() else {}
    if "intro" not in general or not any(general.get(s, Section()).rules for s in ORDER):
        general = parse(BUILT_IN)
    return render(general, *language_pack(code, folder))
