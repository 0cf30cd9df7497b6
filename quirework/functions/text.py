"""Scalar text functions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that open a chapter label.
CHAPTER_WORDS = (
    "chapter", "bölüm", "bolum", "hoofdstuk", "kapitel", "chapitre",
    "capitolo", "capitulo", "capítulo", "kapittel", "rozdział", "part",
    "book", "kısım", "kisim", "prologue", "epilogue", "önsöz", "onsoz",
    "prolog", "epilog", "voorwoord", "proloog", "epiloog",
)
#: Hyphens that always join, and those that may.
EXPLICIT_HYPHENS = ("\u0002", "­", "¬")
LITERAL_HYPHENS = ("-", "‐", "‑")
#: Limits of the drift guard and of signatures.
FREE_EDITS, LENGTH_DRIFT, LEAST_SIMILARITY = 4, 0.15, 0.90
SIGNATURE_BYTES, SIGNATURE_SIMILARITY = 8, 0.85


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_all(text: Column | str) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def signature(text: Column | str) -> Column:
    """Lower case, letters only."""
    return F.regexp_replace(F.lower(_c(text)), r"[^\p{IsAlphabetic}]", "")


def normalise_spaces(text: Column | str) -> Column:
    """White space to single spaces, none before closing punctuation."""
    return F.regexp_replace(trim_all(F.regexp_replace(_c(text), r"(?U)\s+", " ")), r" (?=[,.;:!?’])", "")


def similarity(a: Column | str, b: Column | str) -> Column:
    """Levenshtein similarity from 0 to 1; two empty texts are alike."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.try_divide(F.levenshtein(a, b), longest))


def signatures_match(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    return (F.octet_length(a) >= SIGNATURE_BYTES) & (F.octet_length(b) >= SIGNATURE_BYTES) & ((a == b) | (similarity(a, b) >= SIGNATURE_SIMILARITY))


def page_number(text: Column | str) -> Column:
    """The digits of a line that is a page number, else null."""
    t = _c(text)
    digits = F.regexp_replace(t, "[^0-9]", "")
    shown = F.length(F.regexp_replace(t, r"(?U)\s", ""))
    ok = (F.length(digits).between(1, 5)) & ~t.rlike(r"\p{IsAlphabetic}") & (shown <= F.length(digits) + 4)
    return F.when(ok, digits)


def ends_sentence(text: Column | str) -> Column:
    return _c(text).rlike(r"""(?U)[.!?:;…]["'»”’)\]\s]*$""")


def hyphen_kind(text: Column | str) -> Column:
    last = F.right(_c(text), F.lit(1))
    return F.when(last.isin(*EXPLICIT_HYPHENS), "explicit").when(last.isin(*LITERAL_HYPHENS), "literal")


def chapter_label(text: Column | str) -> Column:
    t = trim_all(text)
    core = F.regexp_replace(t, "[.):—– -]+$", "")
    words = F.lower(t).rlike("^(" + "|".join(CHAPTER_WORDS) + ")")
    return (F.length(t).between(1, 60)) & (core != "") & (core.rlike("^[0-9]+$") | core.rlike("^[IVXLC]{1,8}$") | words)


def separator_line(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"(?U)\s", "").rlike(r"^(\*{3,}|-{3,}|_{3,})$")


def suspicious(text: Column | str, confidence: Column | None = None) -> Column:
    """Text that looks like a bad recognition."""
    t = _c(text)
    tokens = F.filter(F.split(F.regexp_replace(t, r"(?U)\s+", " "), " "), lambda w: w != "")
    singles = F.size(F.filter(tokens, lambda w: F.length(w) == 1))
    longest = F.coalesce(F.array_max(F.transform(tokens, lambda w: F.length(w))), F.lit(0))
    odd = t.rlike(r"[·¬|~^�]") | (longest > 24) | ((F.size(tokens) >= 8) & (singles * 5 > F.size(tokens)))
    return odd if confidence is None else odd | F.coalesce(confidence < 85, F.lit(False))


def percent(x: Column) -> Column:
    """Rounded half to even, as a whole number."""
    return F.bround(x * 100, 0).cast("int").cast("string")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _common_start(a: Column, b: Column) -> Column:
    """Characters at the start that two texts share (of at most two million), by halving."""
    shorter = F.least(F.length(a), F.length(b))
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(20, -1, -1)]), F.lit(0), lambda n, more: F.when((n + more <= shorter) & (F.left(a, n + more) == F.left(b, n + more)), n + more).otherwise(n))


def distance(a: Column, b: Column) -> Column:
    """Levenshtein distance, of what is left without the start and the end that both share."""
    without = lambda x, y: _let(_common_start(x, y), lambda n: F.struct(F.substr(x, n + 1).alias("x"), F.substr(y, n + 1).alias("y")))
    return _let(without(a, b), lambda s: _let(without(F.reverse(s["x"]), F.reverse(s["y"])), lambda e: F.levenshtein(e["x"], e["y"])))


def drift_reason(original: Column | str, corrected: Column | str) -> Column:
    """Why a correction is refused; null if it looks like a repair."""
    a, b = trim_all(original), trim_all(corrected)
    longer, longest = F.abs(F.length(b) - F.length(a)), F.greatest(F.length(a), F.length(b))
    drift = F.try_divide(longer, F.length(a))
    changed = (F.length(a) > 0) & (drift > LENGTH_DRIFT)
    changed_by = F.concat(F.lit("length changed by "), percent(drift), F.lit("%"))

    def by_distance(d: Column) -> Column:
        alike = F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.try_divide(d, longest))
        return (
            F.when(d <= FREE_EDITS, F.lit(None).cast("string"))
            .when(changed, changed_by)
            .when(alike < LEAST_SIMILARITY, F.concat(F.lit("only "), percent(alike), F.lit("% similar to the original")))
        )

    return (
        F.when(b == "", "empty")
        .when((F.octet_length(b) > F.octet_length(a)) & (F.startswith(b, a) | F.endswith(b, a)), "only adds text at the start or end")
        # No fewer edits than characters more or less.
        .when((longer > FREE_EDITS) & changed, changed_by)
        .otherwise(_let(distance(a, b), by_distance))
    )


def page_marker(label: Column | str) -> Column:
    return F.concat(F.lit("<!-- page: "), _c(label), F.lit(" -->"))


def yaml_scalar(text: Column | str) -> Column:
    t = _c(text)
    special = (t == "") | t.contains(":") | t.contains("#") | t.rlike(r"""^[\[{&*!|>'"%@`]""") | (trim_all(t) != t)
    return F.when(special, F.concat(F.lit('"'), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(t)


def escape_block(text: Column | str) -> Column:
    return trim_all(F.replace(_c(text), F.lit("\n"), F.lit(" ")))


def escape_inline(text: Column | str) -> Column:
    return F.regexp_replace(F.replace(_c(text), F.lit("\n"), F.lit(" ")), "^#", r"\\#")


def escape_xml(text: Column | str) -> Column:
    out = _c(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def sanitise_id(text: Column | str) -> Column:
    t = F.regexp_replace(_c(text), r"[^\p{IsAlphabetic}\p{N}]", "_")
    return F.when((t == "") | t.rlike(r"^\p{N}"), F.concat(F.lit("n"), t)).otherwise(t)


def short(text: Column | str) -> Column:
    """For a report: one line of at most 110 characters."""
    t = F.replace(F.replace(_c(text), F.lit("`"), F.lit("'")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(t) > 110, F.concat(F.left(t, F.lit(107)), F.lit("…"))).otherwise(t)


def fingerprint(prompt: Column | str, text: Column | str, version: int = 1) -> Column:
    """Key of a cached reply: of the request's version, the prompt and the text."""
    request = F.sha2(F.concat_ws("\u0000", F.lit(str(version)), _c(prompt)), 256)
    return F.sha2(F.concat_ws("\u0000", request, _c(text)), 256)
