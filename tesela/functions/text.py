"""Text functions as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Letters whose accents search folding drops (ñ stays), and those the scanner's folding drops.
SEARCH_FROM, SEARCH_TO = "áàäéèëíìïóòöúùü", "aaaeeeiiiooouuu"
SCAN_FROM, SCAN_TO = "ÁÀÄÂÉÈËÊÍÌÏÎÓÒÖÔÚÙÜÛÑ", "AAAAEEEEIIIIOOOOUUUUN"


def search_fold(text: Column) -> Column:
    return F.translate(F.lower(text), SEARCH_FROM, SEARCH_TO)


def _scan_char(c: Column) -> Column:
    """A character in upper case if that is one character too, without its accent."""
    return F.translate(F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c), SCAN_FROM, SCAN_TO)


def scan_fold(text: Column) -> Column:
    """Upper case without accents or combining marks, one character for each that stays (ß stays ß)."""
    return F.array_join(F.transform(F.split(F.regexp_replace(text, "\\p{Mn}+", ""), ""), _scan_char), "")


def scan_places(text: Column) -> Column:
    """For each character of :func:`scan_fold`, its place (from 0) in the original text."""
    placed = F.transform(F.split(text, ""), lambda c, i: F.when(~c.rlike("^\\p{Mn}$"), i))
    return F.filter(placed, lambda i: i.isNotNull())


def normal(text: Column) -> Column:
    """Lower-case letters and digits in words, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def line_shape(text: Column) -> Column:
    """The normal form with ``#`` for each run of digits: page numbers and dates don't make lines different."""
    return F.regexp_replace(normal(text), "[0-9]+", "#")


def dehyphenated(text: Column) -> Column:
    """Words that a hyphen and a line break split, joined again."""
    return F.regexp_replace(text, r"(\p{L})-\s+(\p{Ll})", "$1$2")


#: Ligatures and how extractors write them, odd spaces, and characters without width.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st", "/f_i": "fi", "/f_l": "fl", "/f_f": "ff"}
ODD_SPACES, NO_WIDTH = "\u00a0\u2007\u202f", "\u00ad\u200b\ufeff"


def cleaned(text: Column) -> Column:
    """Ligatures spelled out, odd spaces made plain, broken addresses mended, blanks and blank lines squeezed, trimmed."""
    out = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), ODD_SPACES + NO_WIDTH, " " * len(ODD_SPACES))
    for written, meant in LIGATURES.items():
        out = F.replace(out, F.lit(written), F.lit(meant))
    for scheme in ("https:/", "http:/"):
        out = F.replace(out, F.lit(f"{scheme} /"), F.lit(f"{scheme}/"))
    for pattern, instead in (("[ \\t]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n"), ("^\\s+|\\s+$", "")):
        out = F.regexp_replace(out, pattern, instead)
    return out


def words(text: Column) -> Column:
    return F.filter(F.split(normal(text), " "), lambda w: w != "")


def same_statement(a: Column, b: Column) -> Column:
    """The same words with digits, and one text holds the other or they share seven tenths of their words; never for empty ones."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    figures = lambda w: F.array_sort(F.filter(w, lambda t: t.rlike("[0-9]")))
    alike = F.contains(normal(a), normal(b)) | F.contains(normal(b), normal(a)) | (10 * F.size(F.array_intersect(x, y)) >= 7 * F.size(F.array_union(x, y)))
    return (F.size(x) > 0) & (F.size(y) > 0) & (figures(x) == figures(y)) & alike


def dominant_year(text: Column) -> Column:
    """The year from 2000 on that a text names most often, the later of equals; null without any."""
    found = F.regexp_extract_all(text, F.lit("20[0-9]{2}"), F.lit(0))
    times = F.transform(F.array_distinct(found), lambda y: F.struct(F.size(F.filter(found, lambda x: x == y)).alias("n"), y.alias("year")))
    return F.array_max(times)["year"].cast("int")


def version(text: Column) -> Column:
    """A fingerprint that tells whether a text changed."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


@F.pandas_udf(ArrayType(StringType()))
def chunks(text: pd.Series) -> pd.Series:
    """Paragraphs packed to at most a thousand characters; a longer one is cut between words.  Null and blank texts have none."""

    def pack(t: str | None) -> list[str]:
        out, joint = [""], "\n\n"
        for paragraph in filter(None, (x.strip() for x in (t or "").split("\n\n"))):
            whole = len(paragraph) <= CHUNK
            if not whole:
                out.append("")
            joint, parts = ("\n\n", [paragraph]) if whole else (" ", paragraph.split())
            for part in parts:
                if out[-1] and len(out[-1]) + len(joint) + len(part) > CHUNK - (not whole):
                    out.append("")
                out[-1] += (joint if out[-1] else "") + part
            if not whole:
                out.append("")
        return [x for x in out if x]

    return text.map(pack, na_action=None)


@F.pandas_udf(StringType())
def excerpt(text: pd.Series, terms: pd.Series, size: pd.Series) -> pd.Series:
    """About ``size`` characters on one line around the first word that begins with one of the folded terms, between words."""

    def around(t: str | None, begins, n: int) -> str | None:
        if t is None:
            return None
        flat = " ".join(t.split())
        folded = [(m.start(), m[0].lower().translate(_FOLD)) for m in re.finditer(r"[^\W_]+", flat)]
        hit = next((at for at, w in folded if any(w.startswith(b) for b in begins)), None)
        start = max(0, (hit or 0) - n // 4)
        start = flat.rfind(" ", 0, start) + 1 if start else 0
        end = flat.find(" ", min(start + n, len(flat)))
        end = len(flat) if end < 0 else end
        return ("…" if start else "") + flat[start:end].strip() + ("…" if end < len(flat) else "")

    return pd.Series([around(t, b, int(n)) for t, b, n in zip(text, terms, size, strict=True)], dtype=object)


_FOLD = str.maketrans(SEARCH_FROM, SEARCH_TO)
#: Characters of a chunk.
CHUNK = 1_000
