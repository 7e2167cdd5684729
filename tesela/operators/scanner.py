"""The scanner for identifiers of people: shapes over folded text, gated by check digits, dates and allow-lists.

Counts need no places and stay in Spark's engine (:func:`counts`).  Redaction needs them: :func:`scanner` gives an Arrow
function over batches that returns spans in characters of the original text, never the values.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions.arrow import each
from tesela.functions.checks import CURP_ALPHABET, card_valid, clabe_valid, curp_check, nss_valid, plausible_yymmdd
from tesela.functions.text import SCAN_FROM, SCAN_TO
from tesela.operators import names as people

#: Kinds in the order that breaks ties, and their shapes over folded text.
PATTERNS = {
    "curp": r"\b[A-Z][AEIOUX][A-Z]{2}\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[HMX](?:AS|BC|BS|CC|CL|CM|CS|CH|DF|DG|GT|GR|HG|JC|MC|MN|MS|NT|NL|OC|PL|QT|QR|SP|SL|SR|TC|TS|TL|VZ|YN|ZS|NE)[B-DF-HJ-NP-TV-Z]{3}[A-Z\d]\d\b",
    "rfc_person": r"\b[A-Z&]{4}\d{6}[A-Z\d]{3}\b",
    "rfc_company": r"\b[A-Z&]{3}\d{6}[A-Z\d]{3}\b",
    "voter_key": r"\b[A-Z]{6}\d{8}[HMX]\d{3}\b",
    "phone": r"(?:\+?52[ -]?)?(?:\(\d{2,3}\)|\d{2,3})[ -]?\d{3,4}[ -]?\d{4}",
    "email": r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}",
    "clabe": r"\b\d{18}\b",
    "card": r"\b\d(?:[ -]?\d){12,18}\b",
    "nss": r"\b\d{11}\b",
}
#: What clears nobody may lift ("block"), and letters that a picture shows in place of digits.
BLOCKING = frozenset({"rfc_person", "voter_key", "clabe", "card", "nss"})
MISREAD = str.maketrans("OILZSGB", "0112568")
MISREAD_CURP = r"\b[A-Z][AEIOUX][A-Z]{2}[0-9OILZSGB]{6}[HMX][A-Z]{2}[B-DF-HJ-NP-TV-Z]{3}[A-Z0-9][0-9OILZSGB]\b"
MISREAD_RFC = r"\b[A-Z&]{4}[0-9OILZSGB]{6}[A-Z0-9]{3}\b"
#: Words of a header line that tells of a list of people.
ROSTER_WORDS = ("EDAD", "DIAGNOSTICO", "CURP", "PADECIMIENTO", "FECHA DE NACIMIENTO")
#: How sure each kind is; a CURP with a wrong check digit and misread identifiers are less so.
SURE = {"rfc_person": 0.9, "rfc_company": 0.8, "voter_key": 0.9, "phone": 0.8, "email": 1.0, "clabe": 1.0, "card": 0.9, "nss": 0.7}
SURE_CURP, SURE_MISREAD = (1.0, 0.6), {"curp": 0.8, "rfc_person": 0.7}
#: Kinds in the order that breaks ties, names and health after identifiers.
KINDS = [*PATTERNS, "person_name", "health_context"]
#: Every identifier has a digit or an at sign.
POSSIBLE = re.compile("[0-9@]")
#: Bytes of the shortest identifier, an address.
SHORTEST = 6
#: In a text not yet folded: six digits with no letter between.
_SIX_APART = re.compile(r"[0-9](?:\W*[0-9]){5}")  # read by both engines: marks that folding drops are no \w in either
#: The kinds that lie in one run of capitals, digits and ampersands with six digits, by the length of such a run without
#: ampersands, which a match then fills; and the kinds in a run of digits and their marks.
_BY_LENGTH, _FIGURE_KINDS = {11: ("nss",), 12: ("rfc_company",), 13: ("rfc_person",), 18: ("curp", "voter_key", "clabe")}, ("phone", "card")
_WORD_KINDS = sum(_BY_LENGTH.values(), ())
_SIX, _WORD_RUN, _FIGURE_RUN = re.compile("[0-9]{6}"), re.compile("[A-Z0-9&]{11,}"), re.compile("[0-9(+][0-9 ()+-]{8,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("severity", pa.string()), ("confidence", pa.float64())]))
SPANS = "array<struct<start:int,end:int,kind:string,severity:string,confidence:double>>"


@dataclass(frozen=True)
class Own:
    """What belongs to the institution itself, and warnings that somebody cleared."""

    phones: frozenset[str] = field(default_factory=frozenset)
    emails: frozenset[str] = field(default_factory=frozenset)
    accounts: frozenset[str] = field(default_factory=frozenset)
    cleared: frozenset[str] = field(default_factory=frozenset)


def folded(text: Column) -> Column:
    """Upper case without accents or combining marks; null texts are empty."""
    return F.translate(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "\\p{Mn}+", "")), SCAN_FROM, SCAN_TO)


def sought(text: Column) -> Column:
    """The folded form of a text that may hold an identifier, as :func:`likely` tells; empty for all others."""
    may = (F.octet_length(text) >= SHORTEST) & (F.contains(text, F.lit("@")) | text.rlike(_SIX_APART.pattern))
    return F.when(may, folded(text)).otherwise("")


def gated(text: Column, kind: str) -> Column:
    """The values of one kind in a folded text that pass its gate (all but phones, whose edges matter)."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gate = {
        "rfc_person": lambda v: plausible_yymmdd(F.substring(v, 5, 6)),
        "rfc_company": lambda v: plausible_yymmdd(F.substring(v, 4, 6)),
        "clabe": clabe_valid,
        "card": card_valid,
        "nss": nss_valid,
    }.get(kind)
    return F.filter(found, gate) if gate else found


def sized(text: Column, *found: Column) -> Column:
    """How many values several lists hold together; none are looked for in an empty text."""
    return F.when(text == "", 0).otherwise(sum(map(F.size, found[1:]), F.size(found[0])))


def counts(docs: DataFrame) -> DataFrame:
    """kind, severity, documents and findings over ``text``, before overlaps are resolved: one pass, one small aggregation."""
    text = docs.select(sought(F.col("text")).alias("t"))
    told = [(k, "block" if k in BLOCKING else "warn", gated(F.col("t"), k)) for k in PATTERNS if k not in ("phone", "curp")]
    curps = gated(F.col("t"), "curp")
    told += [("curp", "block", F.filter(curps, curp_check)), ("curp", "warn", F.filter(curps, lambda v: ~curp_check(v)))]
    per = text.select(*[sized(F.col("t"), found).alias(f"n{i}") for i, (_, _, found) in enumerate(told)])
    sums = per.agg(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.count_if(F.col(f"n{i}") > 0).alias("documents"), F.sum(f"n{i}").alias("findings")).alias(f"n{i}") for i, (k, s, _) in enumerate(told)])
    return sums.select(F.explode(F.array(*sums.columns)).alias("x")).select("x.*")


def roster_header(text: Column) -> Column:
    """Whether a line names people and one of their details, with two separators or more between cells."""

    def heads(line: Column) -> Column:
        marks = F.length(line) - F.length(F.regexp_replace(line, "[\t|;,]", ""))
        gaps = (F.length(line) - F.length(F.replace(line, F.lit("  "), F.lit("")))) / 2
        return (marks + gaps >= 2) & F.contains(line, F.lit("NOMBRE")) & line.rlike("|".join(ROSTER_WORDS))

    return F.exists(F.split(folded(text), "\n"), heads)


def lists_people(text: Column, spans: Column) -> Column:
    """More than five blocking findings, or the header line of a list: such a text is turned away whole."""
    return (F.size(F.filter(spans, lambda s: s["severity"] == "block")) > 5) | roster_header(text)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each character of two bytes its folded form, and whether it is a combining mark."""
    folded, marks = np.arange(1 << 16, dtype=np.uint32), np.zeros(1 << 16, bool)
    for c in (c for c in range(1 << 16) if not 0xD800 <= c < 0xE000):
        upper = chr(c).upper()
        folded[c] = ord(upper) if len(upper) == 1 else c  # letters that upper case makes longer stay as they are
        marks[c] = unicodedata.category(chr(c)) == "Mn"
    for a, b in zip(SCAN_FROM, SCAN_TO, strict=True):
        folded[folded == ord(a)] = ord(b)
    return folded, marks


def fold(text: str) -> tuple[str, list[int] | range]:
    """The folded text, and for each of its characters the place in the original; letters of more than two bytes stay."""
    if text.isascii():
        return text.upper(), range(len(text))
    folded, marks = _tables()
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    small = letters < 1 << 16
    low = np.where(small, letters, 0)
    kept = np.flatnonzero(~(marks[low] & small))
    out = np.where(small, folded[low], letters)[kept].astype("<u4").tobytes().decode("utf-32-le")
    return out, range(len(text)) if len(kept) == len(text) else kept.tolist()


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text, flags=re.ASCII)


def _date(d: str) -> bool:
    month, day = int(d[2:4]), int(d[4:])
    return 1 <= month <= 12 and 1 <= day <= (29 if month == 2 else 30 if month in (4, 6, 9, 11) else 31)


#: For each digit the sum of the digits of its double, and the last digit of three and seven times it.
_DOUBLED, _TRIPLED, _SEVENFOLD = (str.maketrans("0123456789", to) for to in ("0246813579", "0369258147", "0741852963"))


def _sum(digits: str) -> int:
    return sum(map(int, digits))


def _luhn(d: str) -> bool:
    return (_sum(d[::-2]) + _sum(d[-2::-2].translate(_DOUBLED))) % 10 == 0


def _clabe(d: str) -> bool:
    return (_sum(d[:17:3].translate(_TRIPLED)) + _sum(d[1:17:3].translate(_SEVENFOLD)) + _sum(d[2:17:3]) + int(d[17])) % 10 == 0


def _curp(v: str) -> bool:
    return (10 - sum(CURP_ALPHABET.index(c) * (18 - i) for i, c in enumerate(v[:17])) % 10) % 10 == int(v[17])


def strongest(spans: list[tuple]) -> list[tuple]:
    """Of overlapping (start, end, kind, severity, confidence) the blocking ones first, then the longest, then by kind."""
    kept: list[tuple] = []
    for s in sorted(spans, key=lambda s: (s[3] != "block", s[0] - s[1], KINDS.index(s[2]), s[0])):
        at = bisect.bisect(kept, (s[0],))
        if (at == 0 or kept[at - 1][1] <= s[0]) and (at == len(kept) or kept[at][0] >= s[1]):
            kept.insert(at, s)
    return kept


def likely(text: str) -> bool:
    """Whether a text not yet folded may hold an identifier: it has an at sign, or six digits with no letter between."""
    return "@" in text or _SIX_APART.search(text) is not None


def matches(t: str, shapes: dict[str, re.Pattern]) -> Iterator[tuple[str, re.Match]]:
    """Each kind's matches in a folded text, looked for only where one can lie: a match never leaves its run of characters.

    The character behind a run stays in sight, since shapes ask for an edge there.
    """
    runs = [(m.span(), _WORD_KINDS if "&" in m[0] else _BY_LENGTH.get(len(m[0]), ())) for m in _WORD_RUN.finditer(t) if _SIX.search(m[0])] if _SIX.search(t) else []
    runs += [(m.span(), _FIGURE_KINDS) for m in _FIGURE_RUN.finditer(t)]
    for (a, b), kinds in runs:
        for kind in kinds:
            for m in shapes[kind].finditer(t, a, b + 1):
                yield kind, m
    at, last = t.find("@"), 0
    while at >= 0:
        a = at
        while a > last and t[a - 1] in _LOCAL:
            a -= 1
        if m := shapes["email"].match(t, a):
            yield "email", m
            last = m.end()
        at = t.find("@", max(at + 1, last))


def scanner(own: Own = Own(), pictures: bool = False, lists: people.Lists | None = None):
    """A function of a text column: resolved spans; an empty list for null.

    ``pictures`` also reads misread identifiers, ``lists`` of names adds people and words about one person's health.
    """
    shapes = {k: re.compile(p, re.ASCII) for k, p in PATTERNS.items()}
    misread = [("curp", re.compile(MISREAD_CURP, re.ASCII)), ("rfc_person", re.compile(MISREAD_RFC, re.ASCII))]
    phones = {_digits(p)[-10:] for p in own.phones}
    emails = {e.strip().upper() for e in own.emails}
    accounts = [re.compile(r"\b" + "[ -]?".join(_digits(a)) + r"\b", re.ASCII) for a in own.accounts if len(_digits(a)) == 18]
    cleared = {fold(c.strip())[0] for c in own.cleared}

    def judged(kind: str, v: str, before: str, after: str) -> float | None:
        """The confidence in a value, None if its gate turns it away; a CURP with a wrong check digit is told apart by 0.6."""
        if kind == "curp":
            return SURE_CURP[0] if _curp(v) else SURE_CURP[1]
        if kind.startswith("rfc"):
            return SURE[kind] if _date(v[-9:-3]) else None
        if kind == "phone":
            d = _digits(v)
            d = d[2:] if len(d) == 12 and d.startswith("52") else d
            edge = any(c.isalnum() or c in "-_/" for c in before + after)
            return None if edge or len(d) != 10 or d in phones else SURE[kind]
        passes = {"clabe": lambda: _clabe(v), "card": lambda: _luhn(_digits(v)), "nss": lambda: _luhn(v), "email": lambda: v not in emails}
        return SURE[kind] if passes.get(kind, lambda: True)() else None

    def found(t: str):
        for kind, m in matches(t, shapes):
            sure = judged(kind, m[0], t[m.start() - 1 : m.start()] if m.start() else "", t[m.end() : m.end() + 1])
            if sure is not None:
                yield m.start(), m.end(), kind, "block" if kind in BLOCKING or (kind, sure) == ("curp", 1.0) else "warn", sure
        for kind, shape in misread if pictures else ():
            for m in shape.finditer(t):
                v = m[0]
                mended = v[:4] + v[4:10].translate(MISREAD) + v[10:]
                mended = mended[:17] + mended[17:].translate(MISREAD) if kind == "curp" else mended
                right = shapes[kind].fullmatch(mended) and (_curp(mended) if kind == "curp" else _date(mended[4:10]))
                if mended != v and sum(c.isdigit() for c in v[4:10]) >= 4 and right:
                    yield m.start(), m.end(), kind, "block", SURE_MISREAD[kind]

    def scan(text: str | None) -> list[dict]:
        if lists is None and not (POSSIBLE.search if pictures else likely)(text or ""):
            return []
        t, places = fold(text or "")
        mine = [m.span() for a in accounts for m in a.finditer(t)]
        spans = [s for s in (found(t) if POSSIBLE.search(t) else ()) if not any(a <= s[0] and s[1] <= b for a, b in mine)]
        spans = [s for s in spans if s[3] == "block" or t[s[0] : s[1]].strip() not in cleared]
        spans = [(places[a], places[b - 1] + 1, k, s, c) for a, b, k, s, c in spans]
        if lists is not None and text:
            called = people.find_names(text, lambda w: fold(w)[0], lists)
            about = [(*x, "person_name") for x in called] + [(*x, "health_context") for x in people.find_health(t, places, called)]
            spans += [(a, b, k, "warn", c) for a, b, c, k in about if fold(text[a:b].strip())[0] not in cleared]
        return [dict(zip(("start", "end", "kind", "severity", "confidence"), s, strict=True)) for s in strongest(spans)]

    @F.arrow_udf(SPANS)
    def spans(text: pa.Array) -> pa.Array:
        return each(scan, _ARROW_SPANS, text)

    return spans
