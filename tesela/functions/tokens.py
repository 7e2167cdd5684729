"""Readers of Spanish numbers, dates, amounts and lengths of time over the tokens of one text.

A text is cut once into words, runs of digits and single marks; every reader looks at tokens and their neighbours.  These
are the per-row helpers of the Arrow functions in :mod:`tesela.functions.readings`.
"""

from __future__ import annotations

import calendar
import re
from typing import NamedTuple

from tesela.functions.figures import NUMBER_WORDS

#: The months, number words beyond those of figures, and how scans misread the word for year.
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
MORE_WORDS = {
    "primero": 1, "primer": 1, "veintiun": 21, "veintiseis": 26, "veintisiete": 27, "veintiocho": 28, "veintinueve": 29,
    "doscientos": 200, "trescientos": 300, "cuatrocientos": 400, "quinientos": 500, "seiscientos": 600, "setecientos": 700,
    "ochocientos": 800, "novecientos": 900,
}
YEAR_WORDS = {"año", "ano", "afio", "aho", "ario", "arìo"}
UNITS = {"año": "years", "años": "years", "ano": "years", "anos": "years", "mes": "months", "meses": "months", "semana": "weeks", "semanas": "weeks", "dia": "days", "dias": "days"}
MULTIPLIERS = {"mil": 1e3, "millon": 1e6, "millones": 1e6}
RANGE_WORDS = ("al", "a", "-", "–", "—")

NUMBERS = {w: n for w, n in (NUMBER_WORDS | MORE_WORDS).items() if w not in ("cero", "mil")}
_MONTH = {m: i + 1 for i, m in enumerate(MONTHS)} | {"setiembre": 9}
#: Months as calendars shorten them, too: three letters, or four for September.
_SHORT = _MONTH | {m[:3]: i + 1 for i, m in enumerate(MONTHS)} | {"sept": 9, "set": 9}
_FOLD = str.maketrans("áàäéèëíïóòöúùü", "aaaeeeiiooouuu")  # ì stays: a misreading of year has it
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\S")
#: A run of at most 99 digits; groups of three follow one of at most three.
_WHOLE = re.compile(r"(?<!\d)(?:\d{1,3}(?!\d)(?:,\d{3}(?!\d))*|\d{4,99}(?!\d))")


class Tokens:
    """The folded tokens of a text, where each begins and ends, and whether it is a number."""

    def __init__(self, text: str):
        self.text = text.lower().translate(_FOLD)
        spans = [m.span() for m in _TOKEN.finditer(self.text)]
        self.word = [self.text[a:b] for a, b in spans]
        self.start = [a for a, _ in spans]
        self.end = [b for _, b in spans]

    def __len__(self) -> int:
        return len(self.word)

    def at(self, i: int) -> str:
        return self.word[i] if 0 <= i < len(self.word) else ""

    def digits(self, i: int, most: int = 99, least: int = 1) -> bool:
        w = self.at(i)
        return w.isdecimal() and least <= len(w) <= most

    def letters(self, i: int) -> bool:
        return self.at(i).isalpha()

    def glued(self, i: int) -> bool:
        """Whether nothing stands between a token and the one before it."""
        return 0 < i < len(self.word) and self.start[i] == self.end[i - 1]

    def edged(self, i: int, j: int) -> bool:
        """Whether tokens ``i`` to ``j`` (exclusive) neither continue a word or number nor are continued by one."""
        joined = lambda k: self.glued(k) and all(w.isalnum() or w == "_" for w in (self.at(k - 1), self.at(k)))
        return not joined(i) and not joined(j)


def in_words(words: list[str]) -> int | None:
    """The number that these words say: "y" is skipped, "mil" multiplies what stands before it; None for any other word."""
    words = [w for w in words if w != "y"]
    if not words or not all(w == "mil" or w in NUMBERS for w in words):
        return None
    total = 0
    while "mil" in words:
        cut = words.index("mil")
        total += 1000 * max(1, sum(NUMBERS[w] for w in words[:cut]))
        words = words[cut + 1 :]
    return total + sum(NUMBERS[w] for w in words)


def leading(words: list[str]) -> int | None:
    """The number at the start of a list of words."""
    size = next((i for i, w in enumerate(words) if w not in ("y", "mil") and w not in NUMBERS), len(words))
    return in_words(words[:size])


class Figure(NamedTuple):
    value: float
    after: int  # the token behind it
    grouped: bool


def figure(t: Tokens, i: int) -> Figure:
    """The number in digits that begins at token ``i``.

    One blank or comma between one to three digits and groups of three sets thousands apart, then a point begins decimals.
    Without groups a point begins decimals, and so does a comma before one or two digits; before more it is dropped.
    """
    digits, j, grouped = t.word[i], i + 1, False
    while len(t.word[i]) <= 3:
        comma = t.at(j) == "," and t.glued(j) and t.glued(j + 1)
        k = j + 1 if comma else j
        if not t.digits(k, 3, 3) or not (comma or t.text[t.end[j - 1] : t.start[k]] == " "):
            break
        digits, j, grouped = digits + t.word[k], k + 1, True
    if t.glued(j) and t.glued(j + 1) and t.digits(j + 1) and t.at(j) in ([".", ","] if not grouped else ["."]):
        decimal = t.word[j] == "." or len(t.word[j + 1]) <= 2
        digits, j = digits + ("." if decimal else "") + t.word[j + 1], j + 2
    return Figure(float(digits), j, grouped)


def amount(text: str, pesos: bool) -> tuple[float, str] | None:
    """Value and currency of the first number with a mark, a multiplier or groups; any number in a text about pesos or of it alone."""
    t = Tokens(text)
    i, about = 0, "peso" in t.text
    while i < len(t):
        if not t.digits(i):
            i += 1
            continue
        value, j, grouped = figure(t, i)
        times = MULTIPLIERS.get(t.at(j))
        end = j + (times is not None)
        if not t.edged(end, end):  # letters go on where the number ends: "12km"
            i += 1
            continue
        if times or grouped or about or (i and t.word[i - 1] in "$€") or (i, end) == (0, len(t)) and t.text == t.text.strip():
            return value * (times or 1), currency(t.text, pesos)
        i = end
    return None


def currency(folded: str, pesos: bool) -> str:
    """USD, EUR or MXN by the marks of a text, a bare ``$`` being pesos where ``pesos`` says so; XXX otherwise."""
    marks = [("USD", ("us$", "usd", "dolar")), ("EUR", ("eur", "€")), ("MXN", ("mxn", "pesos", "m.n", *(["$"] if pesos else [])))]
    return next((code for code, said in marks if any(m in folded for m in said)), "XXX")


def percent(text: str) -> float | None:
    """The first number before ``%`` or "por ciento", in figures or else in words; None above 100."""
    t = Tokens(text)
    signs = [i for i in range(len(t)) if t.word[i] == "%" or t.word[i] == "porciento" or (t.word[i] == "por" and t.at(i + 1) == "ciento")]
    value = next((v for v in (_figure_before(t, i) for i in signs) if v is not None), None)
    if value is None:
        spoken = [i for i in signs if t.word[i] != "%" and t.letters(i - 1)]
        value = next((v for v in (_words_before(t, i) for i in spoken[:1]) if v is not None), None)
    return value if value is not None and value <= 100 else None


def _figure_before(t: Tokens, i: int) -> float | None:
    """The number in digits that ends right before token ``i``."""
    if not t.digits(i - 1):
        return None
    first = i - 1
    while t.glued(first) and t.glued(first - 1) and t.at(first - 1) in ("." , ",") and t.digits(first - 2) and first - 2 >= i - 3:
        first -= 2
    found = figure(t, first)
    return found.value if found.after == i else float(t.word[i - 1])


def _words_before(t: Tokens, i: int) -> float | None:
    """The number in words that ends right before token ``i``: two of them with "y" between, or one."""
    if t.at(i - 2) == "y" and t.letters(i - 3) and not t.glued(i - 1) and not t.glued(i - 2):
        both = in_words(t.word[i - 3 : i])
        if both is not None:
            return float(both)
    one = in_words([t.at(i - 1)]) if t.at(i - 1) != "y" else None
    return None if one is None else float(one)


def duration(text: str) -> tuple[float, str] | None:
    """Value and unit of the first length of time above zero."""
    t = Tokens(text)
    for i, unit in [(i, UNITS[w]) for i, w in enumerate(t.word) if w in UNITS]:
        if i and not t.glued(i) and t.edged(i, i + 1):
            value = _figure_before(t, i) if t.digits(i - 1) else _words_before(t, i)
            if value:
                return value, unit
    return None


def whole(text: str) -> int | None:
    """The first whole number in figures (groups after commas), else the first word that is a number."""
    if found := _WHOLE.search(text):
        return int(found[0].replace(",", ""))
    return next((NUMBERS.get(w, 1000) for w in text.lower().translate(_FOLD).split() if w in NUMBERS or w == "mil"), None)


def _iso(year: int | None, month: int | None, day: int | None) -> str | None:
    """The day of the calendar between 1900 and 2100."""
    if not (year and month and day and 1900 <= year <= 2100 and month <= 12 and day <= calendar.monthrange(year, month)[1]):
        return None
    return f"{year:04d}-{month:02d}-{day:02d}"


def _spelled(t: Tokens, i: int) -> tuple[int, int] | None:
    """Day and year in words around the month at token ``i``: "diez días del mes de marzo de dos mil quince"."""
    after = i + 1 + (t.at(i + 1) == "de")
    if after == i + 1 and t.at(after) == "del" and t.at(after + 1) in YEAR_WORDS:
        after += 2
    said = []
    while len(said) < 6 and t.letters(after + len(said)):
        said.append(t.word[after + len(said)])
    thousand = said.index("mil") if "mil" in said[:2] else -1
    if after == i + 1 or thousand < 0 or (thousand == 1 and said[0] != "dos"):
        return None
    said = said[: thousand + 5]
    year = next((y for y in (in_words(said[:n]) for n in range(len(said), 0, -1)) if y and 1800 <= y <= 2100), None)
    last = i - 1  # of "de"
    if [t.at(last - 3).rstrip("s"), *t.word[max(0, last - 2) : last]] == ["dia", "del", "mes"]:
        last -= 3
    words = []
    while len(words) < 3 and t.letters(last - 1 - len(words)):
        words.insert(0, t.word[last - 1 - len(words)])
    day = next((d for d in (in_words(words[n:]) for n in range(len(words))) if d and d <= 31), None)
    return (day, year) if day and year else None


def dates(text: str) -> list[str]:
    """ISO dates of "14 de marzo de 2017", "10/03/2015" and of dates in words, in the text's order, equal neighbours once."""
    t = Tokens(text)
    found: list[tuple[int, str | None]] = []
    for i in [i for i, w in enumerate(t.word) if w == "/" or w in _MONTH]:
        w = t.word[i]
        if w == "/" and t.digits(i - 1, 2) and t.digits(i + 1, 2) and t.at(i + 2) == "/" and t.digits(i + 3, 4, 4) and all(map(t.glued, range(i, i + 4))) and t.edged(i - 1, i + 4):
            found.append((i - 1, _iso(int(t.word[i + 3]), int(t.word[i + 1]), int(t.word[i - 1]))))
        elif w in _MONTH and t.at(i - 1) == "de":
            if t.digits(i - 2, 2) and t.at(i + 1) in ("de", "del") and t.digits(i + 2, 4, 4) and t.edged(i - 2, i + 3):
                found.append((i - 2, _iso(int(t.word[i + 2]), _MONTH[w], int(t.word[i - 2]))))
            elif spelled := _spelled(t, i):
                found.append((i - 2, _iso(spelled[1], _MONTH[w], spelled[0])))
    days = [d for _, d in found if d]
    return [d for k, d in enumerate(days) if k == 0 or days[k - 1] != d]


class Day(NamedTuple):
    """A day as a text gives it: perhaps without a year, or without a day of the month."""

    year: int | None
    month: int
    day: int | None

    def real(self) -> bool:
        longest = 29 if self.month == 2 else 30 if self.month in (4, 6, 9, 11) else 31
        return 1 <= self.month <= 12 and (self.day is None or 1 <= self.day <= longest)


class Span(NamedTuple):
    """Days between two tokens (the second exclusive): one day, or the first and the last of a range."""

    first: int
    after: int
    start: Day
    end: Day | None


def _year(t: Tokens, i: int, joints: tuple[tuple[str, ...], ...]) -> tuple[int | None, int]:
    """A year of four digits at token ``i`` behind one of some joints, and the token behind it."""
    for joint in joints:
        at = i + len(joint)
        if tuple(t.word[i:at]) == joint and t.digits(at, 4, 4):
            return int(t.word[at]), at + 1
    return None, i


_OF, _OF_OR_COMMA, _COMMA_OF = ((("de",), ("del",), ())), (("de",), ("del",), (",",), ()), ((",", "de"), (",",), ("de",), ())


def _point(t: Tokens, i: int) -> int:
    return i + (t.at(i) == ".")


def _days_at(t: Tokens, i: int, form: str) -> Span | None:
    """The days that begin at token ``i``, written in one form; None if that form doesn't begin there."""
    number = lambda k: int(t.word[k])
    if form in ("iso", "figures"):
        marks, sizes, order = (("-",), (4, 2, 2), (0, 2, 4)) if form == "iso" else (("/", ".", "-"), (2, 2, 4), (4, 2, 0))
        exact = [form == "iso", form == "iso", True]
        parts = all(t.digits(i + 2 * n, size, size if whole_ else 1) for n, (size, whole_) in enumerate(zip(sizes, exact, strict=True)))
        if parts and t.at(i + 1) in marks and t.at(i + 3) in marks and all(map(t.glued, range(i + 1, i + 5))) and t.edged(i, i + 5):
            y, m, d = (number(i + k) for k in order)
            return Span(i, i + 5, Day(y, m, d), None)
        return None
    if t.glued(i) and t.at(i - 1).isalnum():
        return None
    if form in ("days of month", "day of month"):
        j = i + 1
        last = None
        if form == "days of month":
            if t.at(j) not in RANGE_WORDS or not t.digits(j + 1, 2):
                return None
            last, j = j + 1, j + 2
        j += t.at(j) == "de"
        if not t.digits(i, 2) or t.at(j) not in _SHORT:
            return None
        year, after = _year(t, _point(t, j + 1), _OF if last else _OF_OR_COMMA)
        month = _SHORT[t.word[j]]
        return Span(i, after, Day(year, month, number(i)), Day(year, month, number(last)) if last else None)
    if t.at(i) not in _SHORT:
        return None
    month, j = _SHORT[t.word[i]], _point(t, i + 1)
    if form == "month of year":
        year, after = _year(t, j, _OF)
        return Span(i, after, Day(year, month, None), None) if year else None
    if not t.digits(j, 2):
        return None
    if form == "month days":
        if t.at(j + 1) not in RANGE_WORDS or not t.digits(j + 2, 2):
            return None
        year, after = _year(t, j + 3, _COMMA_OF)
        return Span(i, after, Day(year, month, number(j)), Day(year, month, number(j + 2)))
    year, after = _year(t, j + 1, _COMMA_OF)
    return Span(i, after, Day(year, month, number(j)), None)


#: Forms of days in the order in which they win where they overlap, and where they begin: so far before a mark or a month.
FORMS = {"iso": (1,), "figures": (1,), "days of month": (4, 3), "month days": (0,), "day of month": (2, 1), "month day": (0,), "month of year": (0,)}


def days(t: Tokens) -> list[Span]:
    """Days and ranges of days of a text in its order; a day, "al" and a day are one range, in which the first takes over the
    second's year, or the one before it when its month is later."""
    found: list[Span] = []
    marks = [i for i, w in enumerate(t.word) if w in ("-", "/", ".") and t.digits(i - 1)]
    months = [i for i, w in enumerate(t.word) if w in _SHORT]
    for form, before in FORMS.items():
        after = 0
        for i in sorted({at - n for at in (marks if before == (1,) else months) for n in before}):
            span = _days_at(t, i, form) if i >= after else None
            if span is None:
                continue
            after = span.after
            if span.start.real() and (span.end is None or span.end.real()) and not any(s.first < span.after and span.first < s.after for s in found):
                found.append(span)
    out: list[Span] = []
    for s in sorted(found):
        last = out[-1] if out else None
        between = tuple(t.word[last.after : s.first]) if last else ()
        joint = between in {("hasta",), ("hasta", "el"), *((w,) for w in RANGE_WORDS)}
        if last and joint and last.end is None and s.end is None and last.start.day and s.start.day:
            year = last.start.year or (s.start.year and s.start.year - (last.start.month > s.start.month))
            out[-1] = Span(last.first, s.after, last.start._replace(year=year), s.start)
        else:
            out.append(s)
    return out


def hour(t: Tokens) -> str | None:
    """The first time of day, as ``HH:MM``."""
    for i in [i for i, w in enumerate(t.word) if w == ":"]:
        if t.glued(i) and t.glued(i + 1) and t.digits(i - 1, 2) and t.digits(i + 1, 2, 2) and t.edged(i - 1, i + 2) and int(t.word[i - 1]) < 24 and int(t.word[i + 1]) < 60:
            return f"{int(t.word[i - 1]):02d}:{t.word[i + 1]}"
    return None


def told(day: Day, time: str | None, usual: int | None) -> dict:
    """date, time, precision (day, month, unreadable) and inferred: whether the year is the usual one, for want of another."""
    year = day.year or usual
    if year is None:
        return {"date": None, "time": None, "precision": "unreadable", "inferred": False}
    inferred = day.year is None
    if day.day is None:
        return {"date": None, "time": None, "precision": "month", "inferred": inferred}
    return {"date": f"{year:04d}-{day.month:02d}-{day.day:02d}", "time": time, "precision": "day", "inferred": inferred}


def date(text: str, usual: int | None) -> dict | None:
    """The first day of a text, the first of a range."""
    t = Tokens(text)
    found = days(t)
    return told(found[0].start, hour(t), usual) if found else None


def milestone(start: str, end: str | None, quote: str, usual: int | None) -> dict | None:
    """start and end: what was said to be the start may hold the whole range, and the quote what neither holds."""
    around = Tokens(quote)
    source = Tokens(start) if start.strip() else around
    found = days(source) or days(around)
    if not found:
        return None
    first = found[0]
    if end and end.strip():
        closing = days(Tokens(end))
        last = told(closing[0].start, None, usual) if closing else None
    else:
        last = first.end and told(first.end._replace(year=first.end.year or first.start.year), None, usual)
    return {"start": told(first.start, hour(source) or hour(around), usual), "end": last}
