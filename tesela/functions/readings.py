"""What Spanish texts say in words and figures: numbers, dates, amounts, shares and lengths of time, as Column expressions.

What takes looking at several words at once is read by Arrow functions over the tokens of each text, what is a matter of
shape by expressions.  Null texts give null.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tesela.functions import tokens
from tesela.functions.arrow import each
from tesela.functions.tokens import MONTHS  # noqa: F401

#: The banks of the first three digits of a CLABE, and words that belong to the surname after them.
BANKS = {
    "002": "Banamex", "012": "BBVA", "014": "Santander", "021": "HSBC", "030": "BanBajío", "036": "Inbursa", "044": "Scotiabank",
    "058": "Banregio", "062": "Afirme", "072": "Banorte", "127": "Banco Azteca", "137": "BanCoppel", "166": "Banco del Bienestar",
    "638": "Nu México", "646": "STP", "722": "Mercado Pago",
}
PARTICLES = ["de", "del", "la", "las", "los", "y", "san", "santa"]
_DAY = pa.struct([("date", pa.string()), ("time", pa.string()), ("precision", pa.string()), ("inferred", pa.bool_())])


def _lookup(entries: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])[key]


_AMOUNT = pa.struct([("value", pa.float64()), ("currency", pa.string())])
_TIME = pa.struct([("value", pa.float64()), ("unit", pa.string())])
_SPAN = pa.struct([("start", _DAY), ("end", _DAY)])
_DATES, _SPANS = pa.list_(pa.string()), pa.list_(_SPAN)


def _reader(kind: pa.DataType) -> Callable:
    """Makes an Arrow function of columns that gives values of a type."""
    return F.arrow_udf(from_arrow_type(kind))


def _each(read: Callable, arrow: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``read`` of each row whose first value is not null."""
    return each(lambda *r: None if r[0] is None else read(*r), arrow, *columns)


@_reader(pa.int64())
def number_in_words(text: pa.Array) -> pa.Array:
    """A number up to the thousands ("dos mil veintisiete"); null when a word is none of a number."""
    return _each(lambda t: tokens.in_words(_words(t)), pa.int64(), text)


@_reader(pa.int64())
def leading_number_in_words(text: pa.Array) -> pa.Array:
    """The number at the start of a text, up to the first word that is not part of one."""
    return _each(lambda t: tokens.leading(_words(t)), pa.int64(), text)


def _words(text: str) -> list[str]:
    return text.lower().translate(str.maketrans("áéíóúü", "aeiouu")).split()


@_reader(_DATES)
def dates_in(text: pa.Array) -> pa.Array:
    """ISO dates of "14 de marzo de 2017", "10/03/2015" and dates in words, in the text's order, equal neighbours once."""
    return _each(tokens.dates, _DATES, text)


@_reader(_AMOUNT)
def amount(text: pa.Array, pesos: pa.Array) -> pa.Array:
    """struct(value, currency) of the first number with a currency mark, a multiplier or groups of three; null without any.

    In a text that speaks of pesos, or is nothing but the number, a plain number is an amount too.  ``pesos`` says whether
    a bare ``$`` means pesos.
    """
    named = lambda t, p: (found := tokens.amount(t, bool(p))) and {"value": found[0], "currency": found[1]}
    return _each(named, _AMOUNT, text, pesos)


@_reader(pa.float64())
def percent(text: pa.Array) -> pa.Array:
    """A share of at most 100, in figures or words before ``%`` or "por ciento"."""
    return _each(tokens.percent, pa.float64(), text)


@_reader(_TIME)
def duration(text: pa.Array) -> pa.Array:
    """struct(value, unit: years, months, weeks or days) of the first length of time above zero; null without any."""
    named = lambda t: (found := tokens.duration(t)) and {"value": found[0], "unit": found[1]}
    return _each(named, _TIME, text)


@_reader(pa.int64())
def whole(text: pa.Array) -> pa.Array:
    """The first whole number in figures, else the first word that is a number."""
    return _each(tokens.whole, pa.int64(), text)


@_reader(_SPANS)
def spans_of_days(text: pa.Array, year: pa.Array) -> pa.Array:
    """Every day and range of days of a text, in seven forms, in its order; ``year`` is taken where a day has none."""

    def read(t: str, usual: int | None) -> list[dict]:
        return [{"start": tokens.told(s.start, None, usual), "end": s.end and tokens.told(s.end._replace(year=s.end.year or s.start.year), None, usual)} for s in tokens.days(tokens.Tokens(t))]

    return _each(read, _SPANS, text, year)


@_reader(_DAY)
def day_of(text: pa.Array, year: pa.Array) -> pa.Array:
    """struct(date, time, precision, inferred) of the first day of a text, the first of a range; null without any."""
    return _each(tokens.date, _DAY, text, year)


@_reader(_SPAN)
def milestone(start: pa.Array, end: pa.Array, quote: pa.Array, year: pa.Array) -> pa.Array:
    """struct(start, end) of a milestone: ``start`` may hold the whole range, ``quote`` what neither holds; null without a day."""
    read = lambda s, e, q, y: tokens.milestone(s, e, q or "", y)
    return _each(read, _SPAN, start, end, quote, year)


def mentions_pesos(text: Column) -> Column:
    return F.coalesce(text.rlike("(?iu)(?<![\\p{L}\\p{N}_])pesos(?![\\p{L}\\p{N}_])|M\\.\\s?N\\.|(?<![\\p{L}\\p{N}_])MXN(?![\\p{L}\\p{N}_])"), F.lit(False))


def bank(clabe: Column) -> Column:
    """The bank of an account number by its first three digits; null for others."""
    return _lookup(BANKS, F.substring(F.regexp_replace(clabe, "[\\s-]", ""), 1, 3))


def phone_like(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", "")).between(10, 13)


def email_like(text: Column) -> Column:
    return F.trim(text).rlike("^[^@\\s]+@(?![.])(?=[^@\\s]*[.])[^@\\s]*[^@\\s.]$")


def zip_like(text: Column) -> Column:
    return F.trim(text).rlike("^[0-9]{5}$")


def split_name(full: Column) -> Column:
    """struct(names, first, second): the last two words with the particles before each are surnames, one name stays."""
    p = "|".join(PARTICLES)
    before, word = f"(?:(?:{p})\\s+)*", f"(?!(?:{p})\\s)\\S+"
    t = F.regexp_replace(F.trim(full), "\\s+", " ")
    two = f"(?i)^({before}{word})\\s+({before}\\S+)$"
    three = f"(?i)^((?:\\S+\\s+)*{word})\\s+({before}{word})\\s+({before}\\S+)$"
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    pair = t.rlike(two)
    triple = t.rlike(three) & ~pair
    return F.struct(
        F.when(triple, part(three, 1)).when(pair, part(two, 1)).otherwise(t).alias("names"),
        F.when(triple, part(three, 2)).when(pair, part(two, 2)).alias("first"),
        F.when(triple, part(three, 3)).alias("second"),
    )
