"""Figures in text: which numbers a text states, and which of them no source holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words that a source may use in place of digits.
NUMBER_WORDS = {
    "cero": 0, "uno": 1, "una": 1, "un": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10,
    "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "dieciseis": 16, "diecisiete": 17, "dieciocho": 18, "diecinueve": 19,
    "veinte": 20, "veintiuno": 21, "veintidos": 22, "veintitres": 23, "veinticuatro": 24, "veinticinco": 25,
    "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90, "cien": 100, "ciento": 100, "mil": 1000,
}


def stated(text: Column) -> Column:
    """The distinct numbers written with digits: a separator before exactly three digits groups thousands, another point
    or comma begins the decimals; zeros that say nothing are cut."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]+(?:[,. ][0-9]{3}(?![0-9]))*(?:[,.][0-9]+)?"), F.lit(0))

    def plain(n: Column) -> Column:
        n = F.regexp_replace(n, "[,. ]([0-9]{3})(?![0-9])", "$1")
        n = F.regexp_replace(F.translate(n, ",", "."), "^0+(?=[0-9])", "")
        return F.regexp_replace(F.regexp_replace(n, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")

    return F.array_distinct(F.transform(found, plain))


def supported(text: Column) -> Column:
    """What a source states, number words included."""
    words = F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), "áéíóúü", "aeiouu"), "[^\\p{L}]+")
    value = F.create_map(*[F.lit(x) for word, n in NUMBER_WORDS.items() for x in (word, str(n))])
    return F.array_union(stated(text), F.array_compact(F.transform(words, lambda w: value[w])))


def unsupported(output: Column, *sources: Column) -> Column:
    """The figures of ``output`` that no source states, sorted."""
    allowed = supported(sources[0])
    for s in sources[1:]:
        allowed = F.array_union(allowed, supported(s))
    return F.array_sort(F.array_except(stated(output), allowed))
