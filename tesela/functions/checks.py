"""Checksums and shapes of identifiers, as Column expressions that stay inside Spark's engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabets over which the check digits are defined.
CURP_ALPHABET = "0123456789ABCDEFGHIJKLMNÑOPQRSTUVWXYZ"
RFC_ALPHABET = "0123456789ABCDEFGHIJKLMN&OPQRSTUVWXYZ Ñ"
#: Codes of the states of birth.
STATES = "AS BC BS CC CL CM CS CH DF DG GT GR HG JC MC MN MS NT NL OC PL QT QR SP SL SR TC TS TL VZ YN ZS NE".split()


def compact(text: Column) -> Column:
    """An identifier as it is stored: without blanks and hyphens, in capitals."""
    return F.upper(F.regexp_replace(text, "[\\s-]", ""))


def weighted(text: Column, alphabet: str, weights: list[int], modulus: int | None = None) -> Column:
    """The sum of each character's place in ``alphabet`` times its weight, each product modulo ``modulus`` if given."""
    terms = [(F.position(F.substring(text, i + 1, 1), F.lit(alphabet)) - 1) * w for i, w in enumerate(weights)]
    terms = [t % modulus for t in terms] if modulus else terms
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def nss_valid(text: Column) -> Column:
    """Eleven digits whose last is a Luhn digit; blanks and hyphens don't count."""
    text = compact(text)
    return text.rlike("^[0-9]{11}$") & luhn(text)


def card_valid(text: Column) -> Column:
    digits = F.regexp_replace(text, "[ -]", "")
    return digits.rlike("^[0-9]{13,19}$") & luhn(digits)


def clabe_valid(text: Column) -> Column:
    """Eighteen digits; the last makes the sum of the others, weighted 3, 7, 1 modulo 10, a multiple of ten."""
    text = compact(text)
    total = weighted(text, "0123456789", [(3, 7, 1)[i % 3] for i in range(17)], 10)
    return text.rlike("^[0-9]{18}$") & ((10 - total % 10) % 10 == F.substring(text, 18, 1).cast("int"))


def plausible_yymmdd(text: Column) -> Column:
    """A month and a day of it; 29 February passes in any year."""
    month, day = F.substring(text, 3, 2).cast("int"), F.substring(text, 5, 2).cast("int")
    most = F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return text.rlike("^[0-9]{6}$") & month.between(1, 12) & day.between(1, 31) & (day <= most)


def month_and_day(text: Column) -> Column:
    """YYMMDD with a month of 1 to 12 and a day of 1 to 31, whatever the month."""
    return text.rlike("^[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$")


def curp_check(text: Column) -> Column:
    """The check digit alone; the shape is left to the pattern that found the text."""
    total = weighted(text, CURP_ALPHABET, list(range(18, 1, -1)))
    return F.when(text.rlike("^[0-9A-ZÑ]{17}[0-9]$"), (10 - total % 10) % 10 == F.substring(text, 18, 1).try_cast("int")).otherwise(False)


def curp_valid(text: Column) -> Column:
    """Shape, state, month and day, and check digit, of the compact form."""
    text = compact(text)
    shape = text.rlike("^[A-ZÑ]{4}[0-9]{6}[HMX][A-Z]{2}[A-ZÑ]{3}[0-9A-Z][0-9]$")
    return shape & F.substring(text, 12, 2).isin(STATES) & month_and_day(F.substring(text, 5, 6)) & curp_check(text)


def curp_birth(text: Column) -> Column:
    """Year of the century, month and day that a CURP tells, as a struct; null where they aren't digits."""
    text = compact(text)
    part = lambda at: F.substring(text, at, 2).try_cast("int")
    return F.when(F.substring(text, 5, 6).rlike("^[0-9]{6}$"), F.struct(part(5).alias("year"), part(7).alias("month"), part(9).alias("day")))


def rfc_valid(text: Column) -> Column:
    """A person's: four letters, a date and three characters of which the last is modulo 11 of the rest; of the compact form."""
    text = compact(text)
    rest = weighted(text, RFC_ALPHABET, list(range(13, 1, -1))) % 11
    check = F.when(rest == 0, "0").when(rest == 1, "A").otherwise((11 - rest).cast("string"))
    return text.rlike("^[A-ZÑ&]{4}[0-9]{6}[A-Z0-9]{3}$") & month_and_day(F.substring(text, 5, 6)) & (check == F.substring(text, 13, 1))


def organisation_rfc_valid(text: Column) -> Column:
    return text.rlike("^[A-ZÑ&]{3}[0-9]{6}[A-Z0-9]{3}$") & F.try_to_timestamp(F.concat(F.lit("20"), F.substring(text, 4, 6)), F.lit("yyyyMMdd")).isNotNull()


def masked(text: Column, head: int, tail: int) -> Column:
    """The first and last characters of the compact form with bullets between; short texts are bullets only."""
    text = compact(text)
    n = F.length(text)
    return F.when(n <= head + tail, F.repeat(F.lit("•"), n)).otherwise(F.concat(F.left(text, F.lit(head)), F.repeat(F.lit("•"), n - head - tail), F.right(text, F.lit(tail))))
