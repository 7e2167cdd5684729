"""Mending of what models and scans write wrong: letters written as HTML, digits in place of vowels; and names of places."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tesela.functions.text import SCAN_FROM, SCAN_TO, normal

#: Letters that are written by name, vowels that a digit looks like, and what a place's name says it is.
NAMED = {
    "aacute": "á", "eacute": "é", "iacute": "í", "oacute": "ó", "uacute": "ú", "ntilde": "ñ", "uuml": "ü", "Aacute": "Á", "Eacute": "É", "Iacute": "Í", "Oacute": "Ó", "Uacute": "Ú", "Ntilde": "Ñ", "Uuml": "Ü",
    "iquest": "¿", "iexcl": "¡", "laquo": "«", "raquo": "»", "quot": '"', "apos": "'", "nbsp": " ", "lt": "<", "gt": ">", "amp": "&",
}
LOOKS_LIKE = {"3": "ée", "1": "íi", "0": "óo", "4": "áa"}
ACCENTED = "áéíóú"
PLACE_WORDS = "^(?:MUNICIPIO DE|MUNICIPIO|ALCALDIA|DELEGACION)(?: |$)"

_ENTITY = re.compile("&(#[0-9]{1,7}|[A-Za-z]{1,8});")


def _letter(m: re.Match) -> str:
    name = m[1]
    if name[0] != "#":
        return NAMED.get(name, m[0])
    code = int(name[1:])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


@F.arrow_udf(StringType())
def unescaped(text: pa.Array) -> pa.Array:
    """A text with letters in place of their HTML names and numbers; what is no letter stays, nothing is read twice."""
    return pa.array([t if t is None or "&" not in t else _ENTITY.sub(_letter, t) for t in text.to_pylist()], pa.string())


def mended_word(word: str, known: frozenset[str]) -> str:
    """A word of small letters (a capital may begin it) with one digit inside, as the known word that it stands for.

    The accented vowel that the digit looks like comes first, then the one accented vowel that makes a known word, then the
    plain vowel; a word that none makes known stays.
    """
    at = [i for i, c in enumerate(word) if c in "0123456789"]
    if len(at) != 1 or at[0] == 0 or len(word) < 3:
        return word
    i = at[0]
    rest = word[:i] + word[i + 1 :]
    if not (rest[0].islower() or rest[0].isupper()) or not all(c.islower() for c in rest[1:]):
        return word
    made = lambda v: word[:i] + v + word[i + 1 :]
    accented, plain = LOOKS_LIKE.get(word[i], ("", ""))
    others = [v for v in ACCENTED if made(v).lower() in known]
    for v in [accented] if accented and made(accented).lower() in known else others if len(others) == 1 else [plain] if plain and made(plain).lower() in known else []:
        return made(v)
    return word


@F.arrow_udf(StringType())
def mended(text: pa.Array, known: pa.Array) -> pa.Array:
    """A text with :func:`mended_word` for each word, by the known words (small letters) of its row."""

    def mend(t: str | None, words: list[str] | None) -> str | None:
        if t is None or not re.search(r"[^\W\d_][0-9]", t):
            return t
        there = frozenset(words or [])
        return re.sub(r"[^\W_]+", lambda m: mended_word(m[0], there), t)

    return pa.array([mend(*r) for r in zip(text.to_pylist(), known.to_pylist(), strict=True)], pa.string())


def whole_units(text: Column) -> Column:
    """The normal forms of a text's lines and cells (between bars), each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n|[|]"), normal), lambda u: u != ""))


def place_key(name: Column) -> Column:
    """A place's name as it is read: capitals without accents, words one blank apart, without the word that says what it is."""
    folded = F.translate(F.upper(F.regexp_replace(name, "\\p{Mn}+", "")), SCAN_FROM, SCAN_TO)
    words = F.trim(F.regexp_replace(folded, "[^\\p{L}\\p{N}]+", " "))
    return F.trim(F.regexp_replace(words, PLACE_WORDS, ""))


def resolved_places(said: DataFrame, catalog: DataFrame) -> DataFrame:
    """``said`` (state, place, ...) with ``official``: the one name of ``catalog`` (state, name) that reads the same, in its state
    where that is known; null where none does or several do.

    Names are counted by key before they are joined, so the join adds no rows; a place said in most rows is dealt by Spark's
    own handling of skew, since both sides are keyed.
    """
    keyed = catalog.select("state", "name", place_key(F.col("name")).alias("_key")).filter("_key <> ''")
    one = lambda rows: F.when(F.count_distinct("name") == 1, F.min("name"))
    by_state = keyed.groupBy(F.col("state").alias("_state"), "_key").agg(one(keyed).alias("_there"))
    anywhere = keyed.groupBy("_key").agg(one(keyed).alias("_anywhere"))
    asked = said.withColumn("_key", place_key(F.col("place")))
    met = asked.join(anywhere, "_key", "left").join(by_state.withColumnRenamed("_key", "_k"), (F.col("_key") == F.col("_k")) & (F.col("state") == F.col("_state")), "left")
    return met.withColumn("official", F.when(F.col("state").isNull(), F.col("_anywhere")).otherwise(F.col("_there"))).drop("_key", "_k", "_state", "_there", "_anywhere")


def education_range(code: Column) -> Column:
    """basic, high_school_or_technical or higher; null for other codes."""
    return F.when(code.isin("none", "primary", "secondary"), "basic").when(code.isin("high_school", "technical"), "high_school_or_technical").when(code.isin("bachelor", "postgraduate"), "higher")


def balance_word(balance: Column) -> Column:
    """A balance as a word, which tells no amount: deficit, even or surplus; null where it isn't known."""
    return F.when(balance < 0, "deficit").when(balance == 0, "even").when(balance > 0, "surplus")


def snapshots(taken: DataFrame, figures: list[str], balance: str, order: list[Column] | None = None) -> DataFrame:
    """id, month, taken_at and figures_json of ``taken`` (id, at, ...): the last of each month, its figures as JSON in order.

    The balance is in it as a word.  A later one of a month takes the place of those before.  Of several taken at one moment
    the first by ``order`` stays, as none of the others is later.  Each task keeps one of a month before they are brought
    together, so a hot one is no task's work.
    """
    told = F.to_json(F.struct(*[F.col(f) for f in figures], balance_word(F.col(balance)).alias("balance")), {"ignoreNullFields": "false"})
    first = [c.alias(f"_{i}") for i, c in enumerate(order or [])]
    rows = taken.select("id", F.date_format("at", "yyyy-MM").alias("month"), F.col("at").alias("taken_at"), told.alias("figures_json"), *first)
    newest = Window.partitionBy("id", "month").orderBy(F.desc("taken_at"), *[f"_{i}" for i in range(len(first))], F.desc("figures_json"))
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select("id", "month", "taken_at", "figures_json")
