"""Marks in place of personal data, the same for the same value in one errand (scope), and back.

A vault is a table (scope, mark, word, key, value).  Marking a text needs the values it may hold, not its errand's: texts
and values meet on all words of a value, so that a hot scope is no task's work, and a text gets the few values whose words
it holds in their order.  Revealing joins the marks that a text holds.  Values never leave these tables.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from tesela.functions.arrow import each
from tesela.operators import ordered
from tesela.operators.scanner import fold, folded
from tesela.sources.shared import written

#: The word of each kind's mark, what it is in the legend, and the label of what is never revealed.
WORDS = {
    "person_name": "NOMBRE", "email": "CORREO", "phone": "TELEFONO", "rfc_person": "RFC", "rfc_company": "RFC", "curp": "CURP", "clabe": "CLABE",
    "card": "TARJETA", "nss": "NSS", "voter_key": "CLAVE_ELECTOR",
}
MEANINGS = {
    "NOMBRE": "un nombre propio, de una persona o de un lugar (el contexto dice cuál)", "CORREO": "un correo", "TELEFONO": "un teléfono", "RFC": "un RFC", "CURP": "una CURP",
    "CLABE": "una CLABE", "TARJETA": "un número de tarjeta", "NSS": "un número de seguro social", "CLAVE_ELECTOR": "una clave de elector",
}
HEALTH_LABEL = "[DATO DE SALUD OCULTO]"
#: Letters of a value that is looked for again, and digits that make two phones one.
LEAST_LETTERS, PHONE_DIGITS = 3, 10
#: Bits of the filters that all tasks know: two megabytes, whatever the size of the vault.
FILTER_BITS = 1 << 24
#: Words of a value by which it meets texts; longer values meet by their first ones.
MOST_WORDS = 8
#: Parts over which the texts of one (scope, words) are dealt.
SALTS = 16

_SAID = "|".join(w.replace("TELEFONO", "TEL[EÉ]FONO").replace("_", "[ _]") for w in dict.fromkeys(WORDS.values()))
# Numbers of any length: a scope of all texts of a source has thousands of values of a kind, all of which come back.
MARK = rf"\[\s*(?:{_SAID})[ _-]?[0-9]+\s*\]|\b(?:{_SAID})_[0-9]+\b"
_MARK = re.compile(MARK, re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")


def canonical(mark: str) -> str:
    """A mark as the vault writes it: in capitals without accents, one underscore, no zeros before the number."""
    word, number = re.fullmatch(r"\[?\s*(.*?)[ _-]?([0-9]+)\s*\]?", mark, re.DOTALL).groups()
    return f"[{fold(word)[0].replace(' ', '_')}_{number.lstrip('0')}]"


def found_values(texts: DataFrame) -> DataFrame:
    """scope, id, start, word, key and value of the findings in ``texts`` (scope, id, text, spans of the scanner).

    Two values are one by their letters and digits without case and accents, phones by their last ten digits.  Health
    words have no mark and are left out.
    """
    word = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    rows = texts.select("scope", "id", "text", F.explode("spans").alias("s")).withColumn("word", word[F.col("s.kind")]).filter("word is not null")
    value = F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    rows = rows.select("scope", "id", F.col("s.start").alias("start"), "word", F.trim(value).alias("value"))
    plain = F.regexp_replace(folded(F.col("value")), "[^\\p{L}\\p{N}]", "")
    return rows.withColumn("key", F.when((F.col("word") == "TELEFONO") & (F.length(plain) > PHONE_DIGITS), F.right(plain, F.lit(PHONE_DIGITS))).otherwise(plain))


def vault_of(found: DataFrame) -> DataFrame:
    """scope, mark, word, key and value of every value found: numbered by first occurrence (id, start) in its scope and word,
    with the value as it stood there.  Occurrences are grouped before they are ranked, by ranges, so no value or scope is hot."""
    first = found.groupBy("scope", "word", "key").agg(F.min(F.struct("id", "start", "value")).alias("first"))
    placed = ordered.ranked(first.select("scope", "word", "key", "first.*"), ["scope", "word"], ["id", "start", "key"], "place")
    mark = F.concat(F.lit("["), "word", F.lit("_"), (F.col("place") + 1).cast("string"), F.lit("]"))
    return placed.select("scope", mark.alias("mark"), "word", "key", "value")


def _likely(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with ``_likely``: false where no row of ``keys`` has their key, by one bit for each key.

    The bits are of one size, so they may be known to all tasks; where many keys fill them more rows are likely, and the join
    that follows decides.
    """
    bit = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS))
    bits = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))
    at = F.bitmap_bit_position(F.col("_bit"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_bit", bit).withColumn("_bucket", F.bitmap_bucket_number("_bit")).join(F.broadcast(bits), "_bucket", "left")
    there = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.withColumn("_likely", F.coalesce(there, F.lit(False))).drop("_bit", "_bucket", "_bits")


def _begin(word: bytes, scope: int) -> int:
    return zlib.crc32(word, scope) % FILTER_BITS


def _whole(words: bytes, scope: int) -> int:
    return zlib.crc32(words, ~scope & 0xFFFFFFFF) % FILTER_BITS


def words_of(value: str) -> list[str]:
    """The words by which a value meets texts."""
    return _WORD.findall(fold(value)[0])[:MOST_WORDS]


@F.arrow_udf(StructType().add("words", StringType()).add("n", IntegerType()).add("bits", ArrayType(LongType())))
def _met_by(scope: pa.Array, value: pa.Array) -> pa.Array:
    """The words of a value in one string, their number and its bits: of the first word and of all; null without a word."""

    def told(of: str | None, v: str) -> dict | None:
        words = words_of(v)
        at, key = zlib.crc32((of or "").encode()), " ".join(words)
        return {"words": key, "n": len(words), "bits": [_begin(words[0].encode(), at), _whole(key.encode(), at)]} if words else None

    return each(told, pa.struct([("words", pa.string()), ("n", pa.int32()), ("bits", pa.list_(pa.int64()))]), scope, value)


def words_met(bits: np.ndarray, lengths: list[int]):
    """A function of scope and text: the strings of words in the text that a value may have, by ``bits`` packed into bytes."""
    filled = bits.tobytes()
    there = lambda bit: filled[bit >> 3] >> (bit & 7) & 1

    def met(of: str | None, text: str | None) -> list[str] | None:
        words = _WORD.findall(fold(text or "")[0])
        at = zlib.crc32((of or "").encode())
        begins = {w for w in set(words) if there(_begin(w.encode(), at))}
        if not begins:
            return None
        found = set()
        for i, w in enumerate(words):
            if w in begins:
                found.update(" ".join(words[i : i + n]) for n in lengths if i + n <= len(words))
        return [k for k in found if there(_whole(k.encode(), at))] or None

    @F.arrow_udf(ArrayType(StringType()))
    def strings(scope: pa.Array, text: pa.Array) -> pa.Array:
        return each(met, pa.list_(pa.string()), scope, text)

    return strings


def _known(texts: DataFrame, vault: DataFrame) -> DataFrame:
    """scope, id and known: (value, mark) of the values whose words the text holds in their order.

    A filter of the values' words, of one size whatever their number, goes to all tasks, so that of a text's words only those
    of a likely value are joined; the join decides.
    """
    keyed = vault.filter(F.length("value") >= LEAST_LETTERS).withColumn("met", _met_by("scope", "value")).filter("met is not null").select("scope", "value", "mark", "met.*")
    bit = keyed.select(F.explode("bits").alias("bit"), "n").withColumn("bit", F.col("bit") + 1)  # buckets count from 1
    parts = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"), F.collect_set("n").alias("lengths")).collect()
    bits, lengths = np.zeros(FILTER_BITS // 8, np.uint8), sorted({n for p in parts for n in p.lengths})
    for p in parts:
        own = np.frombuffer(bytes(p.bits), np.uint8)
        start = (p.bucket - 1) * len(own)
        bits[start : start + len(own)] = own[: len(bits) - start]
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    words = texts.select("scope", "id", F.explode(words_met(bits, lengths)("scope", "text")).alias("words"), salt.alias("salt"))
    values = keyed.select("scope", "value", "mark", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    met = words.join(values, ["scope", "words", "salt"])
    return met.groupBy("scope", "id").agg(F.sort_array(F.collect_set(F.struct("value", "mark"))).alias("known"))


def places_of(text: str, values: list[str]) -> list[tuple[int, int, int]]:
    """(start, end, which) of the values in a text, whatever their case and accents, at the edges of words; the longest
    first, then the leftmost, none over another."""
    low, at = fold(text)
    hits = []
    for n, v in enumerate(values):
        sought = fold(v)[0]
        edges = [r"\b" if sought[:1].isalnum() else "", r"\b" if sought[-1:].isalnum() else ""]
        hits += [(m.start(), m.end(), n) for m in re.finditer(edges[0] + re.escape(sought) + edges[1], low)] if sought else []
    kept: list[tuple[int, int, int]] = []
    for a, b, n in sorted(hits, key=lambda h: (h[0] - h[1], h[0], h[2])):
        if all(b <= x or y <= a for x, y, _ in kept):
            kept.append((a, b, n))
    return sorted((at[a], at[b - 1] + 1, n) for a, b, n in kept)


def _rewrite(text: str, places: list[tuple[int, int, str]]) -> str:
    out, done = [], 0
    for a, b, instead in sorted(places):
        out += [text[done:a], instead]
        done = b
    return "".join([*out, text[done:]])


@F.arrow_udf(StringType())
def _marked(text: pa.Array, found: pa.Array, known: pa.Array) -> pa.Array:
    """Findings (start, end, mark) first, then known values in what is left between them."""

    def mark(t: str | None, own: list | None, others: list | None) -> str | None:
        if t is None:
            return None
        places, done = [], 0
        values = [k["value"] for k in others or []]
        for s in [*sorted(own or [], key=lambda s: s["start"]), {"start": len(t), "end": len(t), "mark": ""}]:
            if s["start"] < done:
                continue
            gap = t[done : s["start"]]
            places += [(done + a, done + b, others[n]["mark"]) for a, b, n in places_of(gap, values)] if values else []
            places.append((s["start"], s["end"], s["mark"]))
            done = s["end"]
        return _rewrite(t, places)

    return each(mark, pa.string(), text, found, known)


def marked(texts: DataFrame, found: DataFrame, vault: DataFrame) -> DataFrame:
    """``texts`` (scope, id, text, spans) with ``marked``: findings as their marks, health as its label, and every value of the
    errand as its mark where it stands again, also where the scanner didn't see it.  (scope, id) must tell texts apart."""
    ends = texts.select("scope", "id", F.explode("spans").alias("s")).select("scope", "id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"))
    keyed = ends.join(found.select("scope", "id", "start", "word", "key"), ["scope", "id", "start"], "left")
    named = keyed.join(vault.select("scope", "word", "key", "mark"), ["scope", "word", "key"], "left")
    own = named.groupBy("scope", "id").agg(F.collect_list(F.struct("start", "end", F.coalesce("mark", F.lit(HEALTH_LABEL)).alias("mark"))).alias("own"))
    told = written(own.join(_known(texts, vault), ["scope", "id"], "full"), "told")  # read twice
    # Only texts that something may be known of are shuffled.
    sorted_ = _likely(texts, told, ["scope", "id"])
    some = sorted_.filter("_likely").drop("_likely").join(told, ["scope", "id"], "left").withColumn("marked", _marked("text", "own", "known")).drop("own", "known")
    return some.unionByName(sorted_.filter("not _likely").drop("_likely").withColumn("marked", F.col("text")))


@F.arrow_udf(ArrayType(StringType()))
def marks_in(text: pa.Array) -> pa.Array:
    """The marks that a text holds, as the vault writes them, each once; also those written a little differently."""
    return each(lambda t: None if t is None else list(dict.fromkeys(canonical(m) for m in _MARK.findall(t))), pa.list_(pa.string()), text)


def _marks(column: str) -> Column:
    """:func:`marks_in`, null where a text has neither a bracket nor a line below, as every mark has."""
    return marks_in(F.when(F.contains(F.col(column), F.lit("[")) | F.contains(F.col(column), F.lit("_")), F.col(column)))


@F.arrow_udf(StringType())
def _revealed(text: pa.Array, values: pa.Array) -> pa.Array:
    def reveal(t: str | None, held: list | None) -> str | None:
        of = {v["mark"]: v["value"] for v in held or []}
        return t if t is None or not of else _MARK.sub(lambda m: of.get(canonical(m[0]), m[0]), t)

    return each(reveal, pa.string(), text, values)


def _held(texts: DataFrame, column: str) -> DataFrame:
    return texts.select("scope", "id", F.explode(_marks(column)).alias("mark"))


def revealed(texts: DataFrame, vault: DataFrame, column: str = "marked") -> DataFrame:
    """``texts`` (scope, id, ``column``) with ``revealed``: marks of its errand as their values; others stay as they are.

    Each text asks for its own marks; a mark that all of a hot scope's texts hold is dealt over parts.
    """
    held = _held(texts, column).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    values = vault.select("scope", "mark", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    of = held.join(values, ["scope", "mark", "salt"]).groupBy("scope", "id").agg(F.collect_list(F.struct("mark", "value")).alias("values"))
    # Only texts with marks are shuffled.
    marked_ = F.coalesce(F.size(_marks(column)), F.lit(0)) > 0
    some = texts.filter(marked_).join(of, ["scope", "id"], "left").withColumn("revealed", _revealed(column, "values")).drop("values")
    return some.unionByName(texts.filter(~marked_).withColumn("revealed", F.col(column)))


def unknown(texts: DataFrame, vault: DataFrame, column: str = "marked") -> DataFrame:
    """scope, id and mark of the marks that the errand never made."""
    return _held(texts, column).join(vault.select("scope", "mark"), ["scope", "mark"], "left_anti").select("scope", "id", "mark")


def legend(vault: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """scope, mark and line: what each mark is and where the same value is saved (``saved``: value, place), never the value."""
    meaning = F.create_map(*[F.lit(x) for pair in MEANINGS.items() for x in pair])[F.col("word")]
    line = F.concat(F.lit("- "), "mark", F.lit(": "), meaning)
    if saved is None:
        return vault.select("scope", "mark", F.concat(line, F.lit(".")).alias("line"))
    plain = F.regexp_replace(folded(F.col("value")), "[^\\p{L}\\p{N}]", "")
    keys = F.when(F.length(plain) > PHONE_DIGITS, F.array(plain, F.right(plain, F.lit(PHONE_DIGITS)))).otherwise(F.array(plain))
    known = saved.select("place", plain.alias("plain"), F.explode(keys).alias("key")).filter("key <> ''")
    same = (F.col("v.key") == F.col("k.key")) & ((F.col("v.word") == "TELEFONO") | (F.col("k.key") == F.col("k.plain")))
    places = vault.alias("v").join(known.alias("k"), same).groupBy("v.scope", "v.mark").agg(F.array_sort(F.collect_set("k.place")).alias("places"))
    told = vault.join(places, ["scope", "mark"], "left")
    also = F.when(F.col("places").isNotNull(), F.concat(F.lit("; es el mismo que está guardado en "), F.array_join("places", " y en "))).otherwise("")
    return told.select("scope", "mark", F.concat(line, also, F.lit(".")).alias("line"))
