"""Forms as data: which fields apply, what is missing, and what is wrong with what was filled in, over JSON answers.

Answers are a VARIANT parsed once a row, so that a value of the wrong kind is told from one out of range.  Every field is
an expression over it; a form's issues are one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions.checks import clabe_valid, organisation_rfc_valid
from tesela.functions.values import date_valid


@dataclass(frozen=True)
class When:
    """A condition on another field: that it is filled, or that it is, or as a list holds, one of some codes."""

    field: str
    any_of: tuple[str, ...] = ()


@dataclass(frozen=True)
class Field:
    """A field: kind (select, multi, number, money, year, yes_no, date, text), its limits or rule, and when it applies.

    ``rule``: postal_code, rfc, clabe or place for texts.  ``step`` is the part of the form that it stands in.
    """

    id: str
    kind: str = "text"
    options: tuple[str, ...] = ()
    least: int | None = None
    most: int | None = None
    rule: str | None = None
    required: bool = False
    when: When | None = None
    step: str = ""


RULES = {
    "postal_code": ("postal_code_invalid", lambda s: F.trim(s).rlike("^[0-9]{5}$")),
    "rfc": ("rfc_moral_invalid", lambda s: F.coalesce(organisation_rfc_valid(F.upper(F.regexp_replace(s, r"[\s-]", ""))), F.lit(False))),
    "clabe": ("clabe_invalid", lambda s: F.coalesce(clabe_valid(F.regexp_replace(s, r"[\s-]", "")), F.lit(False))),
    "place": ("place_name_invalid", lambda s: s.rlike("\\p{L}") & ~s.rlike("[0-9@]")),
}


def _path(field: str) -> str:
    return f"$['{field}']"


def value(field: str, kind: str) -> Column:
    """The value of a field as a type, null where it is of another."""
    return F.try_variant_get("v", _path(field), kind)


def _type(field: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get("v", _path(field), "variant")), F.lit("VOID"))


def filled(field: str) -> Column:
    """A text that is not blank, a list with an item, or anything else that is not null."""
    kind = _type(field)
    text = F.coalesce(F.trim(F.regexp_replace(value(field, "string"), r"\s+", " ")) != "", F.lit(False))
    return F.when(kind == "VOID", False).when(kind == "STRING", text).when(kind.startswith("ARRAY"), F.coalesce(F.size(value(field, "array<variant>")) > 0, F.lit(False))).otherwise(True)


def holds(when: When | None) -> Column:
    """Whether a condition holds; a field that isn't there fills nothing and is none of the codes."""
    if when is None:
        return F.lit(True)
    if not when.any_of:
        return filled(when.field)
    kind = _type(when.field)
    one = F.when(kind == "STRING", value(when.field, "string").isin(*when.any_of))
    many = F.when(kind.startswith("ARRAY"), F.exists(value(when.field, "array<variant>"), lambda x: (F.schema_of_variant(x) == "STRING") & F.coalesce(F.try_variant_get(x, "$", "string").isin(*when.any_of), F.lit(False))))
    return F.coalesce(one, many, F.lit(False))


def problem(f: Field) -> Column:
    """The code of what is wrong with a filled value; null when nothing is."""
    kind, text, number = _type(f.id), value(f.id, "string"), value(f.id, "bigint")
    is_text = kind == "STRING"
    if f.kind == "select":
        return F.when(~is_text, "wrong_type").when(~text.isin(*f.options), "code_unknown")
    if f.kind == "multi":
        texts = F.transform(value(f.id, "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
        odd = F.exists(texts, lambda x: x.isNull())
        unknown = F.size(F.array_except(texts, F.array(*map(F.lit, f.options)))) > 0
        return F.when(~kind.startswith("ARRAY") | odd, "wrong_type").when(unknown, "code_unknown").when(F.size(F.array_distinct(texts)) < F.size(texts), "repeated")
    if f.kind in ("number", "money", "year"):
        low = F.lit(False) if f.least is None else number < f.least
        high = F.lit(False) if f.most is None else number > f.most
        whole = kind.isin("BIGINT")
        if f.kind == "year":
            return F.when(~whole, "wrong_type").when(low | high, "year_invalid").when(number < 0, "negative_number")
        return F.when(~whole, "wrong_type").when(number < 0, "negative_number").when(low, "number_too_small").when(high, "number_too_large")
    if f.kind == "yes_no":
        return F.when(kind != "BOOLEAN", "wrong_type")
    if f.kind == "date":
        return F.when(~is_text, "wrong_type").when(~date_valid(F.trim(text), 0, 9999), "date_invalid")
    out = F.when(~is_text, "wrong_type")
    if f.rule is not None:
        code, good = RULES[f.rule]
        out = out.when(~good(text), code)
    return out


def answered(rows: DataFrame, column: str = "answers") -> DataFrame:
    """``rows`` with ``v``, the parsed answers; what is no JSON answers nothing."""
    return rows.withColumn("v", F.try_parse_json(column))


def issues(rows: DataFrame, key: str, fields: list[Field], column: str = "answers") -> DataFrame:
    """key, field, code and blocking: what is wrong with fields that apply, and, not blocking, which required ones are empty."""
    told = [F.when(holds(f.when), F.when(filled(f.id), F.struct(F.lit(f.id).alias("field"), problem(f).alias("code"), F.lit(True).alias("blocking"))).otherwise(F.struct(F.lit(f.id).alias("field"), F.when(F.lit(f.required), "missing").alias("code"), F.lit(False).alias("blocking")))) for f in fields]
    return answered(rows, column).select(key, F.explode(F.array(*told)).alias("x")).select(key, "x.*").filter("code is not null")


def cleared(rows: DataFrame, key: str, fields: list[Field], column: str = "answers") -> DataFrame:
    """key and kept: the answers, as a map of JSON values, without those that don't apply or that the form doesn't have."""
    kept = [F.when(holds(f.when) & (_type(f.id) != "VOID"), F.struct(F.lit(f.id).alias("k"), F.to_json(F.try_variant_get("v", _path(f.id), "variant")).alias("x"))) for f in fields]
    return answered(rows, column).select(key, F.map_from_entries(F.array_compact(F.array(*kept))).alias("kept"))


def progress(rows: DataFrame, key: str, fields: list[Field], column: str = "answers") -> DataFrame:
    """key, step, applying and filled of each step, and percent: of all steps together, rounded down, 100 where nothing applies."""
    told = [F.when(holds(f.when), F.struct(F.lit(f.step).alias("step"), filled(f.id).cast("int").alias("filled"))) for f in fields]
    parsed = answered(rows, column).select(key, F.array_compact(F.array(*told)).alias("told"))
    total, done = F.size("told"), F.aggregate("told", F.lit(0), lambda a, x: a + x["filled"])
    out = parsed.select(key, "told", F.when(total == 0, 100).otherwise(F.floor(100 * done / total)).cast("long").alias("percent"))
    steps = list(dict.fromkeys(f.step for f in fields))

    def of(step: str, least: int) -> Column:
        return F.size(F.filter("told", lambda x: (x["step"] == step) & (x["filled"] >= least)))

    each = F.array(*[F.struct(F.lit(s).alias("step"), of(s, 0).alias("applying"), of(s, 1).alias("filled")) for s in steps])
    return out.select(key, "percent", F.explode(each).alias("x")).select(key, "x.step", "x.applying", "x.filled", "percent")
