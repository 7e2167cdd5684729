"""Named checks over answers in JSON, and shares of totals."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tesela.functions.arrow import each
from tesela.operators import scanner


@dataclass(frozen=True)
class Criterion:
    """A check: for each group of words, an answer must hold one of them; ``hard`` ones decide whether it is taken at all."""

    name: str
    groups: tuple[tuple[str, ...], ...]
    hard: bool = False


def _texts(value: object) -> list[str]:
    """Every text and number anywhere in nested JSON, in its order."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            todo += reversed(list(v.values()))
        elif isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, str) or isinstance(v, (int, float)) and not isinstance(v, bool):
            out.append(str(v))
    return out


@F.arrow_udf(StringType())
def all_texts(text: pa.Array) -> pa.Array:
    """The texts and numbers of a JSON answer, a line each; null for what is no JSON."""

    def read(t: str | None) -> str | None:
        try:
            return None if t is None else "\n".join(_texts(json.loads(t)))
        except ValueError:
            return None

    return each(read, pa.string(), text)


def checked(answers: DataFrame, rules: list[Criterion], unsupported: Column | None = None) -> DataFrame:
    """id, name, ok and hard of each check of ``answers`` (id, json).

    Beside the rules there are two hard ones: no figure that no source states (``unsupported``: an array), and nothing that
    identifies a person.  What is no JSON holds no word.
    """
    said = answers.withColumn("_said", F.coalesce(all_texts("json"), F.lit(""))).withColumn("_found", F.size(scanner.scanner()("_said"))).withColumn("_low", F.lower("_said"))

    def holds(c: Criterion) -> Column:
        out = F.lit(True)
        for group in c.groups:
            one = F.lit(False)
            for w in group:
                one = one | F.contains("_low", F.lit(w))
            out = out & one
        return out

    told = [F.struct(F.lit(c.name).alias("name"), holds(c).alias("ok"), F.lit(c.hard).alias("hard")) for c in rules]
    told.append(F.struct(F.lit("no invented figures").alias("name"), (F.coalesce(F.size(unsupported), F.lit(0)) <= 0 if unsupported is not None else F.lit(True)).alias("ok"), F.lit(True).alias("hard")))
    told.append(F.struct(F.lit("nobody identified").alias("name"), (F.col("_found") == 0).alias("ok"), F.lit(True).alias("hard")))
    return said.select("id", F.explode(F.array(*told)).alias("x")).select("id", "x.*")


def taken(told: DataFrame) -> DataFrame:
    """id, whether all hard checks hold, and how many of all do."""
    return told.groupBy("id").agg(F.bool_and(~F.col("hard") | F.col("ok")).alias("taken"), F.count_if("ok").alias("met"), F.count("*").alias("checks"))


def shares(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rows`` with ``share``, the part of its group's total that a value is; null where the total is null or zero.

    Totals are added up before they are joined, so a hot group is no task's work.
    """
    total = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum(value).alias("_total"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return rows.join(total, same, "left").withColumn("share", F.col(value) / F.nullif("_total", F.lit(0))).drop("_total", *[f"_{c}" for c in by])
