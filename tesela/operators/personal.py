"""Personal data in text: detection, checksum gating, overlap resolution, redaction and pseudonyms.

Counting stays in Spark's engine.  Where places in the text matter, an Arrow function scans whole batches; it returns
spans in characters, never the values it found.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tesela.functions.arrow import each
from tesela.functions.checks import card_valid
from tesela.operators import ordered

#: Kind, pattern (without look-around, so that every engine reads it alike), severity; order breaks ties.
DETECTORS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]", "block"),
    ("card", r"[0-9]{13,19}", "block"),
    ("phone", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "warn"),
    ("address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "warn"),
]
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType()), StructField("severity", StringType())]))


def values(text: Column, kind: str) -> Column:
    """The texts of one kind, those with a false check digit left out."""
    pattern = {k: p for k, p, _ in DETECTORS}[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.filter(found, card_valid) if kind == "card" else found


def counts(docs: DataFrame) -> DataFrame:
    """Documents and findings of each kind: one pass, one small aggregation."""
    per = docs.select(*[F.size(values(F.coalesce("text", F.lit("")), k)).alias(k) for k, _, _ in DETECTORS])
    stacked = per.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k, _, _ in DETECTORS])).alias("x")).select("x.kind", "x.n")
    return stacked.groupBy("kind").agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("findings"))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def resolve(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping (start, end, detector) the blocking ones first, then the longest, then by kind; sorted by start."""
    kept: list[tuple[int, int, int]] = []
    for s in sorted(spans, key=lambda s: (DETECTORS[s[2]][2] != "block", s[0] - s[1], s[2], s[0])):
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


@F.pandas_udf(SPANS)
def findings(text: pd.Series) -> pd.Series:
    """Resolved spans of a text, in characters; an empty list for a null one."""
    compiled = [re.compile(p) for _, p, _ in DETECTORS]

    def scan(t: str | None) -> list[dict]:
        found = [(m.start(), m.end(), i) for i, r in enumerate(compiled) for m in r.finditer(t or "") if DETECTORS[i][0] != "card" or _luhn(m[0])]
        return [{"start": a, "end": b, "kind": DETECTORS[i][0], "severity": DETECTORS[i][2]} for a, b, i in resolve(found)]

    return text.map(scan, na_action=None)


def redacted(text: str, spans: str) -> Column:
    """The text with ``[KIND]`` in place of each span; only texts with spans are sent to Python."""
    return F.coalesce(_cut(F.when(F.size(spans) > 0, F.col(text)), F.col(spans)), F.col(text))


@F.arrow_udf(StringType())
def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:

    def cut(t: str | None, found) -> str | None:
        if t is None or found is None:
            return t
        out, at = [], 0
        for s in found:
            out += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = s["end"]
        return "".join([*out, t[at:]])

    return each(cut, pa.string(), text, spans)


def decided(spans: Column, overridden: Column, redacted: Column | None = None) -> Column:
    """clean, redacted (somebody had all findings covered), overridden (warnings only, and somebody cleared them) or quarantine;
    blocking findings can be covered but not cleared."""
    block = F.exists(spans, lambda s: s["severity"] == "block")
    covered = F.lit(False) if redacted is None else F.coalesce(redacted, F.lit(False))
    return F.when(F.size(spans) == 0, "clean").when(covered, "redacted").when(~block & F.coalesce(overridden, F.lit(False)), "overridden").otherwise("quarantine")


def lists_people(spans: Column) -> Column:
    """More than five blocking findings make a text a list of people."""
    return F.size(F.filter(spans, lambda s: s["severity"] == "block")) > 5


def pseudonyms(found: DataFrame) -> DataFrame:
    """``found`` (scope, kind, value, place) with ``mark``: the same value has the same numbered mark in its scope.

    Numbers follow first occurrence.  The first occurrence is grouped before ranking, so a hot value is one row, and ranks are counted by ranges.
    """
    first = found.groupBy("scope", "kind", "value").agg(F.min("place").alias("first"))
    placed = ordered.ranked(first, ["scope", "kind"], ["first", "value"], "place")
    number = (F.col("place") + 1).cast("string")
    marks = placed.select("scope", "kind", "value", F.concat(F.lit("["), F.upper("kind"), F.lit("_"), number, F.lit("]")).alias("mark"))
    return found.join(marks, ["scope", "kind", "value"])

