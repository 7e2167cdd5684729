"""Where values come from: quotes found in pages, states by their evidence, readings merged, contradictions kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tesela.functions.text import SEARCH_FROM, SEARCH_TO, normal, same_statement

#: From this length a quote may differ, in one letter of so many, and in at most so many.
FORGIVEN_FROM, LETTERS_A_SLIP, MOST_SLIPS = 12, 20, 3
_PLAIN = str.maketrans(SEARCH_FROM + "ñ", SEARCH_TO + "n")


def _plain(text: str) -> tuple[str, list[int]]:
    """Letters and digits in lower case without accents, words one blank apart, and each one's place in ``text``."""
    out, at, gap = [], [], False
    for i, c in enumerate(text):
        low = c.lower().translate(_PLAIN)
        if not c.isalnum() or len(low) != 1:
            gap = True
            continue
        if gap and out:
            out.append(" ")
            at.append(i)
        gap = False
        out.append(low)
        at.append(i)
    return "".join(out), at


def _edits(sought: np.ndarray, text: np.ndarray, anywhere: bool) -> np.ndarray:
    """The fewest edits that make ``sought`` a piece of ``text`` ending at each place; beginning anywhere, or at its start."""
    steps = np.arange(len(sought) + 1)
    cost, ends = steps.copy(), np.empty(len(text), np.int64)
    for j, c in enumerate(text):
        other = np.empty_like(cost)
        other[0] = 0 if anywhere else j + 1
        other[1:] = np.minimum(cost[:-1] + (sought != c), cost[1:] + 1)
        cost = np.minimum.accumulate(other - steps) + steps
        ends[j] = cost[-1]
    return ends


def _near(sought: str, text: str, cut: list[int], slips: int) -> list[tuple[int, int]]:
    """Where in a text, in its order, a piece with so few edits may lie: around each place of a part as it is."""
    around = []
    for a, b in zip(cut, cut[1:], strict=False):
        part, at = sought[a:b], text.find(sought[a:b])
        while part and at >= 0:
            around.append((max(0, at - a - slips), min(len(text), at - a + len(sought) + slips)))
            at = text.find(part, at + 1)
    out: list[tuple[int, int]] = []
    for a, b in sorted(around):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _closest(sought: str, text: str, slips: int) -> tuple[int, int] | None:
    at = text.find(sought)
    if at >= 0:
        return at, at + len(sought)
    # With so few edits one of slips + 1 parts of the quote stands in the text as it is.
    cut = [len(sought) * i // (slips + 1) for i in range(slips + 2)]
    if not slips or not any(sought[a:b] in text for a, b in zip(cut, cut[1:], strict=False)):
        return None
    q, t = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (sought, text))
    best, end = slips + 1, 0
    for a, b in _near(sought, text, cut, slips):
        ends = _edits(q, t[a:b], True)
        at = int(ends.argmin())
        if ends[at] < best:
            best, end = int(ends[at]), a + at + 1
    if best > slips:
        return None
    back = t[max(0, end - len(q) - slips) : end][::-1]
    start = end - 1 - int(_edits(q[::-1], back, False).argmin())
    start += text[start] == " "
    end -= text[end - 1] == " "
    return (start, end) if start < end else None


@F.pandas_udf(StringType())
def located(quote: pd.Series, text: pd.Series) -> pd.Series:
    """The words of ``text`` that a quote copies, as they stand there: equal but for case, accents and punctuation, and
    from twelve characters on for one letter in twenty (three at most), with the same numbers.  Null when not there."""

    def find(q: str | None, t: str | None) -> str | None:
        if not q or not t:
            return None
        (sought, _), (page, places) = _plain(q), _plain(t)
        slips = 0 if len(sought) < FORGIVEN_FROM else min(max(len(sought) // LETTERS_A_SLIP, 1), MOST_SLIPS)
        span = _closest(sought, page, slips) if sought else None
        figures = lambda x: [w for w in x.split() if w.isascii() and w.isdigit()]
        if span is None or figures(sought) != figures(page[slice(*span)]):
            return None
        return t[places[span[0]] : places[span[1] - 1] + 1].strip()

    return pd.Series([find(q, t) for q, t in zip(quote, text, strict=True)], dtype=object)


def state_of(declared: Column, proofs: Column) -> Column:
    """Evidence beats what was declared: none makes a value absent, some make it found unless it is called ambiguous."""
    return F.when(F.coalesce(proofs, F.lit(0)) == 0, "no_aparece").when(declared == "ambiguo", "ambiguo").otherwise("encontrado")


def value_in_quotes(said: Column, quotes: Column) -> Column:
    """What was said, trimmed, when a quote holds it; else the first quote; null without quotes."""
    t = F.trim(said)
    held = F.exists(quotes, lambda q: F.contains(normal(q), normal(t)))
    return F.when(F.size(quotes) > 0, F.when((t != "") & held, t).otherwise(F.try_element_at(quotes, F.lit(1))))


def first_statements(items: Column) -> Column:
    """The texts of a list in order, without those that state what an earlier kept one does; nulls go."""
    start = F.array().cast("array<string>")
    return F.aggregate(F.array_compact(items), start, lambda kept, x: F.when(F.exists(kept, lambda k: same_statement(k, x)), kept).otherwise(F.array_append(kept, x)))


def merged(first: DataFrame, second: DataFrame, key: str, lists: list[str], singles: list[str]) -> DataFrame:
    """Two readings of the same documents: lists grow by new statements, single values are taken only where empty."""
    a, b = first.alias("a"), second.alias("b")
    none = F.array().cast("array<string>")
    grown = [first_statements(F.concat(F.coalesce(F.col(f"a.{c}"), none), F.coalesce(F.col(f"b.{c}"), none))).alias(c) for c in lists]
    filled = [F.coalesce(F.when(F.trim(f"a.{c}") != "", F.col(f"a.{c}")), F.col(f"b.{c}")).alias(c) for c in singles]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *grown, *filled)


def contradictions(told: DataFrame, order: str) -> DataFrame:
    """``told`` (doc, field, versions: array of (value, quote), and ``order``) with two versions or more and a field's name;
    those of one document with the same quotes, up to sixty characters, are one: the first in ``order``."""
    quotes = F.array_sort(F.transform("versions", lambda v: F.left(normal(v["quote"]), F.lit(60))))
    kept = told.filter((F.size("versions") >= 2) & (F.trim("field") != "")).withColumn("_key", quotes)
    return kept.groupBy("doc", "_key").agg(F.min_by(F.struct("field", "versions", order), order).alias("_x")).select("doc", "_x.*")


def share(part: Column, total: Column) -> Column:
    """A rate that is whole where there is nothing to count: verified quotes of emitted ones, cited pages of all."""
    return F.coalesce(part / F.nullif(total, F.lit(0)), F.lit(1.0))


def own_values(rows: DataFrame, read: DataFrame, key: str, fields: list[str], issued: str, until: str) -> DataFrame:
    """``rows`` with what was read from a file in fields that are empty or came from a file (``<field>_origin``, not "user").

    ``read`` holds one row a key.  A validity before the date of issue, as it then stands, is left out; a value without
    origin is the person's.
    """
    joined = rows.join(read.select(key, *[F.trim(f).alias(f"_{f}") for f in fields]), key, "left")
    for f in [issued, *[f for f in fields if f != issued]]:
        empty = F.coalesce(F.trim(f) == "", F.lit(True))
        from_file = F.coalesce(F.col(f"{f}_origin") != "user", F.lit(False))
        takes = F.coalesce(F.col(f"_{f}") != "", F.lit(False)) & (empty | from_file)
        if f == until:
            takes = takes & ~F.coalesce(F.col(f"_{f}").try_cast("date") < F.col(issued).try_cast("date"), F.lit(False))
        joined = joined.withColumn("_takes", takes)
        joined = joined.withColumn(f, F.when(F.col("_takes"), F.col(f"_{f}")).otherwise(F.col(f))).withColumn(f"{f}_origin", F.when(F.col("_takes"), "document").otherwise(F.col(f"{f}_origin")))
    return joined.drop("_takes", *[f"_{f}" for f in fields])


def latest_milestone(milestones: DataFrame, by: str, order: str, kinds: list[str]) -> DataFrame:
    """Of the milestones (``by``, ``order``, kind, said, day) of the given kinds that look like a date, that of the latest
    day, the later of equals in ``order``; where none has a day, the first."""
    dated = F.col("said").rlike("\\p{L}") | (F.length(F.regexp_replace("said", "[^0-9]", "")) >= 6)
    whole = F.struct("kind", "said", "day", order)
    picked = milestones.filter(F.col("kind").isin(kinds) & dated).groupBy(by).agg(F.max_by(whole, F.when(F.col("day").isNotNull(), F.struct("day", order))).alias("last"), F.min_by(whole, order).alias("first"))
    return picked.select(by, F.coalesce("last", "first").alias("x")).select(by, "x.*")
