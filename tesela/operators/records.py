"""Records over time: as-of reads, versions, differences, upserts, coverage, suppression, validation and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions.text import dehyphenated, normal


def as_of(changes: DataFrame, keys: list[str], at: str, tie: str, value: str, moment: Column) -> DataFrame:
    """The last value of each key at a moment; a value emptied by then is null, a key without changes has no row."""
    last = F.max_by(F.struct(F.col(value)), F.struct(at, tie))
    return changes.filter(F.col(at) <= moment).groupBy(*keys).agg(last.alias("last")).select(*keys, F.col(f"last.{value}").alias(value))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by ``order``, nulls first: nothing is sorted, and a hot key is reduced map-side."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def difference(old: DataFrame, new: DataFrame, key: str, fields: list[str], protected: frozenset[str] = frozenset()) -> DataFrame:
    """key, field, old_value, new_value of the fields that changed; values of protected fields are not told."""
    tall = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])).alias("x")).select(key, f"x.field", f"x.{name}")
    both = tall(old, "old_value").join(tall(new, "new_value"), [key, "field"], "full")
    changed = both.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
    hide = F.col("field").isin(list(protected)) if protected else F.lit(False)
    return changed.select(key, "field", *[F.when(~hide, F.col(c)).alias(c) for c in ("old_value", "new_value")])


def upserted(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with rows of ``changes`` in place of those with the same key."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def coverage(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The length of the union of each group's intervals: only what reaches beyond all earlier ends counts."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(end).over(w), F.col(start))
    return spans.withColumn("_new", F.greatest(F.col(end) - F.greatest(F.col(start), reached), F.lit(0))).groupBy(*by).agg(F.sum("_new").alias("covered"))


def by_catalog(rows: DataFrame, column: str, catalog: DataFrame, least: int = 1) -> DataFrame:
    """code, ord and n in catalog order; groups under ``least`` are left out, which hides small ones."""
    counted = rows.groupBy(F.col(column).alias("code")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return catalog.join(counted, "code").select("code", "ord", "n")


def issues(rows: DataFrame, key: str, rules: list[tuple[str, str, bool, Column]]) -> DataFrame:
    """key, code, field, blocking: one row for each rule (code, field, blocking, broken) that a row breaks."""
    told = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(blocking).alias("blocking"))) for code, field, blocking, broken in rules])
    return rows.select(key, F.explode(F.filter(told, lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def evidence(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """``quotes`` (quote_id, doc, cited, quote) with ``page``, the nearest page of the document that holds the quote, and
    ``state``: verified on the cited page, relocated, or rejected.

    Quotes and pages are compared in their normal forms, as they are and with words joined that a line break split.  A
    quote under twelve characters must be a whole line or cell (between bars or tabs), one under three is never found.
    """
    forms = lambda c: F.array(normal(F.col(c)), normal(dehyphenated(F.col(c))))
    asked = quotes.withColumn("sought", forms("quote"))
    cells = F.transform(F.split(F.col("text"), "\n|\\||\t"), normal)
    near = asked.join(pages.select("doc", F.col("page").alias("p"), forms("text").alias("held"), cells.alias("cells")), "doc")
    length = F.length(F.trim("quote"))
    inside = F.contains(F.col("held")[0], F.col("sought")[0]) | F.contains(F.col("held")[1], F.col("sought")[1])
    found = (length >= 3) & (F.col("sought")[0] != "") & F.when(length < 12, F.array_contains("cells", F.col("sought")[0])).otherwise(inside)
    hit = near.filter(found).groupBy("quote_id").agg(F.min_by("p", F.struct(F.abs(F.col("p") - F.col("cited")), F.col("p"))).alias("page"))
    out = quotes.join(hit, "quote_id", "left")
    return out.withColumn("state", F.when(F.col("page").isNull(), "rejected").when(F.col("page") == F.col("cited"), "verified").otherwise("relocated"))


def optional(rows: DataFrame, **wanted: object) -> DataFrame:
    """``rows`` filtered by the columns that are given; None asks for nothing."""
    for column, value in wanted.items():
        rows = rows if value is None else rows.filter(F.col(column) == F.lit(value))
    return rows


def unhidden(rows: DataFrame, column: str = "hidden") -> DataFrame:
    """Rows that nobody hid; a null counts as hidden, as it does in the original's comparison."""
    return rows.filter(F.col(column) == F.lit(0))


def kept_by_person(by_rule: Column, by_person: Column) -> Column:
    """What a person set, else what a rule says: rules never override people."""
    return F.when(by_person.isNotNull(), by_person).otherwise(by_rule)


def titled(rows: DataFrame, key: str, titles: DataFrame, default: str) -> DataFrame:
    """``rows`` with ``title`` from the list ``titles`` (id, title), or the default label."""
    named = titles.groupBy(F.col("id").alias("_id")).agg(F.min("title").alias("title"))
    return rows.join(named, F.col(key) == F.col("_id"), "left").drop("_id").withColumn("title", F.coalesce("title", F.lit(default)))


def by_code_of_list(rows: DataFrame, column: str, catalog: DataFrame) -> DataFrame:
    """:func:`by_catalog` over a column that holds several codes a row."""
    return by_catalog(rows.select(F.explode(column).alias("code_")), "code_", catalog)


def is_filled(value: Column, is_list: bool = False) -> Column:
    """A list with an item, or a text that is not blank."""
    return F.coalesce(F.size(value) > 0 if is_list else F.trim(value.cast("string")) != "", F.lit(False))


def missing(rows: DataFrame, key: str, fields: list[tuple[str, bool, Column | None]]) -> DataFrame:
    """key and field of the required fields (name, required, the condition under which it applies) that are not filled."""
    told = [F.when(F.coalesce(when, F.lit(False)) if when is not None else F.lit(True), F.when(~is_filled(F.col(name)), F.lit(name))) for name, required, when in fields if required]
    return rows.select(key, F.explode(F.array_compact(F.array(*told))).alias("field"))


def without_hidden_values(rows: DataFrame, fields: list[tuple[str, bool, Column | None]]) -> DataFrame:
    """``rows`` with null in the fields that don't apply."""
    hidden = {name: F.when(F.coalesce(when, F.lit(False)), F.col(name)) for name, _, when in fields if when is not None}
    return rows.select(*[hidden[c].alias(c) if c in hidden else F.col(c) for c in rows.columns])


def progress(fields: list[tuple[str, bool, Column | None]]) -> Column:
    """Percent of the fields that apply which are filled, rounded down; 100 where none applies."""
    applies = [F.coalesce(when, F.lit(False)) if when is not None else F.lit(True) for _, _, when in fields]
    total = sum((a.cast("int") for a in applies[1:]), applies[0].cast("int"))
    filled = [(a & is_filled(F.col(name))).cast("int") for a, (name, _, _) in zip(applies, fields, strict=True)]
    return F.when(total == 0, 100).otherwise(F.floor(100 * sum(filled[1:], filled[0]) / total)).cast("long")


def repeated_lines(lines: DataFrame, least: int = 3) -> DataFrame:
    """``lines`` (doc, page, shape, ...) without those whose shape stands on ``least`` pages of a document or more."""
    headers = lines.groupBy("doc", "shape").agg(F.countDistinct("page").alias("n")).filter(F.col("n") >= least)
    return lines.join(headers.select("doc", "shape"), ["doc", "shape"], "left_anti")
