"""Substring deduplication by hashing paragraphs, lines, or the clauses that lines consist of.

Every unit is normalised and named by a 128-bit digest.  One grouped minimum a digest finds its earliest ranked
occurrence; the other occurrences are reported with their offsets in the original text, neighbouring ones merge into
spans, and :func:`cut` takes spans out.  A passage that starts or ends inside a line is found through its clauses: only
the clauses it breaks at its two ends are lost.  Digests travel instead of texts; partial minima keep a hot digest
small before the shuffle, and hot digests, whose number is bounded by their share, get their minimum by a broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

_TOKEN = re.compile(r"[^\W_]+")
#: The marks that end a clause.
MARKS = ".,;:!?。！？；：，、…"
#: A clause runs to the first mark after its third word, or to the end of its line: shorter ones are no passage's own.
CLAUSES = rf"(?:[^\w\n]|_)*[^\W_]+(?:(?:[^\w\n]|_)+[^\W_]+){{2}}[^{MARKS}\n]*[{MARKS}]*|[^\n]+"
#: A digest that takes this share of all units or more is hot; there are at most so many of them to broadcast.
HOT = 2000
#: A line is what lies between line feeds; a paragraph what lies between blank lines.
BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*")}
UNITS = [*BREAKS, "clause"]
_CLAUSE = re.compile(CLAUSES)


def units_of(text: str, by: str) -> Iterator[tuple[int, int]]:
    """Start and end of every unit of a text, in characters."""
    if by == "clause":
        for m in _CLAUSE.finditer(text):
            yield m.span()
        return
    at = 0
    for gap in BREAKS[by].finditer(text):
        yield at, gap.start()
        at = gap.end()
    yield at, len(text)


def normalised(unit: str) -> list[str]:
    """Lower-case runs of letters and digits: units that differ only in case, spacing or punctuation are one."""
    return _TOKEN.findall(unit.lower())


def units(docs: DataFrame, by: str, min_words: int) -> DataFrame:
    """doc_id, rank, row, unit, start, end, n_words, hi, lo of every unit with enough words.

    ``row`` is a hash of doc_id and text, which tells different texts of one doc_id apart; ``unit`` is the number among
    the text's units that hold a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "rank", "row", "unit", "start", "end", "n_words", "hi", "lo"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                row, columns, digests = [], [[] for _ in range(4)], []
                for i, text in enumerate(part.column(3)):
                    text, k = text.as_py() or "", 0
                    for start, end in units_of(text, by):
                        words = normalised(text[start:end])
                        if len(words) >= min_words:
                            row.append(i)
                            for c, v in zip(columns, (k, start, end, len(words)), strict=True):
                                c.append(v)
                            digests.append(blake2b(" ".join(words).encode(), digest_size=16).digest())
                        k += bool(words)
                where = pa.array(row, pa.int32())
                halves = pa.array(memoryview(b"".join(digests)).cast("q") if digests else [], pa.int64())
                even = pa.array(range(0, len(halves), 2), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(where) for c in range(3)), *(pa.array(c, pa.int64()) for c in columns), halves.take(even), halves.slice(1).take(even)], names)

    return docs.select("doc_id", "rank", F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, rank double, row long, unit long, start long, end long, n_words long, hi long, lo long")


def repeated_units(docs: DataFrame, by: str = "line", min_words: int = 1, rank: str | None = None) -> DataFrame:
    """One row for each unit of ``docs`` (doc_id, text) that repeats an earlier ranked one.

    Columns: doc_id, row, unit, start, end (characters of the original text), n_words, kept_doc_id, kept_unit.  The
    earliest occurrence, by the numeric column ``rank`` if named, then doc_id, then place in the text, stays.  Units
    under ``min_words`` words are left alone, wordless ones always.

    Null and empty texts have no units.  Rows without doc_id rank after all others and a null rank after all numbers.
    A repeated row is one document, so its copies keep and lose the same units, each reported once; different texts of
    one doc_id are told apart by ``row``.  Texts of any length are read whole.  Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    if by not in UNITS:
        raise ValueError(f"by: one of {', '.join(UNITS)}")
    ranked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(rank).cast("double") if rank else F.lit(0.0)).alias("rank"), "text")
    found = checkpointed(units(ranked, by, max(1, min_words)))
    total = found.count()
    place = F.struct(F.col("rank").isNull().alias("unranked"), "rank", F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "unit")
    first = checkpointed(found.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("hi").alias("hi_"), F.col("lo").alias("lo_"), "first", "n"))
    # Hot digests, at most HOT by their definition, meet their rows without a shuffle; no other key weighs more than one in HOT.
    hot = F.col("n") * HOT >= total
    same_digest = (F.col("hi") == F.col("hi_")) & (F.col("lo") == F.col("lo_"))
    near = found.join(F.broadcast(first.filter(hot)), same_digest, "left")
    far = near.filter("n is null").drop("hi_", "lo_", "first", "n").join(first.filter(~hot).hint("merge"), same_digest)
    again = near.filter("n is not null").unionByName(far)
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")) & (F.col("unit") == F.col("first.unit"))
    again = again.filter(~same).select("doc_id", "row", "unit", "start", "end", "n_words", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.unit").alias("kept_unit"))
    return again.repartition("doc_id", "row").dropDuplicates(["doc_id", "row", "unit"])


def repeated_spans(docs: DataFrame, by: str = "clause", min_words: int = 25, rank: str | None = None) -> DataFrame:
    """Runs of neighbouring repeated units: doc_id, row, start, end, n_units, n_words, kept_doc_id.

    Units of any length take part; a run is reported from ``min_words`` words on, since shorter ones are stock phrases
    and chance rather than passages.  kept_doc_id is the document that keeps the run's longest unit (the first of equals).
    Rows, nulls, repeats and empty tables are as in :func:`repeated_units`.
    """
    again = repeated_units(docs, by, 1, rank)
    place = F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("unit"))
    runs = again.withColumn("run", F.col("unit") - place)
    longest = F.max_by("kept_doc_id", F.struct("n_words", -F.col("unit")))
    spans = runs.groupBy("doc_id", "row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.sum("n_words").alias("n_words"), longest.alias("kept_doc_id"))
    return spans.filter(F.col("n_words") >= min_words).drop("run")


def cut(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """``docs`` with the reported spans taken out of ``text``, and with a span of whole lines the line break after it.

    Spans (of :func:`repeated_units` or :func:`repeated_spans`) belong to a doc_id and a text.  A document's spans are
    at most its units, so gathering them by document is bounded by its own text.
    """

    @F.pandas_udf("string")
    def without(text, spans):
        out = []
        for t, gone in zip(text, spans, strict=True):
            if t is not None and gone is not None:
                parts, at = [], 0
                for s in sorted((int(g["start"]), int(g["end"])) for g in gone):
                    if s[0] >= at:
                        parts.append(t[at : s[0]])
                    whole = t[s[1] : s[1] + 1] == "\n" and (s[0] == 0 or t[s[0] - 1] == "\n")
                    at = max(at, s[1] + whole)
                t = "".join([*parts, t[at:]])
            out.append(t)
        import pandas as pd

        return pd.Series(out, dtype=object)

    spans = repeats.groupBy(F.col("row").alias("cut_row"), F.col("doc_id").alias("cut_id")).agg(F.collect_set(F.struct("start", "end")).alias("cut_spans"))
    # Each row is one struct, so that no column's name can clash.
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("cut_key"))
    joined = rows.join(spans, (F.col("cut_key") == F.col("cut_row")) & F.col("whole.doc_id").eqNullSafe(F.col("cut_id")), "left")
    text = F.when(F.col("cut_spans").isNull(), F.col("whole.text")).otherwise(without("whole.text", "cut_spans"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"whole.`{c}`") for c in docs.columns])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("row")


#: The clauses again in the terms of the other engine's expressions, with line feeds as pieces so that all tile a text.
SQL_CLAUSES = rf"[^\p{{L}}\p{{N}}\n]*[\p{{L}}\p{{N}}]+(?:[^\p{{L}}\p{{N}}\n]+[\p{{L}}\p{{N}}]+){{2}}[^{MARKS}\n]*[{MARKS}]*|[^\n]+|\n+"
OP10_SQL = (
    r"""
WITH tiles AS (
    SELECT doc_id, regexp_extract_all(text, '"""
    + SQL_CLAUSES
    + r"""') AS tiles FROM documents WHERE text IS NOT NULL
), numbered AS (
    SELECT doc_id, unnest(tiles) AS tile, unnest(range(len(tiles))) AS k FROM tiles
), placed AS (
    SELECT doc_id, k, tile,
        coalesce(sum(length(tile)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
        trim(regexp_replace(lower(tile), '[^\p{L}\p{N}]+', ' ', 'g')) AS content
    FROM numbered
), counted AS (
    SELECT *, length(content) - length(replace(content, ' ', '')) + 1 AS words, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS unit FROM placed WHERE content <> ''
), ranked AS (
    SELECT *, first_value(doc_id) OVER w AS kept, row_number() OVER w AS place FROM counted WINDOW w AS (PARTITION BY content ORDER BY doc_id, unit)
), runs AS (
    SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM ranked WHERE place > 1
)
SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max(start + length(tile)) AS BIGINT) AS "end", count(*) AS n_units, CAST(sum(words) AS BIGINT) AS n_words,
    arg_max(kept, words * 100000000 - unit) AS kept_doc_id
FROM runs GROUP BY doc_id, run HAVING sum(words) >= 25
"""
)
