"""How text filters interact, by a relational word pipeline.

Words are exploded and aggregated by (document, word), then by document, which gives totals and distinct counts; the
other flags are outer-joined to these by document.  Each document then has one of 32 patterns of failures, and a part of
the corpus is 32 conditional counts (for all, good and toxic documents): whatever the order of the filters, its
figures are sums of these counts, so that the corpus is read once for all 120 orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

FILTERS = "ABCDE"
PATTERNS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Whitespace of the word class; the first of them stands for all.
_BLANKS = " \t\n\x0b\x0c\r"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, part, text (null: empty) and the digest of the text, which with doc_id names a document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return rows.select("*", F.xxhash64("text").alias("hi"), F.xxhash64(F.lit(13), "text").alias("lo"))


def word_counts(keyed: DataFrame) -> DataFrame:
    """doc_id, hi, lo, words and distincts of each document.

    Documents are dealt by their key before words are exploded: both aggregations then find their groups in one task, and
    one text is shuffled instead of its words.  A null stands before each row's words, so that documents without
    words have a row and repeated rows can be told from repeated words.
    """
    texts = keyed.select("doc_id", "hi", "lo", "text").repartition("doc_id", "hi", "lo")
    parts = F.split(F.translate("text", _BLANKS, " " * len(_BLANKS)), " ")
    words = texts.select("doc_id", "hi", "lo", F.explode(F.concat(F.array(F.lit(None).cast("string")), parts)).alias("word"))
    words = words.filter("word is null or word <> ''")
    by_word = words.groupBy("doc_id", "hi", "lo", "word").agg(F.count("*").alias("n"))
    rows = F.max(F.when(F.col("word").isNull(), F.col("n")))
    return by_word.groupBy("doc_id", "hi", "lo").agg((F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)) / rows).cast("long").alias("words"), F.count("word").alias("distincts"))


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with what was ``found`` for their document, null where nothing was; a null doc_id is a key like others."""
    theirs = found.withColumnsRenamed({"doc_id": "their_id", "hi": "their_hi", "lo": "their_lo"})
    same = F.col("doc_id").eqNullSafe(F.col("their_id")) & (F.col("hi") == F.col("their_hi")) & (F.col("lo") == F.col("their_lo"))
    return rows.join(theirs, same, "left").drop("their_id", "their_hi", "their_lo")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, mask (bit i: fails filter i of ABCDE), good and toxic of each row of ``docs``."""
    keyed = _keyed(docs)
    counts = word_counts(keyed)
    text = F.col("text")
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    flags = keyed.select("doc_id", "part", "hi", "lo", (100 * upper > 2 * F.length(text)).alias("c"), text.rlike(r"[#$%&*|]").alias("d"))
    # One row a text, whatever the number of its copies: the first of them alone passes E.
    firsts = keyed.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("marked_id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    out = _joined(_joined(flags, counts), firsts).join(marks, F.col("doc_id") == F.col("marked_id"), "left")
    fails = [F.col("words") < 200, 100 * F.col("distincts") < 50 * F.col("words"), F.col("c"), F.col("d"), F.col("first").isNull()]
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))
    return out.select("doc_id", "part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def pattern_counts(failed: DataFrame) -> DataFrame:
    """part with arrays n, good and toxic: the documents of each of the 32 patterns of failures."""
    column = lambda name, m, cond: F.count(F.when((F.col("mask") == m) & cond, 1)).alias(f"{name}{m}")
    conditions = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counted = failed.groupBy("part").agg(*[column(name, m, cond) for name, cond in conditions.items() for m in range(PATTERNS)])
    return counted.select("part", *[F.array(*[f"{name}{m}" for m in range(PATTERNS)]).alias(name) for name in conditions])


def _over(counts: str, wanted) -> Column:
    """The sum of the counts whose pattern meets ``wanted``."""
    return F.aggregate(F.transform(counts, lambda n, m: F.when(wanted(m), n).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, n: a + n)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and, for the step's filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` (doc_id, text, source) are parted by source, null being the empty string.  Filters fail texts A: of under 200
    words; B: with under half as many distinct words as words; C: of over 2 % capital letters A-Z; D: that hold one of
    ``#$%&*|``; E: that are identical to the text of a smaller doc_id anywhere in the table.  Each part has a row for each
    step of each of the 120 orders, zeros included.

    A null text is empty.  Rows without doc_id come after all others: they fail E where a row with doc_id has their text.
    Rows that share doc_id and text count each and don't fail one another; different texts of one doc_id are different
    documents, which share its labels.  A document is good (toxic) if any label row of its id says 1.  Texts of any
    length are read whole, other columns are ignored whatever their names, an empty table gives an empty result.
    """
    counts = pattern_counts(failures(docs, labels))
    rows = counts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: F.pow(F.lit(2), F.ascii(F.substr("filter_order", i, F.lit(1))) - F.lit(ord("A"))).cast("int"))
    rows = rows.withColumn("bits", bits).withColumn("bit", F.element_at("bits", F.col("step")))
    rows = rows.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b))
    bit, before = F.col("bit"), F.col("before")
    here = lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)
    # Of k failed filters each is the first in 120 / k orders.
    share = F.aggregate(F.transform("n", lambda n, m: F.when(m.bitwiseAND(bit) != 0, n * F.expr("120L") / F.bit_count(m)).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, n: a + n)
    return rows.select(
        "part",
        "filter_order",
        "step",
        _over("n", lambda m: m.bitwiseAND(before + bit) == 0).alias("kept"),
        _over("n", here).alias("removed"),
        _over("n", lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        _over("n", lambda m: m == bit).alias("unique_fails"),
        _over("good", here).alias("good_lost"),
        _over("toxic", here).alias("toxic_lost"),
        F.round(share).cast("long").alias("shapley"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
    SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts
), marks AS (
    SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), failed AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
    FROM words LEFT JOIN marks USING (doc_id)
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x
), grouped AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, fails
), gone AS (
    SELECT *, CASE WHEN fails = '' THEN 6 ELSE length(regexp_extract(filter_order, '^[^' || fails || ']*')) + 1 END AS place FROM grouped, orders
), steps AS (
    SELECT unnest([1, 2, 3, 4, 5]) AS step
), figures AS (
    SELECT part, filter_order, step,
        sum(n) FILTER (place > step) AS kept, sum(n) FILTER (place = step) AS removed,
        sum(n) FILTER (place < step AND contains(fails, substr(filter_order, step, 1))) AS redundant,
        sum(n) FILTER (fails = substr(filter_order, step, 1)) AS unique_fails,
        sum(good) FILTER (place = step) AS good_lost, sum(toxic) FILTER (place = step) AS toxic_lost
    FROM gone, steps GROUP BY part, filter_order, step
), shares AS (
    SELECT part, substr(filter_order, step, 1) AS letter, sum(removed) AS shapley FROM figures GROUP BY 1, 2
)
SELECT f.part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
    CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(shapley, 0) AS BIGINT) AS shapley
FROM figures f JOIN shares s ON f.part = s.part AND letter = substr(filter_order, step, 1)
"""
