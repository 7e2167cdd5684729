"""Cross-site boilerplate lines by distinct-site spread.

A HyperLogLog sketch of the sites that carry it is kept for each line hash; sketches merge map-side and again after
the shuffle, so a line on a third of all pages costs a sketch a task.  Lines whose estimate is clear of the threshold
are settled by it, those near it by an exact distinct count.  Everything is DataFrame code; texts are shuffled once.

Copies of one page on many sites spread all their lines, which makes them no boilerplate.  So a second count settles
the lines that spread at all: only pages which mostly consist of other lines are evidence in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: log2 of a sketch's registers, and three of its standard errors.
PRECISION = 10
NEAR = 0.1


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row as one struct, so that no column's name can clash, with the pair that names it.

    line_key tells rows of one doc_id but different content apart.
    """
    row = docs.select(F.struct(*docs.columns).alias("row"))
    return row.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63))).alias("name"), F.xxhash64("row.doc_id", "row.source", "row.text").alias("line_key"))


def line_rows(keyed: DataFrame) -> DataFrame:
    """name, line_key, source, total, line (its number), size, hi, lo (hashes of the trimmed line); blank lines left out.

    size and total count the characters of the line and of all lines of its text.
    """
    parts = F.split("row.text", "\n")
    total = F.aggregate(F.transform(parts, lambda x: F.length(F.trim(x))), F.lit(0), lambda a, x: a + x)
    # Two steps, or the total would be summed again for every line.
    whole = keyed.select("name", "line_key", F.col("row.source").cast("string").alias("source"), total.alias("total"), parts.alias("parts"))
    rows = whole.select("name", "line_key", "source", "total", F.posexplode("parts").alias("line", "content"))
    rows = rows.withColumn("content", F.trim("content")).filter("content <> ''")
    return rows.select("name", "line_key", "source", "total", "line", F.length("content").alias("size"), F.xxhash64("content").alias("hi"), F.xxhash64(F.lit(20_07), "content").alias("lo"))


def widespread(lines: DataFrame, min_sites: int) -> DataFrame:
    """hi and lo of the lines found on ``min_sites`` distinct sources or more."""
    spread = lines.groupBy("hi", "lo").agg(F.count("source").alias("times"), F.hll_sketch_agg("source", PRECISION).alias("sketch"))
    spread = spread.filter(F.col("times") >= min_sites).select("hi", "lo", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = checkpointed(spread.filter(F.col("sites") >= min_sites * (1 - NEAR) - 1))
    sure = F.col("sites") > min_sites * (1 + NEAR) + 1
    near = spread.filter(~sure).select("hi", "lo")
    exact = lines.join(near, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.countDistinct("source").alias("sites")).filter(F.col("sites") >= min_sites)
    return spread.filter(sure).select("hi", "lo").union(exact.select("hi", "lo"))


def line_dedup(docs: DataFrame, min_sites: int = 8) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) without boilerplate lines, and n_lines and n_removed of each row.

    A line spreads when its trimmed text stands on at least ``min_sites`` distinct sources; it is boilerplate when it
    still does so on the pages of which spreading lines make up at most half of the characters.  Boilerplate is taken out
    of every document, whatever its share there.  Copies of one page, exact or near, are therefore no evidence against
    their own lines, and are left to the document deduplicators.

    Blank lines are never boilerplate and stay.  A null source counts for no site.  A null text stays null, with no
    lines; an empty text has none either; texts of any length are read whole.  Repeated rows give repeated results, and
    different texts of one doc_id are told apart.  Further columns pass through, whatever their names but for n_lines and
    n_removed, which are replaced; an empty table gives an empty result.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = _keyed(docs.select(*columns))
    lines = checkpointed(line_rows(keyed))
    # The hints keep the plan the same at every size: these sides grow with the corpus and are none to broadcast.
    spread = checkpointed(lines.join(widespread(lines, min_sites).hint("merge"), ["hi", "lo"], "left_semi").repartition("name", "line_key"))
    # A repeated row holds its lines as often as it occurs, so each counts once here.
    rows = spread.groupBy("name", "line_key", "line", "total").agg(F.first("size").alias("size")).groupBy("name", "line_key").agg((2 * F.sum("size") <= F.first("total")).alias("page")).filter("page").select("name", "line_key")
    found = widespread(spread.join(rows.hint("merge"), ["name", "line_key"], "left_semi"), min_sites)
    hits = spread.join(found.hint("merge"), ["hi", "lo"], "left_semi").groupBy("name", "line_key").agg(F.collect_set("line").alias("gone"))
    hits = hits.select(F.col("name").alias("hit_name"), F.col("line_key").alias("hit_key"), "gone")
    joined = keyed.join(hits.hint("merge"), (F.col("name") == F.col("hit_name")) & (F.col("line_key") == F.col("hit_key")), "left").select("row", "gone")
    parts = F.split("row.text", "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    n_lines = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size(F.filter(parts, lambda x: F.trim(x) != "")))
    n_removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in columns], n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


OP5_SQL = """
WITH parts AS (
    SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), numbered AS (
    SELECT doc_id, source, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM parts
), spread AS (
    SELECT trim(line) AS content FROM numbered WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 8
), pages AS (
    SELECT doc_id FROM numbered LEFT JOIN spread ON trim(line) = content GROUP BY doc_id
    HAVING 2 * coalesce(sum(length(content)), 0) <= sum(length(trim(line)))
), boilerplate AS (
    SELECT content FROM numbered JOIN spread ON trim(line) = content WHERE doc_id IN (SELECT doc_id FROM pages) GROUP BY 1 HAVING count(DISTINCT source) >= 8
), flagged AS (
    SELECT m.*, b.content IS NOT NULL AS hit FROM numbered m LEFT JOIN boilerplate b ON trim(m.line) = b.content
), totals AS (
    SELECT doc_id, count(*) FILTER (trim(line) <> '') AS n_lines, count(*) FILTER (hit) AS n_removed, string_agg(line, chr(10) ORDER BY n) FILTER (NOT hit) AS rest
    FROM flagged GROUP BY doc_id
), done AS (
    SELECT d.doc_id, t.n_lines, t.n_removed, CASE WHEN t.n_removed > 0 THEN coalesce(t.rest, '') ELSE d.text END AS text
    FROM documents d JOIN totals t USING (doc_id)
)
SELECT doc_id, n_lines, n_removed, length(text) AS n_chars_left, md5(text) AS text_md5 FROM done
"""
