"""Queries over days as texts write them, each with its SQL.  Texts are written from days of orders; the SQL takes the days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import readings
from tesela.sources.shared import spread

_USUAL = 2027


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/orders.parquet").filter("o_orderdate is not null").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")))


def _month(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, readings.MONTHS)), F.month(day))


def calendar_spans(spark: SparkSession, d: str) -> DataFrame:
    """Days in eight forms, beside a sentence without any: what each text's spans are."""
    rows = _orders(spark, d).withColumn("later", F.date_add("day", 40))
    k, day, later = F.col("o_orderkey"), F.col("day"), F.col("later")
    n, month, year = F.dayofmonth(day), _month(day), F.year(day)
    last = F.least(n + 3, F.lit(28))
    text = (
        F.when(k % 8 == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" a las 9:30 horas")))
        .when(k % 8 == 1, F.format_string("%d.%d.%d", n, F.month(day), year))
        .when(k % 8 == 2, F.format_string("del %d al %d de %s de %d", n, last, month, year))
        .when(k % 8 == 3, F.format_string("%s %d - %d, %d", F.initcap(month), n, last, year))
        .when(k % 8 == 4, F.format_string("%d de %s. de %d", n, F.left(month, F.lit(3)), year))
        .when(k % 8 == 5, F.format_string("%s %d", F.upper(month), n))
        .when(k % 8 == 6, F.format_string("%s del %d", month, year))
        .otherwise(F.format_string("%d de %s hasta el %d de %s de %d", n, month, F.dayofmonth(later), _month(later), F.year(later)))
    )
    spans = rows.select(F.explode(readings.spans_of_days(F.concat(F.lit("Registro: "), text, F.lit("; fallo de 3 a 5 personas.")), F.lit(_USUAL))).alias("s"))
    return spans.groupBy(F.col("s.start.date").alias("first"), F.col("s.end.date").alias("last"), F.col("s.start.precision").alias("precision"), F.col("s.start.inferred").alias("inferred")).agg(F.count("*").alias("texts"))


CALENDAR_SPANS_SQL = f"""
WITH o AS (SELECT o_orderkey % 8 AS k, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate IS NOT NULL),
s AS (SELECT k, strftime(d, '%Y-%m-%d') AS day, strftime(d, '%Y-%m-') || printf('%02d', least(day(d) + 3, 28)) AS later, strftime(d + 40, '%Y-%m-%d') AS far, strftime(d, '-%m-%d') AS rest FROM o)
SELECT CASE WHEN k = 5 THEN '{_USUAL}' || rest WHEN k <> 6 THEN day END AS first, CASE WHEN k IN (2, 3) THEN later WHEN k = 7 THEN far END AS last,
  CASE WHEN k = 6 THEN 'month' ELSE 'day' END AS precision, k = 5 AS inferred, count(*) AS texts FROM s GROUP BY ALL
"""


def milestones_read(spark: SparkSession, d: str) -> DataFrame:
    """Starts, ends and quotes of milestones, in which one holds what another lacks."""
    rows = _orders(spark, d)
    k, day = F.col("o_orderkey"), F.col("day")
    n, month, year = F.dayofmonth(day), _month(day), F.year(day)
    last = F.least(n + 3, F.lit(28))
    start = F.when(k % 4 == 0, F.format_string("%d a %d de %s", n, last, month)).when(k % 4 == 1, F.format_string("%d de %s de %d", n, month, year)).when(k % 4 == 2, F.lit(" ")).otherwise("pronto")
    end = F.when(k % 4 == 1, F.format_string("%d de %s", last, month))
    quote = F.when(k % 4 == 2, F.format_string("Cierre: %d de %s de %d, 7:05 horas", n, month, year)).otherwise("a las 25:00 y 18:30")
    told = rows.select(readings.milestone(start, end, quote, F.lit(_USUAL)).alias("m"))
    return told.groupBy(F.col("m.start.date").alias("first"), F.col("m.start.time").alias("time"), F.col("m.end.date").alias("last"), F.col("m.end.inferred").alias("inferred")).agg(F.count("*").alias("milestones"))


MILESTONES_READ_SQL = f"""
WITH o AS (SELECT o_orderkey % 4 AS k, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate IS NOT NULL),
s AS (SELECT k, strftime(d, '%Y-%m-%d') AS day, strftime(d, '-%m-%d') AS rest, strftime(d, '-%m-') || printf('%02d', least(day(d) + 3, 28)) AS later FROM o)
SELECT CASE k WHEN 0 THEN '{_USUAL}' || rest WHEN 1 THEN day WHEN 2 THEN day END AS first, CASE WHEN k < 2 THEN '18:30' WHEN k = 2 THEN '07:05' END AS time,
  CASE WHEN k < 2 THEN '{_USUAL}' || later END AS last, CASE WHEN k < 2 THEN true END AS inferred, count(*) AS milestones FROM s GROUP BY ALL
"""

QUERIES = {f.__name__: f for f in (calendar_spans, milestones_read)}
ORACLES = {k.removesuffix("_SQL").lower(): v for k, v in dict(globals()).items() if k.endswith("_SQL")}
