"""Queries over forms, each with its SQL.  Answers are written as JSON from customers; the SQL takes the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.operators import forms
from tesela.operators.forms import Field, When

FORM = [
    Field("org.name", required=True, step="who"), Field("org.form", "select", ("ac", "iap"), required=True, step="who"), Field("org.ways", "multi", ("day", "night"), step="how"), Field("org.beds", "number", least=1, most=90, required=True, when=When("org.ways", ("night",)), step="how"),
    Field("org.since", "year", least=1900, most=2026, step="how"), Field("org.junta", required=True, when=When("org.form", ("iap",)), step="how"), Field("org.note", when=When("org.name"), step="how"), Field("org.day", "date", step="how"),
]


def _answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda options, i: F.element_at(F.array(*[F.lit(o).cast("string") for o in options]), (i + 1).cast("int"))
    ways: Column = F.when(k % 4 == 0, F.array(F.lit("day"), F.lit("night"))).when(k % 4 == 1, F.array(F.lit("night"), F.lit("night"))).when(k % 4 == 2, F.array(F.lit("moon")))
    told = F.struct(
        F.when(k % 5 > 0, F.col("c_name")).otherwise(" ").alias("org.name"), pick(["ac", "iap", "sa", None], k % 4).alias("org.form"), ways.alias("org.ways"), F.when(k % 3 > 0, k % 100).alias("org.beds"), F.when(k % 7 > 0, k % 200 + 1850).alias("org.since"),
        F.when(k % 6 == 1, "sí").alias("org.junta"), F.when(k % 2 == 0, "x").alias("org.note"), pick(["2024-02-29", "2023-02-29", None], k % 3).alias("org.day"),
    )
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), F.when(k % 50 > 0, F.to_json(told)).otherwise("nada").alias("answers"))


def form_issues(spark: SparkSession, d: str) -> DataFrame:
    return forms.issues(_answers(spark, d), "id", FORM)


_FORM = """
WITH c AS (SELECT c_custkey AS k, c_custkey % 50 > 0 AS ok FROM customer),
f AS (SELECT k, ok, ok AND k % 5 > 0 AS name, ok AND k % 4 < 3 AS form, ok AND k % 4 = 1 AS iap, ok AND k % 4 < 3 AS ways, ok AND k % 4 < 2 AS night, ok AND k % 3 > 0 AS beds, ok AND k % 7 > 0 AS since, ok AND k % 6 = 1 AS junta, ok AND k % 2 = 0 AS note, ok AND k % 3 < 2 AS day FROM c)
"""
FORM_ISSUES_SQL = (
    _FORM
    + """, i AS (SELECT k, unnest([CASE WHEN NOT name THEN 'org.name missing false' END, CASE WHEN NOT form THEN 'org.form missing false' WHEN k % 4 = 2 THEN 'org.form code_unknown true' END, CASE WHEN ok AND k % 4 = 1 THEN 'org.ways repeated true' WHEN ok AND k % 4 = 2 THEN 'org.ways code_unknown true' END,
  CASE WHEN night AND NOT beds THEN 'org.beds missing false' WHEN night AND k % 100 < 1 THEN 'org.beds number_too_small true' WHEN night AND k % 100 > 90 THEN 'org.beds number_too_large true' END, CASE WHEN since AND k % 200 + 1850 NOT BETWEEN 1900 AND 2026 THEN 'org.since year_invalid true' END,
  CASE WHEN iap AND NOT junta THEN 'org.junta missing false' END, CASE WHEN ok AND k % 3 = 1 THEN 'org.day date_invalid true' END]) AS x FROM f)
SELECT k AS id, split_part(x, ' ', 1) AS field, split_part(x, ' ', 2) AS code, split_part(x, ' ', 3) = 'true' AS blocking FROM i WHERE x IS NOT NULL
"""
)


def form_progress(spark: SparkSession, d: str) -> DataFrame:
    return forms.progress(_answers(spark, d), "id", FORM)


FORM_PROGRESS_SQL = (
    _FORM
    + """, n AS (SELECT k, CAST(name AS INTEGER) + CAST(form AS INTEGER) AS a, CAST(ways AS INTEGER) + CAST(night AND beds AS INTEGER) + CAST(since AS INTEGER) + CAST(iap AND junta AS INTEGER) + CAST(name AND note AS INTEGER) + CAST(day AS INTEGER) AS b, 3 + CAST(night AS INTEGER) + CAST(iap AS INTEGER) + CAST(name AS INTEGER) AS total FROM f)
SELECT k AS id, s AS step, CAST(CASE s WHEN 'who' THEN 2 ELSE total END AS INTEGER) AS applying, CAST(CASE s WHEN 'who' THEN a ELSE b END AS INTEGER) AS filled, CAST(floor(100 * (a + b) / (2 + total)) AS BIGINT) AS percent FROM n, (SELECT unnest(['who', 'how']) AS s) t
"""
)

QUERIES = {"form_issues": form_issues, "form_progress": form_progress}
ORACLES = {"form_issues": FORM_ISSUES_SQL, "form_progress": FORM_PROGRESS_SQL}
