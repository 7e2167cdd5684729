"""Queries over findings about institutions, each with its SQL.  Customers stand for institutions, their figures for what modules counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.operators import insights


def _figures(spark: SparkSession, d: str) -> DataFrame:
    """People, money and places as three modules would give them, each for the institutions it knows."""
    who = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    people = who.select(k.alias("id"), (k % 40).alias("served"), (k % 9).alias("limited"), (k % 5).alias("dependent"), (k % 4).alias("few_visits"), (k % 6).alias("elderly_without_program"), (k % 3).alias("school_lag"), (k % 2).alias("without_consent"), (k % 8).alias("incomplete"), (k % 7).alias("waiting"), (k % 2 == 0).alias("elderly_home"), (k % 3 == 0).alias("children_home"), F.when(k % 4 > 0, k % 3000).alias("average_fee"))
    money = who.filter("c_custkey % 5 > 0").select(k.alias("id"), (k % 50 * 1000).alias("expenses_annual"), (k % 6).alias("carers"))
    places = who.filter("c_custkey % 7 > 0").select(k.alias("id"), F.when(k % 6 > 0, k % 45).alias("capacity"), F.when(k % 3 == 0, F.array(F.lit("3 baños"))).otherwise(F.array().cast("array<string>")).alias("not_accessible"), (k % 4).alias("not_accessible_spaces"))
    return insights.board(insights.context([people, money, places]))


def people_insights(spark: SparkSession, d: str) -> DataFrame:
    told = insights.found(_figures(spark, d), "id", insights.people_rules())
    numbers = F.array_join(F.transform(F.array_sort(F.map_entries("numbers")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return told.select("id", "code", numbers.alias("numbers"), F.array_join("items", ",").alias("items"), "for_ai")


PEOPLE_INSIGHTS_SQL = """
WITH c AS (SELECT c_custkey AS id, c_custkey AS k, c_custkey % 40 AS served, c_custkey % 9 AS lim, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 6 > 0 THEN c_custkey % 45 END AS cap, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 50 * 1000 END AS spent, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 3000 ELSE 0 END AS fee FROM customer),
b AS (SELECT *, greatest(cap - served, CASE WHEN cap IS NOT NULL THEN 0 END) AS free, CASE WHEN cap > 0 THEN served * 100 // cap END AS occ, CASE WHEN served > 0 THEN (spent + 6 * served) // (12 * served) END AS cost FROM c),
i AS (SELECT id, unnest([
  CASE WHEN lim > 0 AND k % 7 > 0 AND k % 3 = 0 THEN {'code': 'mobility_vs_access', 'numbers': 'people=' || lim || ' spaces=' || k % 4, 'items': '3 baños', 'ai': lim >= 3} END,
  CASE WHEN k % 7 > 0 THEN {'code': 'waitlist_vs_seats', 'numbers': 'free=' || coalesce(free, -1) || ' waiting=' || k % 7, 'items': '', 'ai': true} END,
  CASE WHEN occ >= 95 THEN {'code': 'occupancy_high', 'numbers': 'percent=' || occ, 'items': '', 'ai': true} END,
  CASE WHEN cost IS NOT NULL THEN {'code': 'cost_gap', 'numbers': 'cost=' || cost || ' fee=' || fee || ' gap=' || greatest(cost - fee, 0), 'items': '', 'ai': false} END,
  CASE WHEN k % 5 >= 3 THEN {'code': 'dependency_vs_carers', 'numbers': 'carers=' || k % 6 || ' dependent=' || k % 5, 'items': '', 'ai': true} END,
  CASE WHEN k % 4 > 0 THEN {'code': 'few_visits', 'numbers': 'people=' || k % 4, 'items': '', 'ai': k % 4 >= 3} END,
  CASE WHEN k % 2 = 0 AND k % 6 > 0 THEN {'code': 'no_program', 'numbers': 'people=' || k % 6, 'items': '', 'ai': k % 6 >= 3} END,
  CASE WHEN k % 3 = 0 AND k % 3 > 0 THEN {'code': 'school_lag', 'numbers': 'people=' || k % 3, 'items': '', 'ai': false} END,
  CASE WHEN k % 2 > 0 THEN {'code': 'without_consent', 'numbers': 'people=' || k % 2, 'items': '', 'ai': false} END,
  CASE WHEN k % 8 > 0 THEN {'code': 'incomplete_records', 'numbers': 'people=' || k % 8, 'items': '', 'ai': false} END]) AS x FROM b)
SELECT id, x.code AS code, x.numbers AS numbers, x.items AS items, x.ai AS for_ai FROM i WHERE x IS NOT NULL
"""

QUERIES = {"people_insights": people_insights}
ORACLES = {"people_insights": PEOPLE_INSIGHTS_SQL}
