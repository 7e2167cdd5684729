"""Queries over checks of answers and shares, each with its SQL.  Answers are written from orders; the SQL takes the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.operators import criteria
from tesela.operators.criteria import Criterion

_RULES = [Criterion("urgency", (("urgent", "high"),)), Criterion("figures", (("7",), ("f", "o")), hard=True)]


def answers_taken(spark: SparkSession, d: str) -> DataFrame:
    """Orders as answers: some with a figure that nobody stated, some with an address."""
    k = F.col("o_orderkey")
    answer = F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("p"), F.array(F.col("o_orderstatus"), F.when(k % 5 == 0, "x@correo.example")).alias("s")).alias("a"), k.alias("n"), F.lit(True).alias("b")))
    rows = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), F.when(k % 11 > 0, answer).otherwise("nada").alias("json"), F.when(k % 3 == 0, F.array(F.lit("9"))).alias("odd"))
    return criteria.taken(criteria.checked(rows, _RULES, F.col("odd"))).groupBy("taken", "met", "checks").agg(F.count("*").alias("answers"))


ANSWERS_TAKEN_SQL = """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 11 > 0 AS ok, lower(o_orderpriority || ' ' || o_orderstatus || CASE WHEN o_orderkey % 5 = 0 THEN ' x@correo.example' ELSE '' END || ' ' || o_orderkey) AS t FROM orders),
c AS (SELECT ok AND (contains(t, 'urgent') OR contains(t, 'high')) AS a, ok AND contains(t, '7') AND (contains(t, 'f') OR contains(t, 'o')) AS b, k % 3 > 0 AS d, NOT (ok AND k % 5 = 0) AS e FROM o)
SELECT b AND d AND e AS taken, CAST(a AS BIGINT) + CAST(b AS BIGINT) + CAST(d AS BIGINT) + CAST(e AS BIGINT) AS met, CAST(4 AS BIGINT) AS checks, count(*) AS answers FROM c GROUP BY ALL
"""


def order_shares(spark: SparkSession, d: str) -> DataFrame:
    """What share of its customer's orders each order is; customers whose number is divisible by ten count as nobody's."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.when(F.col("o_custkey") % 10 > 0, F.col("o_custkey")).alias("who"), F.when(F.col("o_orderkey") % 4 > 0, F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return criteria.shares(o, ["who"], "cents").select("o_orderkey", F.round("share", 9).alias("share"))


ORDER_SHARES_SQL = """
WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 > 0 THEN o_custkey END AS who, CASE WHEN o_orderkey % 4 > 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS cents FROM orders)
SELECT o_orderkey, round(cents / nullif(sum(cents) OVER (PARTITION BY who), 0), 9) AS share FROM o
"""

QUERIES = {"answers_taken": answers_taken, "order_shares": order_shares}
ORACLES = {"answers_taken": ANSWERS_TAKEN_SQL, "order_shares": ORDER_SHARES_SQL}
