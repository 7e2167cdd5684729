"""Usage and cost of model calls: pairs, tasks, the month's spend, prices in force, the newest attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(calls: DataFrame, configured: DataFrame) -> DataFrame:
    """provider, model and last (the newest call's number) of every pair used, and the configured pairs without calls (null).

    The order of the original, most recent first and unused last, is that of ``last`` descending with nulls last.
    """
    used = calls.groupBy("provider", "model").agg(F.max("seq").alias("last"))
    unused = configured.select("provider", "model").distinct().join(used, ["provider", "model"], "left_anti")
    return used.unionByName(unused, allowMissingColumns=True)


def by_task(calls: DataFrame) -> DataFrame:
    """task, calls, whole average latency and tokens, and cost, of the calls that succeeded."""
    mean = lambda c: F.avg(c).cast("long").alias(f"avg_{c}")
    return calls.filter("success").groupBy("task").agg(F.count("*").alias("calls"), mean("latency"), mean("tokens"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))


def spent_in_month(calls: DataFrame, now: Column) -> DataFrame:
    """One row: the cost since the first of the month of ``now``; 0 without calls."""
    return calls.filter((F.col("at") >= F.date_trunc("month", now)) & (F.col("at") <= now)).agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``calls`` (call_id, model, at, input, output, cached, written) with ``cost`` in millionths of the price unit.

    ``prices`` (name, from_day, price_in, price_out; whole numbers a million tokens) is a price list and broadcast: each
    name's newest entry by the day of the call is in force.  A model takes the price of its own name, else that of the
    longest name it begins with, else the highest of all.  Tokens read from a cache cost a tenth, written ones 1.25 times.
    """
    days = calls.select("model", F.to_date("at").alias("day")).distinct()
    listed = prices.select("name", "from_day", F.struct("price_in", "price_out").alias("price"))
    met = days.join(F.broadcast(listed), F.col("from_day") <= F.col("day")).groupBy("model", "day", "name").agg(F.max_by("price", "from_day").alias("price"))
    fits = F.when(F.startswith("model", "name"), F.length("name"))
    best = met.groupBy("model", "day").agg(F.max_by("price", fits).alias("own"), F.max("price.price_in").alias("top_in"), F.max("price.price_out").alias("top_out"))
    pick = lambda side: F.coalesce(F.col(f"own.price_{side}"), F.col(f"top_{side}"))
    rates = best.select(F.col("model").alias("m"), F.col("day").alias("d"), pick("in").alias("rate_in"), pick("out").alias("rate_out"))
    cost = F.col("rate_in") * (F.col("input") + 0.1 * F.col("cached") + 1.25 * F.col("written")) + F.col("rate_out") * F.col("output")
    joined = calls.join(rates, (F.col("model") == F.col("m")) & (F.to_date("at") == F.col("d")), "left")
    return joined.select(*calls.columns, cost.alias("cost"))


def newest(calls: DataFrame, n: int = 20) -> DataFrame:
    return calls.orderBy(F.desc("seq")).limit(n)
