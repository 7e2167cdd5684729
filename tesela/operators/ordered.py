"""Ranks, running sums and exact quantiles of groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.sources.shared import written


def dealt(rows: DataFrame, by: list[str], order: list[Column | str], size: Column) -> DataFrame:
    """``rows`` with ``_range``, ``_size`` and ``_start``, the sum of ``size`` over earlier ranges of the same group.

    Ranges of (by, order) are sampled and so of even size: a hot group lies in many.  They are written down, since a
    range's number is good only for the run that dealt it.  A group's ranges, one row each, are summed across.
    """
    ranges = written(rows.withColumn("_size", size.cast("long")).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ordered")
    totals = ranges.groupBy(*by, "_range").agg(F.sum("_size").alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    same = [ranges[k].eqNullSafe(starts[k]) for k in [*by, "_range"]]
    return ranges.join(starts, same).drop(*[starts[k] for k in [*by, "_range"]])


def summed(deal: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Rows of :func:`dealt` with, in ``name``, the sum over all earlier rows of their group."""
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return deal.withColumn(name, F.coalesce(F.sum("_size").over(inside), F.lit(0)) + F.col("_start")).drop("_range", "_size", "_start")


def ranked(rows: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with, in ``name``, their place (from 0) in their group; ``order`` must tell all rows of a group apart."""
    return summed(dealt(rows, by, order, F.lit(1)), by, order, name)


def quantile(rows: DataFrame, by: list[str], value: str, share: float, name: str) -> DataFrame:
    """``by`` and the smallest value that at least ``share`` of a group's values don't exceed; nulls count for nothing.

    Equal values are counted before they are ordered, so neither a hot group nor a hot value is one task's work.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    below = summed(dealt(counted, by, [value], F.col("_n")), by, [value], "_below")
    total = below.groupBy(*by).agg(F.sum("_n").alias("_all"))
    reached = below.join(total, by).filter(F.col("_below") + F.col("_n") >= F.ceil(F.col("_all") * share))
    return reached.groupBy(*by).agg(F.min(value).alias(name))
