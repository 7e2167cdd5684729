"""Queries over records: joins, usage, indicators, history, validation, dates and pay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import values
from tesela.operators import ordered, records
from tesela.streaming.usage import windowed_usage


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rolling_usage(spark: SparkSession, d: str) -> DataFrame:
    recent = _t(spark, d, "events").filter((F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & ~F.coalesce("event_type", F.lit("")).startswith("err"))
    return recent.groupBy("event_type").agg(F.count("*").alias("calls"), F.coalesce(F.round(F.sum("value"), 4), F.lit(0.0)).alias("value"), F.min("ts").cast("string").alias("oldest"))


ROLLING_USAGE_SQL = "SELECT event_type, count(*) AS calls, coalesce(round(sum(value), 4), 0) AS value, regexp_replace(CAST(min(ts) AS VARCHAR), '0+$', '') AS oldest FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND NOT starts_with(coalesce(event_type, ''), 'err') GROUP BY ALL"


def model_usage(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select((F.col("user_id") % 7).alias("model"), (F.col("event_type") != "error").alias("ok"), "value")
    cents = F.round(F.col("value") * 100).cast("long")
    sums = e.groupBy("model").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.sum(cents).alias("cents"),
        F.coalesce(F.sum(F.when(F.col("ok"), cents)), F.lit(0)).alias("ok_cents"), F.count_if(F.col("ok")).alias("ok_calls"),
    )
    p95 = ordered.quantile(e.filter("ok"), ["model"], "value", 0.95, "p95")
    return sums.join(p95, "model", "left").select("model", "calls", "failures", "cents", F.expr("ok_cents div greatest(ok_calls, 1)").alias("mean_cents"), "p95")


MODEL_USAGE_SQL = "SELECT user_id % 7 AS model, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) // greatest(count(*) FILTER (event_type <> 'error'), 1) AS BIGINT) AS mean_cents, quantile_disc(CASE WHEN event_type <> 'error' THEN value END, 0.95) AS p95 FROM events GROUP BY ALL"


def usage_windows(spark: SparkSession, d: str) -> DataFrame:
    w = windowed_usage(_t(spark, d, "events"), "1 day")
    return w.select("event_type", F.date_format("from", "yyyy-MM-dd").alias("day"), "calls", F.round("value", 2).alias("value"))


USAGE_WINDOWS_SQL = "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, round(round(sum(value), 4), 2) AS value FROM events GROUP BY ALL"


def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    catalog = spark.createDataFrame([(c, i) for i, c in enumerate(["BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE", "AUTOMOBILE", "NONE"])], "code string, ord int")
    return records.by_catalog(_t(spark, d, "customer"), "c_mktsegment", catalog, 3)


CATALOG_COUNTS_SQL = "SELECT code, CAST(ord AS INTEGER) AS ord, count(*) AS n FROM customer JOIN (VALUES ('BUILDING', 0), ('MACHINERY', 1), ('HOUSEHOLD', 2), ('FURNITURE', 3), ('AUTOMOBILE', 4), ('NONE', 5)) c(code, ord) ON code = c_mktsegment GROUP BY ALL HAVING count(*) >= 3"


def pyramid(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("c_acctbal") < 0, "under 0").when(F.col("c_acctbal") < 2500, "to 2499").when(F.col("c_acctbal") < 6000, "to 5999").otherwise("6000 and over")
    return _t(spark, d, "customer").groupBy(band.alias("band"), "c_mktsegment").agg(F.count("*").alias("n")).filter("n >= 3")


PYRAMID_SQL = "SELECT CASE WHEN c_acctbal < 0 THEN 'under 0' WHEN c_acctbal < 2500 THEN 'to 2499' WHEN c_acctbal < 6000 THEN 'to 5999' ELSE '6000 and over' END AS band, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) >= 3"


def history_as_of(spark: SparkSession, d: str) -> DataFrame:
    changes = _t(spark, d, "events").withColumn("set", F.when(F.col("event_type") != "error", F.col("value")))
    return records.as_of(changes, ["user_id"], "ts", "event_id", "set", F.lit("2024-01-15").cast("timestamp"))


HISTORY_AS_OF_SQL = 'SELECT user_id, CASE WHEN event_type <> \'error\' THEN value END AS "set" FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts <= TIMESTAMP \'2024-01-15\') WHERE n = 1'


def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    return records.latest(_t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


LATEST_VERSIONS_SQL = "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1"


def field_changes(spark: SparkSession, d: str) -> DataFrame:
    old = _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    new = old.filter("c_custkey % 5 <> 0").select("c_custkey", (F.col("c_nationkey") + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0)).alias("c_nationkey"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return records.difference(old, new, "c_custkey", ["c_nationkey", "c_mktsegment"], frozenset({"c_mktsegment"}))


FIELD_CHANGES_SQL = """
WITH o AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS a, c_mktsegment AS b FROM customer), w AS (SELECT c_custkey, CAST(c_nationkey + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS a, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS b FROM customer WHERE c_custkey % 5 <> 0)
SELECT c_custkey, 'c_nationkey' AS field, o.a AS old_value, w.a AS new_value FROM o FULL JOIN w USING (c_custkey) WHERE o.a IS DISTINCT FROM w.a
UNION ALL SELECT c_custkey, 'c_mktsegment', NULL, NULL FROM o FULL JOIN w USING (c_custkey) WHERE o.b IS DISTINCT FROM w.b
"""


def upserts(spark: SparkSession, d: str) -> DataFrame:
    base = _t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    changes = base.filter("s_suppkey % 2 = 0").select((F.col("s_suppkey") + 3).alias("s_suppkey"), F.lit(0.0).alias("s_acctbal"))
    return records.upserted(base, changes, ["s_suppkey"])


UPSERTS_SQL = "WITH c AS (SELECT s_suppkey + 3 AS s_suppkey, CAST(0 AS DOUBLE) AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0) SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM c) UNION ALL SELECT * FROM c"


def span_coverage(spark: SparkSession, d: str) -> DataFrame:
    spans = _t(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 5).cast("long").alias("s"), (F.col("l_linenumber") * 5 + F.col("l_quantity").cast("long")).alias("e"))
    return records.coverage(spans, ["l_orderkey"], "s", "e")


SPAN_COVERAGE_SQL = """
WITH s AS (SELECT l_orderkey, l_linenumber * 5 AS s, l_linenumber * 5 + CAST(l_quantity AS BIGINT) AS e FROM lineitem), r AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM s)
SELECT l_orderkey, CAST(sum(greatest(e - greatest(s, coalesce(reached, s)), 0)) AS BIGINT) AS covered FROM r GROUP BY ALL
"""


def validation_issues(spark: SparkSession, d: str) -> DataFrame:
    rules = [("negative", "c_acctbal", True, F.col("c_acctbal") < 0), ("unknown", "c_mktsegment", True, ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")), ("high", "c_acctbal", False, F.col("c_acctbal") > 9000)]
    return records.issues(_t(spark, d, "customer"), "c_custkey", rules).groupBy("code", "field", "blocking").agg(F.count("*").alias("rows"))


VALIDATION_ISSUES_SQL = "SELECT 'negative' AS code, 'c_acctbal' AS field, true AS blocking, count(*) AS rows FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0 UNION ALL SELECT 'unknown', 'c_mktsegment', true, count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') HAVING count(*) > 0 UNION ALL SELECT 'high', 'c_acctbal', false, count(*) FROM customer WHERE c_acctbal > 9000 HAVING count(*) > 0"


def joined_counts(spark: SparkSession, d: str) -> DataFrame:
    """Inner and left joins, a pre-aggregated scalar count, a semi- and an anti-join in one report by nation."""
    c, o, n = _t(spark, d, "customer"), _t(spark, d, "orders"), _t(spark, d, "nation")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("orders"))
    late = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()
    base = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    some = c.join(late, F.col("c_custkey") == F.col("k"), "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("with_f"))
    none = c.join(late, F.col("c_custkey") == F.col("k"), "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("without_f"))
    out = base.groupBy("c_nationkey", "n_name").agg(F.sum(F.coalesce("orders", F.lit(0))).alias("orders"), F.count("*").alias("customers"))
    return out.join(some, "c_nationkey", "left").join(none, "c_nationkey", "left").select("n_name", "customers", "orders", F.coalesce("with_f", F.lit(0)).alias("with_f"), F.coalesce("without_f", F.lit(0)).alias("without_f"))


JOINED_COUNTS_SQL = "WITH x AS (SELECT n_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS f FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT n_name, count(*) AS customers, CAST(sum(k) AS BIGINT) AS orders, count(*) FILTER (f) AS with_f, count(*) FILTER (NOT f) AS without_f FROM x GROUP BY ALL"


def dates_and_pay(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    day, today, amount = F.col("o_orderdate").cast("date"), F.lit("2001-02-28").cast("date"), F.col("o_totalprice").cast("long")
    years = values.years_between(day, today)
    every = F.when(F.col("o_orderkey") % 3 == 0, "weekly").when(F.col("o_orderkey") % 3 == 1, "biweekly").otherwise("monthly")
    status = F.when(F.col("o_orderstatus") == "F", "have").otherwise("missing")
    return o.select("o_orderkey", years.alias("years"), values.validity(status, F.date_add(day, 900), today).alias("validity"), values.vacation_days(years).alias("vacation"), values.monthly_pay(amount, every).alias("monthly"),
        values.annual_benefits(amount, values.vacation_days(years)).alias("benefits"), values.monthly_cost_each(amount, F.col("o_custkey") % 9).alias("each"), values.occupied(F.col("o_custkey") % 90, F.col("o_orderkey") % 70).alias("occupied"))


DATES_AND_PAY_SQL = """
WITH a AS (SELECT *, year(DATE '2001-02-28') - year(o_orderdate) - CASE WHEN 228 < month(o_orderdate) * 100 + day(o_orderdate) THEN 1 ELSE 0 END AS years, CAST(trunc(o_totalprice) AS BIGINT) AS amount, datediff('day', DATE '2001-02-28', CAST(o_orderdate AS DATE) + 900) AS gone FROM orders),
b AS (SELECT *, CASE WHEN years < 1 THEN 0 WHEN years <= 5 THEN 10 + 2 * years ELSE 20 + 2 * (1 + (years - 6) // 5) END AS v FROM a)
SELECT o_orderkey, CAST(years AS BIGINT) AS years, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN gone < 0 THEN 'expired' WHEN gone <= 30 THEN 'expiring' ELSE 'valid' END END AS validity, CAST(v AS BIGINT) AS vacation,
CASE o_orderkey % 3 WHEN 0 THEN (amount * 30 + 3) // 7 WHEN 1 THEN amount * 2 ELSE amount END AS monthly, (amount * 15 + 15) // 30 + (amount * v + 60) // 120 AS benefits,
CASE WHEN o_custkey % 9 > 0 THEN (amount + 6 * (o_custkey % 9)) // (12 * (o_custkey % 9)) END AS each, CASE WHEN o_orderkey % 70 > 0 THEN least((o_custkey % 90 * 100 + (o_orderkey % 70) // 2) // (o_orderkey % 70), 100) END AS occupied FROM b
"""


def monthly_snapshot(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.countDistinct("o_custkey").alias("people"))
    return o.select("month", "n", F.when(F.col("people") >= 3, F.col("people")).alias("people"), F.least(F.expr("done * 100 div n"), F.when(F.col("done") < F.col("n"), 99).otherwise(100)).cast("long").alias("percent"))


MONTHLY_SNAPSHOT_SQL = "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, CASE WHEN count(DISTINCT o_custkey) >= 3 THEN count(DISTINCT o_custkey) END AS people, CAST(least(count(*) FILTER (o_orderstatus = 'F') * 100 // count(*), CASE WHEN count(*) FILTER (o_orderstatus = 'F') < count(*) THEN 99 ELSE 100 END) AS BIGINT) AS percent FROM orders GROUP BY ALL"


def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return _t(spark, d, "events").groupBy((k % 10).alias("k")).agg(F.count("*").alias("n"), F.min(F.sha2(F.col("props"), 256)).alias("first"))


JSON_PROPS_SQL = "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k, count(*) AS n, min(sha256(props)) AS first FROM events GROUP BY ALL"

QUERIES = {f.__name__: f for f in (rolling_usage, model_usage, usage_windows, catalog_counts, pyramid, history_as_of, latest_versions, field_changes, upserts, span_coverage, validation_issues, joined_counts, dates_and_pay, monthly_snapshot, json_props)}
ORACLES = {k.removesuffix("_SQL").lower(): v for k, v in dict(globals()).items() if k.endswith("_SQL")}
