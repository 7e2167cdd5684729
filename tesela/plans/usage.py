"""Queries over usage and cost of calls, forms, bands, and texts: each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import checks, text, values
from tesela.operators import records, search, usage


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as model calls: whole figures, so that sums don't depend on their order."""
    e = _t(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("event_id").alias("call_id"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"), F.concat(F.lit("m"), (F.col("user_id") % 40).cast("string")).alias("model"), F.col("event_type").alias("task"),
        F.col("ts").alias("at"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 977).alias("latency"), (F.col("user_id") * 7 % 1000).alias("tokens"), F.round(F.col("value") * 100).cast("long").alias("cost"))


_CALLS = "WITH calls AS (SELECT event_id AS seq, 'p' || user_id % 3 AS provider, 'm' || user_id % 40 AS model, event_type AS task, ts AS happened, event_type <> 'error' AS success, event_id % 977 AS latency, user_id * 7 % 1000 AS tokens, CAST(round(value * 100) AS BIGINT) AS cost FROM events)\n"


def usage_pairs(spark: SparkSession, d: str) -> DataFrame:
    configured = spark.createDataFrame([("p0", "m0"), ("p9", "m0"), ("p1", "other")], "provider string, model string")
    return usage.pairs(_calls(spark, d), configured)


USAGE_PAIRS_SQL = _CALLS + "SELECT provider, model, max(seq) AS last FROM (SELECT provider, model, seq FROM calls UNION ALL VALUES ('p0', 'm0', NULL), ('p9', 'm0', NULL), ('p1', 'other', NULL)) GROUP BY ALL"


def task_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.by_task(_calls(spark, d))


TASK_USAGE_SQL = _CALLS + "SELECT task, count(*) AS calls, CAST(trunc(avg(latency)) AS BIGINT) AS avg_latency, CAST(trunc(avg(tokens)) AS BIGINT) AS avg_tokens, CAST(coalesce(sum(cost), 0) AS BIGINT) AS cost FROM calls WHERE success GROUP BY ALL"


def month_spend(spark: SparkSession, d: str) -> DataFrame:
    return usage.spent_in_month(_calls(spark, d), F.lit("2024-01-20 12:00:00").cast("timestamp"))


MONTH_SPEND_SQL = _CALLS + "SELECT CAST(coalesce(sum(cost), 0) AS BIGINT) AS cost FROM calls WHERE happened >= TIMESTAMP '2024-01-01' AND happened <= TIMESTAMP '2024-01-20 12:00:00'"

_PRICES = [("m1", "2023-01-01", 10, 40), ("m1", "2024-01-10", 20, 80), ("m12", "2023-01-01", 30, 60), ("m2", "2024-01-15", 50, 70), ("m3", "2023-06-01", 5, 90)]


def call_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost by model: own price, that of the longest name it begins with, or the highest of all, as in force on the day."""
    prices = spark.createDataFrame(_PRICES, "name string, from_day string, price_in int, price_out int").withColumn("from_day", F.to_date("from_day"))
    calls = _calls(spark, d).select("call_id", "model", "at", F.col("tokens").alias("input"), F.col("latency").alias("output"), (F.col("tokens") * 10).alias("cached"), (F.col("latency") * 4).alias("written"))
    return usage.priced(calls, prices).groupBy("model").agg(F.count("*").alias("calls"), F.sum(F.round("cost").cast("long")).alias("cost"))


CALL_COSTS_SQL = (
    _CALLS.rstrip()
    + ", prices(name, from_day, price_in, price_out) AS (VALUES "
    + ", ".join(f"('{n}', DATE '{f}', {i}, {o})" for n, f, i, o in _PRICES)
    + """),
pairs AS (SELECT DISTINCT model, CAST(happened AS DATE) AS day FROM calls),
live AS (SELECT model, day, name, arg_max(price_in, from_day) AS price_in, arg_max(price_out, from_day) AS price_out FROM pairs JOIN prices ON from_day <= day GROUP BY ALL),
rates AS (SELECT model, day, coalesce(arg_max(price_in, length(name)) FILTER (starts_with(model, name)), max(price_in)) AS i, coalesce(arg_max(price_out, length(name)) FILTER (starts_with(model, name)), max(price_out)) AS o FROM live GROUP BY ALL)
SELECT c.model, count(*) AS calls, CAST(sum(CAST(round(i * (tokens + 0.1 * (tokens * 10) + 1.25 * (latency * 4)) + o * latency) AS BIGINT)) AS BIGINT) AS cost
FROM calls c LEFT JOIN rates r ON c.model = r.model AND CAST(c.happened AS DATE) = r.day GROUP BY ALL"""
)


def recent_calls(spark: SparkSession, d: str) -> DataFrame:
    """The newest twenty attempts, failed ones too; the limit is the report's own."""
    return usage.newest(_calls(spark, d)).select("seq", "task", "model", "success", "latency")


RECENT_CALLS_SQL = _CALLS + "SELECT seq, task, model, success, latency FROM calls ORDER BY seq DESC LIMIT 20"


def _customer_form(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    rows = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).otherwise(" ").alias("segment"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("nation"))
    return rows, [("segment", True, None), ("name", True, F.col("nation") < 10), ("nation", False, None)]


_FORM = "WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment ELSE ' ' END AS segment, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, c_nationkey AS nation FROM customer)\n"


def form_missing(spark: SparkSession, d: str) -> DataFrame:
    """Required fields that apply and are blank, by field."""
    rows, fields = _customer_form(spark, d)
    return records.missing(rows, "c_custkey", fields).groupBy("field").agg(F.count("*").alias("rows"))


FORM_MISSING_SQL = _FORM + "SELECT 'segment' AS field, count(*) AS rows FROM f WHERE trim(segment) = '' HAVING count(*) > 0 UNION ALL SELECT 'name', count(*) FROM f WHERE name IS NULL AND nation < 10 HAVING count(*) > 0"


def form_progress(spark: SparkSession, d: str) -> DataFrame:
    """Percent of the applying fields that are filled, after values that don't apply were dropped."""
    rows, fields = _customer_form(spark, d)
    clean = records.without_hidden_values(rows, fields)
    return clean.select("c_custkey", F.col("name").alias("shown"), records.progress(fields).alias("percent"))


FORM_PROGRESS_SQL = _FORM + "SELECT c_custkey, CASE WHEN nation < 10 THEN name END AS shown, CAST(floor(100.0 * ((trim(segment) <> '')::INT + (nation < 10 AND name IS NOT NULL)::INT + 1) / (2 + (nation < 10)::INT)) AS BIGINT) AS percent FROM f"


def order_bands(spark: SparkSession, d: str) -> DataFrame:
    """Orders by whole years of age in bands, days since, yearly amounts, and the rule or person that set the state."""
    today = F.lit("2001-02-28").cast("date")
    day = F.col("o_orderdate").cast("date")
    band = values.banded(values.years_between(day, today), *values.SENIORITY)
    state = records.kept_by_person(F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 7 == 0, "set"))
    yearly = values.annual(F.col("o_totalprice").cast("long"), F.when(F.col("o_orderkey") % 2 == 0, "monthly").otherwise("annual"))
    return _t(spark, d, "orders").groupBy(band.alias("band"), state.alias("state")).agg(F.count("*").alias("n"), F.sum(values.days_between(day, today)).alias("days"), F.sum(yearly).alias("yearly"), F.max(values.add_days(day, 30)).cast("string").alias("due"))


ORDER_BANDS_SQL = """
WITH a AS (SELECT *, year(DATE '2001-02-28') - year(o_orderdate) - CASE WHEN 228 < month(o_orderdate) * 100 + day(o_orderdate) THEN 1 ELSE 0 END AS years FROM orders)
SELECT CASE WHEN years < 1 THEN 'under 1' WHEN years < 5 THEN '1 to 4' WHEN years < 10 THEN '5 to 9' ELSE '10 and over' END AS band, CASE WHEN o_orderkey % 7 = 0 THEN 'set' ELSE o_orderstatus END AS state, count(*) AS n,
CAST(sum(datediff('day', CAST(o_orderdate AS DATE), DATE '2001-02-28')) AS BIGINT) AS days, CAST(sum(CAST(trunc(o_totalprice) AS BIGINT) * CASE WHEN o_orderkey % 2 = 0 THEN 12 ELSE 1 END) AS BIGINT) AS yearly, CAST(max(CAST(o_orderdate AS DATE) + 30) AS VARCHAR) AS due
FROM a GROUP BY ALL
"""


def titled_nations(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the title of their nation's list entry; entries that the list lacks get the default label."""
    titles = _t(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    return records.titled(_t(spark, d, "customer"), "c_nationkey", titles, "not listed").groupBy("title").agg(F.count("*").alias("n"))


TITLED_NATIONS_SQL = "SELECT coalesce(n_name, 'not listed') AS title, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20 GROUP BY ALL"


def multi_code_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words of part types as a column of several codes a row, counted in catalog order."""
    catalog = spark.createDataFrame([(c, i) for i, c in enumerate(["STANDARD", "STEEL", "COPPER", "BRUSHED", "NOTHING"])], "code string, ord int")
    return records.by_code_of_list(_t(spark, d, "part").withColumn("codes", F.split("p_type", " ")), "codes", catalog)


MULTI_CODE_COUNTS_SQL = "SELECT code, CAST(ord AS INTEGER) AS ord, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) JOIN (VALUES ('STANDARD', 0), ('STEEL', 1), ('COPPER', 2), ('BRUSHED', 3), ('NOTHING', 4)) c(code, ord) ON w = code GROUP BY ALL"


def document_years(spark: SparkSession, d: str) -> DataFrame:
    """Pages, characters and fingerprint of every conversation with the year that it names most often."""
    talk = _t(spark, d, "conversations").withColumn("year", text.dominant_year(F.concat("text", F.lit(" 20"), F.lpad((F.col("turn") % 90 + 10).cast("string"), 2, "0"))))
    return talk.groupBy("conv_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), F.max("year").alias("year"), F.min(text.version(F.col("text"))).alias("version"))


DOCUMENT_YEARS_SQL = """
WITH y AS (SELECT conv_id, turn, unnest(regexp_extract_all(text || ' 20' || lpad(CAST(turn % 90 + 10 AS VARCHAR), 2, '0'), '20[0-9]{2}')) AS year FROM conversations),
c AS (SELECT conv_id, turn, year, count(*) AS n FROM y GROUP BY ALL), t AS (SELECT conv_id, turn, CAST(year AS INTEGER) AS year FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, year DESC) AS r FROM c) WHERE r = 1)
SELECT conv_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, max(year) AS year, min(sha256(coalesce(text, ''))) AS version FROM conversations LEFT JOIN t USING (conv_id, turn) GROUP BY conv_id
"""


def best_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The best similarity above 0 of each user's and day's events, as of chunks by query and page."""
    e = _t(spark, d, "events").select(F.col("user_id").alias("query"), F.date_format("ts", "yyyy-MM-dd").alias("page"), (F.round(F.col("value") * 100).cast("long") - 5000).alias("similarity"))
    return search.best_chunk(e)


BEST_CHUNKS_SQL = "SELECT user_id AS query, strftime(ts, '%Y-%m-%d') AS page, max(CAST(round(value * 100) AS BIGINT) - 5000) AS similarity FROM events GROUP BY ALL HAVING max(CAST(round(value * 100) AS BIGINT) - 5000) > 0"


def manual_search(spark: SparkSession, d: str) -> DataFrame:
    """Weighted search over a title (the source and language) and a body."""
    docs = _t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.left("text", F.lit(20)).alias("title"), F.col("text").alias("body"))
    return search.weighted_bm25(docs, ["the", "er"])


_TOKENS = "regexp_extract_all(translate(lower(coalesce({c}, '')), 'áàäéèëíìïóòöúùü', 'aaaeeeiiiooouuu'), '[a-zñß0-9]+')"
_TERM = "CASE WHEN ln((n_rows - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - d{i} + 0.5) / (d{i} + 0.5)) END * n{i} * 2.2 / (n{i} + 1.2 * (0.25 + 0.75 * len / mean))"
MANUAL_SEARCH_SQL = f"""
WITH t AS (SELECT item_id AS doc_id, {_TOKENS.format(c="left(text, 20)")} AS a, {_TOKENS.format(c="text")} AS b FROM benchmark),
c AS (SELECT doc_id, len(a) + len(b) AS len, {", ".join(f"5.0::DOUBLE * len(list_filter(a, lambda w: starts_with(w, '{p}'))) + len(list_filter(b, lambda w: starts_with(w, '{p}'))) AS n{i}" for i, p in enumerate(["the", "er"]))} FROM t),
s AS (SELECT count(*) AS n_rows, avg(len) AS mean, count(*) FILTER (n0 > 0) AS d0, count(*) FILTER (n1 > 0) AS d1 FROM c)
SELECT doc_id, round(-({_TERM.format(i=0)} + {_TERM.format(i=1)}), 6) AS score FROM c, s WHERE n0 > 0 OR n1 > 0
"""


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(text.cleaned(F.coalesce("text", F.lit("")))).alias("clean_md5"))


CLEAN_TEXTS_SQL = r"""
WITH a AS (SELECT doc_id, translate(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(160) || chr(8199) || chr(8239) || chr(173) || chr(8203) || chr(65279), '   ') AS t FROM documents),
b AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(t, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st') AS t FROM a),
c AS (SELECT doc_id, replace(replace(replace(replace(replace(t, '/f_i', 'fi'), '/f_l', 'fl'), '/f_f', 'ff'), 'https:/ /', 'https://'), 'http:/ /', 'http://') AS t FROM b)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean_md5 FROM c
"""


def identifier_checks(spark: SparkSession, d: str) -> DataFrame:
    """Social security numbers and bank accounts, written with hyphens and blanks, that pass their check digits."""
    o = _t(spark, d, "orders")
    nss = F.concat(F.lpad((F.col("o_orderkey") * 7919 % 100000).cast("string"), 5, "0"), F.lit("-"), F.lpad((F.col("o_custkey") * 104729 % 1000000).cast("string"), 6, "0"))
    clabe = F.concat(F.lpad((F.col("o_orderkey") * 15485863 % 1000000000).cast("string"), 9, "0"), F.lit(" "), F.lpad((F.col("o_custkey") * 32452843 % 1000000000).cast("string"), 9, "0"))
    return o.select(checks.nss_valid(nss).alias("nss"), checks.clabe_valid(clabe).alias("clabe")).agg(F.count("*").alias("rows"), F.count_if("nss").alias("nss"), F.count_if("clabe").alias("clabe"))


IDENTIFIER_CHECKS_SQL = """
WITH v AS (SELECT lpad(CAST(o_orderkey * 7919 % 100000 AS VARCHAR), 5, '0') || lpad(CAST(o_custkey * 104729 % 1000000 AS VARCHAR), 6, '0') AS n, lpad(CAST(o_orderkey * 15485863 % 1000000000 AS VARCHAR), 9, '0') || lpad(CAST(o_custkey * 32452843 % 1000000000 AS VARCHAR), 9, '0') AS c FROM orders),
s AS (SELECT list_sum(list_transform(range(1, 12), lambda i: CASE WHEN i % 2 = 1 THEN CAST(n[i] AS INT) WHEN CAST(n[i] AS INT) > 4 THEN 2 * CAST(n[i] AS INT) - 9 ELSE 2 * CAST(n[i] AS INT) END)) % 10 = 0 AS nss,
(10 - list_sum(list_transform(range(1, 18), lambda i: CAST(c[i] AS INT) * CASE i % 3 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 1 END % 10)) % 10) % 10 = CAST(c[18] AS INT) AS clabe FROM v)
SELECT count(*) AS rows, count(*) FILTER (nss) AS nss, count(*) FILTER (clabe) AS clabe FROM s
"""

QUERIES = {f.__name__: f for f in (usage_pairs, task_usage, month_spend, call_costs, recent_calls, form_missing, form_progress, order_bands, titled_nations, multi_code_counts, document_years, best_chunks, manual_search, clean_texts, identifier_checks)}
ORACLES = {k.removesuffix("_SQL").lower(): v for k, v in dict(globals()).items() if k.endswith("_SQL")}
