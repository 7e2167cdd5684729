"""Queries over mended texts, places and monthly figures, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import mending

_NAMES = ["Benito Juárez", "San José", "Ñuu Savi", "Álvaro Obregón", "El Oro"]
_SAID = ["BENITO JUAREZ", "municipio de san jose", "Alcaldía ñuu-savi", "delegación Álvaro  Obregón", "el oro.", "Municipio", "otro"]
_WRITTEN = ["bot3n", "R3gimen", "dej3", "caf3", "a1a", "x4y4", "A3a", "plain"]
_MEANT = ["botón", "Régimen", "dejé", "café", "a1a", "x4y4", "A3a", "plain"]
_KNOWN = ["botón", "régimen", "dejé", "café", "plain"]


def _pick(options: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (i + 1).cast("int"))


def mended_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit("&iquest;"), _pick(_WRITTEN, k % 8), F.lit(" &ntilde;&#225;&amp;lt;&nope; "), F.col("p_name"), F.lit(" | Total&nbsp;"), k.cast("string"), F.lit("\n total "), k.cast("string"))
    plain = mending.mended(mending.unescaped(text), F.array(*map(F.lit, _KNOWN)))
    told = spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), plain.alias("text"))
    return told.select("id", "text", F.array_join(mending.whole_units(F.col("text")), "/").alias("units"))


MENDED_TEXTS_SQL = f"""
WITH t AS (SELECT p_partkey AS id, p_name, '¿' || {_MEANT}[p_partkey % 8 + 1] || ' ñá&lt;&nope; ' || p_name || ' | Total ' || p_partkey || chr(10) || ' total ' || p_partkey AS text FROM part),
u AS (SELECT *, list_transform(string_split(replace(text, chr(10), '|'), '|'), lambda x: trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS l FROM t)
SELECT id, text, l[1] || '/' || l[2] AS units FROM u
"""


def places_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Places as customers write them, in a catalog in which some names stand in one state, others in several."""
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    catalog = spark.read.parquet(f"{d}/nation.parquet").select((n % 5).alias("state"), _pick(_NAMES, F.floor(n / 2) % 5).alias("name"))
    said = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("id"), F.when(k % 4 > 0, k % 5).alias("state"), _pick(_SAID, k % 7).alias("place"))
    return mending.resolved_places(said, catalog).select("id", "official")


PLACES_RESOLVED_SQL = f"""
WITH c AS (SELECT DISTINCT n_nationkey % 5 AS state, {_NAMES}[CAST(floor(n_nationkey / 2) AS BIGINT) % 5 + 1] AS name FROM nation), s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 5 END AS state, c_custkey % 7 AS said FROM customer)
SELECT id, (SELECT CASE WHEN count(DISTINCT name) = 1 THEN min(name) END FROM c WHERE name = CASE WHEN said < 5 THEN {_NAMES}[said + 1] END AND (s.state IS NULL OR c.state = s.state)) AS official FROM s
"""


def monthly_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The last order of a month as its figures; of several at one moment the first in the table stays."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("*", "_metadata.file_path", "_metadata.row_index").filter("o_orderdate is not null")
    k = F.col("o_orderkey")
    taken = o.select((F.col("o_custkey") % 20).alias("id"), (F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, 0, 0, 0, 1) * (o_orderkey % 80000)")).alias("at"), k.alias("people"), F.when(k % 3 > 0, k % 7).alias("waiting"), ((k % 5) - 2).alias("balance_mxn"), "file_path", "row_index")
    out = mending.snapshots(taken, ["people", "waiting"], "balance_mxn", [F.col("file_path"), F.col("row_index")])
    return out.select("id", "month", "figures_json")


MONTHLY_SNAPSHOTS_SQL = """
WITH o AS (SELECT o_custkey % 20 AS id, strftime(o_orderdate, '%Y-%m') AS month, o_orderdate + to_seconds(o_orderkey % 80000) AS moment, o_orderkey AS k FROM orders WHERE o_orderdate IS NOT NULL),
l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id, month ORDER BY moment DESC) = 1)
SELECT id, month, '{"people":' || k || ',"waiting":' || coalesce(CAST(CASE WHEN k % 3 > 0 THEN k % 7 END AS VARCHAR), 'null') || ',"balance":"' || CASE WHEN k % 5 < 2 THEN 'deficit' WHEN k % 5 = 2 THEN 'even' ELSE 'surplus' END || '"}' AS figures_json FROM l
"""

QUERIES = {f.__name__: f for f in (mended_texts, places_resolved, monthly_snapshots)}
ORACLES = {k.removesuffix("_SQL").lower(): v for k, v in dict(globals()).items() if k.endswith("_SQL")}
