"""Queries over all tables at once, and over nested JSON, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions.text import SCAN_FROM, SCAN_TO
from tesela.operators import scanner, store
from tesela.plans import registers

_TABLES = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"], "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"],
}


def store_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every text column of the driver's tables, and of registers written from customers."""
    tables = {name: spark.read.parquet(f"{d}/{name}.parquet") for name in [*_TABLES, "labels", "embeddings"]}
    return store.scanned(tables | {"registers": registers.people(spark, d).select("text")})


def _found(kind: str, gate: str = "true") -> str:
    return f"len(list_filter(regexp_extract_all(t, '{scanner.PATTERNS[kind]}'), lambda v: {gate}))"


_N = " + ".join([_found("curp", registers.CURP_GATE), _found("rfc_person", registers.day_sql(5)), _found("voter_key"), _found("clabe", registers.CLABE_GATE), _found("card", registers.LUHN_GATE), _found("nss", registers.LUHN_GATE)])
_TEXTS = " UNION ALL ".join([*(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {c} AS text FROM {t}" for t, columns in _TABLES.items() for c in columns), f"SELECT 'registers', 'text', text FROM ({registers.PEOPLE_TEXTS})"])
STORE_SCAN_SQL = f"""
WITH x AS ({_TEXTS}), f AS (SELECT "table", "column", CASE WHEN regexp_matches(text, '[0-9@]') THEN translate(upper(text), '{SCAN_FROM}', '{SCAN_TO}') ELSE '' END AS t FROM x WHERE text IS NOT NULL),
n AS (SELECT "table", "column", {_N} AS n FROM f)
SELECT "table", "column", count(*) AS texts, CAST(sum(n) AS BIGINT) AS findings, count(*) FILTER (n > 0) AS texts_with FROM n GROUP BY ALL
"""

QUERIES = {"store_scan": store_scan}
ORACLES = {"store_scan": STORE_SCAN_SQL}
