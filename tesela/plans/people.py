"""Queries over people in texts: names and health, marks and back, and all texts of all tables; with SQL where it can tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.operators import names, scanner, vault
from tesela.sources import shared


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_GIVEN, _FAMILY = ["Ana", "Luz", "Tomás", "Irene"], ["Ruiz", "Peña", "Solís"]
LISTS = names.Lists(frozenset(scanner.fold(n)[0] for n in _GIVEN), frozenset(scanner.fold(n)[0] for n in _FAMILY), frozenset(["LUZ SOLIS"]))


def _pick(options: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (i + 1).cast("int"))


def people_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """Names and words about health in sentences written for each customer: a pair, a title, a place, a saint, a safe name."""
    k = F.col("c_custkey")
    given, family = _pick(_GIVEN, k % 4), _pick(_FAMILY, k % 3)
    who = (
        F.when(k % 7 == 0, F.concat(given, F.lit(" "), family))
        .when(k % 7 == 1, F.concat(F.lit("doña "), given))
        .when(k % 7 == 2, F.concat(F.lit("la casa hogar "), given, F.lit(" "), family))
        .when(k % 7 == 3, F.concat(F.lit("San "), given))
        .when(k % 7 == 4, F.concat(F.lit("Don "), given, F.lit(" de "), family))
        .when(k % 7 == 5, F.lit("la señora"))
        .otherwise(F.lit("mucha gente"))
    )
    text = F.concat(F.lit("Hoy vino "), who, F.when(k % 2 == 0, " y padece diabetes; ").otherwise(". "), F.lit("El tratamiento de todos sigue igual."))
    spans = _t(spark, d, "customer").select("c_custkey", F.explode(scanner.scanner(lists=LISTS)(text)).alias("s"), text.alias("text"))
    said = F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return spans.groupBy(F.col("s.kind").alias("kind"), F.col("s.confidence").alias("confidence"), said.alias("said")).agg(F.count("*").alias("texts"))


PEOPLE_IN_TEXTS_SQL = f"""
WITH c AS (SELECT c_custkey % 7 AS k, c_custkey % 2 = 0 AS ill, {_GIVEN}[c_custkey % 4 + 1] AS g, {_FAMILY}[c_custkey % 3 + 1] AS f FROM customer),
n AS (SELECT *, CASE WHEN g = 'Luz' AND (f = 'Solís' OR k IN (1, 3)) AND k <> 4 THEN NULL WHEN k = 0 THEN g || ' ' || f WHEN k = 1 THEN g WHEN k = 4 THEN g || ' de ' || f END AS said, CASE WHEN k = 0 THEN 0.6 ELSE 0.9 END AS sure FROM c),
h AS (SELECT unnest(['padece', 'diabetes']) AS said, CASE WHEN n.said IS NULL THEN 0.7 ELSE 0.9 END AS sure FROM n WHERE ill AND (n.said IS NOT NULL OR k = 5))
SELECT 'person_name' AS kind, CAST(sure AS DOUBLE) AS confidence, said, count(*) AS texts FROM n WHERE said IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'health_context', CAST(sure AS DOUBLE), said, count(*) FROM h GROUP BY ALL
"""


#: Given and family names for the invented prose of the documents.
_PROSE = names.Lists(frozenset(("ORRE", "UND", "AND", "STTEEN", "OF")), frozenset(("ORRE", "SICH", "ERACHTZ", "AND", "TO")))


def names_in_documents(spark: SparkSession, d: str) -> DataFrame:
    spans = shared.spread(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", scanner.scanner(lists=_PROSE)("text").alias("spans"))
    called = F.filter("spans", lambda s: s["kind"] == "person_name")
    return spans.select("doc_id", F.size(called).alias("names"), F.coalesce(F.array_max(F.transform(called, lambda s: s["end"] - s["start"])), F.lit(0)).alias("longest"))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    docs = shared.spread(_t(spark, d, "documents").filter("doc_id is not null").select("doc_id", "source", "text"))
    scanned = docs.select(F.coalesce("source", F.lit("")).alias("scope"), F.col("doc_id").cast("long").alias("id"), "text", scanner.scanner()("text").alias("spans"))
    return shared.written(scanned, "scanned")  # read several times, scanned once


def _kept(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts with their spans, the values found and the vault, each computed once."""
    texts = _scanned(spark, d)
    found = shared.written(vault.found_values(texts), "found")
    return texts, found, shared.written(vault.vault_of(found), "vault")


def _marked(texts: DataFrame, found: DataFrame, kept: DataFrame) -> DataFrame:
    return shared.written(vault.marked(texts, found, kept).select("scope", "id", "marked"), "marked")  # read three times


def vault_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts marked by source and revealed again; what comes back is the text, but for values that first stood in other forms."""
    texts, found, kept = _kept(spark, d)
    back = vault.revealed(_marked(texts, found, kept), kept)
    plain = F.regexp_replace(F.lower(F.coalesce("revealed", F.lit(""))), "[^\\p{L}\\p{N}]", "")
    return back.select(F.col("id").alias("doc_id"), F.md5(plain).alias("letters_md5"))


VAULT_ROUND_TRIP_SQL = rf"""
SELECT doc_id, md5(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]', '', 'g')) AS letters_md5
FROM documents WHERE doc_id IS NOT NULL
"""


def vault_marks(spark: SparkSession, d: str) -> DataFrame:
    """How many marks of each word every source has, and how many of a text's marks its vault doesn't hold: none."""
    texts, found, kept = _kept(spark, d)
    lost = vault.unknown(vault.marked(texts, found, kept), kept).groupBy("scope").agg(F.count("*").alias("lost"))
    counted = kept.groupBy("scope", "word").agg(F.count("*").alias("marks"), F.max(F.regexp_extract("mark", "[0-9]+", 0).cast("long")).alias("last"))
    return counted.join(lost, "scope", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))


QUERIES = {f.__name__: f for f in (people_in_texts, names_in_documents, vault_round_trip, vault_marks)}
ORACLES = {k.removesuffix("_SQL").lower(): v for k, v in dict(globals()).items() if k.endswith("_SQL")}
