"""A query over what documents of known kinds say, with its SQL.  Pages are written from customers; the SQL takes the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import readings
from tesela.operators import fields, kinds
from tesela.sources.shared import spread

_KINDS = ["tax_status_certificate", "donee_authorization", "cluni_certificate", "junta_registration", "tax_compliance_opinion", "power_of_attorney"]


def _pick(options: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (i + 1).cast("int"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Two pages a document; only odd ones say the second half on the first page."""
    k = F.col("c_custkey")
    day = F.format_string("%d de %s de %d", k % 28 + 1, _pick(readings.MONTHS, k % 12), k % 20 + 2001)
    code = F.lpad(k.cast("string"), 8, "0")
    first = {
        "tax_status_certificate": F.concat(F.lit("CONSTANCIA\nRFC: Abc"), F.lit("9OIl0S"), F.lit("Xy1\nDenominación o  Razón Social: Casa "), code, F.lit("\nRégimen Capital: ASOCIACIÓN CIVIL\nidCIF "), code, F.lit("\nRégimen: Personas Morales con Fines no Lucrativos\nCÓDIGO POSTAL: 0"), F.lpad((k % 10000).cast("string"), 4, "0")),
        "donee_authorization": F.concat(F.lit("Oficio Núm. 600-"), code, F.lit(".\nMéxico, a "), day, F.lit("\nSe AUTORIZA a recibir donativos en el rubro de becas escolares")),
        "cluni_certificate": F.concat(F.lit("Clave (CLUNI) ABC"), code, F.lit("\nFecha de inscripción:\n"), day),
        "junta_registration": F.concat(F.lit("Folio: sin\nNúmero de Institución: "), (k % 1000).cast("string"), F.lit("-A\nvigente hasta el "), day),
        "tax_compliance_opinion": F.concat(F.lit("Folio No. 24N"), code, F.lit("\nFecha de emisión: "), day, F.lit(" y no 01/02/1999")),
        "power_of_attorney": F.concat(F.lit("ESCRITURA PÚBLICA NÚMERO DOS MIL "), F.upper(_pick(["cien", "doscientos", "trescientos"], k % 3)), F.lit(" LIBRO UNO\npoder a favor de la señora MARÍA DE LA "), _pick(["CRUZ", "PEÑA"], k % 2), F.lit(" para todo")),
    }
    text = F.lit(None).cast("string")
    for i, kind in enumerate(_KINDS):
        text = F.when(k % 6 == i, first[kind]).otherwise(text)
    other = F.lit("Página de relleno\nRFC: DEF900101AA1\nFolio: 24N99999\nCLUNI ZZZ00000000 oficio núm. 111-1111")
    customers = spread(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"))
    pages = F.array(F.struct(F.lit(1).alias("page"), F.when(k % 7 == 0, F.lit("Portada")).otherwise(text).alias("text")), F.struct(F.lit(2).alias("page"), F.when(k % 7 == 0, text).otherwise(other).alias("text")))
    return customers.select(k.alias("doc"), _pick(_KINDS, k % 6).alias("kind"), F.explode(pages).alias("p")).select("doc", "kind", "p.*")


def document_fields(spark: SparkSession, d: str) -> DataFrame:
    return fields.found(_pages(spark, d)).select("doc", F.regexp_replace("field", "^institution[.]", "").alias("field"), "value", "page", "computed")


DOCUMENT_FIELDS_SQL = """
WITH c AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS code, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END AS page, make_date(CAST(c_custkey % 20 + 2001 AS BIGINT), CAST(c_custkey % 12 + 1 AS BIGINT), CAST(c_custkey % 28 + 1 AS BIGINT)) AS d FROM customer),
f AS (
  SELECT k, page, 0 AS i, unnest([['legal_rfc', 'ABC901105XY1'], ['legal_name', 'Casa ' || code], ['legal_form', 'ac'], ['tax_regime', 'non_profit'], ['fiscal_postal_code', '0' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0')], ['record.reference', code]]) AS v, false AS computed FROM c
  UNION ALL SELECT k, page, 1, unnest([['authorized_donee', 'yes'], ['donee_letter_number', '600-' || code], ['record.reference', '600-' || code], ['donee_category', 'scholarships'], ['donee_letter_date', CASE WHEN page = 1 THEN strftime(d, '%Y-%m-%d') END]]), false FROM c
  UNION ALL SELECT k, page, 2, unnest([['cluni', 'yes'], ['cluni_key', 'ABC' || code], ['record.reference', 'ABC' || code], ['record.issued_on', strftime(d, '%Y-%m-%d')]]), false FROM c
  UNION ALL SELECT k, page, 3, unnest([['record.valid_until', strftime(d, '%Y-%m-%d')]]), false FROM c
  UNION ALL SELECT k, 2, 3, unnest([['junta_folio', '24N99999'], ['record.reference', '24N99999']]), false FROM c WHERE page = 1
  UNION ALL SELECT k, 2, 3, ['junta_folio', k % 1000 || '-A'], false FROM c WHERE page = 2
  UNION ALL SELECT k, page, 4, unnest([['record.reference', '24N' || code], ['record.issued_on', strftime(d, '%Y-%m-%d')]]), false FROM c
  UNION ALL SELECT k, page, 4, ['record.valid_until', strftime(d + 30, '%Y-%m-%d')], true FROM c
  UNION ALL SELECT k, page, 5, unnest([['record.reference', CAST(2000 + (k % 3 + 1) * 100 AS VARCHAR)], ['legal_rep_name', 'María de la ' || ['Cruz', 'Peña'][k % 2 + 1]]]), false FROM c
)
SELECT k AS doc, v[1] AS field, v[2] AS value, CAST(page AS INTEGER) AS page, computed FROM f WHERE i = k % 6 AND v[2] IS NOT NULL
"""

def papers_placed(spark: SparkSession, d: str) -> DataFrame:
    """Texts that say one of the 18 kinds in the first lines or further on, put on a kind under a name that may say it."""
    k = F.col("p_partkey")
    said = _pick([" y ".join(phrases[0]).upper() for _, phrases, _ in kinds.PAPERS], k % 18)
    name = F.concat(F.when(k % 5 == 0, _pick(["-".join(names[0]) for _, _, names in kinds.PAPERS], F.floor(k / 3) % 18)).otherwise("archivo"), F.lit(".v2.PDF"))
    text = F.when(k % 4 > 0, F.concat(F.when(k % 4 == 1, F.repeat(F.lit("relleno "), 60)).otherwise(""), said, F.when(k % 4 == 3, " con el organigrama").otherwise("")))
    put_on = F.when(k % 11 == 0, "otro").otherwise(_pick(_CODES, F.floor(k / 3) % 18))
    parts = spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), name.alias("name"), text.alias("text"), put_on.alias("put_on"))
    scored = parts.withColumn("scored", kinds.scores(F.col("text"), kinds.PAPERS))
    told = scored.select("id", kinds.recognised(F.col("scored")).alias("kind"), kinds.placement(F.col("scored"), F.col("name"), F.col("put_on"), kinds.PAPERS).alias("p"))
    return told.select("id", "kind", F.col("p.state").alias("state"), F.col("p.kind").alias("looks_like"))


_CODES = [c for c, _, _ in kinds.PAPERS]


def _points_sql(phrases: list[list[str]]) -> str:
    holds = lambda where, p: " AND ".join(f"contains({where}, '{w}')" for w in p)
    return " + ".join(f"CASE WHEN {holds('head', p)} THEN 3 WHEN {holds('body', p)} THEN 1 ELSE 0 END" for p in phrases)


def _named_sql(code: str, words: list[str]) -> str:
    return f"(put_on = '{code}' AND " + " AND ".join(f"contains(stem, '{w}')" for w in words) + ")"


_NAMED = " OR ".join(_named_sql(c, n) for c, _, names in kinds.PAPERS for n in names)
_FILES, _PHRASES = ["-".join(names[0]) for _, _, names in kinds.PAPERS], [" y ".join(phrases[0]) for _, phrases, _ in kinds.PAPERS]
PAPERS_PLACED_SQL = f"""
WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'otro' ELSE {_CODES}[CAST(floor(p_partkey / 3) AS BIGINT) % 18 + 1] END AS put_on, CASE WHEN p_partkey % 5 = 0 THEN {_FILES}[CAST(floor(p_partkey / 3) AS BIGINT) % 18 + 1] ELSE 'archivo' END || '.v2' AS file,
  CASE WHEN p_partkey % 4 > 0 THEN CASE WHEN p_partkey % 4 = 1 THEN repeat('relleno ', 60) ELSE '' END || {_PHRASES}[p_partkey % 18 + 1] || CASE WHEN p_partkey % 4 = 3 THEN ' con el organigrama' ELSE '' END ELSE '' END AS body FROM part),
h AS (SELECT *, left(body, 400) AS head, trim(regexp_replace(file, '[^a-z0-9]+', ' ', 'g')) AS stem FROM p), s AS (SELECT *, [{", ".join(_points_sql(phrases) for _, phrases, _ in kinds.PAPERS)}] AS n FROM h),
m AS (SELECT *, list_max(n) AS best, len(list_filter(n, lambda x: x = list_max(n))) AS winners, list_position({_CODES}, put_on) AS own FROM s),
r AS (SELECT *, CASE WHEN best > 0 AND winners = 1 THEN {_CODES}[list_position(n, best)] END AS kind, n[own] - list_max(list_filter(n, lambda x, i: i <> own)) + CASE WHEN {_NAMED} THEN 1 ELSE 0 END AS sure FROM m)
SELECT k AS id, kind, CASE WHEN put_on = 'otro' OR sure >= 1 THEN 'sure' WHEN kind IS NOT NULL AND kind <> put_on THEN 'other' ELSE 'unsure' END AS state, CASE WHEN put_on <> 'otro' AND sure < 1 AND kind <> put_on THEN kind END AS looks_like FROM r
"""


_TITLES = ["REGLAS DE OPERACIÓN y convocatoria", "Lineamientos del fondo", "Bases 2026", "Fe de erratas", "Guía breve", "Carta compromiso", "Anexo uno", "CONV OC A T ORIA", "Nada de eso", "basesita"]
_TITLE_CLASSES = ["reglas_de_operacion", "lineamientos", "convocatoria", "aviso", "guia", "formato", "anexo", "convocatoria", None, None]


def call_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    title = F.concat(_pick(_TITLES, k % 10), F.lit(" — "), F.when(k % 7 == 0, "MANUAL").otherwise("2026"))
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(kinds.call_class(title).alias("class")).agg(F.count("*").alias("titles"))


_LISTED = ", ".join("NULL" if c is None else f"'{c}'" for c in _TITLE_CLASSES)
CALL_CLASSES_SQL = f"SELECT CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 10 > 3 THEN 'guia' ELSE [{_LISTED}][o_orderkey % 10 + 1] END AS class, count(*) AS titles FROM orders GROUP BY ALL"

QUERIES = {f.__name__: f for f in (document_fields, papers_placed, call_classes)}
ORACLES = {k.removesuffix("_SQL").lower(): v for k, v in dict(globals()).items() if k.endswith("_SQL")}
