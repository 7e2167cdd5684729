"""Queries over nested readings, each with its SQL.  Readings are written from the orders of a customer; the SQL takes the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.operators import canonical


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """doc and json: what can be paid for, days and amounts by the orders of a customer; every seventh is no JSON."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    proof = F.array(F.struct(F.concat(F.lit("cita "), k.cast("string")).alias("cita"), (k % 9).alias("pagina"), F.lit("bases.pdf").alias("documento")))
    item = F.struct(k.alias("k"), F.when(k % 4 > 0, F.concat(F.lit("  Pago  de "), F.col("o_orderpriority"), F.lit("\n"))).otherwise(" ").alias("titulo"), F.when(k % 3 == 0, "todos").alias("aplica_a"), F.when(k % 2 == 0, "deseable").otherwise("otra").alias("obligatoriedad"), (k % 5).cast("string").alias("ponderacion"), proof.alias("evidencias"))
    day = F.struct(k.alias("k"), F.when(k % 2 == 0, "cierre").alias("tipo"), F.when(k % 3 > 0, "Etapa").alias("etiqueta"), F.when(k % 5 > 0, F.date_format("o_orderdate", "d/M/yyyy")).alias("inicio_texto"), F.when(k % 4 == 0, "mayo").alias("fin_texto"), proof.alias("evidencias"))
    each = o.groupBy(F.col("o_custkey").alias("doc")).agg(F.sort_array(F.collect_list(item)).alias("items"), F.sort_array(F.collect_list(day)).alias("days"), F.count("*").alias("n"))
    def pick(odd: int) -> Column:
        return F.struct(F.lit("encontrado").alias("estado"), F.filter("items", lambda x: x["k"] % 2 == odd).alias("elementos"))

    amount = F.struct(F.when(F.col("doc") % 3 == 0, "no_aparece").otherwise("encontrado").alias("estado"), F.concat(F.lit("$ "), F.col("n").cast("string")).alias("valor_texto"), F.lit("una nota").alias("nota"))
    reading = F.struct(
        F.struct(F.lit("no").alias("nombre")).alias("metadatos"),
        F.struct(F.struct(F.lit("encontrado").alias("estado"), F.lit("Convocatoria").alias("valor_texto")).alias("nombre")).alias("identidad"),
        F.struct(amount.alias("monto_maximo"), pick(0).alias("conceptos_financiables"), pick(1).alias("conceptos_no_financiables")).alias("financiamiento"),
        F.struct(F.struct(F.col("items").alias("criterios")).alias("criterios")).alias("evaluacion"),
        F.struct(F.struct(F.col("days").alias("hitos")).alias("hitos")).alias("temporalidad"),
    )
    return each.select("doc", F.when(F.col("doc") % 7 == 0, "no json").otherwise(F.to_json(reading)).alias("json"))


def reading_items(spark: SparkSession, d: str) -> DataFrame:
    told = canonical.items(_readings(spark, d))
    return told.groupBy("group", "text", "applies_to", "requirement", "page", "file").agg(F.count("*").alias("items"))


READING_ITEMS_SQL = """
WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 > 0 THEN 'Pago de ' || o_orderpriority ELSE 'cita ' || o_orderkey END AS text, CASE WHEN o_orderkey % 3 = 0 THEN 'todos' END AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'deseable' END AS r FROM orders WHERE o_custkey % 7 > 0),
i AS (SELECT k, CASE WHEN k % 2 = 0 THEN 'fundable' ELSE 'not_fundable' END AS g, text, a, r FROM o UNION ALL SELECT k, 'criteria', text || ' (' || k % 5 || ')', NULL, NULL FROM o)
SELECT g AS "group", text, a AS applies_to, r AS requirement, k % 9 AS page, 'bases.pdf' AS file, count(*) AS items FROM i GROUP BY ALL
"""


def reading_cards(spark: SparkSession, d: str) -> DataFrame:
    cards = canonical.cards(canonical.items(_readings(spark, d)))
    return cards.select("doc", "block", F.array_join("points", "; ").alias("points"), "more")


READING_CARDS_SQL = """
WITH o AS (SELECT o_custkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'fundable' ELSE 'not_fundable' END AS block, o_orderkey AS k, CASE WHEN o_orderkey % 4 > 0 THEN 'Pago de ' || o_orderpriority ELSE 'cita ' || o_orderkey END AS text FROM orders WHERE o_custkey % 7 > 0),
f AS (SELECT doc, block, text, min(k) AS k FROM o GROUP BY ALL), l AS (SELECT doc, block, list(text ORDER BY k) AS t FROM f GROUP BY ALL),
c AS (SELECT doc, block, array_to_string(t[:3], '; ') AS points, CAST(greatest(len(t) - 3, 0) AS INTEGER) AS more FROM l)
SELECT * FROM c WHERE block = 'fundable' OR NOT EXISTS (SELECT 1 FROM c b WHERE b.doc = c.doc AND b.block = 'fundable' AND b.points = c.points)
"""


def reading_gaps(spark: SparkSession, d: str) -> DataFrame:
    """How often each key field is missing, each amount told, and milestones by kind and label."""
    docs = _readings(spark, d)
    gaps = canonical.missing(docs).select(F.lit("missing").alias("what"), F.col("field").alias("said"))
    money = canonical.amounts(docs).select(F.lit("max_amount").alias("what"), F.col("value").alias("said"))
    days = canonical.days(docs).select(F.concat(F.lit("day "), "kind").alias("what"), F.concat_ws("|", F.regexp_replace("label", "[0-9]+", "#"), F.regexp_replace("when", "[0-9]+", "#")).alias("said"))
    return gaps.union(money).union(days).groupBy("what", "said").agg(F.count("*").alias("n"))


READING_GAPS_SQL = """
WITH c AS (SELECT o_custkey AS doc, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT doc, n, doc % 7 > 0 AS ok FROM c),
m AS (SELECT doc, n, ok, unnest(['identidad.nombre', 'identidad.convocante', 'financiamiento.monto_maximo', 'financiamiento.porcentaje_cofinanciamiento', 'temporalidad.periodo_ejecucion', 'entrega.medio_o_lugar', 'evaluacion.criterios', 'documentacion.obligatoria']) AS f FROM g),
t AS (SELECT 'missing' AS what, f AS said FROM m WHERE NOT (ok AND (f IN ('identidad.nombre', 'evaluacion.criterios') OR (f = 'financiamiento.monto_maximo' AND doc % 3 > 0)))
  UNION ALL SELECT 'max_amount', '$ ' || n FROM g WHERE ok AND doc % 3 > 0
  UNION ALL SELECT 'day ' || CASE WHEN o_orderkey % 2 = 0 THEN 'cierre' ELSE 'otro' END, CASE WHEN o_orderkey % 3 > 0 THEN 'Etapa' ELSE 'cita #' END || '|#/#/#' || CASE WHEN o_orderkey % 4 = 0 THEN ' al mayo' ELSE '' END FROM orders WHERE o_custkey % 7 > 0 AND o_orderkey % 5 > 0)
SELECT what, said, count(*) AS n FROM t GROUP BY ALL
"""


def reading_evidence(spark: SparkSession, d: str) -> DataFrame:
    docs = _readings(spark, d)
    return docs.select("doc", F.md5(canonical.evidence_text("json")).alias("evidence_md5"), F.size(canonical.quotes_of("json")).alias("quotes"))


READING_EVIDENCE_SQL = """
WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, CASE WHEN o_orderkey % 4 > 0 THEN '  Pago  de ' || o_orderpriority || chr(10) ELSE ' ' END AS t, CASE WHEN o_orderkey % 3 = 0 THEN 'todos' END AS a FROM orders),
i AS (SELECT doc, k, concat_ws(chr(10), t, a, 'cita ' || k) AS item, concat_ws(chr(10), CASE WHEN k % 3 > 0 THEN 'Etapa' END, CASE WHEN k % 5 > 0 THEN (SELECT day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) FROM orders x WHERE x.o_orderkey = k) END, CASE WHEN k % 4 = 0 THEN 'mayo' END, 'cita ' || k) AS day FROM o),
s AS (SELECT doc, count(*) AS n, string_agg(item, chr(10) ORDER BY k) FILTER (k % 2 = 0) AS f, string_agg(item, chr(10) ORDER BY k) FILTER (k % 2 = 1) AS x, string_agg(item, chr(10) ORDER BY k) AS c, string_agg(day, chr(10) ORDER BY k) AS h FROM i GROUP BY doc)
SELECT doc, CASE WHEN doc % 7 > 0 THEN md5(concat_ws(chr(10), 'Convocatoria', '$ ' || n, f, x, c, h)) END AS evidence_md5, CASE WHEN doc % 7 > 0 THEN CAST(3 * n AS INTEGER) END AS quotes FROM s
"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text")


def masked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns without what a first reading quoted of them, the quote's blanks being others."""
    quote = F.regexp_replace(F.trim(F.regexp_replace(F.substring("text", 3, 60), r"\s+", " ")), " ", "\n ")
    left = canonical.masked("text", F.array(quote, F.lit(" "), F.lit("nowhere to be found")))
    return _turns(spark, d).select("conv_id", "turn", F.md5(left).alias("left_md5"))


MASKED_PAGES_SQL = f"""
WITH q AS (SELECT conv_id, turn, text, regexp_replace(substr(text, 3, 60), '^\\s+|\\s+$', '', 'g') AS quote FROM conversations)
SELECT conv_id, turn, CASE WHEN quote = '' THEN md5(text) ELSE md5(replace(text, quote, '{canonical.TAKEN}')) END AS left_md5 FROM q
"""


def page_groups(spark: SparkSession, d: str) -> DataFrame:
    pages = _turns(spark, d).select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    return canonical.page_groups(pages, 1500, 2)


PAGE_GROUPS_SQL = """
WITH RECURSIVE e AS (SELECT conv_id AS doc, turn AS page, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
s AS (SELECT doc, CAST(page AS BIGINT) AS page, n, CAST(0 AS INTEGER) AS g, CAST(size AS BIGINT) AS total FROM e WHERE n = 1
  UNION ALL SELECT e.doc, CAST(e.page AS BIGINT), e.n, CAST(CASE WHEN s.total + e.size > 1500 THEN s.g + 1 ELSE s.g END AS INTEGER), CAST(CASE WHEN s.total + e.size > 1500 THEN e.size ELSE s.total + e.size END AS BIGINT) FROM s JOIN e ON e.doc = s.doc AND e.n = s.n + 1)
SELECT doc, page, g AS "group" FROM s WHERE g < 2
"""

QUERIES = {f.__name__: f for f in (reading_items, reading_cards, reading_gaps, reading_evidence, masked_pages, page_groups)}
ORACLES = {k.removesuffix("_SQL").lower(): v for k, v in dict(globals()).items() if k.endswith("_SQL")}
