"""Queries over what texts say, where it comes from, and registers of places and people, each with its SQL.

The driver's tables hold no Spanish dates or amounts, so texts are written from their columns; the SQL takes the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import readings
from tesela.operators import kinds, provenance, records, registers
from tesela.sources.shared import dealt, spread


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(options: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (i + 1).cast("int"))


_UNITS = ["uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"]
_TENS = ["treinta", "cuarenta", "cincuenta", "sesenta", "setenta", "ochenta", "noventa"]
_HUNDREDS = ["ciento", "doscientos", "trescientos", "cuatrocientos", "quinientos", "seiscientos", "setecientos", "ochocientos", "novecientos"]


def numbers_in_words(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    said = F.concat_ws(" ", _pick(_UNITS[1:], k % 8), F.lit("Mil"), _pick(_HUNDREDS, k % 9), _pick(_TENS, k % 7), F.lit("y"), _pick(_UNITS, k % 9))
    leading = readings.leading_number_in_words(F.concat(said, F.when(k % 2 == 0, " libro uno").otherwise(" y folio dos")))
    return _t(spark, d, "part").select(k.alias("id"), readings.number_in_words(said).alias("number"), leading.alias("leading"), readings.number_in_words(F.concat(said, F.lit(" y folio"))).alias("none"))


_NUMBER = "(p_partkey % 8 + 2) * 1000 + (p_partkey % 9 + 1) * 100 + (p_partkey % 7 + 3) * 10 + p_partkey % 9 + 1"
NUMBERS_IN_WORDS_SQL = f"SELECT p_partkey AS id, {_NUMBER} AS number, {_NUMBER} AS leading, CAST(NULL AS BIGINT) AS none FROM part"


def dates_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """Days of orders written in figures, with slashes and as a notary does, with one that is no day of the calendar."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey")
    figure, month, year = F.dayofmonth(day), _pick(readings.MONTHS, F.month(day) - 1), F.year(day)
    spelled = F.concat_ws(" ", F.lit("a los"), _pick(_UNITS, figure % 9), F.lit("días del mes de"), month, F.lit("de dos mil"), _pick(_UNITS, k % 9))
    text = F.concat(F.format_string("El %d de %s de %d; 31/02/%d, %d/%d/%d. Ante mí, ", figure, month, year, year, figure, F.month(day), year), spelled, F.lit(" y nada más."))
    texts = _t(spark, d, "orders").groupBy(text.alias("text")).agg(F.count("*").alias("n"))  # each different text is read once
    return texts.select(F.explode(readings.dates_in("text")).alias("day"), "n").groupBy("day").agg(F.sum("n").alias("times"))


DATES_IN_TEXTS_SQL = """
WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders UNION ALL
  SELECT printf('%d-%02d-%02d', 2001 + o_orderkey % 9, month(o_orderdate), 1 + day(o_orderdate) % 9) AS day FROM orders WHERE NOT (2001 + o_orderkey % 9 = year(o_orderdate) AND 1 + day(o_orderdate) % 9 = day(o_orderdate)))
SELECT day, count(*) AS times FROM d GROUP BY ALL
"""


def amounts_in_texts(spark: SparkSession, d: str) -> DataFrame:
    k, whole = F.col("o_orderkey"), F.col("o_totalprice").cast("long")
    text = (
        F.when(k % 5 == 0, F.format_string("hasta $%,d.50 por proyecto", whole))
        .when(k % 5 == 1, F.format_string("unos %d mil pesos al año", whole % 900))
        .when(k % 5 == 2, F.format_string("US$ %d", whole))
        .when(k % 5 == 3, F.format_string("%d,5 millones de euros", whole % 90))
        .otherwise(F.format_string("%d personas", whole))
    )
    read = readings.amount(text, readings.mentions_pesos(F.lit("en pesos")))
    return spread(_t(spark, d, "orders").select("o_orderkey", "o_totalprice")).groupBy(read["currency"].alias("currency")).agg(F.count("*").alias("texts"), F.sum(F.round(read["value"] * 100).cast("long")).alias("cents"))


AMOUNTS_IN_TEXTS_SQL = """
WITH o AS (SELECT o_orderkey % 5 AS k, CAST(trunc(o_totalprice) AS BIGINT) AS w FROM orders),
a AS (SELECT CASE WHEN k <= 1 THEN 'MXN' WHEN k = 2 THEN 'USD' WHEN k = 3 THEN 'EUR' END AS currency, CASE k WHEN 0 THEN w * 100 + 50 WHEN 1 THEN w % 900 * 100000 WHEN 2 THEN w * 100 WHEN 3 THEN (w % 90 * 10 + 5) * 10000000 END AS cents FROM o)
SELECT currency, count(*) AS texts, CAST(sum(cents) AS BIGINT) AS cents FROM a GROUP BY ALL
"""


def spans_and_shares(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") + F.col("l_linenumber")
    time = F.concat_ws(" ", F.lit("un plazo de"), F.when(k % 2 == 0, (k % 30).cast("string")).otherwise(_pick(_UNITS, k % 9)), _pick(["años", "meses", "semanas", "días"], k % 4))
    part = F.when(k % 3 == 0, F.format_string("el %d %% del total", k % 150)).otherwise(F.concat(_pick(_TENS, k % 7), F.lit(" y "), _pick(_UNITS, k % 9), F.lit(" por ciento")))
    items = F.when(k % 2 == 0, F.format_string("%,d puntos", k * 7)).otherwise(F.concat(F.lit("son "), _pick(_TENS, k % 7)))
    told = dealt(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber").select(readings.duration(time).alias("t"), readings.percent(part).alias("percent"), readings.whole(items).alias("n"))
    return told.groupBy(F.col("t.unit").alias("unit"), F.col("percent").cast("long").alias("percent")).agg(F.count("*").alias("texts"), F.sum("t.value").cast("long").alias("time"), F.sum("n").alias("whole"))


SPANS_AND_SHARES_SQL = """
WITH k AS (SELECT l_orderkey + l_linenumber AS k FROM lineitem), t AS (SELECT k, CASE WHEN k % 2 = 0 THEN k % 30 ELSE k % 9 + 1 END AS v, CASE WHEN k % 3 > 0 THEN (k % 7 + 3) * 10 + k % 9 + 1 WHEN k % 150 <= 100 THEN k % 150 END AS percent FROM k)
SELECT CASE WHEN v > 0 THEN ['years', 'months', 'weeks', 'days'][k % 4 + 1] END AS unit, percent, count(*) AS texts, CAST(sum(CASE WHEN v > 0 THEN v END) AS BIGINT) AS time, CAST(sum(CASE WHEN k % 2 = 0 THEN k * 7 ELSE (k % 7 + 3) * 10 END) AS BIGINT) AS whole FROM t GROUP BY ALL
"""


def names_and_contacts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    full = F.concat_ws(" ", F.lit("Ana"), F.when(k % 2 == 0, "Luz"), F.when(k % 3 > 0, _pick(["Ruiz", "de la Cruz", "San Juan"], k % 3)), F.when(k % 5 > 0, "del Monte"))
    name = readings.split_name(full)
    phone = F.substring(F.lpad(F.col("c_custkey").cast("string"), 14, "5"), 1, (k % 6 + 9).cast("int"))
    return _t(spark, d, "customer").select(
        k.alias("id"), name["names"].alias("names"), name["first"].alias("first"), name["second"].alias("second"), readings.phone_like(phone).alias("phone_ok"),
        readings.email_like(F.concat(F.lit("a"), k.cast("string"), _pick(["@b.mx", "@b", "@.b.mx", " @b.mx", "@b.c@d.mx"], k % 5))).alias("email_ok"),
        readings.zip_like(F.lpad(k.cast("string"), 5, "0")).alias("zip_ok"), readings.bank(F.concat(_pick(["002", "999", "6-4 6"], k % 3), F.lit("180"))).alias("bank"),
    )


NAMES_AND_CONTACTS_SQL = """
WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Luz' END AS luz, CASE c_custkey % 3 WHEN 1 THEN 'de la Cruz' WHEN 2 THEN 'San Juan' END AS own, CASE WHEN c_custkey % 5 > 0 THEN 'del Monte' END AS monte FROM customer),
w AS (SELECT *, list_filter(['Ana', luz, own, monte], lambda x: x IS NOT NULL) AS l FROM c)
SELECT id, CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] ELSE array_to_string(l[:len(l) - 2], ' ') END AS names, CASE WHEN len(l) = 2 THEN l[2] WHEN len(l) > 2 THEN l[len(l) - 1] END AS first, CASE WHEN len(l) > 2 THEN l[len(l)] END AS second,
  id % 6 + 9 BETWEEN 10 AND 13 AS phone_ok, id % 5 = 0 AS email_ok, true AS zip_ok, ['Banamex', NULL, 'STP'][id % 3 + 1] AS bank FROM w
"""

_KINDS: list[kinds.Kind] = [("inglesa", [["the", "ing"], ["tion"]], [["web"]]), ("francesa", [["eau"], ["ment", "è"]], [["site", "1"]]), ("alemana", [["ung", "sch"], ["ß"]], [["blog"]])]


def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").withColumn("scored", kinds.scores(F.col("text"), _KINDS))
    put_on = F.when(F.col("doc_id") % 4 < 3, _pick([k[0] for k in _KINDS], F.col("doc_id") % 4)).otherwise("otro")
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("-1.pdf"))
    return docs.select("doc_id", kinds.recognised(F.col("scored")).alias("kind"), kinds.confidence(F.col("scored"), name, put_on, _KINDS).alias("confidence"))


_FOLDED = "translate(lower({x}), 'áàäéèëíìïóòöúùü', 'aaaeeeiiiooouuu')"
_POINTS = ", ".join("(" + " + ".join(f"CASE WHEN {' AND '.join(f'''contains(head, '{w}')''' for w in p)} THEN 3 WHEN {' AND '.join(f'''contains(body, '{w}')''' for w in p)} THEN 1 ELSE 0 END" for p in phrases) + f") AS p{i}" for i, (_, phrases, _) in enumerate(_KINDS))
_NAMED = " OR ".join(f"(k = {i} AND {' AND '.join(f'''contains(name, '{w}')''' for w in n)})" for i, (_, _, names) in enumerate(_KINDS) for n in names)
DOCUMENT_KINDS_SQL = f"""
WITH b AS (SELECT doc_id, doc_id % 4 AS k, left({_FOLDED.format(x="coalesce(text, '')")}, 6000) AS body, trim(regexp_replace({_FOLDED.format(x="coalesce(source, '') || '-1'")}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS name FROM documents),
h AS (SELECT *, left(body, 400) AS head FROM b), p AS (SELECT *, {_POINTS} FROM h), m AS (SELECT *, greatest(p0, p1, p2) AS best FROM p)
SELECT doc_id, CASE WHEN best > 0 AND (p0 = best)::INT + (p1 = best)::INT + (p2 = best)::INT = 1 THEN CASE best WHEN p0 THEN 'inglesa' WHEN p1 THEN 'francesa' ELSE 'alemana' END END AS kind,
  CAST(CASE k WHEN 0 THEN p0 - greatest(p1, p2) WHEN 1 THEN p1 - greatest(p0, p2) WHEN 2 THEN p2 - greatest(p0, p1) ELSE 0 END + CASE WHEN {_NAMED} THEN 1 ELSE 0 END AS INTEGER) AS confidence FROM m
"""


def page_labels(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return kinds.page_labels(pages).select("page", "label")


_SHAPE = r"regexp_replace(trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')), '[0-9]+', '#', 'g')"
PAGE_LABELS_SQL = rf"""
WITH p AS (SELECT source AS doc, doc_id AS page, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc, page, unnest(ls) AS raw, unnest(range(len(ls))) AS n FROM p), t AS (SELECT doc, page, n, trim(raw, ' ') AS line FROM e),
l AS (SELECT *, {_SHAPE} AS shape FROM t WHERE length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) >= 3), c AS (SELECT source AS doc, count(*) AS pages FROM documents GROUP BY ALL),
h AS (SELECT doc, shape FROM l JOIN c USING (doc) GROUP BY doc, shape, pages HAVING pages >= 4 AND count(DISTINCT page) * 10 >= pages * 3),
f AS (SELECT l.doc, page, arg_min(line, CASE WHEN h.shape IS NULL THEN 0 ELSE 1000000000 END + n) AS line FROM l LEFT JOIN h ON h.doc = l.doc AND h.shape = l.shape GROUP BY ALL)
SELECT doc_id AS page, left(coalesce(line, ''), 80) AS label FROM documents LEFT JOIN f ON page = doc_id
"""


def quotes_located(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of turns, every third with a wrong letter, every third with a wrong number, in the texts they come from."""
    turns = _t(spark, d, "conversations").filter("text is not null").withColumn("k", F.col("turn") + F.col("conv_id"))
    quote = F.substring("text", 5, 40)
    slip = F.concat(F.substring("text", 5, 20), F.lit("x"), F.substring("text", 26, 19))
    asked = turns.withColumn("quote", F.when(F.col("k") % 3 == 0, quote).when(F.col("k") % 3 == 1, slip).otherwise(F.concat(quote, F.lit(" 77"))))
    return asked.withColumn("found", provenance.located("quote", "text")).groupBy((F.col("k") % 3).alias("sort")).agg(F.count("*").alias("quotes"), F.count("found").alias("found"))


def values_by_evidence(spark: SparkSession, d: str) -> DataFrame:
    turns = _t(spark, d, "conversations")
    quotes = F.when(F.col("turn") % 3 > 0, F.array(F.substring("text", 1, 30), F.substring("text", 31, 30))).otherwise(F.array().cast("array<string>"))
    declared = _pick(["encontrado", "ambiguo", "no_aparece"], F.col("conv_id") % 3)
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), F.substring("text", 3, 12))).otherwise("nothing of the kind")
    told = turns.select(provenance.state_of(declared, F.size(quotes)).alias("state"), (provenance.value_in_quotes(said, quotes) == F.trim(said)).alias("kept"), F.size(quotes).alias("n"))
    return told.groupBy("state", "kept").agg(F.count("*").alias("turns"), F.round(provenance.share(F.count_if("kept"), F.sum("n")), 6).alias("rate"))


_NORM = r"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
VALUES_BY_EVIDENCE_SQL = f"""
WITH t AS (SELECT turn, conv_id, text, ' ' || substr(text, 3, 12) AS said FROM conversations),
s AS (SELECT CASE WHEN turn % 3 = 0 THEN 'no_aparece' WHEN conv_id % 3 = 1 THEN 'ambiguo' ELSE 'encontrado' END AS state, CASE WHEN turn % 3 > 0 THEN 2 ELSE 0 END AS n,
  CASE WHEN turn % 3 = 0 OR text IS NULL THEN NULL WHEN turn % 2 = 1 THEN contains({_NORM.format(x="substr(text, 1, 30)")}, 'nothing of the kind') OR contains({_NORM.format(x="substr(text, 31, 30)")}, 'nothing of the kind')
    ELSE trim(said, ' ') <> '' AND (contains({_NORM.format(x="substr(text, 1, 30)")}, {_NORM.format(x="said")}) OR contains({_NORM.format(x="substr(text, 31, 30)")}, {_NORM.format(x="said")})) END AS kept FROM t)
SELECT state, kept, count(*) AS turns, round(coalesce(count(*) FILTER (kept) / nullif(sum(n), 0), 1.0), 6) AS rate FROM s GROUP BY ALL
"""


def contradictions_kept(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as versions of a field; the same quotes under two names are one contradiction."""
    o = _t(spark, d, "orders").withColumn("quote", F.concat(F.lit("Pago: "), F.col("o_orderstatus"), F.lit(" ?")))
    fields = o.withColumn("field", F.explode(F.array("o_orderpriority", F.concat(F.lit("x "), "o_orderpriority"))))
    version = F.struct(F.col("o_orderkey").cast("string").alias("value"), "quote")
    told = fields.filter("o_orderkey % 7 < 3").groupBy(F.col("o_custkey").alias("doc"), "field").agg(F.array_sort(F.collect_list(version)).alias("versions"), F.min("field").alias("at"))
    return provenance.contradictions(told, "at").select("doc", "field", F.size("versions").alias("versions"))


CONTRADICTIONS_KEPT_SQL = """
WITH o AS (SELECT o_custkey AS doc, unnest([o_orderpriority, 'x ' || o_orderpriority]) AS field, lower(o_orderstatus) AS s FROM orders WHERE o_orderkey % 7 < 3),
f AS (SELECT doc, field, list_sort(list(s)) AS key FROM o GROUP BY ALL HAVING count(*) >= 2)
SELECT doc, min(field) AS field, CAST(len(key) AS INTEGER) AS versions FROM f GROUP BY doc, key
"""


def own_window(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("c_custkey"), lambda n: F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int")), "yyyy-MM-dd")
    origin = _pick(["user", "document", "computed"], k % 3)
    rows = _t(spark, d, "customer").select(k.alias("id"), F.when(k % 4 > 0, day(k % 90)).alias("issued"), F.when(k % 5 > 0, day(k % 70)).otherwise(" ").alias("until"), F.when(k % 2 == 0, "old").alias("ref"),
        F.when(k % 7 > 0, origin).alias("issued_origin"), origin.alias("until_origin"), F.lit(None).cast("string").alias("ref_origin"))
    read = _t(spark, d, "customer").filter("c_custkey % 6 > 0").select(k.alias("id"), day(k % 110).alias("issued"), day(k % 100).alias("until"), F.when(k % 11 > 0, " new ").otherwise(" ").alias("ref"))
    return provenance.own_values(rows, read, "id", ["issued", "until", "ref"], "issued", "until")


OWN_WINDOW_SQL = """
WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 > 0 THEN strftime(DATE '2020-01-01' + CAST(c_custkey % 90 AS INTEGER), '%Y-%m-%d') END AS issued, CASE WHEN c_custkey % 5 > 0 THEN strftime(DATE '2020-01-01' + CAST(c_custkey % 70 AS INTEGER), '%Y-%m-%d') ELSE ' ' END AS until,
  CASE WHEN c_custkey % 2 = 0 THEN 'old' END AS ref, ['user', 'document', 'computed'][c_custkey % 3 + 1] AS origin, c_custkey % 6 > 0 AS told, strftime(DATE '2020-01-01' + CAST(c_custkey % 110 AS INTEGER), '%Y-%m-%d') AS i2, strftime(DATE '2020-01-01' + CAST(c_custkey % 100 AS INTEGER), '%Y-%m-%d') AS u2 FROM customer),
i AS (SELECT *, told AND (issued IS NULL OR (k % 7 > 0 AND origin <> 'user')) AS ti FROM r), j AS (SELECT *, CASE WHEN ti THEN i2 ELSE issued END AS i3 FROM i),
u AS (SELECT *, told AND (until = ' ' OR origin <> 'user') AND NOT coalesce(u2 < i3, false) AS tu, told AND ref IS NULL AND k % 11 > 0 AS tr FROM j)
SELECT k AS id, i3 AS issued, CASE WHEN tu THEN u2 ELSE until END AS until, CASE WHEN tr THEN 'new' ELSE ref END AS ref, CASE WHEN ti THEN 'document' WHEN k % 7 > 0 THEN origin END AS issued_origin, CASE WHEN tu THEN 'document' ELSE origin END AS until_origin, CASE WHEN tr THEN 'document' END AS ref_origin FROM u
"""


def latest_milestones(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    told = _t(spark, d, "orders").select(F.col("o_custkey").alias("doc"), k.alias("n"), _pick(["cierre", "registro", "apertura"], k % 3).alias("kind"), F.when(k % 4 == 0, "15").otherwise(F.concat(F.lit("el "), k.cast("string"))).alias("said"),
        F.when(F.col("o_custkey") % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))
    return provenance.latest_milestone(told, "doc", "n", ["registro", "apertura"])


LATEST_MILESTONES_SQL = """
WITH m AS (SELECT o_custkey AS doc, o_orderkey AS n, ['cierre', 'registro', 'apertura'][o_orderkey % 3 + 1] AS kind, 'el ' || o_orderkey AS said, CASE WHEN o_custkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 4 > 0)
SELECT doc, kind, said, day, n FROM m QUALIFY row_number() OVER (PARTITION BY doc ORDER BY day DESC NULLS LAST, CASE WHEN day IS NULL THEN n ELSE -n END) = 1
"""


def _sites(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("p_partkey"), F.lit
    none = c(None).cast("string")
    return _t(spark, d, "part").select(k.alias("id"), F.when(k % 9 > 0, "Casa").otherwise(" ").alias("name"), (k % 50 - 1).alias("land_m2"), F.when(k % 3 > 0, k % 97).alias("built_m2"), (k * 40_000).alias("water_storage_liters"), (k % 23).alias("floors"),
        F.when(k % 4 > 0, k % 1100 - 5).alias("extinguishers"), c(None).cast("long").alias("smoke_detectors"), (k % 5).alias("drills_per_year"), (k % 700 + 1400).alias("built_year"), F.when(k % 3 == 0, c(2024)).alias("opinion_year"), F.when(k % 5 > 0, k % 30 + 2010).alias("tenure_until"),
        _pick(["own", "rent", "loan", "odd"], k % 4).alias("tenure"), none.alias("internal_program"), (k % 2 == 0).alias("civil_protection_opinion"), F.when(k % 6 == 0, F.array(c("none"))).otherwise(F.array(c("none"), c("ramp"))).alias("floor_access"), F.when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(c("well"))).alias("water_sources"))


def site_issues(spark: SparkSession, d: str) -> DataFrame:
    rules = registers.site(2026, {"tenure": ["own", "rent", "loan"]}, {"floor_access": ["none", "ramp"], "water_sources": ["grid"]})
    return records.issues(_sites(spark, d), "id", rules).groupBy("code", "field", "blocking").agg(F.count("*").alias("rows"))


_SITE = "WITH p AS (SELECT p_partkey AS k, p_partkey % 50 - 1 AS land, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 97 END AS built, p_partkey % 23 AS floors, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 1100 - 5 END AS ext, p_partkey % 700 + 1400 AS year, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 30 + 2010 END AS until FROM part)\n"
SITE_ISSUES_SQL = _SITE + """, i AS (SELECT unnest([CASE WHEN k % 9 = 0 THEN 'label_missing name true' END, CASE WHEN land < 0 THEN 'negative_number land_m2 true' END, CASE WHEN land = 0 THEN 'number_invalid land_m2 true' END, CASE WHEN built = 0 THEN 'number_invalid built_m2 true' END,
  CASE WHEN k * 40000 > 10000000 THEN 'number_too_large water_storage_liters true' END, CASE WHEN ext < 0 THEN 'negative_number extinguishers true' END, CASE WHEN ext > 1000 THEN 'number_too_large extinguishers true' END, CASE WHEN floors < 1 OR floors > 20 THEN 'floors_invalid floors true' END,
  CASE WHEN year < 1500 OR year > 2026 THEN 'year_invalid built_year true' END, CASE WHEN k % 4 = 3 THEN 'code_unknown tenure true' END, CASE WHEN k % 4 <> 1 THEN 'code_unknown water_sources true' END, CASE WHEN land > 0 AND built > land * floors THEN 'built_exceeds_land built_m2 false' END,
  CASE WHEN k % 4 IN (1, 2) AND until < 2026 THEN 'tenure_expired tenure_until false' END, CASE WHEN k % 4 IN (1, 2) AND until IS NULL THEN 'tenure_until_missing tenure_until false' END, CASE WHEN k % 2 = 0 AND k % 3 > 0 THEN 'opinion_year_missing opinion_year false' END]) AS x FROM p)
SELECT split_part(x, ' ', 1) AS code, split_part(x, ' ', 2) AS field, split_part(x, ' ', 3) = 'true' AS blocking, count(*) AS rows FROM i WHERE x IS NOT NULL GROUP BY ALL
"""


def site_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _sites(spark, d).select("id", F.array_join(registers.site_gaps(), ",").alias("gaps"), registers.only_stairs().alias("only_stairs"))


SITE_GAPS_SQL = _SITE + "SELECT k AS id, array_to_string(list_filter([CASE WHEN built IS NULL THEN 'built_m2' END, CASE WHEN k % 4 = 1 THEN 'water' END, CASE WHEN ext IS NULL THEN 'safety' END], lambda x: x IS NOT NULL), ',') AS gaps, k % 6 = 0 AND floors > 1 AS only_stairs FROM p"


def age_bands(spark: SparkSession, d: str) -> DataFrame:
    age = F.when(F.col("c_custkey") % 13 > 0, F.col("c_custkey") % 210 - 3)
    bands = [registers.age_band(kind, age).alias(kind) for kind in registers.BANDS]
    return _t(spark, d, "customer").groupBy(*bands).agg(F.count("*").alias("people"))


_AGE_BANDS = {"elderly": "[(60, 'under_60'), (70, '60_69'), (80, '70_79'), (90, '80_89'), (201, '90_plus')]", "children": "[(6, '0_5'), (12, '6_11'), (18, '12_17'), (201, '18_plus')]", "other": "[(18, '0_17'), (60, '18_59'), (201, '60_plus')]"}
AGE_BANDS_SQL = "WITH a AS (SELECT CASE WHEN c_custkey % 13 > 0 THEN c_custkey % 210 - 3 END AS age FROM customer) SELECT " + ", ".join(f"coalesce(CASE WHEN age >= 0 THEN list_filter({b}, lambda x: age < x[1])[1][2] END, 'unknown') AS {k}" for k, b in _AGE_BANDS.items()) + ", count(*) AS people FROM a GROUP BY ALL"

QUERIES = {f.__name__: f for f in (numbers_in_words, dates_in_texts, amounts_in_texts, spans_and_shares, names_and_contacts, document_kinds, page_labels, quotes_located, values_by_evidence, contradictions_kept, own_window, latest_milestones, site_issues, site_gaps, age_bands)}
ORACLES = {k.removesuffix("_SQL").lower(): v for k, v in dict(globals()).items() if k.endswith("_SQL")}
