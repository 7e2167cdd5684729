"""Queries over registers, figures and identifiers of people, on records derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions import figures
from tesela.functions.checks import CURP_ALPHABET
from tesela.functions.text import SCAN_FROM, SCAN_TO
from tesela.operators import records, registers, scanner
from tesela.sources.shared import dealt


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Records that hold one identifier of each kind; about one in ten has the right check digit.  Both engines read this.
_PERSON = """concat('Cuenta ', lpad(cast(k * 15485863 % 1000000000 AS {s}), 9, '0'), lpad(cast(k * 32452843 % 1000000000 AS {s}), 9, '0'), ', tarjeta 4', lpad(cast(k * 7919 % 1000000000 AS {s}), 9, '0'), lpad(cast(k * 104729 % 1000000 AS {s}), 6, '0'),
    ', nss ', lpad(cast(k * 104729 % 100000000000 AS {s}), 11, '0'), ', curp pega', d, 'hdfrrs0', cast(k % 10 AS {s}), '; rfc PEGÁ', d, 'AB', cast(k % 10 AS {s}), ' de abc', d, 'XY', cast(k % 10 AS {s}), '; clave ABCDEF', lpad(cast(k AS {s}), 8, '0'), 'H',
    lpad(cast(k % 1000 AS {s}), 3, '0'), ', correo Cliente', cast(k AS {s}), '@correo.example')"""
_DATE = "concat(lpad(cast(k * 37 % 100 AS {s}), 2, '0'), lpad(cast(k % 13 AS {s}), 2, '0'), lpad(cast(k % 32 AS {s}), 2, '0'))"


PEOPLE_TEXTS = f"SELECT {_PERSON.format(s='VARCHAR')} AS text FROM (SELECT k, {_DATE.format(s='VARCHAR')} AS d FROM (SELECT c_custkey AS k FROM customer))"


def people(spark: SparkSession, d: str) -> DataFrame:
    k = dealt(_t(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")
    return k.withColumn("d", F.expr(_DATE.format(s="string"))).select("k", F.expr(_PERSON.format(s="string")).alias("text"))


def scanner_counts(spark: SparkSession, d: str) -> DataFrame:
    return scanner.counts(people(spark, d).select("text").union(_t(spark, d, "documents").select("text")))


def scanner_findings(spark: SparkSession, d: str) -> DataFrame:
    """Resolved findings of every record by kind and severity; phones and overlaps need places, so this has no SQL."""
    spans = people(spark, d).select("text").union(_t(spark, d, "documents").select("text")).select(F.explode(scanner.scanner()("text")).alias("x"))
    return spans.groupBy("x.kind", "x.severity").agg(F.count("*").alias("findings"))


def _kind_sql(kind: str, gate: str = "true", severity: str | None = None) -> str:
    severity = severity or ("block" if kind in scanner.BLOCKING else "warn")
    n = f"len(list_filter(regexp_extract_all(t, '{scanner.PATTERNS[kind]}'), lambda v: {gate}))"
    return f"SELECT '{kind}' AS kind, '{severity}' AS severity, count(*) FILTER (n > 0) AS documents, CAST(sum(n) AS BIGINT) AS findings FROM (SELECT {n} AS n FROM f)"


def day_sql(at: int) -> str:
    m, d = f"CAST(substr(v, {at + 2}, 2) AS INT)", f"CAST(substr(v, {at + 4}, 2) AS INT)"
    return f"{m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND CASE WHEN {m} = 2 THEN 29 WHEN {m} IN (4, 6, 9, 11) THEN 30 ELSE 31 END"


CURP_GATE = f"(10 - list_sum(list_transform(range(1, 18), lambda i: (strpos('{CURP_ALPHABET}', v[i]) - 1) * (19 - i))) % 10) % 10 = CAST(v[18] AS INT)"
CLABE_GATE = "(10 - list_sum(list_transform(range(1, 18), lambda i: CAST(v[i] AS INT) * CASE i % 3 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 1 END % 10)) % 10) % 10 = CAST(v[18] AS INT)"
LUHN_GATE = "list_sum(list_transform(string_split(reverse(regexp_replace(v, '[^0-9]', '', 'g')), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END)) % 10 = 0"
SCANNER_COUNTS_SQL = f"""
WITH k AS (SELECT k, {_DATE.format(s='VARCHAR')} AS d FROM (SELECT c_custkey AS k FROM customer)),
f AS (SELECT translate(upper(coalesce(text, '')), '{SCAN_FROM}', '{SCAN_TO}') AS t FROM (SELECT {_PERSON.format(s='VARCHAR')} AS text FROM k UNION ALL SELECT text FROM documents))
""" + "\nUNION ALL\n".join(
    [_kind_sql("curp", CURP_GATE, "block"), _kind_sql("curp", f"NOT ({CURP_GATE})", "warn"), _kind_sql("rfc_person", day_sql(5)), _kind_sql("rfc_company", day_sql(4)), _kind_sql("voter_key"), _kind_sql("email"), _kind_sql("clabe", CLABE_GATE), _kind_sql("card", LUHN_GATE), _kind_sql("nss", LUHN_GATE)]
)


def unsupported_figures(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose summary states a number that neither the order nor the note holds."""
    o = _t(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    wrong = F.when(F.col("o_orderkey") % 5 == 0, F.col("cents") + 100).otherwise(F.col("cents"))
    summary = F.format_string("Total %,d.%02d, cliente %d, 3 pagos de 0%d.50", F.expr("cents div 100"), F.col("cents") % 100, F.col("o_custkey"), F.col("o_orderkey") % 9)
    source = F.format_string("Cliente %d debe %d.%02d en tres pagos", F.col("o_custkey"), (wrong / 100).cast("long"), wrong % 100)
    bad = figures.unsupported(summary, source, F.concat(F.lit("pago: "), (F.col("o_orderkey") % 3).cast("string"), F.lit(".5")))
    return o.select("o_orderkey", F.size(bad).alias("n")).groupBy("n").agg(F.count("*").alias("orders"))


UNSUPPORTED_FIGURES_SQL = """
SELECT CAST(CASE WHEN o_orderkey % 5 = 0 AND NOT (CAST(round(o_totalprice * 100) AS BIGINT) % 100 = 0 AND CAST(round(o_totalprice * 100) AS BIGINT) // 100 IN (3, o_custkey)) THEN 1 ELSE 0 END
  + CASE WHEN o_orderkey % 9 <> o_orderkey % 3 THEN 1 ELSE 0 END AS INTEGER) AS n, count(*) AS orders FROM orders GROUP BY 1
"""


def _groups(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, d, "part").select(k.alias("id"), F.element_at(F.array(*map(F.lit, ("room", "bath", "other", "odd"))), (k % 4 + 1).cast("int")).alias("kind"), F.when(k % 3 == 0, " ").otherwise(F.col("p_brand")).alias("label"),
        (F.col("p_size").cast("long") - 2).alias("count"), (k % 11 - 1).alias("good"), F.when(k % 2 == 0, k % 7).alias("fair"), (k % 5).alias("poor"), F.when(k % 6 > 0, k % 3).alias("unusable"))


_GROUPS = """WITH g AS (SELECT p_partkey AS id, ['room', 'bath', 'other', 'odd'][p_partkey % 4 + 1] AS kind, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_brand END AS label, CAST(p_size AS BIGINT) - 2 AS count, p_partkey % 11 - 1 AS good,
    CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 7 END AS fair, p_partkey % 5 AS poor, CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 3 END AS unusable FROM part),
c AS (SELECT *, coalesce(good, 0) + coalesce(fair, 0) + coalesce(poor, 0) + coalesce(unusable, 0) AS checked FROM g)
"""


def group_issues(spark: SparkSession, d: str) -> DataFrame:
    found = records.issues(_groups(spark, d), "id", registers.things(["room", "bath", "other"]))
    return found.groupBy("code", "field", "blocking").agg(F.count("*").alias("rows"))


GROUP_ISSUES_SQL = _GROUPS + """, i AS (SELECT unnest([CASE WHEN kind = 'odd' THEN 'code_unknown kind true' END, CASE WHEN kind = 'other' AND trim(label) = '' THEN 'label_missing label true' END, CASE WHEN count < 1 THEN 'count_invalid count true' END,
  CASE WHEN count > 1000 THEN 'number_too_large count true' END, CASE WHEN good < 0 THEN 'negative_number good true' END, CASE WHEN count >= 1 AND checked > count THEN 'states_exceed_count states true' END,
  CASE WHEN count >= 1 AND checked BETWEEN 0 AND count - 1 THEN 'states_unchecked states false' END]) AS x FROM c)
SELECT split_part(x, ' ', 1) AS code, split_part(x, ' ', 2) AS field, split_part(x, ' ', 3) = 'true' AS blocking, count(*) AS rows FROM i WHERE x IS NOT NULL GROUP BY ALL
"""


def group_totals(spark: SparkSession, d: str) -> DataFrame:
    return registers.totals_by_kind(_groups(spark, d), ["kind"])


GROUP_TOTALS_SQL = _GROUPS + "SELECT kind, CAST(sum(count) AS BIGINT) AS count, CAST(sum(coalesce(good, 0)) AS BIGINT) AS good, CAST(sum(coalesce(fair, 0)) AS BIGINT) AS fair, CAST(sum(coalesce(poor, 0)) AS BIGINT) AS poor, CAST(sum(coalesce(unusable, 0)) AS BIGINT) AS unusable, CAST(sum(greatest(count - checked, 0)) AS BIGINT) AS unchecked FROM c GROUP BY kind"


def finance_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Customers as institutions, orders as income, and the orders of urgent ones as expenses."""
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    base = c.select(k.alias("id"), F.when(k % 3 == 0, k * 10).alias("fees"), (k % 7 * 100).alias("payroll"), F.lit(5).alias("support"), F.lit(None).cast("long").alias("external"), F.when(k % 2 == 0, k * 50).alias("budget"))
    o, n = _t(spark, d, "orders"), F.col("o_orderkey")
    line = [F.col("o_custkey").alias("id"), F.when(n % 4 > 0, F.col("o_totalprice").cast("long")).alias("amount_mxn"), F.when(n % 2 == 0, "monthly").otherwise("annual").alias("period")]
    kind = F.when(n % 5 == 0, "fee_estimate").when(n % 5 == 1, "recurring_donor").otherwise("event").alias("kind")
    return registers.finance(base, o.filter("o_orderpriority <> '1-URGENT'").select(*line, kind), o.filter("o_orderpriority = '1-URGENT'").select(*line))


FINANCE_ROLLUP_SQL = """
WITH o AS (SELECT o_custkey AS id, o_orderpriority = '1-URGENT' AS out, CASE o_orderkey % 5 WHEN 0 THEN 'e' WHEN 1 THEN 'r' ELSE 'v' END AS kind, CASE WHEN o_orderkey % 4 > 0 THEN CAST(trunc(o_totalprice) AS BIGINT) * CASE WHEN o_orderkey % 2 = 0 THEN 12 ELSE 1 END END AS a FROM orders),
s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN nullif(c_custkey * 10, 0) END AS fees, c_custkey % 7 * 100 + 5 AS people, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 50 END AS budget, count(*) FILTER (o.out) AS lines, coalesce(sum(a) FILTER (o.out), 0) AS spent,
  coalesce(fees, sum(a) FILTER (NOT o.out AND kind = 'e')) AS fee, sum(a) FILTER (NOT o.out AND kind = 'r') AS r, sum(a) FILTER (NOT o.out AND kind = 'v') AS v FROM customer LEFT JOIN o ON o.id = c_custkey GROUP BY c_custkey),
x AS (SELECT id, CAST(coalesce(fee, 0) + coalesce(r, 0) AS BIGINT) AS f, CAST(coalesce(v, 0) AS BIGINT) AS v, coalesce(fee, r, v) IS NOT NULL AS known, CASE WHEN lines > 0 THEN 'list' WHEN budget IS NOT NULL THEN 'estimate' ELSE 'unknown' END AS basis, CAST(CASE WHEN lines > 0 THEN spent + people ELSE budget END AS BIGINT) AS expenses FROM s)
SELECT id, f + v AS income, f AS income_fixed, v AS income_variable, basis, expenses, CASE WHEN known THEN f + v - expenses END AS balance FROM x
"""


def position_vacancies(spark: SparkSession, d: str) -> DataFrame:
    positions = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("position_id"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") * 7 % 20 - 1).alias("authorized_seats"))
    people = _t(spark, d, "customer").select((F.col("c_custkey") * 13 % 97).alias("position_id"), (F.col("c_acctbal") > 0).alias("current"))
    return registers.position_summary(positions, people)


POSITION_VACANCIES_SQL = """
WITH h AS (SELECT c_custkey * 13 % 97 AS position_id, count(*) AS people FROM customer WHERE c_acctbal > 0 GROUP BY 1),
p AS (SELECT s_suppkey AS position_id, coalesce(people, 0) AS people, CASE WHEN s_suppkey % 3 > 0 AND s_suppkey * 7 % 20 > 1 THEN s_suppkey * 7 % 20 - 1 END AS seats FROM supplier LEFT JOIN h ON h.position_id = s_suppkey)
SELECT position_id, people, seats, coalesce(greatest(seats - people, 0), 0) AS vacancies FROM p WHERE people > 0 OR seats IS NOT NULL
"""

QUERIES = {f.__name__: f for f in (scanner_counts, scanner_findings, unsupported_figures, group_issues, group_totals, finance_rollup, position_vacancies)}
ORACLES = {k.removesuffix("_SQL").lower(): v for k, v in dict(globals()).items() if k.endswith("_SQL")}
