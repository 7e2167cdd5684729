"""Queries over indicators and rules of registers, each with its SQL.  Customers are people in care, nations institutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.operators import indicators, provenance, records, registers

_DAY = "2026-06-15"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _today() -> Column:
    return F.lit(_DAY).cast("date")


def _pick(options: list[str | None], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o).cast("string") for o in options]), (i + 1).cast("int"))


def _on(first: str, days: Column) -> Column:
    return F.date_format(F.date_add(F.lit(first).cast("date"), days.cast("int")), "yyyy-MM-dd")


_STATUS, _VISITS = ["active", "hospitalized", "discharged", "deceased", "active", "odd"], ["weekly", "rarely", "never", None]
_CHRONIC = ["diabetes", "asthma", "none"]


def _people(spark: SparkSession, d: str) -> DataFrame:
    k, no = F.col("c_custkey"), F.lit(None).cast("string")
    names = F.array().cast("array<string>")
    return _t(spark, d, "customer").select(
        F.col("c_nationkey").alias("home"), k.alias("id"), _pick(_STATUS, k % 6).alias("status"), F.when(k % 5 > 0, _on("1930-01-01", k % 30_000)).when(k % 10 == 0, "1930-02-31").alias("birth_date"), F.when(k % 15 == 0, k % 90).alias("approx_age"),
        F.when(k % 4 > 0, _on("2020-03-01", k % 2400)).alias("entry_date"), F.when(k % 3 == 2, _on("2025-01-01", k % 520)).alias("status_date"), _pick(["female", "male", None], k % 3).alias("sex"), _pick(_VISITS, k % 4).alias("visits"),
        F.when(k % 7 > 0, F.array(F.when(k % 2 == 0, "Ana").otherwise(" "))).otherwise(names).alias("contacts"), F.when(k % 8 == 0, F.array(F.lit("pension"))).when(k % 8 == 1, names).alias("programs"),
        F.when(k % 9 == 0, "exempt").when(k % 9 == 1, "family").alias("fee_payer"), F.when(k % 11 > 0, (k % 50) * 100 - 100).alias("monthly_fee_mxn"), F.when(k % 2 == 0, " ").otherwise("2024-01-01").alias("consent_date"),
        F.when(k % 13 == 0, "mixe").alias("indigenous_language"), (k % 17 == 0).alias("attends_school"), F.when(k % 19 == 0, True).alias("school_lag"), (k % 101).alias("progress"),
        F.array(_pick(_CHRONIC, k % 3), F.when(k % 4 == 0, "asthma")).alias("chronic"), _pick(["low", "high", None], k % 3).alias("dependency"),
        F.when(k % 12 > 0, "Luz").otherwise(" ").alias("first_names"), no.alias("curp"), F.lit(False).alias("birth_date_approx"), F.when(k % 14 == 0, "moved").alias("discharge_reason"),
    )


_PEOPLE = f"""
WITH c AS (SELECT c_custkey AS k, c_nationkey AS home, ['active', 'hospitalized', 'discharged', 'deceased', 'active', 'odd'][c_custkey % 6 + 1] AS status, CASE WHEN c_custkey % 5 > 0 THEN DATE '1930-01-01' + CAST(c_custkey % 30000 AS INTEGER) END AS born, CASE WHEN c_custkey % 15 = 0 THEN c_custkey % 90 END AS approx,
  CASE WHEN c_custkey % 4 > 0 THEN DATE '2020-03-01' + CAST(c_custkey % 2400 AS INTEGER) END AS entered, CASE WHEN c_custkey % 3 = 2 THEN DATE '2025-01-01' + CAST(c_custkey % 520 AS INTEGER) END AS moved, ['female', 'male', NULL][c_custkey % 3 + 1] AS sex, ['low', 'high', NULL][c_custkey % 3 + 1] AS dependency,
  CASE WHEN c_custkey % 11 > 0 THEN (c_custkey % 50) * 100 - 100 END AS fee, c_custkey % 8 = 0 AS program, c_custkey % 9 = 0 AS exempt FROM customer),
y AS (SELECT *, status IN ('active', 'hospitalized') AS s, year(DATE '{_DAY}') - year(born) - CASE WHEN month(DATE '{_DAY}') * 100 + day(DATE '{_DAY}') < month(born) * 100 + day(born) THEN 1 ELSE 0 END AS years,
  year(DATE '{_DAY}') - year(entered) - CASE WHEN month(DATE '{_DAY}') * 100 + day(DATE '{_DAY}') < month(entered) * 100 + day(entered) THEN 1 ELSE 0 END AS stay FROM c),
p AS (SELECT *, coalesce(years, approx) AS age, s AND coalesce(fee > 0, false) AND NOT exempt AS pays FROM y)
"""


def care_indicators(spark: SparkSession, d: str) -> DataFrame:
    out = indicators.care(_people(spark, d), ["home"], _today())
    return out.withColumns({c: F.round(c, 6) for c in ("average_age", "average_years")})


CARE_INDICATORS_SQL = (
    _PEOPLE
    + f"""SELECT home, count(*) FILTER (s) AS served, count(*) FILTER (status = 'hospitalized') AS hospitalized, count(*) FILTER (s AND age IS NULL) AS without_age, round(avg(age) FILTER (s), 6) AS average_age, round(avg(stay) FILTER (s), 6) AS average_years,
  count(*) FILTER (year(entered) = 2026) AS admitted_this_year, count(*) FILTER (status = 'discharged' AND year(moved) = 2026) AS discharged_this_year, count(*) FILTER (status = 'deceased' AND year(moved) = 2026) AS deceased_this_year,
  CASE WHEN max(moved) FILTER (status = 'discharged') > max(entered) THEN 'discharged' WHEN max(entered) IS NOT NULL THEN 'admitted' WHEN max(moved) FILTER (status = 'discharged') IS NOT NULL THEN 'discharged' END AS latest_movement,
  count(*) FILTER (s AND k % 4 IN (1, 2)) AS few_visits, count(*) FILTER (s AND NOT (k % 7 > 0 AND k % 2 = 0)) AS without_contact, count(*) FILTER (s AND program) AS with_program, count(*) FILTER (s AND NOT program AND age >= 65) AS elderly_without_program,
  count(*) FILTER (s AND exempt) AS exempt, count(*) FILTER (pays) AS paying, CAST(coalesce(sum(fee) FILTER (pays), 0) AS BIGINT) AS fees_monthly, count(*) FILTER (s AND k % 2 = 0) AS without_consent, count(*) FILTER (s AND k % 13 = 0) AS indigenous_language,
  count(*) FILTER (s AND k % 17 = 0) AS attending_school, count(*) FILTER (s AND k % 19 = 0) AS school_lag, count(*) FILTER (s AND k % 101 < 50) AS incomplete, CASE WHEN count(*) FILTER (pays) > 0 THEN CAST(sum(fee) FILTER (pays) // count(*) FILTER (pays) AS BIGINT) END AS average_fee
FROM p GROUP BY home
"""
)


def care_summary(spark: SparkSession, d: str) -> DataFrame:
    people = _people(spark, d)
    counts = indicators.care_counts(people, ["home"], ["sex", "dependency"], ["chronic"])
    told = indicators.safe_summary(indicators.care(people, ["home"], _today()), counts, ["home"])
    groups = F.array_join(F.transform("groups", lambda g: F.concat_ws(":", g["what"], g["code"], g["n"].cast("string"))), " ")
    return told.select("home", "served", "average_age", "admitted_this_year", "discharged_this_year", "latest_movement", groups.alias("groups"))


CARE_SUMMARY_SQL = (
    _PEOPLE
    + """, g AS (SELECT home, 'sex' AS what, sex AS code FROM p WHERE s UNION ALL SELECT home, 'dependency', dependency FROM p WHERE s UNION ALL SELECT home, 'chronic', ['diabetes', 'asthma', 'none'][k % 3 + 1] FROM p WHERE s UNION ALL SELECT home, 'chronic', 'asthma' FROM p WHERE s AND k % 4 = 0),
n AS (SELECT home, what, code, count(*) AS n FROM g WHERE code IS NOT NULL GROUP BY ALL HAVING count(*) >= 3), t AS (SELECT home, string_agg(what || ':' || code || ':' || n, ' ' ORDER BY what, code) AS groups FROM n GROUP BY home)
SELECT p.home, count(*) FILTER (s) AS served, CAST(floor(avg(age) FILTER (s) + 0.5) AS BIGINT) AS average_age, count(*) FILTER (year(entered) = 2026) AS admitted_this_year, count(*) FILTER (status = 'discharged' AND year(moved) = 2026) AS discharged_this_year,
  CASE WHEN max(moved) FILTER (status = 'discharged') > max(entered) THEN 'discharged' WHEN max(entered) IS NOT NULL THEN 'admitted' WHEN max(moved) FILTER (status = 'discharged') IS NOT NULL THEN 'discharged' END AS latest_movement, coalesce(any_value(groups), '') AS groups
FROM p LEFT JOIN t ON t.home = p.home GROUP BY p.home
"""
)


def care_pyramid(spark: SparkSession, d: str) -> DataFrame:
    return indicators.pyramid(_people(spark, d), ["home"], "elderly", _today())


CARE_PYRAMID_SQL = _PEOPLE + "SELECT home, CASE WHEN age < 60 THEN 'under_60' WHEN age < 70 THEN '60_69' WHEN age < 80 THEN '70_79' WHEN age < 90 THEN '80_89' ELSE '90_plus' END AS band, sex, count(*) AS n FROM p WHERE s AND sex IS NOT NULL AND age BETWEEN 0 AND 200 GROUP BY ALL"


def population_lines(spark: SparkSession, d: str) -> DataFrame:
    return registers.population_lines(_people(spark, d).filter(indicators.served()), ["home", "dependency", "fee_payer"], indicators.age(_today()), indicators.pays())


POPULATION_LINES_SQL = _PEOPLE + "SELECT home, dependency, CASE k % 9 WHEN 0 THEN 'exempt' WHEN 1 THEN 'family' END AS fee_payer, count(*) AS people, count(*) FILTER (pays) AS paying, min(age) AS youngest, max(age) AS oldest FROM p WHERE s GROUP BY ALL"


def beneficiary_issues(spark: SparkSession, d: str) -> DataFrame:
    rules = registers.beneficiary(_today(), {"sex": ["female"], "dependency": ["low", "high"]}, {"chronic": _CHRONIC[:2]}, youngest=60)
    return records.issues(_people(spark, d), "id", rules).groupBy("code", "field", "blocking").agg(F.count("*").alias("rows"))


BENEFICIARY_ISSUES_SQL = (
    _PEOPLE
    + f""", i AS (SELECT unnest([CASE WHEN k % 12 = 0 THEN 'name_missing first_names true' END, CASE WHEN born IS NULL AND k % 10 > 0 AND approx IS NULL THEN 'birth_missing birth_date true' END, CASE WHEN k % 3 = 1 THEN 'code_unknown sex true' END, CASE WHEN k % 3 = 2 THEN 'code_unknown chronic true' END,
  CASE WHEN k % 4 <> 0 THEN 'code_unknown chronic true' END, CASE WHEN k % 10 = 0 THEN 'date_invalid birth_date true' END, CASE WHEN entered < born THEN 'entry_before_birth entry_date true' END, CASE WHEN born > DATE '{_DAY}' THEN 'birth_in_future birth_date true' END, CASE WHEN age < 60 THEN 'age_unusual birth_date false' END,
  CASE WHEN fee < 0 THEN 'negative_number monthly_fee_mxn true' END, CASE WHEN exempt AND fee > 0 THEN 'exempt_with_fee monthly_fee_mxn false' END, CASE WHEN status IN ('discharged', 'deceased') AND moved IS NULL THEN 'status_date_missing status_date false' END, CASE WHEN status = 'discharged' AND k % 14 > 0 THEN 'discharge_reason_missing discharge_reason false' END]) AS x, k FROM p)
SELECT split_part(x, ' ', 1) AS code, split_part(x, ' ', 2) AS field, split_part(x, ' ', 3) = 'true' AS blocking, count(DISTINCT k) AS rows FROM i WHERE x IS NOT NULL GROUP BY ALL
"""
)


def admissions(spark: SparkSession, d: str) -> DataFrame:
    """A waiting list after admissions, some of them asked for twice."""
    k = F.col("c_custkey")
    waiting = _t(spark, d, "customer").select(k.alias("entry_id"), F.col("c_name").alias("name"), F.when(k % 4 > 0, k % 90).alias("approx_age"), _pick(["waiting", "admitted", "withdrawn"], k % 3).alias("status"))
    asked = _t(spark, d, "orders").select(F.col("o_custkey").alias("entry_id")).filter("entry_id % 2 = 0")
    people, left = registers.admitted(waiting, asked, _today())
    told = people.select(F.lit("person").alias("what"), "status", "approx_age").union(left.select(F.lit("entry"), "status", "approx_age"))
    return told.groupBy("what", "status", "approx_age").agg(F.count("*").alias("n"))


ADMISSIONS_SQL = """
WITH w AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 90 END AS approx_age, ['waiting', 'admitted', 'withdrawn'][c_custkey % 3 + 1] AS status, c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0) AS asked FROM customer),
g AS (SELECT *, asked AND status = 'waiting' AND approx_age IS NOT NULL AS goes FROM w)
SELECT 'person' AS what, 'active' AS status, approx_age, count(*) AS n FROM g WHERE goes GROUP BY ALL UNION ALL SELECT 'entry', CASE WHEN goes THEN 'admitted' ELSE status END, approx_age, count(*) FROM g GROUP BY ALL
"""


def waiting_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    entries = _t(spark, d, "customer").select(k.alias("id"), F.when(k % 5 > 0, _on("2026-01-01", k % 300)).when(k % 2 == 0, "pronto").alias("requested_on"), F.when(k % 3 > 0, _pick(["family", "court"], k % 2)).alias("referred_by"), _pick(["waiting", None, "odd"], k % 3).alias("status"), (k % 140 - 5).alias("approx_age"), _pick(["55 1234-5678", "+52 55 1234 5678", "12", " "], k % 4).alias("phone"))
    return records.issues(entries, "id", registers.waiting({"referred_by": ["family"]}, ["waiting"])).groupBy("code", "field", "blocking").agg(F.count("*").alias("rows"))


WAITING_ISSUES_SQL = """
WITH i AS (SELECT unnest([CASE WHEN c_custkey % 5 = 0 THEN 'date_invalid requested_on' END, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 2 = 1 THEN 'code_unknown referred_by' END, CASE WHEN c_custkey % 3 > 0 THEN 'code_unknown status' END, CASE WHEN c_custkey % 140 - 5 NOT BETWEEN 0 AND 120 THEN 'age_invalid approx_age' END, CASE WHEN c_custkey % 4 = 2 THEN 'phone_invalid phone' END]) AS x FROM customer)
SELECT split_part(x, ' ', 1) AS code, split_part(x, ' ', 2) AS field, true AS blocking, count(*) AS rows FROM i WHERE x IS NOT NULL GROUP BY ALL
"""


def staff_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = _t(spark, d, "supplier").select(k.alias("id"), F.when(k % 7 > 0, "Luz").alias("first_names"), F.when(k % 5 > 0, k.cast("string")).alias("position_id"), _pick(["full", "odd"], k % 2).alias("contract"), F.array(_pick(["morning", "moon"], k % 2)).alias("shifts"), _on("1950-01-01", k * 331 % 28_000).alias("birth_date"),
        F.when(k % 3 > 0, _on("2024-01-01", k % 400)).alias("start_date"), _on("2024-06-01", k % 100).alias("end_date"), F.lit("2024-02-30").alias("left_date"), F.lit(None).cast("string").alias("curp"), _pick(["ABCD900101XY1", "ABCD900132XY1", "x"], k % 3).alias("rfc"))
    rules = registers.staff(_today(), {"contract": ["full"]}, {"shifts": ["morning"]})
    return records.issues(rows, "id", rules).groupBy("code", "field", "blocking").agg(F.count("*").alias("rows"))


STAFF_ISSUES_SQL = f"""
WITH s AS (SELECT s_suppkey AS k, DATE '1950-01-01' + CAST(s_suppkey * 331 % 28000 AS INTEGER) AS born FROM supplier),
a AS (SELECT *, 2026 - year(born) - CASE WHEN month(DATE '{_DAY}') * 100 + day(DATE '{_DAY}') < month(born) * 100 + day(born) THEN 1 ELSE 0 END AS age FROM s),
i AS (SELECT unnest([CASE WHEN k % 7 = 0 THEN 'name_missing first_names true' END, CASE WHEN k % 5 = 0 THEN 'position_missing position_id true' END, CASE WHEN k % 2 = 1 THEN 'code_unknown contract true' END, CASE WHEN k % 2 = 1 THEN 'code_unknown shifts true' END, 'date_invalid left_date true',
  CASE WHEN k % 3 > 0 AND DATE '2024-06-01' + CAST(k % 100 AS INTEGER) < DATE '2024-01-01' + CAST(k % 400 AS INTEGER) THEN 'end_before_start end_date true' END, CASE WHEN age NOT BETWEEN 14 AND 100 THEN 'age_out_of_range birth_date false' END, 'rfc_invalid rfc true']) AS x FROM a)
SELECT split_part(x, ' ', 1) AS code, split_part(x, ' ', 2) AS field, split_part(x, ' ', 3) = 'true' AS blocking, count(*) AS rows FROM i WHERE x IS NOT NULL GROUP BY ALL
"""


def line_and_position_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    lines = _t(spark, d, "part").select(k.alias("id"), F.when(k % 6 > 0, "Luz").otherwise(" ").alias("label"), F.when(k % 7 > 0, (k - 50) * 1_000_000_000).alias("amount_mxn"))
    seats = _t(spark, d, "part").select(k.alias("id"), F.when(k % 5 > 0, F.col("p_name")).alias("title"), _pick(["care", "odd"], k % 2).alias("area"), F.when(k % 3 > 0, _pick(["fixed", "odd"], k % 2)).alias("default_modality"), (k - 10).alias("reference_pay_mxn"), (k * 10 - 40).alias("authorized_seats"))
    a = records.issues(lines, "id", registers.lines()).withColumn("list", F.lit("lines"))
    b = records.issues(seats, "id", registers.position({"area": ["care"]}, ["fixed"])).withColumn("list", F.lit("positions"))
    return a.unionByName(b).groupBy("list", "code", "field").agg(F.count("*").alias("rows"))


LINE_AND_POSITION_ISSUES_SQL = """
WITH i AS (SELECT unnest([CASE WHEN p_partkey % 6 = 0 THEN 'lines label_missing label' END, CASE WHEN p_partkey % 7 > 0 AND p_partkey < 50 THEN 'lines negative_number amount_mxn' END, CASE WHEN p_partkey % 7 > 0 AND p_partkey - 50 > 100 THEN 'lines amount_too_large amount_mxn' END,
  CASE WHEN p_partkey % 5 = 0 THEN 'positions label_missing title' END, CASE WHEN p_partkey % 2 = 1 THEN 'positions code_unknown area' END, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 2 = 1 THEN 'positions modality_unknown default_modality' END, CASE WHEN p_partkey < 10 THEN 'positions negative_number reference_pay_mxn' END, CASE WHEN p_partkey * 10 - 40 NOT BETWEEN 0 AND 10000 THEN 'positions negative_number authorized_seats' END]) AS x FROM part)
SELECT split_part(x, ' ', 1) AS list, split_part(x, ' ', 2) AS code, split_part(x, ' ', 3) AS field, count(*) AS rows FROM i WHERE x IS NOT NULL GROUP BY ALL
"""


_PROBLEMS = ["damp", "cracks", "electrical", "noise"]


def _spaces(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    n = k % 9 + 1
    return _t(spark, d, "part").select(k.alias("id"), (k % 20).alias("home"), (k % 50).alias("site_id"), _pick(["bathroom", "bedroom", "other", "odd"], k % 4).alias("kind"), F.lit(None).cast("string").alias("label"), n.alias("count"), F.when(k % 3 > 0, n - 1).alias("good"), F.lit(0).cast("long").alias("fair"), F.when(k % 5 == 0, F.lit(1)).cast("long").alias("poor"), F.lit(None).cast("long").alias("unusable"),
        (k % 4 - 1).alias("floor"), (k % 6 == 0).alias("grab_bars"), F.when(k % 4 == 1, k % 7).alias("beds"), F.when(k % 8 == 1, k % 9).alias("hospital_beds"), F.when(k % 7 > 0, k % 7 > 1).alias("accessible"), F.when(k % 3 == 0, F.array(_pick(_PROBLEMS, k % 4), F.when(k % 6 == 0, "rust").otherwise("damp"))).otherwise(F.array().cast("array<string>")).alias("problems"))


def space_issues(spark: SparkSession, d: str) -> DataFrame:
    rules = registers.spaces(["bathroom", "bedroom", "other"], _PROBLEMS, F.lit(2))
    return records.issues(_spaces(spark, d), "id", rules).groupBy("code", "field", "blocking").agg(F.count("*").alias("rows"))


_SPACES = """
WITH s AS (SELECT p_partkey AS k, p_partkey % 9 + 1 AS n, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 9 ELSE 0 END AS good, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS poor, CASE WHEN p_partkey % 4 = 1 THEN p_partkey % 7 END AS beds, CASE WHEN p_partkey % 8 = 1 THEN p_partkey % 9 END AS hospital, p_partkey % 4 - 1 AS floor FROM part)
"""
SPACE_ISSUES_SQL = (
    _SPACES
    + """, i AS (SELECT unnest([CASE WHEN k % 4 = 3 THEN 'code_unknown kind true' END, CASE WHEN k % 4 = 2 THEN 'label_missing label true' END, CASE WHEN good + poor > n THEN 'states_exceed_count states true' END, CASE WHEN good + poor < n THEN 'states_unchecked states false' END, CASE WHEN floor >= 2 THEN 'floor_above_building floor false' END,
  CASE WHEN k % 6 = 0 THEN 'code_unknown problems true' END, CASE WHEN hospital > beds THEN 'hospital_beds_exceed hospital_beds true' END, CASE WHEN k % 3 = 0 AND good + poor > 0 AND poor = 0 THEN 'problems_but_good problems false' END]) AS x FROM s)
SELECT split_part(x, ' ', 1) AS code, split_part(x, ' ', 2) AS field, split_part(x, ' ', 3) = 'true' AS blocking, count(*) AS rows FROM i WHERE x IS NOT NULL GROUP BY ALL
"""
)


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select((F.col("p_partkey") % 50).alias("site_id")).distinct().select("site_id", (F.col("site_id") % 20).alias("home"), F.when(F.col("site_id") % 3 > 0, F.col("site_id") * 10).alias("land_m2"), F.lit(None).cast("long").alias("built_m2"), (F.col("site_id") % 4).alias("floors"), F.lit("own").alias("tenure"),
        F.when(F.col("site_id") % 2 == 0, F.array(F.lit("none"))).otherwise(F.array(F.lit("ramp"))).alias("floor_access"), F.array(F.lit("well")).alias("water_sources"), F.lit(1).alias("extinguishers"), F.lit(None).cast("string").alias("internal_program"))


def facility_indicators(spark: SparkSession, d: str) -> DataFrame:
    spaces = _spaces(spark, d)
    things = spaces.withColumn("kind", F.when(F.col("id") % 10 == 3, "generator").otherwise("bed")).filter("home % 5 > 0")
    out = indicators.facilities(_sites(spark, d), spaces, things, "home").join(indicators.problems(spaces, "home", _PROBLEMS), "home", "left")
    told = F.array_join(F.transform("problems", lambda p: F.concat_ws(":", p["code"], p["n"].cast("string"))), " ")
    return out.withColumn("problems", told).withColumn("missing", F.array_join("missing", " "))


FACILITY_INDICATORS_SQL = (
    _SPACES
    + """, t AS (SELECT DISTINCT k % 50 AS site FROM s), w AS (SELECT site, site % 20 AS home, CASE WHEN site % 3 > 0 THEN site * 10 END AS land, site % 4 AS floors, site % 2 = 0 AND site % 4 > 1 AS stairs FROM t),
a AS (SELECT home, count(*) AS sites, CAST(sum(land) AS BIGINT) AS land_m2, CAST(NULL AS BIGINT) AS built_m2, max(floors) AS floors, bool_or(stairs) AS only_stairs FROM w GROUP BY home),
b AS (SELECT k % 20 AS home, CAST(sum(n) AS BIGINT) AS spaces, CAST(coalesce(sum(n) FILTER (stairs AND floor >= 1), 0) AS BIGINT) AS spaces_upstairs, CAST(coalesce(sum(n) FILTER (k % 4 = 0), 0) AS BIGINT) AS bathrooms, CAST(coalesce(sum(n) FILTER (k % 4 = 0 AND k % 6 > 0), 0) AS BIGINT) AS bathrooms_without_bars, CAST(sum(beds) AS BIGINT) AS beds, CAST(sum(hospital) AS BIGINT) AS hospital_beds,
  count(*) FILTER (k % 3 = 0 AND k % 4 IN (1, 2)) AS structural, count(*) FILTER (k % 7 = 1) AS not_accessible, count(*) FILTER (poor > 0) AS broken, CAST(sum(greatest(n - good - poor, 0)) AS BIGINT) AS spaces_unchecked FROM s JOIN w ON site = k % 50 GROUP BY 1),
e AS (SELECT k % 20 AS home, CAST(sum(n) AS BIGINT) AS equipment, count(*) FILTER (poor > 0) AS broken_equipment, bool_or(good > 0 OR good + poor < n) FILTER (k % 10 = 3) AS generator_works FROM s WHERE k % 20 % 5 > 0 GROUP BY 1),
q AS (SELECT home, code, count(*) AS n FROM (SELECT k % 20 AS home, unnest([['damp', 'cracks', 'electrical', 'noise'][k % 4 + 1], CASE WHEN k % 6 = 0 THEN 'rust' ELSE 'damp' END]) AS code FROM s WHERE k % 3 = 0) u GROUP BY ALL),
r AS (SELECT home, string_agg(code || ':' || n, ' ' ORDER BY n DESC, CASE code WHEN 'damp' THEN 1 WHEN 'cracks' THEN 2 WHEN 'electrical' THEN 3 WHEN 'noise' THEN 4 ELSE 5 END, code) AS problems FROM q GROUP BY home)
SELECT home, sites, land_m2, built_m2, floors, only_stairs, spaces, spaces_upstairs, bathrooms, bathrooms_without_bars, beds, hospital_beds, structural, not_accessible, broken, spaces_unchecked, coalesce(equipment, 0) AS equipment, coalesce(broken_equipment, 0) AS broken_equipment, generator_works, 'built_m2' || CASE WHEN spaces_unchecked > 0 THEN ' unchecked' ELSE '' END AS missing, problems
FROM a JOIN b USING (home) LEFT JOIN e USING (home) LEFT JOIN r USING (home)
"""
)


_CATALOG = {"rfc": "always", "oficio": "donee", "cluni": "cluni", "junta": "junta", "children": "minors_living", "beds": "housing", "land": "premises"}


def papers_summary(spark: SparkSession, d: str) -> DataFrame:
    """Papers that customers are asked for, and those on record by their orders."""
    k = F.col("c_custkey")
    who = _t(spark, d, "customer").select(k.alias("id"), _pick(["yes", " in_progress ", "no", None], k % 4).alias("authorized_donee"), F.lit("no").alias("cluni"), _pick(["iap", "ac"], k % 2).alias("legal_form"), F.array(_pick(["childhood", "older_adults"], k % 2)).alias("populations"), F.array(_pick(["residential", "outpatient", "remote"], k % 3)).alias("modalities"))
    o = F.col("o_orderkey")
    kept = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), _pick([*_CATALOG, "other"], o % 8).alias("kind")).agg(F.max("o_orderkey").alias("k"))
    kept = kept.select("id", "kind", _pick(["have", "in_progress", "not_applicable", "missing"], F.col("k") % 4).alias("status"), F.when(F.col("k") % 5 > 0, _on("2026-05-01", F.col("k") % 100)).otherwise("sin fecha").alias("valid_until"))
    return indicators.papers_summary(indicators.papers(who, _CATALOG, kept, _today()))


PAPERS_SUMMARY_SQL = f"""
WITH i AS (SELECT c_custkey AS id, unnest(list_filter(['rfc', CASE WHEN c_custkey % 4 < 2 THEN 'oficio' END, CASE WHEN c_custkey % 2 = 0 THEN 'junta' END, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'children' END, CASE WHEN c_custkey % 3 = 0 THEN 'beds' END, CASE WHEN c_custkey % 3 < 2 THEN 'land' END], lambda x: x IS NOT NULL)) AS kind FROM customer),
r AS (SELECT o_custkey AS id, ['rfc', 'oficio', 'cluni', 'junta', 'children', 'beds', 'land', 'other'][o_orderkey % 8 + 1] AS kind, max(o_orderkey) AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY ALL),
h AS (SELECT id, kind, ['have', 'in_progress', 'not_applicable', 'missing'][k % 4 + 1] AS status, CASE WHEN k % 5 > 0 THEN DATE '2026-05-01' + CAST(k % 100 AS INTEGER) END AS until FROM r),
b AS (SELECT coalesce(i.id, h.id) AS id, coalesce(i.kind, h.kind) AS kind, i.id IS NOT NULL OR h.kind = 'other' AS asked, coalesce(status, 'missing') AS status, until FROM i FULL JOIN h ON i.id = h.id AND i.kind = h.kind),
k AS (SELECT * FROM b WHERE (asked OR status IN ('have', 'in_progress')) AND status <> 'not_applicable')
SELECT id, count(*) AS expected, count(*) FILTER (status = 'have') AS have, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status NOT IN ('have', 'in_progress')) AS missing,
  count(*) FILTER (status = 'have' AND until BETWEEN DATE '{_DAY}' AND DATE '{_DAY}' + 30) AS expiring, count(*) FILTER (status = 'have' AND until < DATE '{_DAY}') AS expired FROM k GROUP BY id
"""


def boards(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), lambda c: F.when(c, F.col("c_custkey") % 97)
    rows = _t(spark, d, "customer").select(k.alias("id"), F.when(k % 3 > 0, k % 40).alias("served"), n(k % 5 > 0).alias("served_estimate"), n(k % 7 > 0).alias("last_year"), F.when(k % 6 > 0, k % 60).alias("capacity"), F.array(_pick(["residential", "remote"], k % 2)).alias("modalities"), (k % 4).alias("staff"), n(k % 8 > 3).alias("paid_estimate"), n(k % 8 > 5).alias("volunteer_estimate"))
    return indicators.overview(rows)


BOARDS_SQL = """
WITH c AS (SELECT c_custkey AS k, c_custkey % 97 AS n, c_custkey % 2 = 0 AS stays, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 40 ELSE 0 END AS served, CASE WHEN c_custkey % 6 > 0 AND c_custkey % 2 = 0 THEN c_custkey % 60 END AS cap, c_custkey % 4 AS staff FROM customer),
p AS (SELECT *, stays AND served = 0 AND k % 5 > 0 AS guess, CASE WHEN NOT stays THEN CASE WHEN k % 7 > 0 THEN n ELSE 0 END WHEN served = 0 AND k % 5 > 0 THEN n ELSE served END AS people, staff = 0 AND k % 8 > 3 AS guessed FROM c)
SELECT k AS id, people, guess AS people_approx, CASE WHEN stays THEN 'today' ELSE 'last_year' END AS period, cap AS capacity, CASE WHEN cap > 0 THEN least((people * 100 + cap // 2) // cap, 100) END AS occupied, greatest(cap - people, CASE WHEN cap IS NOT NULL THEN 0 END) AS vacant,
  CASE WHEN guessed THEN n + CASE WHEN k % 8 > 5 THEN n ELSE 0 END ELSE staff END AS staff, guessed AS staff_approx FROM p
"""


def profile_totals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    staff = _t(spark, d, "orders").select(F.col("o_custkey").alias("id"), (k % 3 + 1).alias("count"), (k % 4 > 0).alias("paid"), F.when(k % 6 > 0, F.col("o_totalprice").cast("long")).alias("monthly_salary_mxn"), _pick(["payroll", "fees", None], k % 3).alias("contract"), F.when(k % 5 > 0, k % 30 + 2000).alias("start_year"), _pick(["religious", "external", "trainee", None], F.floor(k / 4) % 4).alias("relation"))
    people = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50).alias("count"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 20).alias("paying_count"), F.lit(700).cast("long").alias("monthly_fee_mxn"))
    return indicators.profile_totals(staff, people, "id", 2026)


PROFILE_TOTALS_SQL = """
WITH o AS (SELECT o_custkey AS id, o_orderkey AS k, o_orderkey % 3 + 1 AS n, o_orderkey % 4 > 0 AS paid, CASE WHEN o_orderkey % 6 > 0 THEN CAST(trunc(o_totalprice) AS BIGINT) ELSE 0 END AS pay, CASE WHEN o_orderkey % 5 > 0 THEN 2026 - (o_orderkey % 30 + 2000) ELSE 1 END AS years, o_orderkey % 3 <> 1 AS keeps, CAST(floor(o_orderkey / 4) AS BIGINT) % 4 AS rel FROM orders),
v AS (SELECT *, CASE WHEN years < 1 THEN 0 WHEN years <= 5 THEN 10 + 2 * years ELSE 20 + 2 * (1 + (years - 6) // 5) END AS days FROM o),
s AS (SELECT id, CAST(coalesce(sum(n) FILTER (paid), 0) AS BIGINT) AS staff_paid, CAST(coalesce(sum(n) FILTER (NOT paid), 0) AS BIGINT) AS staff_volunteer, CAST(coalesce(sum(n * pay) FILTER (paid), 0) AS BIGINT) AS payroll_monthly,
  CAST(coalesce(sum(n * ((pay * 15 + 15) // 30 + (pay * days + 60) // 120)) FILTER (paid AND pay > 0 AND keeps), 0) AS BIGINT) AS benefits_annual, CAST(coalesce(sum(n) FILTER (paid AND pay > 0 AND keeps AND (k % 3 = 2 OR k % 5 = 0)), 0) AS BIGINT) AS benefits_assumed,
  CAST(coalesce(sum(n * pay * 12) FILTER (NOT paid AND rel IN (0, 2)), 0) AS BIGINT) AS support_annual, CAST(coalesce(sum(n * pay * 12) FILTER (NOT paid AND rel = 1), 0) AS BIGINT) AS external_annual FROM v GROUP BY id),
p AS (SELECT c_custkey AS id, c_custkey % 50 AS population, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 20 ELSE 0 END AS fee_payers FROM customer)
SELECT id, coalesce(staff_paid, 0) AS staff_paid, coalesce(staff_volunteer, 0) AS staff_volunteer, coalesce(payroll_monthly, 0) AS payroll_monthly, coalesce(benefits_annual, 0) AS benefits_annual, coalesce(benefits_assumed, 0) AS benefits_assumed, coalesce(support_annual, 0) AS support_annual, coalesce(external_annual, 0) AS external_annual,
  coalesce(population, 0) AS population, coalesce(fee_payers, 0) AS fee_payers, coalesce(fee_payers * 700, 0) AS fees_monthly, coalesce(payroll_monthly, 0) * 12 + coalesce(benefits_annual, 0) AS payroll_cost_annual, coalesce(fee_payers * 700 * 12, 0) AS fees_annual FROM s FULL JOIN p USING (id)
"""


def positions_held(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    jobs = _t(spark, d, "orders").select((k % 40).alias("position_id"), F.col("o_custkey").alias("person_id"), F.when(k % 3 == 0, "2024-01-01").alias("end_date"))
    people = _t(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), _pick(["active", "left", None], F.col("c_custkey") % 3).alias("status"), (F.col("c_custkey") % 5 == 0).alias("hidden"))
    return indicators.people_in_positions(jobs, people)


POSITIONS_HELD_SQL = "SELECT o_orderkey % 40 AS position_id, count(DISTINCT o_custkey) AS people FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 > 0 AND c_custkey % 3 <> 1 AND c_custkey % 5 > 0 GROUP BY 1"


def readings_agree(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").filter("o_orderkey % 11 > 0")
    first = o.filter("o_orderkey % 7 > 0").select(k.alias("id"), F.col("o_orderstatus").alias("state"), F.array("o_orderpriority", F.lit("a")).alias("quotes"))
    second = o.filter("o_orderkey % 5 > 0").select(k.alias("id"), F.when(k % 3 == 0, "F").otherwise(F.col("o_orderstatus")).alias("state"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("quotes"))
    told = indicators.agreement(first, second, ["id"])
    return told.select("fields", F.round("same_state", 6).alias("same_state"), F.round("overlap", 6).alias("overlap"))


READINGS_AGREE_SQL = """
WITH o AS (SELECT o_orderkey % 7 > 0 AS a, o_orderkey % 5 > 0 AS b, o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 11 > 0 AND (o_orderkey % 7 > 0 OR o_orderkey % 5 > 0))
SELECT count(*) AS fields, round(avg(CASE WHEN a AND b AND (k % 3 > 0 OR s = 'F') THEN 1.0 ELSE 0.0 END), 6) AS same_state, round(avg(CASE WHEN a AND b AND k % 2 = 0 THEN 1.0 / 3 WHEN NOT a AND k % 2 = 1 THEN 1.0 ELSE 0.0 END), 6) AS overlap FROM o
"""


def statements_merged(spark: SparkSession, d: str) -> DataFrame:
    """Two readings of customers: single values only where empty, lists grown by statements that are new."""
    k = F.col("c_custkey")
    first = _t(spark, d, "customer").filter("c_custkey % 5 > 0").select(k.alias("id"), F.when(k % 3 > 0, "uno").otherwise(" ").alias("name"), F.array(F.lit("Se paga en mayo"), F.concat(F.lit("Hasta "), (k % 4).cast("string"), F.lit(" meses"))).alias("terms"))
    second = _t(spark, d, "customer").filter("c_custkey % 7 > 0").select(k.alias("id"), F.lit("dos").alias("name"), F.array(F.lit("se PAGA, en mayo"), F.lit("Hasta 2 meses"), F.lit("Hay comedor")).alias("terms"))
    return provenance.merged(first, second, "id", ["terms"], ["name"]).select("id", "name", F.array_join("terms", "; ").alias("terms"))


STATEMENTS_MERGED_SQL = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 AND (c_custkey % 3 > 0 OR c_custkey % 7 = 0) THEN CASE WHEN c_custkey % 3 > 0 THEN 'uno' END ELSE 'dos' END AS name,
  array_to_string(list_filter([CASE WHEN c_custkey % 5 > 0 THEN 'Se paga en mayo' ELSE 'se PAGA, en mayo' END, CASE WHEN c_custkey % 5 > 0 THEN 'Hasta ' || c_custkey % 4 || ' meses' END, CASE WHEN c_custkey % 7 > 0 AND NOT (c_custkey % 5 > 0 AND c_custkey % 4 = 2) THEN 'Hasta 2 meses' END, CASE WHEN c_custkey % 7 > 0 THEN 'Hay comedor' END], lambda x: x IS NOT NULL), '; ') AS terms
FROM customer WHERE c_custkey % 5 > 0 OR c_custkey % 7 > 0
"""

QUERIES = {f.__name__: f for f in (care_indicators, care_summary, care_pyramid, population_lines, beneficiary_issues, admissions, waiting_issues, staff_issues, line_and_position_issues, space_issues, facility_indicators, papers_summary, boards, profile_totals, positions_held, readings_agree, statements_merged)}
ORACLES = {k.removesuffix("_SQL").lower(): v for k, v in dict(globals()).items() if k.endswith("_SQL")}
