"""Registers of an institution: rules for people, groups of things, waiting lists and money lines, and their roll-ups.

A set of rules is a list for :func:`tesela.operators.records.issues`: (code, field, blocking, condition that breaks it).
Catalogs of codes are arguments.  A null means "not known" and breaks no rule but those that ask for a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions.checks import compact, curp_birth, curp_valid, rfc_valid
from tesela.functions.values import date_valid, years_between
from tesela.operators.records import is_filled

Rule = tuple[str, str, bool, Column]
#: Limits of amounts, counts, floors and ages.
MOST_MONEY, MOST_COUNT, FLOORS, AGES, WORKING_AGES = 100_000_000_000, 1_000, (-1, 19), (0, 120), (14, 100)
STATES = ("good", "fair", "poor", "unusable")


def _day(name: str) -> Column:
    return F.when(date_valid(F.col(name)), F.col(name).try_cast("date"))


def codes(catalogs: dict[str, list[str]]) -> list[Rule]:
    """A code, when one is written, is one of its catalog."""
    return [("code_unknown", f, True, is_filled(F.col(f)) & ~F.col(f).isin(known)) for f, known in catalogs.items()]


def code_lists(catalogs: dict[str, list[str]]) -> list[Rule]:
    return [("code_unknown", f, True, F.size(F.array_except(f, F.array(*map(F.lit, known)).cast("array<string>"))) > 0) for f, known in catalogs.items()]


def dates(fields: list[str]) -> list[Rule]:
    return [("date_invalid", f, True, is_filled(F.col(f)) & ~date_valid(F.col(f))) for f in fields]


def money(field: str) -> list[Rule]:
    return [("negative_number", field, True, F.col(field) < 0), ("amount_too_large", field, True, F.col(field) > MOST_MONEY)]


def _curp_rules(approximate: Column) -> list[Rule]:
    b, told, born = F.col("curp"), curp_birth(F.col("curp")), _day("birth_date")
    same = (told["year"] == F.year(born) % 100) & (told["month"] == F.month(born)) & (told["day"] == F.dayofmonth(born))
    return [
        ("curp_invalid", "curp", True, is_filled(b) & ~curp_valid(b)),
        ("curp_birth_mismatch", "curp", False, is_filled(b) & curp_valid(b) & ~same & ~F.coalesce(approximate, F.lit(False))),
    ]


def beneficiary(today: Column, catalogs: dict[str, list[str]], lists: dict[str, list[str]], youngest: int | None = None, oldest: int | None = None) -> list[Rule]:
    """People in care; ``youngest`` and ``oldest`` are the usual ages of the institution's kind."""
    born, entered = _day("birth_date"), _day("entry_date")
    age = F.coalesce(years_between(born, today), F.col("approx_age"))
    unusual = F.lit(False)
    unusual = unusual | (age < youngest) if youngest is not None else unusual
    unusual = unusual | (age > oldest) if oldest is not None else unusual
    return [
        ("name_missing", "first_names", True, ~is_filled(F.col("first_names"))),
        ("birth_missing", "birth_date", True, ~is_filled(F.col("birth_date")) & F.col("approx_age").isNull()),
        ("age_invalid", "approx_age", True, ~F.col("approx_age").between(*AGES)),
        *codes(catalogs),
        *code_lists(lists),
        *dates(["birth_date", "entry_date", "status_date", "consent_date"]),
        ("entry_before_birth", "entry_date", True, entered < born),
        ("birth_in_future", "birth_date", True, born > today),
        ("age_unusual", "birth_date", False, unusual),
        *_curp_rules(F.col("birth_date_approx")),
        *money("monthly_fee_mxn"),
        ("exempt_with_fee", "monthly_fee_mxn", False, (F.col("fee_payer") == "exempt") & (F.col("monthly_fee_mxn") > 0)),
        ("status_date_missing", "status_date", False, F.col("status").isin("discharged", "deceased") & ~is_filled(F.col("status_date"))),
        ("discharge_reason_missing", "discharge_reason", False, (F.col("status") == "discharged") & ~is_filled(F.col("discharge_reason"))),
    ]


def staff(today: Column, catalogs: dict[str, list[str]], lists: dict[str, list[str]]) -> list[Rule]:
    """Working people: names, position, dates, ages, and identifiers that must tell the same."""
    born, rfc, curp = _day("birth_date"), F.col("rfc"), F.col("curp")
    return [
        ("name_missing", "first_names", True, ~is_filled(F.col("first_names"))),
        ("position_missing", "position_id", True, ~is_filled(F.col("position_id"))),
        *codes(catalogs),
        *code_lists(lists),
        *dates(["birth_date", "start_date", "end_date", "left_date"]),
        ("end_before_start", "end_date", True, _day("end_date") < _day("start_date")),
        ("age_out_of_range", "birth_date", False, ~F.coalesce(years_between(born, today), F.lit(-1)).between(*WORKING_AGES) & born.isNotNull()),
        *_curp_rules(F.lit(False)),
        ("rfc_invalid", "rfc", True, is_filled(rfc) & ~rfc_valid(rfc)),
        ("rfc_curp_mismatch", "rfc", False, is_filled(rfc) & rfc_valid(rfc) & curp_valid(curp) & (F.left(compact(rfc), F.lit(10)) != F.left(compact(curp), F.lit(10)))),
    ]


def waiting(catalogs: dict[str, list[str]], statuses: list[str]) -> list[Rule]:
    """The waiting list; a phone has ten digits, or twelve with the country's."""
    digits = F.regexp_replace("phone", "[^0-9]", "")
    return [
        ("date_invalid", "requested_on", True, ~date_valid(F.coalesce("requested_on", F.lit("")))),
        *codes(catalogs),
        ("code_unknown", "status", True, ~F.coalesce(F.col("status").isin(statuses), F.lit(False))),
        ("age_invalid", "approx_age", True, ~F.col("approx_age").between(*AGES)),
        ("phone_invalid", "phone", True, is_filled(F.col("phone")) & ~digits.rlike("^([0-9]{10}|52[0-9]{10})$")),
    ]


def checked() -> Column:
    """How many things of a group have a known state; unknown ones count as none."""
    return sum((F.coalesce(F.col(s), F.lit(0)) for s in STATES[1:]), F.coalesce(F.col(STATES[0]), F.lit(0)))


def things(kinds: list[str]) -> list[Rule]:
    """Groups of spaces or equipment: kind, label, count and the states of what they count."""
    n = F.col("count")
    return [
        ("code_unknown", "kind", True, ~F.coalesce(F.col("kind").isin(kinds), F.lit(False))),
        ("label_missing", "label", True, (F.col("kind") == "other") & ~is_filled(F.col("label"))),
        ("count_invalid", "count", True, n < 1),
        ("number_too_large", "count", True, n > MOST_COUNT),
        *[("negative_number", s, True, F.col(s) < 0) for s in STATES],
        ("states_exceed_count", "states", True, (n >= 1) & (checked() > n)),
        ("states_unchecked", "states", False, (n >= 1) & (checked() >= 0) & (checked() < n)),
    ]


def spaces(kinds: list[str], problems: list[str], floors: Column) -> list[Rule]:
    """:func:`things` with floors (of the building, null if unknown), problems and beds."""
    floor, bad = F.col("floor"), sum((F.coalesce(F.col(s), F.lit(0)) for s in STATES[2:]), F.coalesce(F.col("fair"), F.lit(0)))
    beds = [r for f in ("beds", "hospital_beds") for r in (("negative_number", f, True, F.col(f) < 0), ("number_too_large", f, True, F.col(f) > 10 * MOST_COUNT))]
    return [
        *things(kinds),
        ("floor_invalid", "floor", True, ~floor.between(*FLOORS)),
        ("floor_above_building", "floor", False, floor.between(*FLOORS) & (floor >= floors)),
        *code_lists({"problems": problems}),
        *beds,
        ("hospital_beds_exceed", "hospital_beds", True, F.col("hospital_beds") > F.col("beds")),
        ("problems_but_good", "problems", False, (F.size("problems") > 0) & (checked() > 0) & (bad == 0)),
    ]


def lines() -> list[Rule]:
    """Lines of income or expense: a label, and an amount that is neither negative nor beyond reason."""
    return [("label_missing", "label", True, ~is_filled(F.col("label"))), *money("amount_mxn")]


#: Limits of places, and the holdings that come to an end.
MOST_M2, MOST_LITRES, OLDEST_YEAR, ENDING = 1_000_000, 10_000_000, 1500, ["loan", "rent"]


def position(catalogs: dict[str, list[str]], modalities: list[str]) -> list[Rule]:
    """Positions: a title, known codes, a pay and a number of seats within their limits."""
    kind = F.col("default_modality")
    return [
        ("label_missing", "title", True, ~is_filled(F.col("title"))),
        *codes(catalogs),
        ("modality_unknown", "default_modality", True, is_filled(kind) & ~kind.isin(modalities)),
        *money("reference_pay_mxn"),
        ("negative_number", "authorized_seats", True, ~F.col("authorized_seats").between(0, 10_000)),
    ]


def site(year: int, catalogs: dict[str, list[str]], lists: dict[str, list[str]]) -> list[Rule]:
    """Buildings; ``year`` is the current one.  Problems block, what does not add up is a heads-up."""
    c = F.col
    sized = [("land_m2", MOST_M2), ("built_m2", MOST_M2), ("water_storage_liters", MOST_LITRES), *[(f, MOST_COUNT) for f in ("extinguishers", "smoke_detectors", "drills_per_year")]]
    rules = [("label_missing", "name", True, ~is_filled(c("name")))]
    for field, most in sized:
        rules += [("negative_number", field, True, c(field) < 0), ("number_too_large", field, True, c(field) > most)]
    rules += [("number_invalid", f, True, c(f) == 0) for f in ("land_m2", "built_m2")]
    rules += [("floors_invalid", "floors", True, ~c("floors").between(1, FLOORS[1] + 1))]
    rules += [("year_invalid", f, True, ~c(f).between(OLDEST_YEAR, last)) for f, last in (("built_year", year), ("opinion_year", year), ("tenure_until", year + 199))]
    ends = F.coalesce(c("tenure").isin(ENDING), F.lit(False))
    return [
        *rules, *codes(catalogs), *code_lists(lists),
        ("built_exceeds_land", "built_m2", False, (c("land_m2") > 0) & (c("built_m2") > c("land_m2") * c("floors"))),
        ("tenure_expired", "tenure_until", False, ends & (c("tenure_until") < year)),
        ("tenure_until_missing", "tenure_until", False, ends & c("tenure_until").isNull()),
        ("opinion_year_missing", "opinion_year", False, c("civil_protection_opinion") & c("opinion_year").isNull()),
    ]


def site_gaps() -> Column:
    """The key data a building still lacks, as codes."""
    none = lambda name: F.coalesce(F.size(name) == 0, F.lit(True))
    lacks = [("built_m2", F.col("built_m2").isNull()), ("floors", F.col("floors").isNull()), ("tenure", F.col("tenure").isNull()), ("water", none("water_sources")),
        ("safety", F.col("extinguishers").isNull() & F.col("internal_program").isNull())]
    return F.array_compact(F.array(*[F.when(missing, code) for code, missing in lacks]))


def only_stairs() -> Column:
    return F.coalesce((F.col("floors") > 1) & (F.size("floor_access") == 1) & F.array_contains("floor_access", "none"), F.lit(False))


#: The first age of each band after the lowest, by kind of institution.
BANDS = {"elderly": [60, 70, 80, 90], "children": [6, 12, 18], "other": [18, 60]}


def age_band(kind: str, age: Column) -> Column:
    """The band of an age: ``under_60`` or ``0_5``, ``60_69``, ``90_plus``; unknown without an age, below 0 and above 200."""
    firsts = BANDS[kind]
    low = f"under_{firsts[0]}" if kind == "elderly" else f"0_{firsts[0] - 1}"
    out = F.when(age.isNull() | ~age.between(0, 200), "unknown").when(age < firsts[0], low)
    for first, after in zip(firsts, firsts[1:], strict=False):
        out = out.when(age < after, f"{first}_{after - 1}")
    return out.otherwise(f"{firsts[-1]}_plus")


def admitted(waiting: DataFrame, admissions: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """People made from entries of a waiting list that still wait, with an age, and the list with those admitted.

    ``admissions`` holds ``entry_id``; an entry asked for twice is admitted once, one without an age or no longer waiting
    stays as it is.
    """
    asked = admissions.select("entry_id").distinct().withColumn("_asked", F.lit(True))
    told = waiting.join(asked, "entry_id", "left")
    goes = F.col("_asked").isNotNull() & (F.col("status") == "waiting") & F.col("approx_age").isNotNull()
    people = told.filter(goes).select(F.col("entry_id").alias("from_entry"), "name", "approx_age", F.lit("active").alias("status"), today.alias("entry_date"))
    return people, told.withColumn("status", F.when(goes, "admitted").otherwise(F.col("status"))).drop("_asked")


def totals_by_kind(groups: DataFrame, by: list[str]) -> DataFrame:
    """Counts, states and what nobody checked, of each kind."""
    left = F.greatest(F.col("count") - checked(), F.lit(0))
    return groups.groupBy(*by).agg(F.sum("count").alias("count"), *[F.sum(F.coalesce(F.col(s), F.lit(0))).alias(s) for s in STATES], F.sum(left).alias("unchecked"))


def population_lines(people: DataFrame, keys: list[str], age: Column, pays: Column) -> DataFrame:
    """People of each combination of ``keys`` (nulls are a group), how many pay, and their youngest and oldest."""
    return people.groupBy(*keys).agg(F.count("*").alias("people"), F.count_if(pays).alias("paying"), F.min(age).alias("youngest"), F.max(age).alias("oldest"))


def position_summary(positions: DataFrame, people: DataFrame) -> DataFrame:
    """position_id, people, seats and vacancies of positions that hold somebody or have seats.

    ``people`` (position_id, current) is counted before the join, so a position that holds most people is one row there.
    """
    held = people.filter(F.col("current")).groupBy("position_id").agg(F.count("*").alias("people"))
    out = positions.join(held, "position_id", "left").withColumn("people", F.coalesce("people", F.lit(0)))
    seats = F.when(F.col("authorized_seats") > 0, F.col("authorized_seats"))
    out = out.withColumn("seats", seats).filter((F.col("people") > 0) | F.col("seats").isNotNull())
    return out.select("position_id", "people", "seats", F.coalesce(F.greatest(F.col("seats") - F.col("people"), F.lit(0)), F.lit(0)).alias("vacancies"))


def annual() -> Column:
    return F.col("amount_mxn") * F.when(F.col("period") == "monthly", 12).otherwise(1)


#: Kinds of income that come whatever happens; fees counted from people are always among them.
FIXED_INCOME = ("fee_estimate", "recurring_donor")


def finance(base: DataFrame, income: DataFrame, expense: DataFrame) -> DataFrame:
    """Income, expenses and balance of a year for each institution.

    ``base`` has id, fees, payroll, support, external (from people, whole years) and budget (null if nobody knows);
    ``income`` and ``expense`` have id, amount_mxn (null: not known) and period, ``income`` also kind.  An estimate of
    fees is left out where people's fees are known.  Expenses are the list's with what people cost, else the budget,
    else unknown; a balance needs both sides.
    """
    estimate, amount = F.col("kind") == "fee_estimate", F.col("amount")
    told = income.select("id", "kind", annual().alias("amount"))
    i = told.groupBy("id").agg(
        F.sum(F.when(~estimate, amount)).alias("others"), F.sum(F.when(estimate, amount)).alias("estimate"), F.sum(F.when(F.col("kind").isin(*FIXED_INCOME) & ~estimate, amount)).alias("regular")
    )
    e = expense.select("id", annual().alias("amount")).groupBy("id").agg(F.count("*").alias("lines"), F.sum("amount").alias("spent"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    has_fees = zero("fees") > 0
    fee = F.when(has_fees, F.col("fees")).otherwise(F.col("estimate"))
    out = base.join(i, "id", "left").join(e, "id", "left").withColumn("fee", fee)
    out = out.withColumn("basis", F.when(F.col("lines") > 0, "list").when(F.col("budget").isNotNull(), "estimate").otherwise("unknown"))
    out = out.withColumn("income_known", F.col("fee").isNotNull() | F.col("others").isNotNull())
    out = out.withColumn("income", zero("fee") + zero("others")).withColumn("income_fixed", zero("fee") + zero("regular"))
    cost = F.when(F.col("basis") == "list", zero("spent") + sum((F.greatest(zero(c), F.lit(0)) for c in ("support", "external")), F.greatest(zero("payroll"), F.lit(0)))).otherwise(F.col("budget"))
    out = out.withColumn("expenses", cost)
    return out.select("id", "income", "income_fixed", (F.col("income") - F.col("income_fixed")).alias("income_variable"), "basis", "expenses", F.when(F.col("income_known"), F.col("income") - F.col("expenses")).alias("balance"))
