"""Indicators of institutions: people in care, staff, places, papers and the figures of a board, for each of many at once.

Single figures are conditional aggregates of one pass; counts by code are rows, exploded before they are counted, so that
no institution's people are collected.  ``today`` is an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions.values import annual_benefits, date_valid, occupied, vacation_days, validity, years_between
from tesela.operators.records import is_filled
from tesela.operators.registers import STATES, age_band, checked, only_stairs, site_gaps

#: Who is served, smallest group that is told, age of a pension, records that count as incomplete.
SERVED, LEAST_GROUP, PENSION, HALF = ("active", "hospitalized"), 3, 65, 50
#: Which of what an institution says makes a paper apply to it.
MINORS, LODGING, PREMISES = ("early_childhood", "childhood", "adolescence"), ("residential", "day_care"), ("residential", "day_care", "outpatient")
UNDER_A_JUNTA = ("iap", "ibp", "abp")
#: Kinds of spaces with beds, problems of a building itself, relations that cost support or are external, contracts without benefits.
WITH_BEDS, STRUCTURAL, SUPPORT, EXTERNAL, NO_BENEFITS = ("bedroom", "infirmary"), ("cracks", "electrical"), ("religious", "trainee"), ("external",), ("fees",)


def served() -> Column:
    return F.coalesce(F.col("status").isin(*SERVED), F.lit(False))


def current(status: Column) -> Column:
    """Whether a person still works somewhere."""
    return F.coalesce(status != "left", F.lit(True))


def pays() -> Column:
    """Whether somebody pays a fee: one above zero, unless exempt."""
    return F.coalesce(F.col("monthly_fee_mxn") > 0, F.lit(False)) & F.coalesce(F.col("fee_payer") != "exempt", F.lit(True))


def age(today: Column) -> Column:
    born = F.when(date_valid(F.col("birth_date")), F.col("birth_date").try_cast("date"))
    return F.coalesce(years_between(born, today), F.col("approx_age"))


def _date(name: str) -> Column:
    return F.when(date_valid(F.col(name)), F.col(name))


def care(people: DataFrame, by: list[str], today: Column) -> DataFrame:
    """One row of figures an institution: who is served, ages and years, movements of the year, ties, fees and gaps.

    The latest movement is of the latest entry or discharge, an entry where they fall on one day.  Means are over those
    whose age or entry is known; the mean fee is over who pays, in whole units.
    """
    year = F.date_format(today, "yyyy")
    in_year = lambda name: F.coalesce(F.left(_date(name), F.lit(4)) == year, F.lit(False))
    rows = people.withColumn("_s", served()).withColumn("_age", age(today)).withColumn("_years", years_between(_date("entry_date").try_cast("date"), today)).withColumn("_pays", served() & pays())
    s, n = F.col("_s"), F.count_if
    last_in, last_out = F.max(_date("entry_date")), F.max(F.when(F.col("status") == "discharged", _date("status_date")))
    lists = lambda name: F.coalesce(F.size(name) > 0, F.lit(False))
    out = rows.groupBy(*by).agg(
        n(s).alias("served"),
        n(F.col("status") == "hospitalized").alias("hospitalized"),
        n(s & F.col("_age").isNull()).alias("without_age"),
        F.avg(F.when(s, F.col("_age"))).alias("average_age"),
        F.avg(F.when(s, F.col("_years"))).alias("average_years"),
        n(in_year("entry_date")).alias("admitted_this_year"),
        n((F.col("status") == "discharged") & in_year("status_date")).alias("discharged_this_year"),
        n((F.col("status") == "deceased") & in_year("status_date")).alias("deceased_this_year"),
        F.when(last_out > last_in, "discharged").when(last_in.isNotNull(), "admitted").when(last_out.isNotNull(), "discharged").alias("latest_movement"),
        n(s & F.col("visits").isin("rarely", "never")).alias("few_visits"),
        n(s & ~F.coalesce(F.exists("contacts", lambda c: is_filled(c)), F.lit(False))).alias("without_contact"),
        n(s & lists("programs")).alias("with_program"),
        n(s & ~lists("programs") & (F.col("_age") >= PENSION)).alias("elderly_without_program"),
        n(s & (F.col("fee_payer") == "exempt")).alias("exempt"),
        n("_pays").alias("paying"),
        F.coalesce(F.sum(F.when(F.col("_pays"), F.col("monthly_fee_mxn"))), F.lit(0)).cast("long").alias("fees_monthly"),
        n(s & ~is_filled(F.col("consent_date"))).alias("without_consent"),
        n(s & is_filled(F.col("indigenous_language"))).alias("indigenous_language"),
        n(s & F.col("attends_school")).alias("attending_school"),
        n(s & F.col("school_lag")).alias("school_lag"),
        n(s & (F.col("progress") < HALF)).alias("incomplete"),
    )
    return out.withColumn("average_fee", F.when(F.col("paying") > 0, F.floor(F.col("fees_monthly") / F.col("paying"))).cast("long"))


def care_counts(people: DataFrame, by: list[str], codes: list[str], lists: list[str]) -> DataFrame:
    """``by``, what, code and n: people served by each code of some columns and of some columns that hold lists."""
    one = [F.struct(F.lit(c).alias("what"), F.array(F.col(c)).alias("codes")) for c in codes]
    many = [F.struct(F.lit(c).alias("what"), F.col(c).alias("codes")) for c in lists]
    told = people.filter(served()).select(*by, F.explode(F.array(*one, *many)).alias("x")).select(*by, "x.what", F.explode("x.codes").alias("code"))
    return told.filter(F.col("code").isNotNull()).groupBy(*by, "what", "code").agg(F.count("*").alias("n"))


def pyramid(people: DataFrame, by: list[str], kind: str, today: Column) -> DataFrame:
    """``by``, band, sex and n of the people served whose sex and age are known."""
    told = people.filter(served()).select(*by, age_band(kind, age(today)).alias("band"), "sex").filter("band <> 'unknown' and sex is not null")
    return told.groupBy(*by, "band", "sex").agg(F.count("*").alias("n"))


def safe_summary(figures: DataFrame, counts: DataFrame, by: list[str], least: int = LEAST_GROUP) -> DataFrame:
    """What may be told to others: who is served, the mean age in whole years, and counts of groups that hide nobody.

    Neither money nor the state of records is told.  ``groups`` is sorted by what and code, empty where none is large enough.
    """
    kept = counts.filter(F.col("n") >= least).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("what", "code", "n"))).alias("groups"))
    told = figures.select(*by, "served", F.floor(F.col("average_age") + 0.5).alias("average_age"), "admitted_this_year", "discharged_this_year", "latest_movement")
    none = F.array().cast("array<struct<what:string,code:string,n:bigint>>")
    return told.join(kept, by, "left").withColumn("groups", F.coalesce("groups", none))


def staff_lines(people: DataFrame, keys: list[str]) -> DataFrame:
    """Working people by the combination of ``keys``, nulls being a group."""
    return people.filter(current(F.col("status"))).groupBy(*keys).agg(F.count("*").alias("count"))


def people_in_positions(jobs: DataFrame, people: DataFrame) -> DataFrame:
    """position_id and people: jobs that go on, of people who neither left nor are hidden."""
    here = people.filter(current(F.col("status")) & ~F.coalesce("hidden", F.lit(False))).select("person_id")
    return jobs.filter(F.col("end_date").isNull()).join(here, "person_id", "left_semi").groupBy("position_id").agg(F.countDistinct("person_id").alias("people"))


def facilities(sites: DataFrame, spaces: DataFrame, equipment: DataFrame, by: str) -> DataFrame:
    """One row of figures an institution (``by``) over its sites, groups of spaces and groups of equipment.

    A sum of what is known is null where nothing is; a generator works if one is good or fair or wasn't looked at.
    """
    stairs = sites.groupBy(by).agg(
        F.count("*").alias("sites"), F.sum("land_m2").alias("land_m2"), F.sum("built_m2").alias("built_m2"), F.max("floors").alias("floors"), F.bool_or(only_stairs()).alias("only_stairs"),
        F.min_by(site_gaps(), "site_id").alias("gaps"),
    )
    upstairs = sites.select("site_id", only_stairs().alias("_stairs"))
    bath, bad = F.col("kind") == "bathroom", F.coalesce(F.col("poor"), F.lit(0)) + F.coalesce(F.col("unusable"), F.lit(0))
    left = F.greatest(F.col("count") - checked(), F.lit(0))
    told = spaces.join(upstairs, "site_id", "left").groupBy(by).agg(
        F.sum("count").alias("spaces"),
        F.coalesce(F.sum(F.when(F.col("_stairs") & (F.col("floor") >= 1), F.col("count"))), F.lit(0)).alias("spaces_upstairs"),
        F.coalesce(F.sum(F.when(bath, F.col("count"))), F.lit(0)).alias("bathrooms"),
        F.coalesce(F.sum(F.when(bath & ~F.col("grab_bars"), F.col("count"))), F.lit(0)).alias("bathrooms_without_bars"),
        F.sum(F.when(F.col("kind").isin(*WITH_BEDS), F.col("beds"))).alias("beds"),
        F.sum(F.when(F.col("kind").isin(*WITH_BEDS), F.col("hospital_beds"))).alias("hospital_beds"),
        F.count_if(F.arrays_overlap("problems", F.array(*map(F.lit, STRUCTURAL)))).alias("structural"),
        F.count_if(~F.col("accessible")).alias("not_accessible"),
        F.count_if(bad > 0).alias("broken"),
        F.sum(left).alias("spaces_unchecked"),
    )
    generator = F.col("kind") == "generator"
    runs = (F.coalesce(F.col("good"), F.lit(0)) + F.coalesce(F.col("fair"), F.lit(0)) > 0) | (checked() < F.col("count"))
    things = equipment.groupBy(by).agg(F.sum("count").alias("equipment"), F.count_if(bad > 0).alias("broken_equipment"), F.bool_or(F.when(generator, runs)).alias("generator_works"))
    out = stairs.join(told, by, "left").join(things, by, "left")
    lacks = F.when(F.col("spaces").isNull(), F.array(F.lit("spaces"))).when(F.col("spaces_unchecked") > 0, F.array(F.lit("unchecked"))).otherwise(F.array().cast("array<string>"))
    zero = ["spaces", "spaces_upstairs", "bathrooms", "bathrooms_without_bars", "structural", "not_accessible", "broken", "spaces_unchecked", "equipment", "broken_equipment"]
    return out.withColumn("missing", F.concat("gaps", lacks)).drop("gaps").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def problems(spaces: DataFrame, by: str, catalog: list[str]) -> DataFrame:
    """``by`` and problems: (code, n) by frequency, equal ones in catalog order, what is in no catalog last."""
    n = spaces.select(by, F.explode("problems").alias("code")).groupBy(by, "code").agg(F.count("*").alias("n"))
    at = F.array_position(F.array(*map(F.lit, catalog)), F.col("code"))
    placed = n.withColumn("at", F.when(at > 0, at).otherwise(len(catalog) + 1))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "at", "code")))
    return placed.groupBy(by).agg(F.transform(rows, lambda r: F.struct(r["code"].alias("code"), (-r["less"]).alias("n"))).alias("problems"))


def applies(rule: Column) -> Column:
    """Whether a paper of the catalog applies to an institution (authorized_donee, cluni, legal_form, populations, modalities)."""
    by = lambda ways: F.coalesce(F.arrays_overlap("modalities", F.array(*map(F.lit, ways))), F.lit(False))
    under_way = lambda c: F.coalesce(F.trim(c).isin("yes", "in_progress"), F.lit(False))
    minors = F.coalesce(F.arrays_overlap("populations", F.array(*map(F.lit, MINORS))), F.lit(False))
    cases = {"donee": under_way("authorized_donee"), "cluni": under_way("cluni"), "junta": F.coalesce(F.trim("legal_form").isin(*UNDER_A_JUNTA), F.lit(False)), "minors_living": minors & by(("residential",)), "housing": by(LODGING), "premises": by(PREMISES)}
    out = rule == "always"
    for name, holds in cases.items():
        out = out | ((rule == name) & holds)
    return out


def papers(institutions: DataFrame, catalog: dict[str, str], records: DataFrame, today: Column, other: str = "other") -> DataFrame:
    """id, kind, status and validity of the papers an institution is asked for: those of the catalog (kind to rule) that apply,
    those it has or is getting though they don't, and those it named itself (``records``: id, kind, status, valid_until).

    The catalog is a literal, as long as its kinds; records are joined by institution and kind.
    """
    asked = institutions.withColumn("c", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("rule")) for k, r in catalog.items()])))
    asked = asked.select("id", "c.kind", applies(F.col("c.rule")).alias("applies"))
    held = records.filter(F.col("kind") != other).select("id", "kind", "status", "valid_until")
    both = asked.join(held, ["id", "kind"], "left").filter("applies or status in ('have', 'in_progress')").withColumn("status", F.coalesce("status", F.lit("missing")))
    own = records.filter(F.col("kind") == other).join(institutions.select("id"), "id", "left_semi").select("id", "kind", "status", "valid_until")
    every = both.select("id", "kind", "status", "valid_until").unionByName(own)
    return every.withColumn("validity", validity(F.col("status"), F.when(date_valid(F.col("valid_until")), F.col("valid_until").try_cast("date")), today))


def papers_summary(told: DataFrame) -> DataFrame:
    """id and how many papers are expected, held, on their way, missing, expiring and expired; what applies to nobody is none."""
    asked = told.filter(F.coalesce(F.col("status") != "not_applicable", F.lit(True)))
    n = F.count_if
    return asked.groupBy("id").agg(
        F.count("*").alias("expected"), n(F.col("status") == "have").alias("have"), n(F.col("status") == "in_progress").alias("in_progress"), n(~F.coalesce(F.col("status").isin("have", "in_progress"), F.lit(False))).alias("missing"),
        n(F.col("validity") == "expiring").alias("expiring"), n(F.col("validity") == "expired").alias("expired"),
    )


def figure(records: Column, estimate: Column) -> tuple[Column, Column]:
    """A figure and whether it is approximate: records win, an estimate stands in while there are none."""
    stands_in = estimate.isNotNull() & (records == 0)
    return F.when(stands_in, estimate).otherwise(records), stands_in


def overview(rows: DataFrame) -> DataFrame:
    """The board of each institution: people, how full its places are, staff; of ``rows`` (id, served, served_estimate, last_year,
    capacity, modalities, staff, paid_estimate, volunteer_estimate).

    Where people stay, those there today; elsewhere those of the last year, without a capacity.
    """
    lodging = F.coalesce(F.arrays_overlap("modalities", F.array(*map(F.lit, LODGING))), F.lit(False))
    today, approx = figure(F.coalesce("served", F.lit(0)), F.col("served_estimate"))
    people = F.when(lodging, today).otherwise(F.coalesce("last_year", F.lit(0)))
    capacity = F.when(lodging, F.col("capacity"))
    guess = F.when(F.col("paid_estimate").isNotNull() | F.col("volunteer_estimate").isNotNull(), F.coalesce("paid_estimate", F.lit(0)) + F.coalesce("volunteer_estimate", F.lit(0)))
    staff, guessed = figure(F.coalesce("staff", F.lit(0)), guess)
    return rows.select(
        "id", people.alias("people"), (lodging & approx).alias("people_approx"), F.when(lodging, "today").otherwise("last_year").alias("period"), capacity.alias("capacity"),
        occupied(F.greatest(people, F.lit(0)), capacity).alias("occupied"), F.greatest(capacity - people, F.when(capacity.isNotNull(), F.lit(0))).alias("vacant"), staff.alias("staff"), guessed.alias("staff_approx"),
    )


def profile_totals(staff: DataFrame, population: DataFrame, by: str, year: int) -> DataFrame:
    """Payroll, benefits, support and fees of each profile from its lines of staff and of people served.

    A paid line without a contract that has none has benefits; without a year of start it counts as one year's.
    """
    pay, count = F.coalesce("monthly_salary_mxn", F.lit(0)), F.col("count")
    paid = F.coalesce("paid", F.lit(False))
    years = F.coalesce(F.lit(year) - F.col("start_year"), F.lit(1))
    earns = paid & (pay > 0) & ~F.coalesce(F.col("contract").isin(*NO_BENEFITS), F.lit(False))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    unpaid = lambda relations: zero(F.when(~paid & F.col("relation").isin(*relations), count * pay * 12))
    s = staff.groupBy(by).agg(
        zero(F.when(paid, count)).alias("staff_paid"), zero(F.when(~paid, count)).alias("staff_volunteer"), zero(F.when(paid, count * pay)).alias("payroll_monthly"),
        zero(F.when(earns, count * annual_benefits(pay, vacation_days(years)))).alias("benefits_annual"), zero(F.when(earns & (F.col("contract").isNull() | F.col("start_year").isNull()), count)).alias("benefits_assumed"),
        unpaid(SUPPORT).alias("support_annual"), unpaid(EXTERNAL).alias("external_annual"),
    )
    p = population.groupBy(by).agg(zero("count").alias("population"), zero("paying_count").alias("fee_payers"), zero(F.coalesce("paying_count", F.lit(0)) * F.coalesce("monthly_fee_mxn", F.lit(0))).alias("fees_monthly"))
    out = s.join(p, by, "full")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in out.columns if c != by})
    return out.withColumn("payroll_cost_annual", F.col("payroll_monthly") * 12 + F.col("benefits_annual")).withColumn("fees_annual", F.col("fees_monthly") * 12)


def population_by_label(population: DataFrame, by: str, order: str) -> DataFrame:
    """``by``, label, people and place: groups of one label added up, in the order in which they first come."""
    return population.groupBy(by, "label").agg(F.sum("count").alias("people"), F.min(order).alias("place"))


def confirmed_days(moment: Column, now: Column) -> Column:
    """Whole days since something was confirmed, by the hours between and not by midnights."""
    return F.floor((F.unix_seconds(now) - F.unix_seconds(moment)) / 86_400).cast("long")


def agreement(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """How alike two readings (key, state, quotes) are: the share of equal states and the mean overlap of quotes.

    A field that only one reading has is a difference; two readings without quotes overlap wholly.
    """
    none = F.array().cast("array<string>")
    both = first.select(*key, F.col("state").alias("a"), F.col("quotes").alias("qa")).join(second.select(*key, F.col("state").alias("b"), F.col("quotes").alias("qb")), key, "full")
    qa, qb = F.coalesce("qa", none), F.coalesce("qb", none)
    all_ = F.size(F.array_union(qa, qb))
    overlap = F.when(all_ == 0, 1.0).otherwise(F.size(F.array_intersect(qa, qb)) / all_)
    return both.agg(F.count("*").alias("fields"), F.avg(F.coalesce(F.col("a") == F.col("b"), F.lit(False)).cast("double")).alias("same_state"), F.avg(overlap).alias("overlap"))


def states_of(groups: DataFrame, by: str) -> DataFrame:
    """The sums of each state of an institution's groups."""
    return groups.groupBy(by).agg(*[F.sum(F.coalesce(F.col(s), F.lit(0))).alias(s) for s in STATES])
