"""Findings about institutions by fixed rules over their figures, each with its numbers and whether others may be told.

A rule is data: a code, when it holds, its numbers, what goes with it, and when it may be told.  All rules of a board are
one expression over one row an institution, to which :func:`context` joins what the modules counted.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions.values import monthly_cost_each
from tesela.operators import personal, scanner
from tesela.operators.indicators import LEAST_GROUP

#: Percent from which places are full, years before a loan's end that are told.
FULL, ENDING_YEARS = 95, 5


@dataclass(frozen=True)
class Rule:
    code: str
    holds: Column
    numbers: dict[str, Column] = field(default_factory=dict)
    items: Column | None = None
    tell: Column | None = None  # None: it may be told


def context(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """What several modules counted, one row each an institution, side by side; nothing where a module has no row."""
    return reduce(lambda a, b: a.join(b, key, "full"), parts)


def found(rows: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """key, at (the rule's place), code, numbers, items and for_ai of every rule that holds."""
    none = F.array().cast("array<string>")
    told = []
    for at, r in enumerate(rules):
        numbers = F.create_map(*[x for n, v in r.numbers.items() for x in (F.lit(n), v.cast("long"))]) if r.numbers else F.create_map().cast("map<string,bigint>")
        may = F.lit(True) if r.tell is None else F.coalesce(r.tell, F.lit(False))
        told.append(F.when(F.coalesce(r.holds, F.lit(False)), F.struct(F.lit(at).alias("at"), F.lit(r.code).alias("code"), numbers.alias("numbers"), (none if r.items is None else r.items).alias("items"), may.alias("for_ai"))))
    return rows.select(key, F.explode(F.array_compact(F.array(*told))).alias("x")).select(key, "x.*")


def board(rows: DataFrame) -> DataFrame:
    """``rows`` (served, capacity, expenses_annual) with free_seats, occupancy and cost: a month's for each person served."""
    served = F.col("served")
    free = F.when(F.col("capacity").isNotNull(), F.greatest(F.col("capacity") - served, F.lit(0)))
    return rows.withColumn("free_seats", free).withColumn("occupancy", F.when(F.col("capacity") > 0, F.floor(served * 100 / F.col("capacity")))).withColumn("cost", F.when(F.col("expenses_annual").isNotNull(), monthly_cost_each(F.col("expenses_annual"), served)))


def people_rules() -> list[Rule]:
    """Findings about people served, over :func:`board` with limited, not_accessible (spaces, named), waiting, average_fee, dependent,
    carers, few_visits, elderly_without_program, school_lag, without_consent, incomplete, elderly_home and children_home.

    Neither money nor a group under three people is told to others.
    """
    c = F.col
    large = lambda n: c(n) >= LEAST_GROUP
    fee = F.coalesce("average_fee", F.lit(0))
    no = F.lit(False)
    return [
        Rule("mobility_vs_access", (c("limited") > 0) & (F.size("not_accessible") > 0), {"people": c("limited"), "spaces": c("not_accessible_spaces")}, c("not_accessible"), large("limited")),
        Rule("waitlist_vs_seats", c("waiting") > 0, {"waiting": c("waiting"), "free": F.coalesce("free_seats", F.lit(-1))}),
        Rule("occupancy_high", c("occupancy") >= FULL, {"percent": c("occupancy")}),
        Rule("cost_gap", c("cost").isNotNull() & (c("served") > 0), {"cost": c("cost"), "fee": fee, "gap": F.greatest(c("cost") - fee, F.lit(0))}, tell=no),
        Rule("dependency_vs_carers", large("dependent"), {"dependent": c("dependent"), "carers": c("carers")}),
        Rule("few_visits", c("few_visits") > 0, {"people": c("few_visits")}, tell=large("few_visits")),
        Rule("no_program", c("elderly_home") & (c("elderly_without_program") > 0), {"people": c("elderly_without_program")}, tell=large("elderly_without_program")),
        Rule("school_lag", c("children_home") & (c("school_lag") > 0), {"people": c("school_lag")}, tell=large("school_lag")),
        Rule("without_consent", c("without_consent") > 0, {"people": c("without_consent")}, tell=no),
        Rule("incomplete_records", c("incomplete") > 0, {"people": c("incomplete")}, tell=no),
    ]


def facility_rules(year: int) -> list[Rule]:
    """Findings about places, over figures of :func:`tesela.operators.indicators.facilities`, served, capacity, limited, elderly_home and the
    columns of the main site."""
    c = F.col
    often = lambda name: c(name).isin("sometimes", "often")
    cared = (c("limited") > 0) | F.coalesce("elderly_home", F.lit(False))
    some = lambda *cases: F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), name) for name, when in cases]))
    civil = some(("internal_program_no", c("internal_program") == "no"), ("internal_program_in_progress", c("internal_program") == "in_progress"), ("opinion", ~c("civil_protection_opinion")))
    fire = some(("no_extinguishers", c("extinguishers") == 0), ("extinguishers_expired", ~c("extinguishers_current") & ~F.coalesce(c("extinguishers") == 0, F.lit(False))), ("no_smoke_detectors", c("smoke_detectors") == 0))
    return [
        Rule("broken_spaces", c("broken") > 0, {"groups": c("broken")}),
        Rule("broken_equipment", c("broken_equipment") > 0, {"items": c("broken_equipment")}),
        Rule("structural", c("structural") > 0, {"groups": c("structural")}),
        Rule("only_stairs", c("only_stairs") & (c("spaces_upstairs") > 0) & cared, {"people": c("limited"), "spaces": c("spaces_upstairs")}, tell=(c("limited") == 0) | (c("limited") >= LEAST_GROUP)),
        Rule("bathrooms_without_bars", (c("bathrooms_without_bars") > 0) & cared, {"without": c("bathrooms_without_bars"), "bathrooms": c("bathrooms")}),
        Rule("beds_short", (c("served") > c("beds")) | F.coalesce(c("capacity") > c("beds"), F.lit(False)), {"beds": c("beds"), "served": c("served"), "capacity": F.coalesce("capacity", F.lit(-1))}),
        Rule("tenure_weak", c("tenure").isin("rent", "borrowed", "other"), items=F.array("tenure")),
        Rule("tenure_ending", (c("tenure") == "loan") & (c("tenure_until") - year < ENDING_YEARS), {"until": c("tenure_until"), "years": F.greatest(c("tenure_until") - year, F.lit(0))}),
        Rule("tenure_undocumented", ~c("tenure_documented")),
        Rule("civil_protection_gap", F.size(civil) > 0, items=civil),
        Rule("fire_safety_gap", F.size(fire) > 0, items=fire),
        Rule("water_shortage", often("water_shortage"), {"often": (c("water_shortage") == "often").cast("int"), "liters": F.coalesce("water_storage_liters", F.lit(-1))}),
        Rule("power_without_backup", often("power_outages") & ~F.coalesce("generator_works", F.lit(False)), {"often": (c("power_outages") == "often").cast("int"), "hospital_beds": F.coalesce("hospital_beds", F.lit(0))}),
        Rule("spaces_unchecked", c("spaces_unchecked") > 0, {"spaces": c("spaces_unchecked")}, tell=F.lit(False)),
    ]


def covered_pages(pages: DataFrame, own: scanner.Own = scanner.Own(), pictures: bool = False) -> DataFrame:
    """``pages`` (doc, page, text) with every finding covered and ``covered``, how many there were: counts, never what they were."""
    spans = pages.withColumn("_spans", scanner.scanner(own, pictures)("text"))
    return spans.withColumn("text", personal.redacted("text", "_spans")).withColumn("covered", F.size("_spans")).drop("_spans")
