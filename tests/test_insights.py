"""Findings about institutions on hand-worked cases; all values are invented."""

from pyspark.sql import functions as F

from tesela.operators import insights

PLACES = "id int, broken long, broken_equipment long, structural long, only_stairs boolean, spaces_upstairs long, limited long, elderly_home boolean, bathrooms_without_bars long, bathrooms long, beds long, served long, capacity long, tenure string, tenure_until int, tenure_documented boolean, internal_program string, civil_protection_opinion boolean, extinguishers int, extinguishers_current boolean, smoke_detectors int, water_shortage string, water_storage_liters long, power_outages string, generator_works boolean, hospital_beds long, spaces_unchecked long"


def test_places(spark):
    rows = [
        (1, 2, 0, 1, True, 4, 2, False, 3, 5, 10, 12, None, "loan", 2028, False, "in_progress", False, 0, False, 0, "often", None, "sometimes", False, 2, 7),
        (2, 0, 0, 0, True, 4, 0, False, 3, 5, 10, 9, 10, "own", None, True, "yes", True, 3, False, 2, "never", 5, "often", True, None, 0),
        (3, *[None] * 26),
    ]
    told = insights.found(spark.createDataFrame(rows, PLACES), "id", insights.facility_rules(2026))
    got = {(r.id, r.code): (r.numbers, r["items"], r.for_ai) for r in told.collect()}
    assert {c for i, c in got if i == 1} == {"broken_spaces", "structural", "only_stairs", "bathrooms_without_bars", "beds_short", "tenure_ending", "tenure_undocumented", "civil_protection_gap", "fire_safety_gap", "water_shortage", "power_without_backup", "spaces_unchecked"}
    assert got[1, "only_stairs"] == ({"people": 2, "spaces": 4}, [], False) and got[1, "beds_short"][0] == {"beds": 10, "served": 12, "capacity": -1} and got[1, "tenure_ending"][0] == {"until": 2028, "years": 2}
    assert got[1, "civil_protection_gap"][1] == ["internal_program_in_progress", "opinion"] and got[1, "fire_safety_gap"][1] == ["no_extinguishers", "no_smoke_detectors"] and got[1, "water_shortage"][0] == {"often": 1, "liters": -1} and not got[1, "spaces_unchecked"][2]
    assert {c for i, c in got if i == 2} == {"fire_safety_gap"} and got[2, "fire_safety_gap"][1] == ["extinguishers_expired"] and not any(i == 3 for i, _ in got)


def test_a_board_without_people_or_money(spark):
    rows = spark.createDataFrame([(1, 0, 10, 100_000), (2, 24, 25, 2_419_200), (3, 5, 0, None)], "id int, served long, capacity long, expenses_annual long")
    got = {r.id: (r.free_seats, r.occupancy, r.cost) for r in insights.board(rows).collect()}
    assert got == {1: (10, 0, None), 2: (1, 96, 8400), 3: (0, None, None)}


def test_pages_are_covered(spark):
    pages = spark.createDataFrame([("a", 1, "correo ana@ejemplo.mx y nada"), ("a", 2, None), ("a", 3, "limpio")], "doc string, page int, text string")
    got = {r.page: (r.text, r.covered) for r in insights.covered_pages(pages).collect()}
    assert got == {1: ("correo [EMAIL] y nada", 1), 2: (None, 0), 3: ("limpio", 0)}
