"""Indicators on hand-worked cases that the queries' SQL doesn't reach; all values are invented."""

from pyspark.sql import functions as F

from tesela.operators import indicators, kinds

SPACE = "home string, site_id int, kind string, count long, good long, fair long, poor long, unusable long, floor int, grab_bars boolean, beds long, hospital_beds long, accessible boolean, problems array<string>"
SITE = "home string, site_id int, land_m2 long, built_m2 long, floors int, tenure string, floor_access array<string>, water_sources array<string>, extinguishers int, internal_program string"


def test_lines_labels_and_days(spark):
    people = spark.createDataFrame([("a", None, "left"), ("a", None, None), ("a", "x", "active"), ("a", None, "active")], "home string, area string, status string")
    assert sorted((r.area or "", r["count"]) for r in indicators.staff_lines(people, ["home", "area"]).collect()) == [("", 2), ("x", 1)]
    lines = spark.createDataFrame([("a", 2, "niñas", 3), ("a", 1, "niños", 4), ("a", 0, "niñas", None)], "id string, n int, label string, count int")
    assert sorted((r.place, r.label, r.people) for r in indicators.population_by_label(lines, "id", "n").collect()) == [(0, "niñas", 3), (1, "niños", 4)]
    moments = spark.createDataFrame([("2024-01-01 23:00:00",), ("2024-01-02 01:00:00",), (None,)], "t string").select(indicators.confirmed_days(F.col("t").cast("timestamp"), F.lit("2024-01-03 00:30:00").cast("timestamp")).alias("d"))
    assert [r.d for r in moments.collect()] == [1, 0, None]


def test_readings_that_are_empty(spark):
    schema = "id int, state string, quotes array<string>"
    some, none = spark.createDataFrame([(1, "x", None), (2, None, ["a"])], schema), spark.createDataFrame([], schema)
    assert tuple(indicators.agreement(some, some, ["id"]).first()) == (2, 0.5, 1.0)
    assert tuple(indicators.agreement(some, none, ["id"]).first()) == (2, 0.0, 0.5) and tuple(indicators.agreement(none, none, ["id"]).first()) == (0, None, None)


def test_places_without_anything(spark):
    sites = spark.createDataFrame([("a", 1, None, 5, 2, "own", ["none"], [], 1, None), ("b", 2, 7, None, None, None, None, None, None, None)], SITE)
    spaces = spark.createDataFrame([("a", 1, "bathroom", 3, 1, None, 1, None, 1, None, 9, None, False, ["cracks"]), ("a", 1, "bedroom", 2, 2, 0, 0, 0, 0, False, 4, 1, None, None)], SPACE)
    things = spark.createDataFrame([("a", 1, "generator", 1, None, None, None, 1, 0, None, None, None, None, None)], SPACE)
    got = {r.home: r for r in indicators.facilities(sites, spaces, things, "home").collect()}
    a, b = got["a"], got["b"]
    assert (a.only_stairs, a.spaces, a.spaces_upstairs, a.bathrooms, a.bathrooms_without_bars, a.beds, a.hospital_beds, a.structural, a.not_accessible, a.broken, a.spaces_unchecked, a.equipment, a.broken_equipment, a.generator_works) == (True, 5, 3, 3, 0, 4, 1, 1, 1, 1, 1, 1, 1, False)
    assert a.missing == ["water", "unchecked"] and b.missing == ["built_m2", "floors", "tenure", "water", "safety", "spaces"] and (b.spaces, b.beds, b.land_m2, b.built_m2, b.generator_works) == (0, None, 7, None, None)


def test_papers_of_every_rule(spark):
    who = spark.createDataFrame([(1, " yes ", "in_progress", "iap ", ["childhood"], ["residential"]), (2, None, None, None, None, None)], "id int, authorized_donee string, cluni string, legal_form string, populations array<string>, modalities array<string>")
    catalog = {r: r for r in ("always", "donee", "cluni", "junta", "minors_living", "housing", "premises", "odd")}
    held = spark.createDataFrame([(2, "donee", "have", "2020-01-01"), (2, "junta", "missing", None), (2, "other", None, None), (1, "always", "not_applicable", None), (3, "always", "have", None)], "id int, kind string, status string, valid_until string")
    told = indicators.papers(who, catalog, held, F.lit("2024-01-01").cast("date"))
    assert {(r.id, r.kind): (r.status, r.validity) for r in told.filter("id = 2").collect()} == {(2, "always"): ("missing", None), (2, "donee"): ("have", "expired"), (2, "other"): (None, None)}
    assert sorted(r.kind for r in told.filter("id = 1").collect()) == ["always", "cluni", "donee", "housing", "junta", "minors_living", "premises"]
    sums = {r.id: (r.expected, r.have, r.missing, r.expired) for r in indicators.papers_summary(told).collect()}
    assert sums == {1: (6, 0, 6, 0), 2: (3, 1, 2, 1)}


def test_classes_of_calls(spark):
    texts = ["Programa", "bases de datos", "basesita", "R E G L A S  D E  O P E R A C I Ó N", "Fe de Erratas; anexo", "ANEXO", None, "carta-compromiso", "El formato"]
    got = [r.c for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", kinds.call_class(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [None, "convocatoria", None, "reglas_de_operacion", "aviso", "anexo", None, "formato", "formato"]
