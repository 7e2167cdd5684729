"""Readings of texts, quotes, kinds and registers on hand-worked cases; all values are invented."""

import random

import pytest
from pyspark.sql import functions as F

from tesela.functions import readings
from tesela.operators import kinds, provenance, records, registers


def each(spark, function, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", function(F.col("t")).alias("x")).collect()
    return [tuple(r.x) if isinstance(r.x, tuple) else r.x for r in sorted(rows, key=lambda r: r.i)]


def test_numbers_in_words(spark):
    assert each(spark, readings.number_in_words, "Dos Mil Veintisiete", "treinta y uno", "mil", "perro", "y", "", None) == [2027, 31, 1000, None, None, None, None]
    assert each(spark, readings.leading_number_in_words, "cuarenta y dos mil ciento diez libro uno", "libro", "tres y perro") == [42110, None, 3]


def test_dates(spark):
    texts = ["el 14 de marzo de 2017, 10/03/2015 y a los diez días del mes de marzo de dos mil quince", "el treinta y uno de enero de dos mil veintisiete, 31/02/2020", "1/2/2020 y 1 de febrero del 2020", "palabra " * 3000 + "5 de mayo de 2001", None, ""]
    assert each(spark, readings.dates_in, *texts) == [["2017-03-14", "2015-03-10"], ["2027-01-31"], ["2020-02-01"], ["2001-05-05"], None, []]


def test_amounts_shares_and_spans(spark):
    assert each(spark, lambda t: readings.amount(t, F.lit(True)), "hasta $250,000.50", "3 millones de pesos", "US$ 12 mil", "el 5 de mayo", "42", None) == [(250000.5, "MXN"), (3e6, "MXN"), (12000.0, "USD"), None, (42.0, "XXX"), None]
    assert each(spark, lambda t: readings.amount(t, F.lit(False)), "$ 5") == [(5.0, "XXX")]
    assert each(spark, readings.percent, "el 80% del total", "treinta por ciento", "120 %", "12,5 por ciento", "nada", None) == [80.0, 30.0, None, 12.5, None, None]
    assert each(spark, readings.duration, "plazo de tres meses", "2 años y 3 días", "0 días, 5 semanas", "mes", None) == [(3.0, "months"), (2.0, "years"), (5.0, "weeks"), None, None]
    assert each(spark, readings.whole, "1,250 puntos", "son tres", "nada", None) == [1250, 3, None, None]
    assert each(spark, readings.mentions_pesos, "en pesos", "M. N.", "pesosx", None) == [True, True, False, False]


def test_names_and_shapes(spark):
    names = ["Ana María Pérez de la Cruz", " Ana ", "Ana Pérez", "de la Cruz", "José de Jesús Ruiz Luna", "Ana de la Cruz"]
    assert each(spark, readings.split_name, *names) == [("Ana María", "Pérez", "de la Cruz"), ("Ana", None, None), ("Ana", "Pérez", None), ("de la Cruz", None, None), ("José de Jesús", "Ruiz", "Luna"), ("Ana", "de la Cruz", None)]
    assert each(spark, readings.email_like, "a@b.mx", "a@.mx", "a@b", "a@b.", "@b.c", " a@b.mx ", "a@b@c.mx") == [True, False, False, False, False, True, False]
    assert each(spark, readings.bank, "012-180", "999", None) == ["BBVA", None, None]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_closest_against_brute_force():
    draw = random.Random(5)
    for _ in range(150):
        text = "".join(draw.choice("abc ") for _ in range(40)).strip()
        sought = list(text[5:22])
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(sought))
            sought[at : at + 1] = draw.choice([[], ["b"], ["a", "c"]])
        sought = "".join(sought).strip()
        least = min(edits(sought, text[a:b]) for a in range(len(text)) for b in range(a, min(len(text), a + 24) + 1))
        got = provenance._closest(sought, text, 2)
        assert (got is not None) == (least <= 2)
        assert got is None or edits(sought, text[slice(*got)]) <= least + 2  # blanks at the ends are cut off


def test_quotes(spark):
    page = "La Asociación recibirá hasta 250 mil pesos,\nsegún el artículo 12 de la convocatoria; ñandú."
    cases = [("asociacion RECIBIRA hasta 250 mil", "Asociación recibirá hasta 250 mil"), ("segun el articvlo 12 de la convocatoria", "según el artículo 12 de la convocatoria"), ("segun el articulo 13 de la convocatoria", None), ("ñandu", "ñandú"), ("nandi", None), ("...", None), (None, None)]
    rows = spark.createDataFrame([(i, q, page) for i, (q, _) in enumerate(cases)], "i int, q string, t string").select("i", provenance.located("q", "t").alias("x")).collect()
    assert [r.x for r in sorted(rows, key=lambda r: r.i)] == [want for _, want in cases]


def test_statements_and_merged_readings(spark):
    a = spark.createDataFrame([(1, ["Entregar el informe anual", None], " ", "a"), (2, None, None, None)], "id long, items array<string>, title string, note string")
    b = spark.createDataFrame([(1, ["entregar el informe anual.", "Firmar 2 copias"], "T", "b"), (3, ["x y"], None, "c")], "id long, items array<string>, title string, note string")
    got = {r.id: (r["items"], r.title, r.note) for r in provenance.merged(a, b, "id", ["items"], ["title", "note"]).collect()}
    assert got == {1: (["Entregar el informe anual", "Firmar 2 copias"], "T", "a"), 2: ([], None, None), 3: (["x y"], None, "c")}


def test_states(spark):
    df = spark.createDataFrame([("ambiguo", 0), ("ambiguo", 1), ("no_aparece", 2), (None, None)], "d string, n int")
    assert [r.s for r in df.select(provenance.state_of(F.col("d"), F.col("n")).alias("s")).collect()] == ["no_aparece", "ambiguo", "encontrado", "no_aparece"]


def test_kinds(spark):
    rules = [("a", [["poder general"], ["pleitos", "cobranzas"]], [["poder"]]), ("b", [["informe anual"]], [["informe"]])]
    texts = [("Poder General para pleitos y cobranzas", "x.pdf", "a"), ("poder general, informe anual", "informe.pdf", "b"), ("z" * 500 + " informe anual", "Poder.pdf", "a"), (None, "01-poder_notarial.pdf", "a"), ("informe anual", "f", "otro")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, t string, f string, p string").withColumn("s", kinds.scores(F.col("t"), rules))
    got = df.select("i", kinds.recognised(F.col("s")).alias("k"), kinds.confidence(F.col("s"), F.col("f"), F.col("p"), rules).alias("c")).orderBy("i").collect()
    assert [(r.k, r.c) for r in got] == [("a", 6), (None, 1), ("b", 0), (None, 1), ("b", 0)]


def test_page_labels(spark):
    pages = [("d", i, f"Convocatoria {i}\n12\nParte {'abcde'[i]}{i}x") for i in range(5)] + [("e", 1, "Convocatoria"), ("e", 2, None), ("f", 1, "1\n2")]
    got = {(r.doc, r.page): r.label for r in kinds.page_labels(spark.createDataFrame(pages, "doc string, page int, text string")).collect()}
    assert got[("d", 3)] == "Parte d3x" and got[("e", 1)] == "Convocatoria" and got[("e", 2)] == got[("f", 1)] == "" and len(got) == 8


def test_positions_and_admissions(spark):
    df = spark.createDataFrame([(1, " ", "garden", "odd", -1, 5), (2, "Cuidadora", None, None, None, None)], "id long, title string, area string, default_modality string, authorized_seats long, reference_pay_mxn long")
    found = {(r.id, r.code) for r in records.issues(df, "id", registers.position({"area": ["care"]}, ["fixed"])).collect()}
    assert found == {(1, "label_missing"), (1, "code_unknown"), (1, "modality_unknown"), (1, "negative_number")}
    waiting = spark.createDataFrame([(1, "Ana", 80, "waiting"), (2, "Eva", None, "waiting"), (3, "Luz", 70, "declined"), (4, "Sol", 60, "waiting")], "entry_id long, name string, approx_age int, status string")
    people, after = registers.admitted(waiting, spark.createDataFrame([(1,), (1,), (2,), (3,)], "entry_id long"), F.lit("2026-01-01"))
    assert [(r.from_entry, r.status) for r in people.collect()] == [(1, "active")]
    assert {r.entry_id: r.status for r in after.collect()} == {1: "admitted", 2: "waiting", 3: "declined", 4: "waiting"}


@pytest.mark.parametrize(("kind", "ages", "want"), [("elderly", [59, 60, 95, 201, None, -1], ["under_60", "60_69", "90_plus", "unknown", "unknown", "unknown"]), ("children", [5, 6, 18], ["0_5", "6_11", "18_plus"]), ("other", [17, 59, 60], ["0_17", "18_59", "60_plus"])])
def test_age_bands(spark, kind, ages, want):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, a int")
    assert [r.b for r in df.select("i", registers.age_band(kind, F.col("a")).alias("b")).orderBy("i").collect()] == want


def test_equal_texts_of_days_are_put_together_before_they_are_read(spark, sf):
    """Before, each order's text was read, though few differ."""
    from tesela.plans import QUERIES

    plan = QUERIES["dates_in_texts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("Aggregate")
