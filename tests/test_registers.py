"""Scanner, figures and register rules on hand-worked cases; all values are invented."""

import pytest
from pyspark.sql import functions as F

from tesela.functions import figures
from tesela.operators import records, registers, scanner


def found(spark, text, pictures=False, **own):
    df = spark.createDataFrame([(text,)], "text string").select(scanner.scanner(scanner.Own(**{k: frozenset(v) for k, v in own.items()}), pictures)("text").alias("s"))
    return [((text or "")[x.start : x.end], x.kind, x.severity) for x in df.first().s]


def test_scanner_gates(spark):
    curps = [found(spark, f"clave pega800101hdfrrs0{d}.")[0] for d in range(10)]
    assert [c[1] for c in curps] == ["curp"] * 10 and sorted(c[2] for c in curps) == ["block"] + ["warn"] * 9
    assert found(spark, "PEGA801301AB3 y PEGA800230AB3, ABC801231XY1") == [("ABC801231XY1", "rfc_company", "warn")]
    assert found(spark, "4539 1488 0343 6467 y 4539 1488 0343 6468") == [("4539 1488 0343 6467", "card", "block")]
    assert found(spark, None) == [] and found(spark, "") == []


def test_matches_lie_where_the_shapes_find_them():
    """Runs against every shape over the whole text, with what stands around identifiers and joins them."""
    import random
    import re

    draw, shapes = random.Random(11), {k: re.compile(p, re.ASCII) for k, p in scanner.PATTERNS.items()}
    bits = ["PEGA800101HDFRRS09", "PEGA800101AB3", "ABC801231XY1", "ABCDEF80010112H123", "55 1234 5678", "(55)1234-5678", "+52 55 1234 5678", "A.B@C.MX", "ANA@CORREO.EXAMPLE.", "@", "002010077777777779", "4539 1488 0343 6467", "12345678901", "7"]
    joints = ["", "", " ", "-", "_", "&", "Ñ", "ß", ".", "+", "(", "\n", "X", "1", "@", "\u0301"]
    for _ in range(4000):
        raw = "".join(draw.choice(bits if draw.random() < 0.5 else joints) for _ in range(draw.randrange(9)))
        t = scanner.fold(raw)[0]
        want = sorted((k, m.span()) for k, s in shapes.items() for m in s.finditer(t))
        assert sorted((k, m.span()) for k, m in scanner.matches(t, shapes)) == want, t
        assert not want or scanner.likely(raw), raw


def test_only_texts_that_may_hold_an_identifier_are_folded(spark):
    """Before, one digit was enough; digits apart by marks or blanks count, since folding and cards join them."""
    apart = "4\u0301539 1488-0343\u0301 6467"
    texts = [apart, "nss 1\u03012345678903", "año 2024, página 12 de 345", "corto", "a@b.mx", "1.234.567", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.t for r in df.select("i", scanner.sought(F.col("text")).alias("t")).collect()}
    assert got == {0: "4539 1488-0343 6467", 1: "NSS 12345678903", 2: "", 3: "", 4: "A@B.MX", 5: "1.234.567", 6: "", 7: ""}
    told = {(r.kind, r.severity): (r.documents, r.findings) for r in scanner.counts(df).collect()}
    assert len(told) == 9 and {k for k, v in told.items() if v != (0, 0)} == {("card", "block"), ("nss", "block"), ("email", "warn")}


def test_check_digits_by_hand():
    for n in range(3000):
        d = f"{n * 7919 * 104729:018d}"[-18:]
        assert scanner._luhn(d) == (sum(sum(divmod(int(c) << (i & 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0)
        assert scanner._clabe(d) == ((10 - sum(int(c) * (3, 7, 1)[i % 3] % 10 for i, c in enumerate(d[:17])) % 10) % 10 == int(d[17]))


def test_records_of_one_row_group_are_dealt_over_the_cores(spark, sf):
    """Before, customers of a few bytes a row were one task's work whatever their number."""
    from tesela.plans.registers import people

    assert people(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_scanner_places_in_folded_text(spark):
    text = "Señora Ñuño, ß, tel 55 1234 5678; correo Ana@Correo.example"
    assert found(spark, text) == [("55 1234 5678", "phone", "warn"), ("Ana@Correo.example", "email", "warn")]


def test_scanner_leaves_what_is_allowed(spark):
    text = "tel +52 55 1234 5678, folio-5512345670, ana@correo.example"
    assert found(spark, text, phones=["55-1234-5678"], emails=["ANA@correo.example "]) == []
    assert found(spark, text, cleared=["ana@correo.EXAMPLE"]) == [("+52 55 1234 5678", "phone", "warn")]
    account = next(a for a in (f"00201007777777777{d}" for d in range(10)) if any(k == "clabe" for _, k, _ in found(spark, a)))
    assert found(spark, f"a {account}", accounts=[account]) == []


def test_scanner_reads_pictures(spark):
    assert found(spark, "PEGA8001O1AB3") == [] and found(spark, "PEGA8OO1O1AB3", pictures=True) == []
    assert found(spark, "PEGA8001O1AB3", pictures=True) == [("PEGA8001O1AB3", "rfc_person", "block")]


def test_strongest_is_the_brute_force(spark):
    import random

    draw = random.Random(3)
    for _ in range(200):
        spans = [(a, a + draw.randint(1, 9), draw.choice(list(scanner.PATTERNS)), draw.choice(["block", "warn"]), 1.0) for a in (draw.randint(0, 40) for _ in range(draw.randint(0, 20)))]
        kept = []
        for s in sorted(spans, key=lambda s: (s[3] != "block", s[0] - s[1], list(scanner.PATTERNS).index(s[2]), s[0])):
            if not any(s[0] < k[1] and k[0] < s[1] for k in kept):
                kept.append(s)
        assert scanner.strongest(spans) == sorted(kept)


@pytest.mark.parametrize(
    ("text", "is_list"),
    [("Nombre | Edad | Área\nx", True), ("Nombre, edad", False), ("NOMBRE  Diagnóstico  otro", True), ("edad | área | nota", False), (None, False)],
)
def test_header_lines_tell_lists(spark, text, is_list):
    df = spark.createDataFrame([(text,)], "text string").select(scanner.lists_people(F.col("text"), scanner.scanner()("text")))
    assert df.first()[0] is is_list


def test_figures(spark):
    cases = {"4 y 15 de 007": ["4", "15", "7"], "$250,000 o 250 000": ["250000"], "12.50 % de 3,0 y 0.5": ["12.5", "3", "0.5"], "5 6 y 7": ["5", "6", "7"], "$1,234,567.80": ["1234567.8"], "nada": [], "2,0261": ["2.0261"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", figures.stated(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == cases
    bad = spark.range(1).select(figures.unsupported(F.lit("Son 6, 7 y 16"), F.lit("Hay seis y siete"), F.lit(None).cast("string")))
    assert bad.first()[0] == ["16"]


def test_rules_of_people(spark):
    cols = "id int, first_names string, birth_date string, birth_date_approx boolean, approx_age int, sex string, programs array<string>, entry_date string, status_date string, consent_date string, curp string, monthly_fee_mxn long, fee_payer string, status string, discharge_reason string"
    rows = [
        (1, " ", None, None, None, "x", ["p", "q"], None, None, None, None, -1, None, "active", None),
        (2, "A", "1950-02-30", None, 130, "", [], None, None, None, "bad", None, None, "discharged", None),
        (3, "A", "2001-01-01", None, None, "f", None, "2000-01-01", "2020-01-01", None, None, 5, "exempt", "deceased", None),
    ]
    rules = registers.beneficiary(F.lit("2024-06-01").cast("date"), {"sex": ["f", "m"]}, {"programs": ["p"]}, youngest=50)
    out = {}
    for r in records.issues(spark.createDataFrame(rows, cols), "id", rules).collect():
        out.setdefault(r.id, set()).add((r.code, r.field))
    assert out[1] == {("name_missing", "first_names"), ("birth_missing", "birth_date"), ("code_unknown", "sex"), ("code_unknown", "programs"), ("negative_number", "monthly_fee_mxn")}
    assert out[2] == {("age_invalid", "approx_age"), ("date_invalid", "birth_date"), ("curp_invalid", "curp"), ("status_date_missing", "status_date"), ("discharge_reason_missing", "discharge_reason")}
    assert out[3] == {("entry_before_birth", "entry_date"), ("age_unusual", "birth_date"), ("exempt_with_fee", "monthly_fee_mxn")}


def test_rules_of_waiting_lists_and_lines(spark):
    w = spark.createDataFrame([(1, "2024-01-01", "f", "open", 3, "55 1234 5678"), (2, None, "z", None, -1, "123"), (3, "2024-01-01", None, "odd", None, " ")], "id int, requested_on string, sex string, status string, approx_age int, phone string")
    got = sorted((r.id, r.code, r.field) for r in records.issues(w, "id", registers.waiting({"sex": ["f", "m"]}, ["open"])).collect())
    assert got == [(2, "age_invalid", "approx_age"), (2, "code_unknown", "sex"), (2, "code_unknown", "status"), (2, "date_invalid", "requested_on"), (2, "phone_invalid", "phone"), (3, "code_unknown", "status")]
    m = spark.createDataFrame([(1, "a", 100_000_000_000), (2, "", 100_000_000_001), (3, "b", None)], "id int, label string, amount_mxn long")
    assert sorted((r.id, r.code) for r in records.issues(m, "id", registers.lines()).collect()) == [(2, "amount_too_large"), (2, "label_missing")]


def test_balance_needs_both_sides(spark):
    base = spark.createDataFrame([(1, None, 10, 0, 0, None), (2, 7, 10, 0, -3, 90), (3, 5, 1, 0, 0, None)], "id int, fees long, payroll long, support long, external long, budget long")
    income = spark.createDataFrame([(2, "fee_estimate", 100, "monthly"), (2, "event", 2, "monthly"), (1, "event", None, "annual")], "id int, kind string, amount_mxn long, period string")
    expense = spark.createDataFrame([(3, None, "annual")], "id int, amount_mxn long, period string")
    out = {r.id: tuple(r)[1:] for r in registers.finance(base, income, expense).collect()}
    assert out == {1: (0, 0, 0, "unknown", None, None), 2: (31, 7, 24, "estimate", 90, -59), 3: (5, 5, 0, "list", 1, 4)}


def test_population_lines_group_nulls(spark):
    p = spark.createDataFrame([("a", None, 70, 5), ("a", None, 80, None), (None, "x", None, 0)], "label string, dependency string, age int, fee long")
    out = registers.population_lines(p, ["label", "dependency"], F.col("age"), F.col("fee") > 0).collect()
    assert {tuple(r) for r in out} == {("a", None, 2, 1, 70, 80), (None, "x", 1, 0, None, None)}
