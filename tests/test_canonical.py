"""Nested readings, field rules and the store scan on hand-worked cases; all values are invented."""

import json
import random
import re

from pyspark.sql import functions as F

from tesela.operators import canonical, fields, store


def frame(spark, docs):
    return spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "doc long, json string")


def proof(quote, page=1):
    return [{"cita": quote, "pagina": page, "documento": "bases.pdf"}]


def test_items_cards_and_gaps(spark):
    line = "x" * 400
    docs = [
        {
            "identidad": {"que_apoya": {"elementos": [{"titulo": "  Comer\nbien ", "evidencias": proof("q", 3), "aplica_a": "", "obligatoriedad": "no_indicado"}, {"titulo": None, "evidencias": proof("Dormir", 4)}, {"titulo": " ", "evidencias": []}]}, "nombre": {"estado": "encontrado", "valor_texto": "N"}},
            "financiamiento": {"conceptos_financiables": {"elementos": [{"titulo": "comer bien"}, {"titulo": "Dormir"}]}, "conceptos_no_financiables": {"elementos": [{"titulo": t} for t in ("a", "A", "b", "c", "d", line)]}, "monto_maximo": {"estado": "no_aparece", "valor_texto": "nada"}, "monto_minimo": {"estado": "encontrado", "evidencias": proof("$ 5", 2)}},
            "evaluacion": {"criterios": {"estado": "no_aparece", "criterios": [{"titulo": "Impacto", "ponderacion": "30"}, {"titulo": "Otro"}]}},
            "temporalidad": {"hitos": {"hitos": [{"tipo": "cierre", "inicio_texto": "1 de mayo", "fin_texto": "3 de mayo", "evidencias": proof("Cierra")}, {"etiqueta": "sin dia"}]}},
        },
        {"proyecto": {"objetivos": {"elementos": [{"titulo": "Meta"}]}}, "financiamiento": {"monto_maximo": {"estado": "ambiguo"}}}, None, "nada", "[1]", {}, {"identidad": "odd", "financiamiento": {"conceptos_financiables": 5}},
    ]
    df = frame(spark, docs)
    told = canonical.items(df)
    got = {(r.group, r.n): (r.text, r.applies_to, r.requirement, r.page, r.file) for r in told.filter("doc = 0").collect()}
    assert got["supported", 0] == ("Comer bien", None, None, 3, "bases.pdf") and got["supported", 1] == ("Dormir", None, None, 4, "bases.pdf") and ("supported", 2) not in got
    assert got["criteria", 0][0] == "Impacto (30)" and got["criteria", 1][0] == "Otro" and got["not_fundable", 5][0] == "x" * 320 + "…"
    cards = sorted((r.doc, r.block, tuple(r.points), r.more) for r in canonical.cards(told).collect())
    assert cards == [(0, "not_fundable", ("a", "b", "c"), 2), (0, "supported", ("Comer bien", "Dormir"), 0), (1, "supported", ("Meta",), 0)]
    assert sorted((r.doc, r.kind, r.value, r.page) for r in canonical.amounts(df).collect()) == [(0, "min_amount", "$ 5", 2)]
    assert [(r.n, r.kind, r.label, r.when) for r in canonical.days(df).collect()] == [(0, "cierre", "Cierra", "1 de mayo al 3 de mayo")]
    gaps = {d: {r.field for r in canonical.missing(df).filter(F.col("doc") == d).collect()} for d in range(7)}
    assert gaps[0] == set(canonical.KEY_FIELDS) - {"identidad.nombre", "evaluacion.criterios"} and gaps[1] == set(canonical.KEY_FIELDS) - {"financiamiento.monto_maximo"} and len(gaps[2]) == len(gaps[3]) == len(gaps[6]) == 8


def slow_walk(v, keep, skip):
    if isinstance(v, list):
        return [t for x in v for t in slow_walk(x, keep, skip)]
    out = []
    for k, x in v.items() if isinstance(v, dict) else ():
        if k in skip:
            continue
        out += [x] if k in keep and isinstance(x, str) else slow_walk(x, keep, skip)
    return out


def test_walk_against_recursion():
    draw = random.Random(8)

    def nested(depth):
        if depth == 0 or draw.random() < 0.2:
            return draw.choice(["a", "b", 3, None, True])
        if draw.random() < 0.4:
            return [nested(depth - 1) for _ in range(draw.randrange(4))]
        return {draw.choice(["cita", "texto", "nota", "x", "metadatos", "titulo"]): nested(depth - 1) for _ in range(draw.randrange(5))}

    for _ in range(400):
        v = nested(6)
        assert canonical.walk(v, canonical.EVIDENCE, canonical.NO_EVIDENCE) == slow_walk(v, canonical.EVIDENCE, canonical.NO_EVIDENCE)
    deep = {"cita": "fin"}
    for _ in range(5000):
        deep = [deep]
    assert canonical.walk(deep, canonical.EVIDENCE, frozenset()) == ["fin"]


def test_evidence_of_odd_json(spark):
    df = frame(spark, [{"cita": "a", "nota": "b", "x": [{"texto": "c"}, "d"]}, None, "no", "[]"])
    rows = df.select("doc", canonical.evidence_text("json").alias("e"), canonical.quotes_of("json").alias("q")).orderBy("doc").collect()
    assert [(r.e, r.q) for r in rows] == [("a\nc", ["a"]), (None, None), (None, None), ("", [])]


def test_masks():
    m, t = canonical.masked_text, canonical.TAKEN
    assert m("uno dos\n tres cuatro", ["dos tres"]) == f"uno {t} cuatro" and m("uno dos", ["cinco", " ", "d.s"]) == "uno dos"
    assert m("uno dos tres", ["uno", "dos"]) == f"{t}  tres" and m("a b a", ["a"]) == f"{t} b {t}"
    assert m("abcdef", ["abc", "bcd"]) == f"{t}ef" or m("abcdef", ["abc", "bcd"]).count(t) == 1
    draw = random.Random(2)
    for _ in range(300):
        text = "".join(draw.choice("ab ") for _ in range(40))
        quotes = ["".join(draw.choice("ab ") for _ in range(4)) for _ in range(3)]
        hit = set()
        for q in quotes:
            words = q.split()
            if words:
                for at in range(len(text)):
                    got = re.match(r"\s+".join(words), text[at:])
                    if got:
                        hit |= set(range(at, at + got.end()))
        left = re.sub(re.escape(t), "", m(text, quotes))
        assert len(left.replace(" ", "")) >= sum(c != " " and i not in hit for i, c in enumerate(text))


def test_groups_of_pages(spark):
    rows = [("a", i, "x" * n) for i, n in enumerate((4, 5, 2, 30, 1, 9, 10))] + [("b", 1, None), ("b", 2, ""), (None, 1, "x" * 99)]
    got = sorted((r.doc or "", r.page, r.group) for r in canonical.page_groups(spark.createDataFrame(rows, "doc string, page int, text string"), 10, 4).collect())
    assert got == [("", 1, 0), ("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("a", 5, 3), ("b", 1, 0), ("b", 2, 0)]


def test_field_rules(spark):
    rows = [
        ("a", "power_of_attorney", 1, "Escritura número 12,345 del libro\r\notorga a favor de MARÍA DEL CARMEN RUIZ y de otros"), ("a", "power_of_attorney", 2, "Escritura pública No. 99"),
        ("b", "tax_compliance_opinion", 1, None), ("b", "tax_compliance_opinion", 2, "Fecha de  Expedición:\n30 de enero de 2024\nFolio: ABC\nfolio: 24-X"),
        ("c", "tax_status_certificate", 1, "rfc: ABC991301XY1\nRFC ABC990101XY1 fin\nRégimen General de Ley\nDenominación/Razón Social: " + "y" * 300),
        ("d", "donee_authorization", 2, "11 de mayo de 2020"), ("d", "donee_authorization", 3, "rubro: cultural\nrubro: ecológico; se recibe"), ("e", "unknown", 1, "RFC: ABC990101XY1"),
        ("f", "tax_compliance_opinion", 1, "fecha de emisión: 01/02/2024 vigencia: hasta 05/03/2024"), ("g", "articles_of_incorporation", 1, "a los diez días del mes de marzo de dos mil quince"),
    ]
    got = {(r.doc, r.field.removeprefix("institution.")): (r.value, r.page, r.computed) for r in fields.found(spark.createDataFrame(rows, "doc string, kind string, page int, text string")).collect()}
    assert {k: v[:2] for k, v in got.items() if k[0] == "a"} == {("a", "record.reference"): ("12345", 1), ("a", "legal_rep_name"): ("María del Carmen Ruiz", 1)}
    assert {k: v for k, v in got.items() if k[0] == "b"} == {("b", "record.issued_on"): ("2024-01-30", 2, False), ("b", "record.reference"): ("24-X", 2, False), ("b", "record.valid_until"): ("2024-02-29", 2, True)}
    assert got["c", "legal_rfc"][0] == "ABC990101XY1" and got["c", "tax_regime"][0] == "general" and got["c", "legal_name"][0] == "y" * 300
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "d"} == {"donee_category": "culture"}
    assert got["f", "record.valid_until"] == ("2024-03-05", 1, False) and got["g", "founded_year"][0] == "2015" and not any(k[0] == "e" for k in got)
    line = fields.found(spark.createDataFrame(rows, "doc string, kind string, page int, text string")).filter("doc = 'c' and field = 'institution.legal_name'").first().line
    assert len(line) == 200 and line.endswith("y…") and fields.found(spark.createDataFrame([], "doc string, kind string, page int, text string")).count() == 0


def test_store(spark):
    notes = spark.createDataFrame([(1, "cuenta 002010077777777771", ["x", "tarjeta 4111111111111111"], {"document_id": "d1"}), (2, None, None, None), (3, "nada", [], {"document_id": "d2"})], "id int, note string, tags array<string>, source_ref map<string,string>").withColumn("source_ref", F.to_json("source_ref"))
    tables = {"notes": notes, "numbers": spark.range(3), "people": spark.createDataFrame([("correo@ejemplo.mx", 1)], "mail string, n int")}
    assert store.text_columns(notes.schema) == ["note", "tags", "source_ref"] and store.with_column(tables, "source_ref") == ["notes"]
    got = {(r.table, r.column): (r.texts, r.findings, r.texts_with) for r in store.scanned(tables).collect()}
    assert got == {("notes", "note"): (2, 1, 1), ("notes", "tags"): (2, 1, 1), ("notes", "source_ref"): (2, 0, 0), ("people", "mail"): (1, 0, 0)}
    assert sorted(r.id for r in store.forgotten(tables, "source_ref", "d1")["notes"].collect()) == [2, 3]
