"""Names, health, marks and the index on hand-worked cases; all values are invented."""

import random
import re

from pyspark.sql import functions as F

from tesela.operators import names, postings, scanner, vault

LISTS = names.Lists(frozenset(("ANA", "JUAN", "ROSA", "LUZ", "JOSE")), frozenset(("LOPEZ", "RUIZ", "PENA", "CRUZ")), frozenset(("FUNDACION LUZ PENA", "ROSA CRUZ")))
fold = lambda w: scanner.fold(w)[0]


def called(text):
    return [(text[a:b], c) for a, b, c in names.find_names(text, fold, LISTS)]


def test_names():
    assert called("Vino Ana López con Juan de Cruz y Luz de la Peña.") == [("Vino Ana López", 0.6), ("Juan de Cruz y Luz", 0.6)]
    assert called("Es doña Ana; vino Don José Ruiz Pérez Cruz Luz") == [("Ana", 0.9), ("José Ruiz Pérez", 0.9), ("Cruz Luz", 0.6)]
    assert called("Ana  López, Ana. López y ANA LÓPEZ ana lópez") == [] and called("") == []
    assert called("Casa Ana Ruiz, en la calle Juan Peña, casa hogar Ana Ruiz; y San José Cruz") == [("Casa Ana Ruiz", 0.6), ("José Cruz", 0.6)]
    assert called("San José y la paciente Zoila, la paciente Ana") == [("Ana", 0.9)]
    assert called("Rosa Cruz vino, Luz Peña no; Rosa Ruiz sí") == [("Rosa Ruiz", 0.6)]
    assert called("Ana y Juan López") == [("Ana y Juan López", 0.6)] and called("Sor Juan") == [("Juan", 0.9)]


def brute_runs(text):
    """Runs of capitalised words by walking from word to word."""
    words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text)]
    cap = lambda w: len(w) > 1 and w[0].isupper() and any(c.islower() for c in w[1:])
    near = lambda i: i < len(words) and text[words[i - 1][2] : words[i][1]] == " "
    out, i = [], 0
    while i < len(words):
        if not cap(words[i][0]):
            i += 1
            continue
        j, caps = i + 1, 1
        while caps < 4 and near(j):
            if cap(words[j][0]):
                j += 1
            elif words[j][0] in names.CONNECTORS and near(j + 1) and cap(words[j + 1][0]):
                j += 2
            else:
                break
            caps += 1
        out.append((words[i][1], words[j - 1][2]))
        i = j
    return out


def test_names_against_brute_force():
    """With every word known, names are the runs themselves."""
    draw = random.Random(3)
    everybody = names.Lists(frozenset(("ABA", "BEBE", "CORO", "DI")), frozenset(("ABA", "BEBE", "CORO", "DI")))
    for _ in range(500):
        text = "".join(draw.choice(["Aba", "Bebe", "Coro", "Di", "de", "la", "y", "no", "X", "ABA", "7"]) + draw.choice([" ", " ", " ", "  ", ", ", ".", "\n"]) for _ in range(25))
        want = [(a, b) for a, b in brute_runs(text) if len(re.findall(r"[A-Z]", text[a:b])) > 1]
        assert [(a, b) for a, b, _ in names.find_names(text, fold, everybody)] == want, text


def test_health_beside_one_person(spark):
    texts = ["Ana López padece diabetes. Todos reciben tratamiento.", "La señora toma su MEDICAMENTO; las dosis sobran", "Hay 30 personas con discapacidad y alergias", "cama 12: hipertensión", None, "Mañaná ella: epilepsia"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", scanner.scanner(lists=LISTS)("t").alias("s")).collect()
    got = {r.i: [(r.t[s.start : s.end], s.kind, s.confidence) for s in r.s] for r in rows}
    assert got == {
        0: [("Ana López", "person_name", 0.6), ("padece", "health_context", 0.9), ("diabetes", "health_context", 0.9)],
        1: [("MEDICAMENTO", "health_context", 0.7)],
        2: [],
        3: [("hipertensión", "health_context", 0.7)],
        4: [],
        5: [("epilepsia", "health_context", 0.7)],
    }


def errands(spark, rows):
    return spark.createDataFrame(rows, "scope string, id long, text string").withColumn("spans", scanner.scanner(lists=LISTS)("text"))


def test_marks_and_back(spark):
    rows = [
        ("a", 1, "Firmó Rosa Ruiz, Ana López, ana@ejemplo.mx, tel 55 1234 5678."), ("a", 2, "ANA LOPEZ: +52 (55) 1234-5678; ana@EJEMPLO.mx y RUIZ"), ("a", 3, None), ("a", 4, "sin datos"),
        ("b", 1, "Ana López padece diabetes"), ("b", 2, "ana lópez y otra ana lópezz"),
    ]
    texts = errands(spark, rows)
    found = vault.found_values(texts)
    kept = vault.vault_of(found)
    said = {(r.scope, r.mark): r.value for r in kept.collect()}
    assert said == {("a", "[NOMBRE_1]"): "Firmó Rosa Ruiz", ("a", "[NOMBRE_2]"): "Ana López", ("a", "[CORREO_1]"): "ana@ejemplo.mx", ("a", "[TELEFONO_1]"): "55 1234 5678", ("b", "[NOMBRE_1]"): "Ana López"}
    back = vault.revealed(vault.marked(texts, found, kept), kept)
    got = {(r.scope, r.id): (r.marked, r.revealed) for r in back.collect()}
    assert got["a", 1] == ("[NOMBRE_1], [NOMBRE_2], [CORREO_1], tel [TELEFONO_1].", rows[0][2])
    assert got["a", 2][0] == "[NOMBRE_2]: [TELEFONO_1]; [CORREO_1] y RUIZ"
    assert got["a", 3] == (None, None) and got["a", 4] == ("sin datos", "sin datos")
    assert got["b", 1] == ("[NOMBRE_1] [DATO DE SALUD OCULTO] [DATO DE SALUD OCULTO]", "Ana López [DATO DE SALUD OCULTO] [DATO DE SALUD OCULTO]")
    assert got["b", 2][0] == "[NOMBRE_1] y otra ana lópezz"
    written = [("a", 1, "[NOMBRE 2] [Nombre-2] [ nombre_02 ] NOMBRE_2 [Teléfono_1] [NOMBRE_9] El RFC y NOMBRE 2"), ("b", 1, "[CORREO_1]"), ("c", 1, "[NOMBRE_1]"), ("a", 2, None)]
    answers = spark.createDataFrame(written, "scope string, id long, marked string")
    out = {(r.scope, r.id): r.revealed for r in vault.revealed(answers, kept).collect()}
    assert out == {("a", 1): "Ana López Ana López Ana López Ana López 55 1234 5678 [NOMBRE_9] El RFC y NOMBRE 2", ("b", 1): "[CORREO_1]", ("c", 1): "[NOMBRE_1]", ("a", 2): None}
    assert sorted((r.scope, r.id, r.mark) for r in vault.unknown(answers, kept).collect()) == [("a", 1, "[NOMBRE_9]"), ("b", 1, "[CORREO_1]"), ("c", 1, "[NOMBRE_1]")]
    saved = spark.createDataFrame([("ANA@ejemplo.mx", "«Correo»"), ("+52 55 1234 5678", "«Teléfono»"), ("", "«Nada»")], "value string, place string")
    lines = {r.mark: r.line for r in vault.legend(kept.filter("scope = 'a'"), saved).collect()}
    assert lines["[CORREO_1]"] == "- [CORREO_1]: un correo; es el mismo que está guardado en «Correo»." and lines["[TELEFONO_1]"].endswith("guardado en «Teléfono».") and lines["[NOMBRE_2]"].endswith("(el contexto dice cuál).")
    assert vault.legend(kept).count() == 5 and vault.vault_of(vault.found_values(texts.limit(0))).count() == 0


def test_marks_beyond_a_thousand_come_back(spark):
    """Before, marks were read with three digits at most, so the values from the thousandth of a kind and scope on never came back."""
    said = [f"p{n:04d}@ejemplo.mx" for n in range(1203)]
    rows = [("a", i, "; ".join(said[at : at + 40])) for i, at in enumerate(range(0, len(said), 40))] + [("a", 99, f"otra vez {said[1100]} y {said[7]}")]
    texts = errands(spark, rows)
    found = vault.found_values(texts)
    kept = vault.vault_of(found)
    marked = vault.marked(texts, found, kept)
    assert {(r.scope, r.id): r.revealed for r in vault.revealed(marked, kept).collect()} == {(s, i): t for s, i, t in rows}
    assert [r.marked for r in marked.filter("id = 99").collect()] == ["otra vez [CORREO_1101] y [CORREO_8]"]
    answers = spark.createDataFrame([("a", 1, "[Correo 1203], CORREO_01203, CORREO_20000 y [CORREO_1204]")], "scope string, id long, marked string")
    assert [r.revealed for r in vault.revealed(answers, kept).collect()] == [f"{said[1202]}, {said[1202]}, CORREO_20000 y [CORREO_1204]"]
    assert sorted(r.mark for r in vault.unknown(answers, kept).collect()) == ["[CORREO_1204]", "[CORREO_20000]"]


def test_known_values_longest_first_against_brute_force():
    draw = random.Random(9)
    for _ in range(300):
        values = sorted({" ".join(draw.choice(["ana", "luz", "óscar"]) for _ in range(draw.randrange(1, 4))) for _ in range(4)})
        text = "".join(draw.choice(["Ana", "LUZ", "oscar", "x", "anaz"]) + draw.choice([" ", " ", ", "]) for _ in range(12))
        left, low, taken = set(range(len(text))), fold(text), []
        for v in sorted(values, key=lambda v: (-len(v), values.index(v))):
            for m in re.finditer(rf"\b{re.escape(fold(v))}\b", low):
                taken.append((m.start(), m.end(), values.index(v)))
        want = []
        for a, b, n in sorted(taken, key=lambda t: (t[0] - t[1], t[0], t[2])):
            if set(range(a, b)) <= left:
                left -= set(range(a, b))
                want.append((a, b, n))
        assert vault.places_of(text, values) == sorted(want)


def test_texts_get_only_the_values_whose_words_they_hold(spark):
    """Before, a text got every value that begins with one of its words, such as all phones of one city."""
    draw = random.Random(3)
    phones = [f"55 {n:04d} {n % 7:04d}" for n in range(300)]
    values = [*phones, "_ana@x.mx", "+52 (55) 0001", "Óscar de la Luz y de la Paz y de la O", "ana"]
    rows = [("a", i, " ".join(draw.choice([*values, "55", "ana_", "oscar", "0001"]) for _ in range(draw.randrange(6)))) for i in range(60)] + [("b", 1, phones[0]), ("a", 99, None)]
    texts = spark.createDataFrame(rows, "scope string, id long, text string")
    kept = spark.createDataFrame([("a", f"[M_{n}]", v) for n, v in enumerate(values)], "scope string, mark string, value string")
    got = {(r.scope, r.id): {k.value for k in r.known} for r in vault._known(texts, kept).collect()}
    for scope, i, text in rows:
        want = {v for v in values if scope == "a" and text and vault.places_of(text, [v])}
        assert want <= got.get((scope, i), set())
        assert all(" ".join(vault.words_of(v)) in " ".join(vault.words_of(text or "") if len(text or "") < 20 else re.findall(r"[^\W_]+", fold(text))) for v in got.get((scope, i), set()))
    assert sum(map(len, got.values())) < 300


def test_passages(spark, tmp_path):
    text = "Para pedir la licencia\nde construcción hay que llenar el formato azul y llevarlo a la ventanilla número tres del palacio antes del lunes"
    rows = [("f1", 1, "Guía", "obras", False, 1, 0, text), ("f2", 1, "Guía", "obras", False, 2, 1, "licencias y más licencias"), ("f3", 2, "Oculto", "obras", True, 1, 0, "licencia"), ("f4", 3, "Otro", "salud", False, 1, 0, "licencia"), ("f5", 4, "Nulo", "obras", None, 1, 0, "licencia"), ("f6", 5, "Vacío", "obras", False, 1, 0, None)]
    rows += [(f"g{i}", 10 + i, "Relleno", "obras", False, 1, 0, "palabras sin relación") for i in range(30)]
    df = spark.createDataFrame(rows, "fragment string, doc long, document string, drawer string, hidden boolean, page int, ordinal int, text string")
    path = f"file://{tmp_path}/index"
    postings.write_index(df, path, folders=4)
    index, texts = postings.read_index(spark, path)
    got = postings.passages(index, texts, "¿La licencia de obra?", 10, 40, "obras").orderBy("score").collect()
    assert [(r.fragment, r.document, r.page) for r in got] == [("f2", "Guía", 2), ("f1", "Guía", 1)] and got[0].score < got[1].score < 0
    assert got[1].snippet == "Para pedir la licencia de construcción hay…" and got[0].snippet == "licencias y más licencias"
    assert [r.fragment for r in postings.passages(index, texts, "licencia", 10, 40).orderBy("fragment").collect()] == ["f1", "f2", "f4"]
    assert [r.fragment for r in postings.passages(index, texts, "licencia", 10, 40, document=3).collect()] == ["f4"]
    assert postings.passages(index, texts, " ", 5, 40) is None and postings.passages(index, texts, "x" * 301, 5, 40) is None
    assert postings.passages(index, texts, "inexistente", 5, 40).count() == 0
    first = sorted((r.doc, r.fragment, r.place) for r in postings.first_fragments(df, 1, "obras").filter("doc < 10").collect())
    assert first == [(1, "f1", 1), (5, "f6", 1)]
    plan = index.filter(postings._asked(["licencia"]))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*prefix", plan) and "StringStartsWith(term,licencia)" in plan
    read = index.filter(postings._asked(["licencia"])).select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all("prefix=li" in r.f for r in read)
