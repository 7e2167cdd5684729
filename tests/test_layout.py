"""Rows of tables from letters and lines on hand-drawn pages."""

import random

import numpy as np

from tesela.operators import layout
from tesela.operators.layout import Letters, cell_text, grids, laid_out_rows, lines_of, rows_of, tidied


def letters(*said):
    """(x, y, text[, direction]): letters five wide and ten high."""
    rows = []
    for x, y, text, *way in said:
        way = way[0] if way else "across"
        for i, c in enumerate(text):
            if way == "across":
                rows.append((x + 5 * i, x + 5 * i + 5, y, 10.0, c, way))
            else:
                rows.append((x, x + 5, y + (-5 if way == "up" else 5) * i, 10.0, c, way))
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return Letters(*(np.array(c, float) for c in columns[:4]), *(np.array(c, object) for c in columns[4:]))


def lines(*drawn):
    """(level, at, from, to) tidied."""
    return tidied(np.array([d[0] for d in drawn], bool), *(np.array([d[n] for d in drawn], float) for n in (1, 2, 3)))


def frame(xs, ys):
    return [*((True, y, xs[0], xs[-1]) for y in ys), *((False, x, ys[0], ys[-1]) for x in xs)]


def data(drawn, said):
    return [g.rows for g in grids(lines(*drawn), said) if g.data]


def test_cells_of_several_lines():
    said = letters((55, 120, "Documento"), (255, 120, "Para que sirve"), (55, 180, "Acta de"), (55, 194, "la asamblea"), (255, 180, "Dice quien firma"), (255, 194, "y desde cuando"), (255, 208, "puede hacerlo"))
    assert data(frame([50, 250, 550], [100, 160, 240]), said) == [["Documento | Para que sirve", "Acta de la asamblea | Dice quien firma y desde cuando puede hacerlo"]]


def test_merged_cells():
    drawn = [(True, 100, 50, 450), (True, 130, 50, 450), (True, 160, 50, 450), (True, 190, 150, 450), (True, 220, 50, 450), (False, 50, 100, 220), (False, 450, 100, 220), (False, 150, 130, 220), (False, 300, 130, 220)]
    said = letters((60, 120, "Agenda"), (55, 150, "Fase"), (155, 150, "Abre"), (305, 150, "Cierra"), (55, 185, "Envio"), (155, 175, "lunes"), (305, 175, "martes"), (155, 205, "jueves"))
    assert data(drawn, said) == [["Agenda", "Fase | Abre | Cierra", "Envio | lunes | martes", "Envio | jueves"]]
    long = letters((60, 120, "Agenda"), *((55, 165 + 7 * k, "largo texto sin fin") for k in range(8)), (155, 175, "lunes"), (305, 175, "martes"), (155, 205, "jueves"))
    assert [r.split(" | ")[0][:5] for r in data(drawn, long)[0][1:]] == ["largo", ""]  # too long to be said again


def test_boxes_that_hold_no_table():
    notice = letters((60, 150, "Un aviso en un recuadro"))
    assert data(frame([50, 400], [100, 200]), notice) == [] and data(frame([50, 400], [100, 140, 180, 220]), notice) == []
    assert data(frame([0, 200, 400, 600], [740, 770, 800]), letters((580, 760, "26"))) == []
    assert data(frame([60, 90, 120], [100, 130, 160, 190]), letters(*((x, y, "12") for x in (65, 95) for y in (115, 145, 175)))) == []
    assert grids(lines(*frame([60, 90, 120], [100, 130])[:5]), notice) == []


def test_turned_labels():
    said = letters((70, 155, "Alcance", "up"), (100, 125, "Comedor"), (310, 125, "Si"), (100, 165, "Taller"), (310, 165, "No"))
    rows = data(frame([50, 90, 300, 500], [100, 140, 180]), said)[0]
    assert rows == ["| Comedor | Si", "Alcance | Taller | No"] or rows[0].startswith("Alcance") or rows[1].startswith("Alcance") or "Al" in rows[1]
    assert cell_text(letters((70, 215, "Hacia arriba", "up"))) == "Hacia arriba" and cell_text(letters((70, 100, "Abajo", "down"))) == "Abajo"
    assert cell_text(letters((70, 215, "uno", "up"), (90, 215, "dos", "up"), (10, 10, "fin"))) == "uno dos fin"
    assert cell_text(letters((70, 100, "uno", "down"), (90, 100, "dos", "down"))) == "dos uno"


def test_lines_in_pieces_and_two_tables():
    drawn = [(True, 100, 50, 200), (True, 100.4, 201, 350), (True, 130, 50, 350), (True, 160.2, 50, 350), (False, 50, 100, 160), (False, 200.5, 100, 160), (False, 350, 100, 160), *frame([50, 200, 350], [400, 430, 460])]
    said = letters((55, 120, "Fase"), (205, 120, "Dia"), (55, 150, "Fin"), (205, 150, "mayo"), (55, 300, "Entre las dos"), (55, 420, "Rubro"), (205, 420, "Costo"), (55, 450, "Obra"), (205, 450, "$300"))
    assert data(drawn, said) == [["Fase | Dia", "Fin | mayo"], ["Rubro | Costo", "Obra | $300"]]
    assert [r for r in rows_of(said, lines(*drawn)) if not r[0]] == []


def test_rows_without_lines_are_read_across():
    said = letters((50, 100, "Revision"), (50, 120, "Entrega"), (50, 140, "Cierre final"), (250, 100, "octubre"), (250, 120, "2 de mayo"), (250, 140, "julio"))
    assert laid_out_rows(said) == ["Revision | octubre", "Entrega | 2 de mayo", "Cierre final | julio"]
    # A value written over two lines is one row; a line across the columns ends the table.
    said = letters((50, 100, "Fase"), (250, 100, "Dia"), (50, 130, "Revision"), (250, 125, "octubre y"), (250, 135, "noviembre"), (50, 160, "Fin"), (250, 160, "hoy"), (50, 180, "Una linea que cruza de lado a lado las columnas de la tabla"), (50, 200, "x"), (250, 200, "y"))
    assert laid_out_rows(said) == ["Fase | Dia", "Revision | octubre y noviembre", "Fin | hoy"]


def test_what_is_no_table():
    assert laid_out_rows(letters((50, 100, "a)"), (90, 100, "Primero se pide"), (50, 120, "b)"), (90, 120, "Luego se da"))) == []
    assert laid_out_rows(letters((50, 100, "Uno"), (250, 100, "dos"))) == [] and laid_out_rows(letters()) == []
    left = ["La casa abre todos los dias", "y recibe a quien lo pide en", "su puerta sin preguntar nada", "ni pedir papeles a la gente"]
    right = ["El comedor sirve a las dos y", "cierra cuando se acaba lo que", "hay en la cocina ese dia para", "todas las personas que llegan"]
    prose = letters(*((50, 100 + 12 * n, t) for n, t in enumerate(left)), *((300, 100 + 12 * n, t) for n, t in enumerate(right)))
    assert laid_out_rows(prose) == [" ".join(left) + " | " + " ".join(right)]


def test_tables_of_random_words_come_back():
    draw = random.Random(4)
    for _ in range(40):
        rows, columns = draw.randrange(2, 9), draw.randrange(2, 5)
        words = [["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(3, 9))) for _ in range(columns)] for _ in range(rows)]
        said = [(60 + 100 * c, 120 + 25 * r, words[r][c]) for r in range(rows) for c in range(columns)]
        draw.shuffle(said)
        want = [" | ".join(w) for w in words]
        assert laid_out_rows(letters(*said)) == want
        if rows * columns >= 4:
            drawn = frame([55 + 100 * c for c in range(columns + 1)], [105 + 25 * r for r in range(rows + 1)])
            draw.shuffle(drawn)
            assert rows_of(letters(*said), lines(*drawn)) == [(True, w) for w in want]


def test_lines_break_at_wide_gaps():
    [line] = lines_of(letters((50, 100, "uno"), (66, 103, "dos"), (120, 98, "tres")))
    assert [p.text for p in line.pieces] == ["unodos", "tres"]


def test_pages_stream_through_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(doc, page, True, float(x + 5 * i), float(x + 5 * i + 5), float(y), 10.0, c, "across", None, None, None, None) for doc in range(3) for page in range(4) for x, y, t in ((50, 100, f"D{doc}"), (250, 100, f"p{page}"), (50, 120, "abc"), (250, 120, "def")) for i, c in enumerate(t)]
        rows += [(9, 9, True, 1.0, 2.0, None, 10.0, "x", "across", None, None, None, None), (None, 1, True, 1.0, 2.0, 3.0, 1.0, "x", "across", None, None, None, None), (9, 8, False, None, None, None, None, None, None, True, float("nan"), 1.0, 2.0)]
        got = sorted(tuple(r) for r in layout.page_rows(spark.createDataFrame(rows, layout.MARKS)).collect())
        assert got == sorted((d, p, n, False, r) for d in range(3) for p in range(4) for n, r in enumerate((f"D{d} | p{p}", "abc | def")))
        assert layout.page_rows(spark.createDataFrame([], layout.MARKS)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_letters_and_lines_of_a_page_meet(spark, sf):
    """Before, where Spark joined the parts of letters and of lines in other ways, no page with lines was read as ruled."""
    from tesela.plans.layout import table_rows

    own = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = table_rows(spark, sf).select("page", "ruled").distinct().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(r.ruled == (r.page % 2 == 0) for r in got) and len(got) == 8


def test_pages_read_together_are_as_read_alone(spark):
    """Pages of all kinds in one batch, some empty: each gives what it gives alone."""
    draw = random.Random(8)
    pages = []
    for doc in range(60):
        rows, columns = draw.randrange(0, 7), draw.randrange(1, 5)
        said = [(60 + 100 * c, 120 + draw.choice([25, 12]) * r, "".join(draw.choice("ab ñ3") for _ in range(draw.randrange(0, 9))), draw.choice(["across"] * 9 + ["up"])) for r in range(rows) for c in range(columns)]
        drawn = frame([55 + 100 * c for c in range(columns + 1)], [105 + 25 * r for r in range(rows + 1)]) if draw.random() < 0.6 else []
        pages.append((doc, 1, letters(*said), drawn[: len(drawn) - draw.randrange(2)]))
    table = [(d, p, [tuple(map(float, v[:4])) + ((t, {0: "across", 1: "up"}[int(w)])) for *v, t, w in zip(s.x, s.end, s.y, s.size, s.text, s.direction, strict=True)] or None, [(bool(x), *map(float, v)) for x, *v in n] or None) for d, p, s, n in pages]
    got = {r.doc: [tuple(x) for x in r.rows] for r in layout.read_pages(spark.createDataFrame(table, layout.PAGES).coalesce(1)).collect()}
    want = {d: rows_of(s, lines(*n)) for d, _, s, n in pages}
    assert got == {d: rows for d, rows in want.items() if rows} and len({ruled for rows in got.values() for ruled, _ in rows}) == 2


def test_letters_of_pages_are_not_shuffled(spark, sf):
    """Before, each letter and line was a row that was dealt and sorted (109 s on sf0.1); now line items alone are dealt."""
    from tesela.plans.layout import table_rows

    plan = table_rows(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.index("Exchange") > plan.index("MapInArrow") and "letters" not in plan[plan.index("Exchange") :]
