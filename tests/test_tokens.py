"""Readers over tokens against sentences whose meaning the generator knows; all values are invented."""

import datetime
import random

import pyarrow as pa
import pytest

from tesela.functions import tokens
from tesela.functions.arrow import each
from tesela.functions.tokens import MONTHS, Day, Tokens

UNITS = ["uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"]
FILL = ["Ante mí,", "y nada más;", "según el acta", "(sin costo)", "de la mesa", "el mes pasado", "2 testigos", "en mayo", "para todo"]


def words(n):
    """A number under ten thousand in words."""
    small = {w: v for v, w in [(v, w) for w, v in tokens.NUMBERS.items() if w not in ("una", "un", "primero", "primer", "veintiun", "cien", "setiembre")]}
    by_value = {v: w for w, v in small.items()} | {1: "uno"}
    out = []
    if n >= 1000:
        out += ([] if n < 2000 else [by_value[n // 1000]]) + ["mil"]
        n %= 1000
    if n >= 100:
        out.append("cien" if n == 100 else by_value[n // 100 * 100])
        n %= 100
    if n and n in by_value:
        out.append(by_value[n])
    elif n:
        out += [by_value[n // 10 * 10], "y", by_value[n % 10]]
    return out


def test_numbers_in_words_of_every_size():
    for n in range(1, 10_000):
        assert tokens.in_words(words(n)) == n
        assert tokens.leading([*words(n), "folio"]) == n


def test_dates_against_what_was_written():
    draw = random.Random(1)
    for _ in range(2000):
        text, want = [draw.choice(FILL)], []
        for _ in range(draw.randrange(1, 4)):
            d = datetime.date(1950, 1, 1) + datetime.timedelta(draw.randrange(50_000))
            month = draw.choice([MONTHS[d.month - 1], MONTHS[d.month - 1].upper()])
            spelled = " ".join(words(d.day))
            text.append(
                draw.choice(
                    [
                        f"el {d.day} de {month} de {d.year}", f"{d.day} de {month} del {d.year},", f"{d.day:02d}/{d.month:02d}/{d.year}.",
                        f"a los {spelled} días del mes de {month} de {' '.join(words(d.year))}", f"el {spelled} de {month} del año {' '.join(words(d.year))};",
                    ]
                )
            )
            want.append(d.isoformat())
            text.append(draw.choice(FILL))
        want = [w for i, w in enumerate(want) if i == 0 or want[i - 1] != w]
        assert tokens.dates(" ".join(text)) == want, text


def span(s):
    return (s.start, s.end)


def test_days_in_every_form_against_what_was_written():
    draw = random.Random(2)
    for _ in range(3000):
        text, want = [], []
        for _ in range(draw.randrange(1, 4)):
            d = datetime.date(1990, 1, 1) + datetime.timedelta(draw.randrange(30_000))
            m, y, to = MONTHS[d.month - 1], d.year, draw.randrange(1, 29)
            m = draw.choice([m, m.title(), m[:3], m[:3] + "."])
            joint = draw.choice(["al", "a", "-", "–"])
            forms = [
                (d.isoformat(), Day(y, d.month, d.day), None),
                (f"{d.day}{draw.choice('/.-')}{d.month}{draw.choice('/.-')}{y}", Day(y, d.month, d.day), None),
                (f"{d.day} {joint} {to} de {m} de {y}", Day(y, d.month, d.day), Day(y, d.month, to)),
                (f"{d.day} {joint} {to} {m}", Day(None, d.month, d.day), Day(None, d.month, to)),
                (f"{m} {d.day} {joint} {to}, {y}", Day(y, d.month, d.day), Day(y, d.month, to)),
                (f"{d.day} de {m}, {y}", Day(y, d.month, d.day), None),
                (f"{d.day} {m}", Day(None, d.month, d.day), None),
                (f"{m} {d.day} de {y}", Day(y, d.month, d.day), None),
                (f"{m} {d.day}", Day(None, d.month, d.day), None),
                (f"{m} de {y}", Day(y, d.month, None), None),
            ]
            said, start, end = draw.choice(forms)
            text += [draw.choice(["se entrega", "o bien", "El fallo será"]), said, draw.choice(["; luego", "sin falta", "(ver bases)"])]
            want.append((start, end))
        got = [span(s) for s in tokens.days(Tokens(" ".join(text)))]
        assert got == want, text


def test_two_days_that_are_one_range():
    one = lambda t: [span(s) for s in tokens.days(Tokens(t))]
    assert one("22 de junio al 15 de julio de 2026") == [(Day(2026, 6, 22), Day(2026, 7, 15))]
    assert one("20 de diciembre hasta el 6 de enero de 2027") == [(Day(2026, 12, 20), Day(2027, 1, 6))]
    assert one("1 de marzo y 4 de marzo") == [(Day(None, 3, 1), None), (Day(None, 3, 4), None)]
    assert one("31 de febrero, 12/13/2020, 40 de mayo, mayo, 2020") == []
    assert one("A12/05/2020 y 12/05/2020b") == [] and one("") == []


def test_days_of_milestones():
    day = lambda d, time=None, inferred=False: {"date": d, "time": time, "precision": "day", "inferred": inferred}
    assert tokens.date("el 3 de mayo a las 9:30 hrs", 2027) == day("2027-05-03", "09:30", True)
    assert tokens.date("el 3 de mayo", None) == {"date": None, "time": None, "precision": "unreadable", "inferred": False}
    assert tokens.date("mayo de 2026", 2027) == {"date": None, "time": None, "precision": "month", "inferred": False}
    assert tokens.date("sin fecha", 2027) is None
    assert tokens.milestone("16 al 23 de mayo de 2026", None, "", 2027) == {"start": day("2026-05-16"), "end": day("2026-05-23")}
    assert tokens.milestone(" ", "", "del 1 de abril al 2 de mayo de 2026 a las 24:00 o 8:05", None) == {"start": day("2026-04-01", "08:05"), "end": day("2026-05-02")}
    assert tokens.milestone("pronto", "ya", "abre el 1 de abril", 2027) == {"start": day("2027-04-01", None, True), "end": None}
    assert tokens.milestone("pronto", "1 de abril", "nunca", 2027) is None


@pytest.mark.parametrize(
    ("text", "pesos", "want"),
    [
        ("$250,000 pesos", True, (250000.0, "MXN")), ("hasta $300,000.00 (Trescientos mil pesos 00/100 M.N.)", True, (300000.0, "MXN")), ("300 mil pesos", True, (300000.0, "MXN")),
        ("1.5 millones de pesos", True, (1500000.0, "MXN")), ("USD 50,000", True, (50000.0, "USD")), ("sin cifra alguna", True, None), ("$40,000", False, (40000.0, "XXX")),
        ("son 250 000", True, (250000.0, "XXX")), ("el 5 de 20 de $ 7", True, (7.0, "MXN")), ("€1,5", True, (1.5, "EUR")), ("12km y 3", True, None), ("1234,567 pesos", True, (1234567.0, "MXN")), ("42 ", True, None),
    ],
)
def test_amounts(text, pesos, want):
    assert tokens.amount(text, pesos) == want


def test_shares_times_and_counts():
    assert [tokens.percent(t) for t in ("mínima del 30%", "el 12.5 por ciento", "treinta por ciento", "el 130%", "treinta y cinco porciento", "1,000%", "por mucho", "nada %")] == [30.0, 12.5, 30.0, None, 35.0, None, None, None]
    assert [tokens.duration(t) for t in ("hasta 12 meses", "por un año", "dos años", "quince días hábiles", "1.5 años", "0 días, 5 semanas", "treinta y un días", "nada", "3 mesas")] == [(12.0, "months"), (1.0, "years"), (2.0, "years"), (15.0, "days"), (1.5, "years"), (5.0, "weeks"), (31.0, "days"), None, None]
    assert [tokens.whole(t) for t in ("30 puntos", "1,000 puntos", "tres", "ninguno", "1,00 y 2", "mil")] == [30, 1000, 3, None, 1, 1000]


def test_whole_numbers_against_a_walk_over_tokens():
    def walked(text):
        t = Tokens(text)
        i = next((i for i in range(len(t)) if t.digits(i)), None)
        if i is None:
            return next((tokens.NUMBERS.get(w, 1000) for w in t.text.split() if w in tokens.NUMBERS or w == "mil"), None)
        digits, j = t.word[i], i + 1
        while len(t.word[i]) <= 3 and t.at(j) == "," and t.glued(j) and t.glued(j + 1) and t.digits(j + 1, 3, 3):
            digits, j = digits + t.word[j + 1], j + 2
        return int(digits)

    draw = random.Random(8)
    for _ in range(5000):
        text = "".join(draw.choice(["1", "250", "1,250", ",000", ",", " ", ".", "a", "_", "tres ", "Mil ", "x" * 3, "9" * 98, "٣", "é"]) for _ in range(draw.randrange(9)))
        assert tokens.whole(text) == walked(text), text


def test_each_different_short_text_is_read_once():
    """Before, equal texts of a batch were read again and again."""
    seen = []
    read = lambda t: seen.append(t) or (None if t is None else [t, t.upper()])
    column = pa.array(["a", None, "b", "a", "a", None, "b", "a"] * 100)
    want = [None if t is None else [t, t.upper()] for t in column.to_pylist()]
    got = each(read, pa.list_(pa.string()), column)
    assert got.to_pylist() == want and got.type == pa.list_(pa.string()) and sorted(map(str, seen)) == ["None", "a", "b"]
    for few in ([], ["a"], ["a", "b"], ["x" * 1000] * 3):
        assert each(read, pa.list_(pa.string()), pa.array(few, pa.string())).to_pylist() == [[t, t.upper()] for t in few]
    assert each(lambda a, b: a + b, pa.int64(), pa.array([1, 1]), pa.array([2, 3])).to_pylist() == [3, 4]
