"""Forms over JSON answers on hand-worked cases; all values are invented."""

import json

from tesela.operators import forms
from tesela.operators.forms import Field, When

FORM = [
    Field("name", required=True, step="a"), Field("kind", "select", ("x", "y"), required=True, step="a"), Field("ways", "multi", ("x", "y", "z"), step="a"), Field("n", "number", least=2, most=9, step="b"), Field("pay", "money", step="b"),
    Field("year", "year", least=1900, most=2030, step="b"), Field("ok", "yes_no", step="b"), Field("day", "date", step="b"), Field("a.cp", rule="postal_code", step="b"), Field("why", required=True, when=When("ok"), step="c"), Field("how", when=When("ways", ("x", "z")), required=True, step="c"), Field("which", when=When("kind", ("y",)), required=True, step="c"),
]


def run(spark, *answers):
    rows = spark.createDataFrame([(i, a if a is None or isinstance(a, str) else json.dumps(a)) for i, a in enumerate(answers)], "i int, answers string")
    out = [set() for _ in answers]
    for r in forms.issues(rows, "i", FORM).collect():
        out[r.i].add((r.field, r.code, r.blocking))
    return rows, out


def test_issues(spark):
    missing = {("name", "missing", False), ("kind", "missing", False)}
    _, got = run(
        spark,
        {"name": " Ana ", "kind": "x", "ways": ["y"], "n": 2, "pay": 0, "year": 2000, "ok": None, "day": "2024-02-29", "a.cp": " 01234 "},
        {"name": 5, "kind": "q", "ways": ["x", "x"], "n": 1, "pay": -1, "year": 1800, "ok": "si", "day": "2023-02-29", "a.cp": "123"},
        {"name": " \n", "kind": ["x"], "ways": ["x", 3], "n": 10, "pay": 1.5, "year": "2000", "ok": False, "day": 3},
        {"name": "A", "kind": "y", "ways": ["q"], "n": -3, "other": 1, "which": "w", "how": ""},
        None, "no json", {}, "[]",
    )
    assert got[0] == set()
    assert got[1] == {("name", "wrong_type", True), ("kind", "code_unknown", True), ("ways", "repeated", True), ("n", "number_too_small", True), ("pay", "negative_number", True), ("year", "year_invalid", True), ("ok", "wrong_type", True), ("day", "date_invalid", True), ("a.cp", "postal_code_invalid", True), ("why", "missing", False), ("how", "missing", False)}
    assert got[2] == {("name", "missing", False), ("kind", "wrong_type", True), ("ways", "wrong_type", True), ("n", "number_too_large", True), ("pay", "wrong_type", True), ("year", "wrong_type", True), ("day", "wrong_type", True), ("why", "missing", False), ("how", "missing", False)}
    assert got[3] == {("ways", "code_unknown", True), ("n", "negative_number", True)}
    assert got[4] == got[5] == got[6] == got[7] == missing


def test_hidden_values_and_progress(spark):
    rows, _ = run(spark, {"name": "A", "kind": "y", "which": "w", "how": "h", "why": "b", "odd": 1, "n": 3}, {})
    kept = {r.i: r.kept for r in forms.cleared(rows, "i", FORM).collect()}
    assert kept == {0: {"name": '"A"', "kind": '"y"', "which": '"w"', "n": "3"}, 1: {}}
    told = {(r.i, r.step): (r.applying, r.filled, r.percent) for r in forms.progress(rows, "i", FORM).collect()}
    assert told == {(0, "a"): (3, 2, 40), (0, "b"): (6, 1, 40), (0, "c"): (1, 1, 40), (1, "a"): (3, 0, 0), (1, "b"): (6, 0, 0), (1, "c"): (0, 0, 0)}
    assert forms.progress(rows, "i", [Field("x", when=When("nothing"))]).first().percent == 100
