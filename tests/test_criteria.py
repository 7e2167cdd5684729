"""Checks of answers on hand-worked cases; all values are invented."""

import json

from pyspark.sql import functions as F

from tesela.operators import criteria
from tesela.operators.criteria import Criterion


def test_answers(spark):
    rules = [Criterion("words", (("barra", "apoyo"), ("40",))), Criterion("must", (("puerta",),), hard=True)]
    answers = [(1, json.dumps({"a": ["Barra", {"b": 40}], "c": "PUERTA"}), []), (2, json.dumps(["apoyo", "puerta ana@ejemplo.mx"]), None), (3, "no json", ["9"]), (4, None, None)]
    df = spark.createDataFrame(answers, "id int, json string, odd array<string>")
    told = criteria.checked(df, rules, F.col("odd"))
    got = {}
    for r in told.collect():
        got.setdefault(r.id, {})[r.name] = r.ok
    assert got[1] == {"words": True, "must": True, "no invented figures": True, "nobody identified": True}
    assert got[2] == {"words": False, "must": True, "no invented figures": True, "nobody identified": False}
    assert got[3] == {"words": False, "must": False, "no invented figures": False, "nobody identified": True} and got[4]["must"] is False
    assert {r.id: (r.taken, r.met) for r in criteria.taken(told).collect()} == {1: (True, 4), 2: (False, 2), 3: (False, 1), 4: (False, 2)}


def test_shares(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 3), (3, None, 5), (4, "b", 0), (5, "c", None)], "i int, g string, v int")
    assert {r.i: r.share for r in criteria.shares(rows, ["g"], "v").collect()} == {1: 0.25, 2: 0.75, 3: 1.0, 4: None, 5: None}
