"""Proposals and prepared changes against folds by hand; all values are invented."""

import random

import pytest
from pyspark.sql import functions as F

from tesela.operators import changes, proposals
from tesela.operators.fold import folded

EVENT = "form string, record string, field string, at long, id long, kind string, target long, value string, origin string, rank long"


def told(spark, rows):
    return {r.id: (r.outcome, r.waiting) for r in proposals.outcomes(spark.createDataFrame(rows, EVENT)).collect()}


def propose(id_, value, origin="document", rank=1, field="f"):
    return ("perfil", None, field, id_, id_, "propose", None, value, origin, rank)


def decide(id_, kind, target=None, value=None, field="f"):
    return ("perfil", None, field, id_, id_, kind, target, value, None, None)


def test_what_is_refused_and_what_waits(spark):
    rows = [
        propose(1, "azul", rank=2), propose(2, "rojo", rank=1), propose(3, "verde", rank=2), propose(4, "gris", "ai", None), propose(5, "rojo", rank=None), propose(6, " "), propose(7, None, "ai"),
        decide(8, "accept", 3), decide(9, "reject", 5), decide(10, "reject", 5), propose(11, "rojo"), propose(12, "rojo", "ai"), decide(13, "save", value="blanco"), propose(14, "azul"), decide(15, "accept", 12), decide(16, "save"), propose(17, "azul"),
        propose(18, "otro", field="g"), decide(19, "save", value="suyo", field="g"), propose(20, "otro", field="g"), decide(21, "save", field="g"), propose(22, "otro", field="g"),
    ]
    want = {
        "1": ("kept", "1"), "2": ("lower_authority", "1"), "3": ("kept", "3"), "4": ("kept", "4"), "5": ("kept", "5"), "6": ("empty", "5"), "7": ("empty", "5"), "8": ("not_waiting", "5"), "9": ("rejected", None), "10": ("not_waiting", None),
        "11": ("rejected_before", None), "12": ("kept", "12"), "13": ("saved", "12"), "14": ("filled", "12"), "15": ("accepted", None), "16": ("saved", None), "17": ("kept", "17"),
        "18": ("kept", "18"), "19": ("rejected", None), "20": ("filled", None), "21": ("saved", None), "22": ("rejected_before", None),
    }
    assert told(spark, rows) == want
    assert told(spark, rows + rows[:9]) == want  # replayed
    assert told(spark, []) == {} and told(spark, [("perfil", None, "f", None, 1, "propose", None, "x", "ai", 1), ("perfil", None, "f", 1, 2, "odd", None, "x", "ai", 1)]) == {}
    status = {r.id: (r.status, r.value) for r in proposals.status(spark.createDataFrame(rows, EVENT), frozenset("f")).collect()}
    assert status["1"] == ("replaced", None) and status["5"] == ("rejected", None) and status["12"] == ("accepted", None) and status["17"] == ("pending", "azul") and status["18"] == ("rejected", "otro") and "2" not in status


def slow(rows):
    """Outcomes by scanning all earlier events anew for each event."""
    out = {}
    for e in sorted(rows, key=lambda e: (e[3], e[4])):
        _, _, field, _, id_, kind, target, value, origin, rank = e
        before = [(x, out[str(x[4])][0]) for x in sorted(rows, key=lambda e: (e[3], e[4])) if x[2] == field and (x[3], x[4]) < (e[3], e[4])]
        by_id = {x[4]: x for x, _ in before}
        filled, refused, waiting = False, set(), None
        for x, o in before:
            if o == "kept":
                waiting = x[4]
            elif o in ("accepted", "rejected"):
                if o == "rejected" and by_id[waiting][8] == "document":
                    refused.add(by_id[waiting][7])
                filled = True if o == "accepted" else filled
                waiting = None
            if x[5] == "save":
                filled = x[7] is not None
        wait = by_id.get(waiting)
        if kind == "propose":
            doc = origin == "document"
            o = "empty" if value is None else "filled" if doc and filled else "rejected_before" if doc and value in refused else "lower_authority" if doc and wait and wait[8] == "document" and wait[9] > rank else "kept"
        elif kind == "save":
            o = "rejected" if value is not None and wait and wait[8] == "document" else "saved"
        else:
            o = ("accepted" if kind == "accept" else "rejected") if waiting is not None and waiting == target else "not_waiting"
        out[str(id_)] = (o, str(id_) if o == "kept" else None if o in ("accepted", "rejected") or waiting is None else str(waiting))
    return out


def test_hot_field_against_brute_force(spark):
    draw = random.Random(7)
    rows = []
    for i in range(500):
        field = "hot" if draw.random() < 0.6 else f"f{draw.randrange(20)}"
        kind = draw.choice(["propose"] * 5 + ["accept", "reject", "save"])
        value = draw.choice(["a", "b", "c", "d", "e", "f", None]) if kind in ("propose", "save") else None
        rows.append(("perfil", None, field, i // 2, i, kind, i - draw.randrange(1, 4), value, draw.choice(["document", "document", "ai"]), draw.randrange(3)))
    want = slow(rows)
    draw.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        assert told(spark, rows) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {o for o, _ in want.values()} == {"kept", "empty", "filled", "rejected_before", "lower_authority", "accepted", "rejected", "not_waiting", "saved"}


def test_fold_keeps_null_keys_together(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 1), (None, 3)], "k string, n int")
    count = lambda s, r: s.append(r["n"]) or {"k": r["k"], "seen": list(s)}
    got = sorted((r.k or "", r.seen) for r in folded(df, ["k"], ["n"], lambda r: [], count, "k string, seen array<int>").collect())
    assert got == [("", [1]), ("", [1, 2]), ("", [1, 2, 3]), ("a", [1])]


def test_fold_carries_columns_and_reads_first_ones_once(spark):
    """Before, every column of every event became a Python value."""
    rows = [("a", i, f"x{i}", "s" if i else "begin") for i in range(40)] + [("b", 1, None, "other")]
    df = spark.createDataFrame(rows, "k string, n int, carry string, head string")

    def step(state, row):
        assert set(row) == {"k", "n"}
        return {"was": state} if row["n"] % 2 else None

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in folded(df, ["k"], ["n"], lambda r: r["head"], step, "carry string, k string, was string", ["carry", "k"], ["head"]).collect() if r.carry)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((f"x{i}", "a", "begin") for i in range(1, 40, 2))


CHANGE = "seq long, change string, entity string, base_version long, values map<string,string>, approved string, valid boolean, fact string, origin string, at timestamp"


def change(seq, entity, base, values, approved=None, valid=True):
    return (seq, f"chg{seq}", entity, base, values, approved, valid, "hecho", "person", None)


@pytest.fixture
def ledger(tmp_path):
    return f"file://{tmp_path}/ledger"


def outcomes(spark, ledger, rows):
    out = changes.decided(changes.read_ledger(spark, ledger), spark.createDataFrame(rows, CHANGE), frozenset(["secreto"]))
    return {r.change: (r.outcome, r.version) for r in out.collect()}


def test_changes_apply_once_and_never_stale(spark, ledger):
    rows = [
        change(1, "n1", 0, {"a": "x", "secreto": "1"}), change(2, "n1", 0, {"a": "y"}), change(3, "n1", 1, {"a": "x"}), change(4, "n1", 1, {"a": "z", "b": None}, valid=False), change(5, "n1", 1, {"b": "w"}), change(6, "n1", 0, {"secreto": "1", "a": "x"}),
        change(7, "n2", 0, {"a": "x"}, approved="not mine"), change(8, "n2", 1, {"a": "x"}), change(9, "n2", 0, {}), change(10, "n3", 0, {"a": "x"}), change(11, None, 0, {"a": "x"}), change(12, "n4", None, {"a": "x"}),
    ]
    want = {"chg1": ("applied", 1), "chg2": ("prepare_again", None), "chg3": ("nothing_to_change", None), "chg4": ("invalid", None), "chg5": ("applied", 2), "chg6": ("already_applied", 1), "chg7": ("prepare_again", None), "chg8": ("prepare_again", None), "chg9": ("nothing_to_change", None), "chg10": ("applied", 1), "chg12": ("prepare_again", None)}
    assert outcomes(spark, ledger, rows) == want and outcomes(spark, ledger, rows + rows[:3]) == want
    frame = spark.createDataFrame(rows, CHANGE)
    changes.apply_batch(spark, ledger, "b1", frame, frozenset(["secreto"]))
    first = sorted(map(str, changes.read_ledger(spark, ledger).collect()))
    for again in ("b1", "b2"):
        changes.apply_batch(spark, ledger, again, frame, frozenset(["secreto"]))
        assert sorted(map(str, changes.read_ledger(spark, ledger).collect())) == first
    later = outcomes(spark, ledger, [*rows, change(13, "n1", 2, {"a": "q", "secreto": "2"}), change(14, "n1", 2, {"a": "r"})])
    assert {later[f"chg{n}"] for n in (1, 6)} == {("already_applied", 1)} and later["chg5"] == ("already_applied", 2) and later["chg13"] == ("applied", 3) and later["chg14"] == ("prepare_again", None)
    changes.apply_batch(spark, ledger, "b3", spark.createDataFrame([change(13, "n1", 2, {"a": "q", "secreto": "2"})], CHANGE), frozenset(["secreto"]))
    held = {r.entity: (r.version, r.held) for r in changes.current(changes.read_ledger(spark, ledger)).collect()}
    assert held == {"n1": (3, {"a": "q", "b": "w", "secreto": "2"}), "n3": (1, {"a": "x"})}
    steps = sorted((r.entity, r.version, r.field, r.before, r.after, r.protected) for r in changes.history(changes.read_ledger(spark, ledger)).collect())
    assert steps == [("n1", 1, "a", None, "x", False), ("n1", 1, "secreto", None, None, True), ("n1", 2, "b", None, "w", False), ("n1", 3, "a", "x", "q", False), ("n1", 3, "secreto", None, None, True), ("n3", 1, "a", None, "x", False)]
    assert {r.change for r in changes.outbox(changes.read_ledger(spark, ledger)).collect()} == {"chg1", "chg5", "chg10", "chg13"}


def test_a_batch_cut_short_is_not_read(spark, ledger, tmp_path):
    frame = spark.createDataFrame([change(1, "n1", 0, {"a": "x"})], CHANGE)
    changes.apply_batch(spark, ledger, "b1", frame)
    (tmp_path / "ledger" / "b1" / "_SUCCESS").unlink()
    assert changes.read_ledger(spark, ledger).count() == 0 and outcomes(spark, ledger, [change(1, "n1", 0, {"a": "x"})]) == {"chg1": ("applied", 1)}
    changes.apply_batch(spark, ledger, "b1", frame)
    assert changes.read_ledger(spark, ledger).count() == 1


def test_fingerprints(spark):
    rows = [("n", 3, {"a": "1", "b": "2"}), ("n", 3, {"b": "2", "a": "1"}), ("n", 4, {"a": "1", "b": "2"}), ("m", 3, {"a": "1", "b": "2"}), ("n", 3, {"a": "1", "b": "3"})]
    got = [r.p for r in spark.createDataFrame(rows, "e string, b int, v map<string,string>").select(changes.fingerprint(F.col("e"), F.col("b"), F.col("v")).alias("p")).collect()]
    assert got[0] == got[1] and len(set(got)) == 4 and all(len(p) == 64 for p in got)


def test_where_proposals_come_from(spark):
    refs = [(1, '{"document_id": "d1", "page": 3, "quote": "x"}'), (2, '{"quote": "dijo"}'), (3, "no json"), (4, None), (5, '{"document_id": "gone"}')]
    docs = spark.createDataFrame([("d1", "Acta")], "id string, name string")
    got = {r.id: (r.document, r.page, r.said) for r in proposals.named_documents(spark.createDataFrame(refs, "id int, source_ref string"), docs).collect()}
    assert got == {1: ("Acta", 3, None), 2: (None, None, "dijo"), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None)}
    known = spark.createDataFrame([(1, "document")], "id int, origin string")
    assert {r.id: r.origin for r in proposals.origins(spark.range(1, 3), known, ["id"]).collect()} == {1: "document", 2: "user"}
