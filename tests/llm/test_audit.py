import re
from itertools import permutations

import duckdb

from tesela.llm.audit import OP13_SQL, filter_audit, op13

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """Every filter applied, in every order, to every document."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        older = any((j is not None and (i is None or j < i)) and (t or "") == text for j, t, _ in docs)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": older}
        rows.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, shares = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left, gone = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left, gone = [r for r in left if f not in r[1]], gone + removed
                shares[part, f] = shares.get((part, f), 0) + len(removed)
                alone = sum(r[0] == part and r[1] == {f} for r in rows)
                out[part, order, step] = (len(left), len(removed), redundant, alone, sum(r[2] for r in removed), sum(r[3] for r in removed))
    return sorted((*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_tables_against_sql(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = sorted(map(tuple, op13(spark, sf).collect()))
    assert len(got) == 20 * 600 and got == sorted(db.execute(OP13_SQL).fetchall())


def test_edges_against_brute_force(spark):
    many = " ".join(f"w{i}" for i in range(250))
    docs = [(1, many, "a"), (2, many, "a"), (3, many, "b"), (None, many, "b"), (None, "no id", None), (None, "no id", None), (4, None, None), (5, "", ""), (6, " \t\r\n\x0b\x0c ", "a"), (7, "x " * 400, "a"), (8, many.upper(), "b"), (9, many + "   é #", "b"), (9, many + " second", "b"), (9, many + " second", "c"), (10, "tab\tword|\x0bword", "a"), (11, "Very long " * 100_000, "c"), (12, many, None)]
    labels = [(1, 1, 0), (1, 0, 1), (3, None, 1), (5, 1, None), (9, 1, 1), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(i, t, s, 1, "x", 2) for i, t, s in docs], "doc_id long, text string, source string, words int, part string, hi int")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit(frame, marks)
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)
    assert filter_audit(frame, marks.limit(0)).filter("good_lost > 0").count() == 0
    assert filter_audit(frame.limit(0), marks).count() == 0
