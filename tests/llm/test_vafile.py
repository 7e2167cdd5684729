import math

import duckdb
import numpy as np

from tesela.llm.vafile import OP3_SQL, best_of_block, op3, top_k


def brute(rows, queries, k):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * x) for x in v]
            ints[i] = min(w, ints.get(i, w))
    out = []
    for q in queries:
        if q in ints:
            found = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_table_against_sql(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, op3(spark, sf).collect()))
    assert got and got == sorted(db.sql(OP3_SQL).fetchall())


def test_edges_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(20)] + [(400, None), (401, [None] + [1.0] * 7), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [1.0, 2.0]), (405, [1.0, 3.0]), (406, []), (407, []), (None, [1.0] * 8), (7, [9.0] * 8), (7, [9.0] * 8), (408, [-3e4] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, block int, score string")
    asked = df.filter("vec_id % 10 = 0 or vec_id > 300")
    queries = {i for i, _ in rows if i is not None and (i % 10 == 0 or i > 300)}
    for k, block in ((5, 4096), (3, 40), (400, 64)):
        assert sorted(map(tuple, top_k(df, asked, k, block_rows=block, query_rows=32).collect())) == brute(rows, queries, k)
    assert top_k(df.limit(0), asked).count() == 0 and top_k(df, asked.limit(0)).count() == 0


def test_huge_components_stay_exact(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [1e9, 2.5]), (3, [-1e9, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top = 2**63 - 1
    clamp = [(q, r, i, max(-(2**63), min(top, s))) for q, r, i, s in brute(rows, [0], 3)]
    got = sorted(map(tuple, top_k(df, df.filter("vec_id = 0"), 3).collect()))
    assert [(g[0], g[1], g[3]) for g in got] == [(c[0], c[1], c[3]) for c in clamp]


def test_few_exact_vectors_are_read():
    rng = np.random.default_rng(4)
    exact = rng.integers(-100, 100, (4000, 4))
    low, width = exact.min(axis=0).astype(float), np.full(4, 4.0)
    cells = ((exact - low) // width).astype(np.uint8)
    found = best_of_block(exact[:20], np.arange(20), exact, np.arange(4000), cells, low, width, 5)
    assert len(found[0]) == 100 and found[3] < 0.1 * 20 * 4000
