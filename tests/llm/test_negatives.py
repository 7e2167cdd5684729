import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tesela.llm.negatives import OP12_SQL, Lists, best, hard_negatives, kmeans, op12


def brute(rows, anchors, positives=5, negatives=10):
    ints = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            row = ([math.floor(256 * x) for x in v], label)
            ints[i] = min(row, ints.get(i, row))
    out = []
    for a in sorted(set(anchors) & set(ints)):
        va, la = ints[a]
        ranked = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, (v, label) in ints.items() if i != a and len(v) == len(va))
        for ps, p, _ in [r for r in ranked if r[2] == la][:positives]:
            inside = [(-s, i) for s, i, label in ranked if label != la and 30 * -ps <= 100 * -s <= 90 * -ps][:negatives]
            out += [(a, p, rank, i, -ps, s) for rank, (s, i) in enumerate(inside, 1)]
    return sorted(out)


def test_table_against_sql(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, op12(spark, sf).collect()))
    assert got and got == sorted(db.execute(OP12_SQL).fetchall())


def test_edges_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) + i % 3).astype("f4").tolist(), i % 4) for i in range(240)]
    rows += [(300 + i, [0.5] * 6, i % 2) for i in range(70)]  # one hot vector, ties throughout
    rows += [(400, None, 1), (401, [None] + [1.0] * 5, 1), (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 2), (404, [1.0] * 6, None), (405, [1.0, 2.0], 0), (406, [2.0, 2.0], 0), (407, [1.0, 1.0], 1), (408, [0.5, 0.5], 1), (409, [], 0), (410, [], 0), (411, [], 1), (None, [1.0] * 6, 1), (7, [9.0] * 6, 2), (7, [9.0] * 6, 1), (412, [-200.0] * 6, 3)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, dim int, slots string")
    anchors = [i for i, _, _ in rows if i is not None and (i % 10 == 0 or i > 360)]
    asked = F.col("vec_id").isin(anchors)
    want = brute(rows, anchors)
    assert {r[0] for r in want} >= {0, 310, 405, 409}
    for clusters, shard, sheet in ((256, 8192, 1024), (5, 16, 7), (1, 40, 1024)):
        assert sorted(map(tuple, hard_negatives(df, asked, clusters=clusters, shard_rows=shard, sheet_rows=sheet).collect())) == want
    few = sorted(map(tuple, hard_negatives(df, asked, positives=1, negatives=500, clusters=9, sample=50).collect()))
    assert few == brute(rows, anchors, 1, 500)
    assert hard_negatives(df.limit(0), asked).count() == 0 and hard_negatives(df, F.lit(False)).count() == 0


def test_huge_components_stay_exact(spark):
    rows = [(0, [1e7, 1.0], 0), (1, [1e7, 2.0], 0), (2, [6e6, 2.5], 1), (3, [-1e7, 0.0], 1), (4, [5e6, 7.25], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hard_negatives(df, F.col("vec_id") < 2).collect())) == brute(rows, [0, 1])


def test_far_lists_are_not_read():
    """On clustered vectors an anchor reads its own list and few others, whatever the number of rows."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(40, 16)) * 200
    near = np.arange(4000) % 40
    matrix = np.rint(middles[near] + rng.normal(size=(4000, 16)) * 5)
    centroids = kmeans(matrix[rng.permutation(4000)[:1000]], 128)
    own = ((centroids**2).sum(axis=1) - 2 * matrix @ centroids.T).argmin(axis=1)
    order = np.argsort(own, kind="stable")
    matrix, own, labels = matrix[order], own[order], near[order]
    span = {int(c): (int(np.searchsorted(own, c)), int(np.searchsorted(own, c, "right"))) for c in np.unique(own)}
    radius = np.array([np.linalg.norm(matrix[slice(*span[c])] - centroids[c], axis=1).max() if c in span else -1.0 for c in range(len(centroids))])
    lists = Lists(centroids, radius, np.zeros(len(radius), int), np.ones(len(radius), int))
    read = 0
    for a in range(0, 4000, 100):
        [(_, names, scores, n)] = best(lists, a, labels[a], matrix[a], [[0, -(1 << 63), (1 << 63) - 1, -(1 << 63)]], np.arange(4000), labels, matrix, span, True, 5)
        all_ = (matrix @ matrix[a]).astype(int)
        want = sorted((-all_[i], i) for i in range(4000) if i != a and labels[i] == labels[a])[:5]
        assert list(zip(-scores, names, strict=True)) == want
        read += n
    assert read < 0.25 * 40 * 4000
