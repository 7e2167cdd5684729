import itertools

import numpy as np
from pyspark.sql import functions as F

from tesela.llm import crf
from tesela.llm.queries import QUERIES


def brute(emission, tie):
    """Marginals by summing over all labelings."""
    n = len(emission)
    weight = {}
    for y in itertools.product((0, 1), repeat=n):
        score = sum(e * k for e, k in zip(emission, y, strict=True)) + sum(tie[a, b] for a, b in zip(y, y[1:], strict=False))
        weight[y] = np.exp(score)
    total = sum(weight.values())
    return [sum(w for y, w in weight.items() if y[t]) / total for t in range(n)], np.log(total)


def test_forward_backward_matches_all_labelings():
    rng = np.random.default_rng(3)
    tie = rng.normal(size=(2, 2))
    sizes = [3, 0, 1, 6, 2]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emission = rng.normal(size=first[-1]) * 2
    good, pairs, norm = crf.forward_backward(emission, first, tie)
    want, logs = [], 0.0
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            marginals, log = brute(emission[a:b], tie)
            want += marginals
            logs += log
    assert np.allclose(good, want) and np.isclose(norm, logs)
    assert np.isclose(pairs.sum(), sum(max(0, n - 1) for n in sizes))


def test_doubling_gives_the_same_messages(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = [700, 1, 0, 65, 2, 513]
    first, tie = np.concatenate([[0], np.cumsum(sizes)]), rng.normal(size=(2, 2))
    emission = rng.normal(size=first[-1]) * 3
    got = crf.forward_backward(emission, first, tie)
    monkeypatch.setattr(crf, "LONG", 10**9)
    want = crf.forward_backward(emission, first, tie)
    assert all(np.allclose(g, w) for g, w in zip(got, want, strict=True))


def test_a_document_of_very_many_lines(spark):
    rows = [(i, "Plain words, here in a line.\nAnother quiet line of words.") for i in range(6)] + [(10 + i, "BUY!! NOW!! BUY!! NOW!!\n### $$$ BUY!!") for i in range(6)]
    docs = spark.createDataFrame([*rows, (30, "Plain words, here in a line.\n" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, 1) for i in range(6)], *[(10 + i, 0) for i in range(6)], (30, 1)], "doc_id long, quality int")
    field = crf.fit(docs, labels, most_lines=500)
    by = {r.doc_id: (r.score, r.n_lines) for r in crf.quality_scores(docs, field).collect()}
    assert by[30][0] > 0.5 > by[10][0] and by[30][1] == 100_000


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op2_quality_classifier"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.filter("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)


def test_edges(spark):
    schema = "doc_id long, text string, score string"
    labelled = [(i, "Plain words, here in a line.\nAnother quiet line of words.", "") for i in range(6)] + [(10 + i, "BUY!! NOW!! BUY!! NOW!!\n### $$$ BUY!! NOW!!", "") for i in range(6)]
    docs = spark.createDataFrame([*labelled, (30, None, "x"), (31, "", "x"), (None, "Plain words.", "x"), (32, " \n\n ", "x"), (32, " \n\n ", "x"), (33, "word " * 200_000, "x")], schema)
    labels = spark.createDataFrame([*[(i, 1) for i in range(6)], *[(10 + i, 0) for i in range(6)], (None, 1), (30, None)], "doc_id long, quality int")
    field = crf.fit(docs, labels)
    rows = crf.quality_scores(docs, field).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[0] > 0.5 > by[10]
    assert by[30] == by[31] == by[32]
    assert crf.fit(docs, labels.limit(0)) is None
    assert {r.score for r in crf.quality_scores(docs, None).collect()} == {0.5}
    assert crf.quality_scores(docs.limit(0), field).count() == 0
    assert crf.with_scores(docs, field).columns == ["doc_id", "text", "score", "n_lines"]
    assert crf.quality_scores(docs.filter(F.col("doc_id") == 32), field).count() == 2
