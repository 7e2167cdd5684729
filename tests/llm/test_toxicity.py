import numpy as np
from pyspark.sql import functions as F

from tesela.llm import toxicity as tox
from tesela.llm.queries import QUERIES


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    margin, y = rng.normal(size=40), rng.integers(0, 2, 40)
    x, p = tox.isotonic(margin, y, np.ones(40))
    assert (np.diff(p) >= -1e-12).all() and (np.diff(x) >= 0).all()
    # The fit's mean is the labels' mean, up to the smoothing of the pools.
    assert abs(np.interp(margin, x, p).mean() - y.mean()) < 0.15


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = tox.boost(x[:2000], y[:2000], np.ones(2000))
    assert ((model.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_obfuscated_insults_are_read():
    for text in ("you 1d1ot", "you i d i o t !", "You ID!OT.", "m0r0n"):
        assert tox.features(text, {})[0] > 0 and tox.features(text, {})[5] > 0, text
    assert tox.features("a quiet day", {})[0] == 0
    near, far = tox.features("you idiot", {})[7], tox.features("you " + "word " * 30 + "idiot", {})[7]
    assert near > far > 0


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op8_toxicity"](spark, sf).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.85 * len(rows)


def test_edges(spark):
    clean = [(i, f"A quiet day number {i} by the river.", 0) for i in range(20)]
    rude = [(100 + i, f"You stupid clown number {i}, you idiot", 1) for i in range(20)]
    docs = spark.createDataFrame([*clean, *rude, (300, None, 0), (301, "", 0), (None, "you idiot", 0), (302, "calm " * 100_000, 0), (302, "calm " * 100_000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, t) for i, _, t in [*clean, *rude]] + [(None, 1), (301, None)], "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    rows = tox.toxicity_scores(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[105] > 0.5 > by[5] and by[300] == by[301] < 0.3 and by[None] > by[5]
    assert tox.fit(docs, labels.filter("toxic = 0")) is None
    assert tox.toxicity_scores(docs, None).agg(F.max("score")).first()[0] <= 1
    assert tox.toxicity_scores(docs.limit(0), model).count() == 0
