import pytest
from pyspark.sql import functions as F

from tesela.llm import mixing

PLAIN, LOUD = "some quiet words stand here, all of them plain. ", "WOW!! BUY!! NOW!! ### "


def corpus(spark):
    rows = [(i, PLAIN * (1 + i % 4), "a") for i in range(90)] + [(100 + i, LOUD * (1 + i % 3), "b") for i in range(10)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, rate string")
    return docs, spark.createDataFrame([(i, d) for i, _, d in rows], "doc_id long, domain string")


def totals(out):
    row = out.agg(*[F.sum(F.col("n_tokens") * F.col("rate") * F.col("p")[k]).alias(f"t{k}") for k in range(2)], F.sum("n_tokens").alias("n"), F.min("rate").alias("low")).first()
    return row.t0, row.t1, row.n, row.low


@pytest.mark.parametrize("share", [0.5, 0.7, 0.95])
def test_expected_totals_meet_targets(spark, share):
    docs, labels = corpus(spark)
    a, b, n, low = totals(mixing.mixed(docs, labels, {"a": share, "b": 1 - share}))
    assert low >= 0 and abs(a - share * n) <= 1e-3 * share * n and abs(b - (1 - share) * n) <= 1e-3 * (1 - share) * n


@pytest.mark.parametrize(("share", "least"), [(0.4, 0.0), (0.999, 0.0), (0.5, 1.0), (0.05, 0.8)])
def test_rates_are_a_least_squares_optimum(spark, share, least):
    """At the optimum no document's rate can move, in the direction open to it, and lower the squared gap."""
    import numpy as np

    docs, labels = corpus(spark)
    out = mixing.mixed(docs, labels, {"a": share, "b": 1 - share}, least=least, close=1e-9).collect()
    p, t, rate = np.array([r.p for r in out]), np.array([r.n_tokens for r in out], float), np.array([r.rate for r in out])
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all() and (rate >= least).all()
    want = np.array([share, 1 - share]) * t.sum()
    gap = p.T @ (t * rate) - want
    slope = p @ np.linalg.inv((p * t[:, None]).T @ p + 1e-9 * np.eye(2)) @ gap
    free = rate > least + 1e-9
    assert abs(slope[free]).max(initial=0) < 1e-2 and (slope[~free] > -1e-2).all()


def test_rates_keep_to_both_bounds(spark):
    """A rare domain can't meet its target within four copies: all of it gets four."""
    docs, labels = corpus(spark)
    out = mixing.mixed(docs, labels, {"a": 0.1, "b": 0.9}, least=1.0, most=4.0).collect()
    assert {round(r.rate, 6) for r in out if r.doc_id >= 100} == {4.0} and all(1 <= r.rate <= 4 for r in out)


def test_targets_are_met_on_the_table(spark, sf):
    """Expected totals within a thousandth of their targets."""
    out = mixing.op7(spark, sf.replace("sf0.001", "sf0.01"))
    got = out.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in mixing.TARGETS]).first()
    for d, share in mixing.TARGETS.items():
        assert abs(got[d] - share * got.n) <= 1.01e-3 * share * got.n, d


def test_least_rate_and_copies(spark):
    docs, labels = corpus(spark)
    out = mixing.mixed(docs, labels, {"a": 0.5, "b": 0.5}, least=1.0)
    assert totals(out)[3] >= 1.0
    counted = spark.range(4000).select(mixing.copies(F.lit(1.25), F.col("id")).alias("c")).agg(F.avg("c")).first()[0]
    assert abs(counted - 1.25) < 0.03


def test_edges(spark):
    docs, labels = corpus(spark)
    odd = spark.createDataFrame([(None, PLAIN, "x"), (500, None, "x"), (501, "", "x"), (502, " \n", "x"), (503, PLAIN * 20_000, "x"), (503, PLAIN * 20_000, "x")], docs.schema)
    both = docs.union(odd)
    labels = labels.union(spark.createDataFrame([(None, "a"), (0, "zzz"), (501, None)], labels.schema))
    out = mixing.mixed(both, labels, {"a": 0.8, "b": 0.2})
    assert out.count() == both.count() and out.filter("rate is null or rate < 0").count() == 0
    assert {r.doc_id: r.n_tokens for r in out.filter("doc_id >= 500").collect()} == {500: 0, 501: 0, 502: 0, 503: 9 * 20_000}
    assert out.select("row.*").columns == docs.columns
    assert mixing.mixed(both.limit(0), labels, {"a": 1.0}).count() == 0
    assert mixing.mixed(both, labels.limit(0), {"a": 0.5, "b": 0.5}).count() == both.count()


def test_native(spark, sf):
    from tesela.llm.queries import QUERIES

    plan = QUERIES["op7_soft_mixing"](spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
