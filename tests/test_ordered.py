"""Ranks, sums and quantiles by ranges against windows over whole groups, with a hot group, nulls and ties."""

import random

from pyspark.sql import functions as F

from tesela.operators import ordered


def rows(spark):
    draw = random.Random(3)
    data = [(draw.choice(["a", "a", "a", "b", None]), i, draw.randrange(40), draw.choice([1.5, 2.5, None, 4.0])) for i in range(3000)]
    return data, spark.createDataFrame(data, "g string, id long, size long, value double").repartition(7)


def test_sums_and_ranks(spark):
    data, df = rows(spark)
    got = {(r.g, r.id): (r.before, r.size) for r in ordered.summed(ordered.dealt(df, ["g"], [F.desc("size"), "id"], F.col("size")), ["g"], [F.desc("size"), "id"], "before").collect()}
    places = {(r.g, r.id): r.place for r in ordered.ranked(df, ["g"], ["id"], "place").collect()}
    assert len(got) == len(places) == len(data)
    for g in ("a", "b", None):
        total = 0
        for _, i, size, _ in sorted((r for r in data if r[0] == g), key=lambda r: (-r[2], r[1])):
            assert got[g, i] == (total, size)
            total += size
        assert [places[g, r[1]] for r in data if r[0] == g] == list(range(sum(r[0] == g for r in data)))


def test_quantile(spark):
    data, df = rows(spark)
    got = {r.g: r.q for r in ordered.quantile(df.filter("g is not null"), ["g"], "value", 0.4, "q").collect()}
    for g in ("a", "b"):
        values = sorted(r[3] for r in data if r[0] == g and r[3] is not None)
        assert got[g] == values[-(-4 * len(values) // 10) - 1]
    assert ordered.quantile(df.limit(0), ["g"], "value", 0.4, "q").collect() == []
