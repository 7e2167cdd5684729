import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesela.llm.minhash import LONGS, common_bits, components, filled_lanes, near_duplicates, needed_bits, op4, signatures
from tesela.llm.textkit import Words, slices, windows, word_hash

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= 85 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()))


def test_words_match_a_plain_split():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n\t\x0b\x1c x") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", None, "abc", "abc"]
    for limit in (10, 200, 10**6):
        for lo, hi, data, bounds in slices(pa.array(texts), limit):
            words, k = Words(data, bounds), 0
            hashes = words.hashes()
            for i in range(lo, hi):
                for w in (texts[i] or "").encode().split():
                    assert bytes(data[words.start[k] : words.end[k]]) == w and int(hashes[k]) == word_hash(w) and words.doc[k] == i - lo
                    k += 1
            assert k == len(words.start)


def test_windows_tell_order_apart():
    h = np.arange(10, dtype=np.uint64)
    assert len(set(windows(h, 3).tolist())) == 8 and len(windows(h[:2], 3)) == 0


def test_matches_brute_force_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op4(spark, sf)) == brute(rows)


def test_chains_edges_and_ties(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows, text = [], list(base)
    for i in range(40):  # a chain in which far members are linked only over those between
        text[(i * 3) % 120] = word()
        rows.append((1000 - i, " ".join(text)))
    rows += [(i, " ".join([*base[:60], *[word() for _ in range(n)]])) for i, n in zip(range(20), range(0, 60, 3), strict=True)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE  two"), (2005, "two one"), (2006, "É a b c d e f"), (2007, "é a b c d e f")]
    rows += [(2008 + i, "same words in this text again and again") for i in range(30)]
    rows.append((3000, " ".join(base * 300)))
    assert got(near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_base_with_copies_that_differ_from_each_other(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        t = list(base)
        for at in rng.sample(range(0, 400, 6), 6):
            t[at] = f"x{i}_{at}"
        rows.append((i + 1, " ".join(t)))
    assert got(near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_nulls_repeats_empty_and_extra_columns(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("key", T.LongType()), ("rep", T.StringType()), ("a", T.LongType()))])
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f", 1, "x", 2), (1, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (2, "a b c d e f", 1, "x", 2)]
    out = sorted([tuple(r) for r in near_duplicates(spark.createDataFrame(rows, schema)).select("doc_id", "component_id", "kept").collect()], key=str)
    assert out == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)], key=str)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 9), (8, 9)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(i, 100) for i in range(100, 161)} | {(7, 7), (8, 7), (9, 7)}


@pytest.mark.parametrize("scale", [0.2, 1, 20])
def test_lanes_tell_close_pairs_from_far_ones(spark, scale):
    """Pairs at the threshold are never ruled out; those of a similarity under 0.7 nearly always."""
    rows, wanted = [], []
    for k in range(40):
        n = int(200 * scale)
        for far in (False, True):
            d = len(rows)
            shared = round(n * (0.80 if far else 0.919)) if n > 50 else n - (4 if far else 1)
            rows.append((d, " ".join(f"{k}{far}{i}" for i in range(n))))
            rows.append((d + 1, " ".join(f"{k}{far}{i}" for i in range(n - shared, 2 * n - shared))))
            x, y = shingles(rows[-2][1]), shingles(rows[-1][1])
            wanted.append((d, len(x & y) / len(x | y)))
    sign = signatures(spark.createDataFrame(rows, SCHEMA), 25, 5, 5, True).withColumn("f", filled_lanes()).cache()
    sides = [sign.select((F.col("doc_id") - off).alias(f"id_{s}"), F.col("f").alias(f"f_{s}"), F.col("n_shingles").alias(f"n_{s}"), *[F.col(f"s{k}").alias(f"{s}{k}") for k in range(LONGS)]) for off, s in ((0, "a"), (1, "b"))]
    told = {r[0]: r[1] for r in sides[0].join(sides[1], F.col("id_a") == F.col("id_b")).select("id_a", common_bits("a", "b") >= needed_bits("a", "b", 0.85)).collect()}
    assert all(told[d] for d, j in wanted if j >= 0.85)
    far = [told[d] for d, j in wanted if j < 0.7]
    assert scale < 1 or far and sum(far) <= 0.1 * len(far)
