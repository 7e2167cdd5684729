import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tesela.llm.rules import FEATURES, calibrate, fit, grow, judged, measured, op1, quality_rules, statistics
from tesela.llm.textkit import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if times[r] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def check(rows, got):
    want = sorted(((d, *brute(t)) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_every_document_of_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op1(spark, sf).collect()
    check(rows, got)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    lost = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed and not r.kept]
    assert len(lost) <= 0.05 * len(got)


def test_nulls_long_texts_repeats_and_empty(spark):
    schema = "doc_id long, text string, n_words string, quality string, kept double"
    assert quality_rules(spark.createDataFrame([], schema), None).count() == 0
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "é x " * 60_000), (5, "same line\nsame line\n \n \nsame line"), (6, " ".join(f"w{i}" for i in range(25)) + " #$|"), (6, "repeat"), (None, "x")]
    check(rows, quality_rules(spark.createDataFrame([(d, t, "x", None, 1.0) for d, t in rows], schema), None).collect())


def test_without_usable_labels_there_is_no_forest(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None), (9, 1)], "doc_id long, quality int")
    assert fit(docs, labels) is None


def test_texts_of_one_slice_stay_apart():
    run = "a b c d e f g h"
    _, _, data, bounds = next(slices(pa.array([run, run, f"{run} {run}", ""])))
    base, features = statistics(data, bounds)
    assert base[:, 4].tolist() == [0, 0, 16, 0] and features.shape == (4, len(FEATURES))


def test_forest_isolates_outliers_and_calibration_bounds_the_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    forest = grow(x, 50, 256, 1)
    assert forest.score(np.full((1, 3), 6.0))[0] > forest.score(np.zeros((1, 3)))[0] + 0.15
    scores = forest.score(x)
    limit = calibrate(scores, np.ones(2000, bool), 0.01)
    assert 0 < (scores > limit).mean() <= 0.01
    assert calibrate(np.zeros(0), np.zeros(0, bool), 0.1) == 1.0


def test_the_limit_is_that_of_all_labelled_rows(spark):
    """Before, it came from at most 6000 labelled rows."""
    words = ["uno", "dos", "TRES", "cuatro;", "cinco", "#"]
    docs = spark.createDataFrame([(i, " ".join(words[(i * k + k * k // 7) % 6] + str(k) for k in range(21 + i % 40))) for i in range(6500)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 5 > 0) as quality")
    rows = measured(docs)
    forest = fit(docs, labels, trees=20, sample=64, most_lost=0.01)
    got = [(r.doc_id, r.anomaly) for r in judged(rows, forest).filter("doc_id % 5 > 0 and not base_failed").collect()]
    assert len(got) > 5000 and forest.limit == calibrate(np.array([s for _, s in got]), np.ones(len(got), bool), 0.01)
