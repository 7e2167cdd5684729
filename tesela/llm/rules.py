"""Quality rules: statistics of a text, hard limits, and an isolation forest (Liu, Ting and Zhou, 2008) over the rest.

The forest isolates rows by random splits: the shorter a document's mean path, the odder its statistics.  Its trees are
grown on small random draws of the labelled documents; the score above which a document goes is calibrated on all of
them, as the lowest one at which the share of good documents lost stays under a limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, checkpointed, discard, table, utf8
from .textkit import Words, slices, sums, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True  # the characters of the class [#*$%&|<>]
_UPPER, _PUNCT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT[list(b"!?.,;:'\"()[]{}-_/\\+=~^@`")] = True
_CHAR = np.ones(256, bool)
_CHAR[0x80:0xC0] = False  # continuation bytes
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["mean_word", "symbols", "upper", "punct", "mean_line"]
_BLANK = b" \t\n\r\x0b\x0c"


def statistics(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The base counts and the forest's features (ratios, so that length alone is no oddity) of several texts."""
    words = Words(data, bounds)
    count = np.diff(words.first)
    hashes = words.hashes()
    ends = lambda flags: sums(flags, bounds)
    chars = ends(words.inside & _CHAR[data])
    symbols = ends(_SYMBOL[data])

    repeat = np.zeros(len(bounds) - 1, np.int64)
    runs = windows(hashes, 8)
    if len(runs):
        at = np.flatnonzero(words.doc[: len(runs)] == words.doc[7 : 7 + len(runs)])
        doc = words.doc[at].astype(np.uint64)
        with np.errstate(over="ignore"):
            key = runs[at] ^ (doc * np.uint64(0x9E3779B97F4A7C15))  # windows of different texts are told apart
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, at[again], 1)
        np.add.at(cover, at[again] + 8, -1)
        repeat = sums(np.cumsum(cover[:-1]) > 0, words.first)

    dup, lines = np.zeros(len(bounds) - 1, np.int64), np.zeros(len(bounds) - 1, np.int64)
    raw = data.tobytes()
    for i in range(len(bounds) - 1):
        full = [x for x in raw[bounds[i] : bounds[i + 1]].split(b"\n") if x.strip(_BLANK)]
        lines[i] = len(full)
        dup[i] = len(full) - len(set(full))
    # Ratios are drawn towards a usual value as if some usual text stood beside each one: few words tell little.
    def ratio(part: np.ndarray, whole: np.ndarray, usual: float, weight: float) -> np.ndarray:
        return (part + usual * weight) / (whole + weight)

    features = np.stack(
        [
            ratio(chars, count, 5.0, 60),
            ratio(symbols, chars, 0.0, 300),
            ratio(ends(_UPPER[data]), chars, 0.02, 300),
            ratio(ends(_PUNCT[data]), chars, 0.03, 300),
            ratio(count, lines, 50.0, 5),
        ],
        axis=1,
    )
    return np.stack([count, chars, symbols, dup, repeat], axis=1), features


@dataclass
class Forest:
    """Trees as arrays of one size: node k has children 2k+1 and 2k+2; a leaf holds the path length that ends there."""

    feature: np.ndarray
    cut: np.ndarray
    depth: np.ndarray
    norm: float
    limit: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows isolated early, under a half for ordinary ones."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, depth in zip(self.feature, self.cut, self.depth, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                split = feature[node]
                live = split >= 0
                if not live.any():
                    break
                right = x[rows, np.maximum(split, 0)] >= cut[node]
                node = np.where(live, 2 * node + 1 + right, node)
            total += depth[node]
        return np.exp2(-total / len(self.feature) / self.norm)


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n keys."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def grow(x: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    height = max(1, int(np.ceil(np.log2(max(2, sample)))))
    size = (1 << (height + 1)) - 1
    feature, cut, depth = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, rng.permutation(len(x))[:sample], 0)]
        while todo:
            node, rows, level = todo.pop()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            open_ = np.flatnonzero(high > low)
            if level == height or len(rows) <= 1 or not len(open_):
                depth[t, node] = level + _expected(len(rows))
                continue
            f = rng.choice(open_)
            c = rng.uniform(low[f], high[f])
            c = np.nextafter(low[f], high[f]) if c <= low[f] else c
            feature[t, node], cut[t, node] = f, c
            right = x[rows, f] >= c
            todo += [(2 * node + 1, rows[~right], level + 1), (2 * node + 2, rows[right], level + 1)]
    return Forest(feature, cut, depth, max(_expected(min(sample, len(x))), 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray, most_lost: float) -> float:
    """The lowest limit at which at most ``most_lost`` of the good rows score above it."""
    kept = np.sort(scores[good])
    return float(kept[min(len(kept) - 1, int(np.ceil(len(kept) * (1 - most_lost))))]) if len(kept) else 1.0


def fit(docs: DataFrame, labels: DataFrame, trees: int = 100, sample: int = 256, most_lost: float = 0.004, seed: int = 11) -> Forest | None:
    """A forest calibrated on all labelled documents (doc_id, text) and (doc_id, quality); None without any."""
    return fitted(measured(docs), labels, trees, sample, most_lost, seed)


def fitted(rows: DataFrame, labels: DataFrame, trees: int = 100, sample: int = 256, most_lost: float = 0.004, seed: int = 11) -> Forest | None:
    """:func:`fit` over rows of :func:`measured`.

    A tree is grown on ``sample`` rows, as the method has it, so all trees together see at most that many times ``trees``; they
    are drawn from all labelled rows.  The limit is the exact one over all of these that are good and pass the hard limits.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("long").alias("quality"))
    labelled = checkpointed(rows.join(known, "doc_id").select("doc_id", "quality", *FEATURES, (~F.col("base_failed")).alias("passed")))
    drawn = bounded_sample(labelled, "doc_id", trees * sample).collect()
    if not drawn:
        return None
    drawn.sort(key=lambda r: tuple(r))
    forest = grow(np.array([[r[n] for n in FEATURES] for r in drawn]), trees, sample, seed)
    # Rows that fail the hard limits are gone whatever the forest says, so it is calibrated on those that pass.
    good = labelled.filter("quality = 1 and passed")
    n = good.count()
    if n:
        above = n - min(n - 1, int(np.ceil(n * (1 - most_lost))))
        forest.limit = good.select(*FEATURES).mapInArrow(_scores(forest), "score double").orderBy(F.desc("score")).limit(above).agg(F.min("score")).first()[0]
    discard(labelled)
    return forest


def _scores(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(_features(batch)))], ["score"])

    return run


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in FEATURES], axis=1)


def _failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, bounds in slices(batch.column(1)):
            base, features = statistics(data, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c) for c in base.T), pa.array(_failed(base)), *(pa.array(c) for c in features.T)], ["doc_id", *BASE, "base_failed", *FEATURES])


_COUNTS = ", ".join(f"{n} long" for n in BASE)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and the forest's features of each row of ``docs`` (doc_id, text)."""
    features = ", ".join(f"{n} double" for n in FEATURES)
    return docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")).mapInArrow(_measure, f"doc_id long, {_COUNTS}, base_failed boolean, {features}")


def quality_rules(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): the base counts, base_failed, anomaly, kept.

    n_words counts words; word_chars code points in them; n_symbols symbols; n_dup_lines lines with a word that equal
    an earlier line; n_repeat_words words inside 8-word windows that occur again in the text.  ``base_failed``: under
    20 words, or over 30 % of them repeated.  ``anomaly`` is the forest's score, and ``kept`` is false where the base
    failed or the score is above the calibrated limit; without a forest (no labels) only the base decides.

    A null text counts as empty, so it fails the base.  Repeated rows give repeated results, a null doc_id stays null,
    other columns are ignored and an empty table gives an empty result.
    """

    return judged(measured(docs), forest)


def judged(rows: DataFrame, forest: Forest | None) -> DataFrame:
    """:func:`quality_rules` over rows of :func:`measured`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            score = forest.score(_features(batch)) if forest else np.zeros(batch.num_rows)
            kept = ~failed & (score <= forest.limit if forest else True)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ["doc_id", *BASE, "base_failed"]), pa.array(score), pa.array(kept)], ["doc_id", *BASE, "base_failed", "anomaly", "kept"])

    return rows.mapInArrow(run, f"doc_id long, {_COUNTS}, base_failed boolean, anomaly double, kept boolean")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(measured(table(spark, sf_dir, "documents")))  # read by the fit and by the verdict
    return judged(rows, fitted(rows, table(spark, sf_dir, "labels")))
