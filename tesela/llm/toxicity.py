"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

1. A lexicon: a short fixed list, and terms (words and word beginnings) that labelled toxic documents hold far more
   often than clean ones.  Documents are split in two halves; each half's features use the lexicon of the other, so
   that trees don't trust terms which only fit by chance.
2. Features of a text: lexicon densities, nearness of a hit to the second person, capitals, punctuation, obfuscation.
3. Trees boost the logistic loss on quantile-binned features (Friedman, 2001); out-of-fold margins go through
   isotonic regression (pool adjacent violators), which turns margins into probabilities.

All models come from a bounded sample of labelled documents; scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, discard, fold, labelled_texts, table

#: Common insults, and pronouns of the second person in English, German, French and Spanish.
INSULTS = frozenset("idiot idiots moron morons stupid dumb scum trash loser losers pathetic worthless disgusting clown imbecile jerk creep vermin filth garbage idiota imbécil estúpido estúpida basura escoria dumm dummkopf abschaum arschloch crétin abruti ordure débile connard".split())
SECOND = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split())
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "|": "i"})
_EDGE = ".,;:!?\"'()[]{}<>*_~`-–—…#%&+=/\\|^$"
_SPACED = re.compile(r"(?<!\w)(?:\w[ ._*-]){3,}\w(?!\w)")
_NOT_LETTER = re.compile(r"[\W\d_]+")
PREFIXES = (4, 5, 6)
NAMES = ["fixed", "hits", "learned", "strongest", "density", "hidden", "second", "near", "capitals", "shouted", "exclaimed", "punctuated", "odd", "words"]


def plain(token: str) -> tuple[str, bool]:
    """A lower-case token without its edges, and whether letters had to be read out of other characters."""
    core = token.strip(_EDGE)
    if not core or core.isalpha():
        return core, False
    return _NOT_LETTER.sub("", token.translate(_LEET).strip(_EDGE).translate(_LEET)), True


def terms(word: str) -> list[str]:
    """A word's own term and those of its beginnings, which catch inflected and compounded forms."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


class Reading(dict):
    """What a token says: word, whether it was disguised, of the second person, a fixed insult, and its learned weight.

    Texts repeat their tokens, so each is read once; the store starts anew when it is full.
    """

    def __init__(self, lexicon: dict[str, float], most: int = 1 << 18):
        self.lexicon, self.most = lexicon, most

    def __missing__(self, token: str) -> tuple[str, bool, bool, bool, float]:
        word, changed = plain(token)
        weight = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0) if self.lexicon and word else 0.0
        if len(self) >= self.most:
            self.clear()
        out = self[token] = (word, changed, word in SECOND, word in INSULTS, weight)
        return out


def _capitals(text: str, lower: str) -> int:
    if text == lower or text.islower():
        return 0
    if len(lower) != len(text):
        return sum(map(str.isupper, text))
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in (text, lower))
    return int(np.count_nonzero(a != b))


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The dense features of a text, by a lexicon or a :class:`Reading` of one."""
    read = lexicon if isinstance(lexicon, Reading) else Reading(lexicon)
    lexicon = read.lexicon
    lower = text.lower()
    tokens = lower.split()
    fixed = learned = strongest = hidden = odd = second = 0.0
    found = set()
    for token, times in Counter(tokens).items():
        word, changed, you, insult, weight = read[token]
        if not word:
            continue
        odd += changed * times
        second += you * times
        if insult:
            fixed += times
            hidden += changed * times
            found.add(token)
        if weight:
            learned += weight * times
            strongest = max(strongest, weight)
            hidden += (changed and not insult) * times
            found.add(token)
    for m in _SPACED.finditer(lower):
        word = _NOT_LETTER.sub("", m[0])
        if word in INSULTS or lexicon.get(word):
            fixed += 1
            hidden += 1
    near = 0.0
    if found and second:
        last = {True: -1e9, False: -1e9}
        gap = 1e9
        for i, token in enumerate(tokens):
            for kind in (True, False):
                if (token in found) if kind else read[token][2]:
                    gap = min(gap, i - last[not kind])
                    last[kind] = i
        near = 1 / (1 + gap)
    n, size = max(1, len(tokens)), max(1, len(text))
    upper = _capitals(text, lower)
    marks = text.count("!")
    return [
        100 * fixed / n, np.log1p(fixed), np.log1p(learned), strongest, 100 * learned / n, hidden, 100 * second / n, near,
        upper / size, 10 * upper / size if upper > 0.5 * size else 0.0, 100 * marks / n, (text.count(".") + text.count(",") + text.count("?") + marks) / n, odd / n, np.log1p(n),
    ]


@dataclass
class Trees:
    """Trees of one depth as arrays: level by level a feature and a bin a node, then the leaves' values."""

    edges: list[np.ndarray]
    depth: int
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.bins(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, most_bins: int = 32, ridge: float = 2.0) -> Trees:
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, most_bins + 1)[1:-1])) for k in range(x.shape[1])]
    model = Trees(edges, depth)
    b = model.bins(x)
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4))
    model.base = float(np.log(share / (1 - share)))
    margin = np.full(len(x), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(x), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, most_bins + 1)
        for level in range(depth):
            low = 2**level - 1
            gain = np.zeros(2**level)
            for k in range(x.shape[1]):
                cell = (node - low) * (most_bins + 2) + b[:, k]
                size = 2**level * (most_bins + 2)
                gs, hs = (np.bincount(cell, v, size).reshape(2**level, -1) for v in (g, h))
                gl, hl = gs.cumsum(axis=1), hs.cumsum(axis=1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gains = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                best = gains.argmax(axis=1)
                value = gains[np.arange(2**level), best]
                better = value > gain + 1e-9
                gain[better] = value[better]
                feature[low:][: 2**level][better], cut[low:][: 2**level][better] = k, best[better]
            node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
        node -= 2**depth - 1
        leaf = rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + ridge)
        margin += leaf[node]
        model.feature.append(feature), model.cut.append(cut), model.leaf.append(leaf)
    return model


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, probability) of the best nondecreasing fit; pooled blocks keep their weighted mean margin."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted label, weighted margin
    for m, t, w in zip(margin[order], y[order], weight[order], strict=True):
        blocks.append([w, w * t, w * m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([(b[1] + 0.01) / (b[0] + 0.02) for b in blocks])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(x)
        # The share of a knot, and a sliver of the margin so that ranks inside a level survive.
        return np.clip(np.interp(margin, *self.knots) * 0.999 + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


def _weighed(sums: DataFrame, toxic: Column, clean: Column, sizes: tuple[float, float], most: int) -> dict[str, float]:
    """Weights (log odds) of the terms whose surplus in toxic documents is no chance: over five times as often there.

    Terms are tested where they are counted; only the ``most`` surest of those that pass come to the driver.
    """
    n_toxic, n_clean = sizes
    base = n_toxic / max(1.0, n_toxic + n_clean)
    if not 0 < base < 1:
        return {}
    counted = sums.select("term", toxic.cast("double").alias("t"), clean.cast("double").alias("c")).filter("t >= 3")
    lift = (F.col("t") + 0.1) / (n_toxic + 0.2) / ((F.col("c") + 0.5) / (n_clean + 1.0))
    n = F.col("t") + F.col("c")
    surprise = 2 * (F.col("t") * F.ln(F.col("t") / (n * base)) + F.when(F.col("c") > 0, F.col("c") * F.ln(F.col("c") / (n * (1 - base)))).otherwise(0.0))
    sure = counted.select("term", lift.alias("lift"), surprise.alias("surprise")).filter("lift > 5 and surprise > 20")
    return {r.term: math.log(r.lift) for r in sure.orderBy(F.desc("surprise"), "term").limit(most).collect()}


def _half(doc_id: int) -> int:
    return (doc_id * 0x9E3779B1 >> 13) & 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, most_terms: int = 2000) -> Model | None:
    """A model from at most ``rows`` toxic and as many other labelled documents; None where either is missing.

    Rows of each kind are weighted back to their share among all labelled rows, so scores are probabilities there.
    ``most_terms`` bounds the learned lexicon, surest terms first.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    share = {int(r.toxic): r["count"] for r in known.groupBy((F.col("toxic").cast("int") > 0).cast("int").alias("toxic")).count().collect()}
    if len(share) < 2:
        return None
    texts = reduce(DataFrame.union, [labelled_texts(docs, known.filter((F.col("toxic") > 0) == bool(k)), "toxic", rows) for k in (0, 1)])
    texts = checkpointed(texts.select("doc_id", F.col("text").cast("string").alias("text"), (F.col("label") > 0).cast("int").alias("label")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[int, int], Counter] = {}
        for batch in batches:
            for i, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = {plain(t)[0] for t in set((text or "").lower().split())}
                got.setdefault((_half(i), label), Counter()).update({t for w in words if len(w) > 2 for t in terms(w)})
        for (half, label), counter in got.items():
            names, times = list(counter), list(counter.values())
            for lo in range(0, len(names), 1 << 16):
                n = len(names[lo : lo + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + n]), pa.array([2 * half + label] * n, pa.int32()), pa.array(times[lo : lo + n], pa.int64())], ["term", "kind", "n"])

    counted = texts.mapInArrow(count, "term string, kind int, n long")
    sums = counted.groupBy("term").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)])
    sums = checkpointed(sums.filter("n1 + n3 >= 3"))

    sizes = Counter((_half(r.doc_id), r.label) for r in texts.select("doc_id", "label").collect())
    size = lambda k: (float(sizes[k, 1]), float(sizes[k, 0]))
    of = [Reading(_weighed(sums, F.col(f"n{2 * half + 1}"), F.col(f"n{2 * half}"), size(half), most_terms)) for half in (0, 1)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = features(text or "", of[1 - _half(i)])
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([label], pa.int32()), pa.array([x], pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    measured: list[tuple[int, int, list[float]]] = sorted((r.doc_id, r.label, list(r.x)) for r in texts.mapInArrow(measure, "doc_id long, label int, x array<double>").collect())
    if len({m[1] for m in measured}) < 2:
        return None
    y = np.array([m[1] for m in measured])
    x = np.array([m[2] for m in measured])
    weight = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum()))
    weight *= len(y) / weight.sum()
    part = np.array([m[0] % 5 for m in measured])
    margin = np.zeros(len(y))
    for k in range(5):
        if (part == k).any():
            inside = part != k
            margin[~inside] = boost(x[inside], y[inside], weight[inside]).margin(x[~inside]) if inside.any() else 0.0
    whole = _weighed(sums, F.col("n1") + F.col("n3"), F.col("n0") + F.col("n2"), (size(0)[0] + size(1)[0], size(0)[1] + size(1)[1]), most_terms)
    discard(sums), discard(texts)
    return Model(whole, boost(x, y, weight), isotonic(margin, y, weight))


def toxicity_scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, score (probability of toxic).

    A null text counts as empty; an empty one is scored by its features like any other.  Without a model (labels of
    one kind only) the score is the share of fixed insults among the words.  Texts of any length are scored whole.
    Repeated rows give repeated results, a null doc_id stays null, other columns are ignored, whatever their names, and an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Reading(model.lexicon if model else {})
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = np.array([features(t.as_py() or "", lexicon) for t in part.column(1)])
                score = model.score(x) if model else np.minimum(x[:, 0] / 100, 1.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model that never saw the labels of fold 2 of 4."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity_scores(docs, fit(docs, labels.filter(fold("doc_id", 4) != 2)))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
