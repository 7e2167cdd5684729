"""Document quality from a linear-chain conditional random field over lines (Lafferty, McCallum and Pereira, 2001).

Every line is good or bad.  Its evidence comes from its own statistics and those of the lines before and after it;
neighbouring labels are tied by transition weights.  Forward-backward gives each line's marginal; the mean of the
marginals, weighted by line length, is the document's quality, put on the scale of probabilities by a logistic fit.

Only documents are labelled, so in training every line of a document carries its document's label.  The field is fitted
on a bounded sample of labelled documents; scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, discard, fold, labelled_texts, table, utf8
from .textkit import Words, slices, sums, windows

_ALPHA, _UPPER, _DIGIT, _SYMBOL, _STOP, _LOUD, _CHAR = (np.zeros(256, bool) for _ in range(7))
_UPPER[65:91] = True
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[0x80:] = True
_DIGIT[48:58] = True
_SYMBOL[list(b"#*$%&|<>{}[]=~^@\\/_+")] = True
_STOP[list(b".,;:?\"'()-")] = True
_LOUD[list(b"!")] = True
_CHAR[:0x80] = _CHAR[0xC0:] = True
#: Lines of a document from which on its messages are doubled.
LONG = 512
#: Statistics of a line; the evidence of a line holds them for it and both neighbours.
WIDTH = 13


def line_statistics(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (one row a line with a word), weight (its characters) and document of each line of several texts."""
    edges = np.union1d(bounds, np.flatnonzero(data == 10) + 1)
    words = Words(data, edges)
    count = np.diff(words.first)
    chars = sums(_CHAR[data], edges)
    hashes = words.hashes()
    inside = np.maximum(sums(words.inside, edges), 1)
    n = np.maximum(count, 1)
    owner = np.searchsorted(bounds, edges[:-1], "right") - 1

    # Words seen before in the same line, and words in a run of four that occurs again in the same document.
    with np.errstate(over="ignore"):
        in_line = hashes ^ (words.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        distinct = np.zeros(len(hashes), bool)
        distinct[np.unique(in_line, return_index=True)[1]] = True
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
        runs = windows(hashes, 4)
        document = owner[words.doc] if len(hashes) else np.zeros(0, np.int64)
        key = runs ^ (document[: len(runs)].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        looped = np.zeros(len(hashes), bool)
        if len(runs):
            hit = np.flatnonzero((times[where] > 1) & (document[: len(runs)] == document[3:]))
            for k in range(4):
                looped[hit + k] = True

    share = lambda flags: sums(flags[data], edges) / inside
    letters = np.maximum(sums(_ALPHA[data], edges), 1)
    rows = np.stack(
        [
            np.log1p(count),
            sums(words.inside & _CHAR[data], edges) / n,
            share(_ALPHA),
            share(_DIGIT),
            np.sqrt(share(_SYMBOL)),
            share(_STOP),
            np.sqrt(share(_LOUD)),
            np.sqrt(sums(_UPPER[data], edges) / letters),
            sums(distinct, words.first) / n,
            sums(again, words.first) / n,
            sums(looped, words.first) / n,
            np.minimum(count, 8) / 8,
            (share(_SYMBOL) > 0.05).astype(float),
        ],
        axis=1,
    )
    full = count > 0
    return rows[full].astype(np.float32), chars[full], owner[full]


def _evidence(rows: np.ndarray, first: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised statistics of every line, of the line before and the line after it (0 at a document's ends), and 1."""
    own = np.clip((rows - mean) / scale, -4, 4)
    out = np.zeros((len(own), 3 * WIDTH + 1))
    out[:, :WIDTH], out[:, -1] = own, 1
    inner = np.ones(len(own), bool)
    inner[first[:-1][first[:-1] < len(own)]] = False
    at = np.flatnonzero(inner)
    out[at, WIDTH : 2 * WIDTH] = own[at - 1]
    out[at - 1, 2 * WIDTH : 3 * WIDTH] = own[at]
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices of logarithms."""
    return np.logaddexp(a[:, :, :1] + b[:, :1, :], a[:, :, 1:] + b[:, 1:, :])


def _doubled(score: np.ndarray, first: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of every line by prefix products of its document's transitions."""
    n = len(score)
    size = np.diff(first)
    place = np.arange(n) - np.repeat(first[:-1], size)
    rest = np.repeat(size, size) - 1 - place
    steps = tie[None] + score[:, None, :]
    one = np.where(np.eye(2, dtype=bool), 0.0, -np.inf)[None]
    upto = np.where((place > 0)[:, None, None], steps, one)
    after = np.repeat(one, n, axis=0)
    inner = np.flatnonzero(rest > 0)
    after[inner] = steps[inner + 1]
    d = 1
    while d <= place.max(initial=0):
        at = np.flatnonzero(place >= d)
        upto[at] = _times(upto[at - d], upto[at])
        at = np.flatnonzero(rest >= d)
        after[at] = _times(after[at], after[at + d])
        d *= 2
    head = score[np.arange(n) - place]
    return np.logaddexp(head[:, :1] + upto[:, 0], head[:, 1:] + upto[:, 1]), np.logaddexp(after[:, :, 0], after[:, :, 1])


def forward_backward(emission: np.ndarray, first: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal of the good label of every line, expected label pairs (2 x 2), and the sum of log normalisers.

    ``emission``: log-odds of good from a line's own evidence; ``first``: each document's first line, with one entry
    more; ``tie``: transition weights.  Documents step together, the longest first, so memory is a few numbers a line;
    where one has over ``LONG`` lines, messages come from products of doubling length instead of a step a line.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    score = np.stack([np.zeros(len(emission)), emission], axis=1)
    if steps > LONG:
        ahead, back = _doubled(score, first, tie)
    else:
        ahead, back = score.copy(), np.zeros((len(emission), 2))
        for t in range(1, steps):
            at = start[: live[t]] + t
            before = ahead[at - 1]
            for y in (0, 1):
                ahead[at, y] += np.logaddexp(before[:, 0] + tie[0, y], before[:, 1] + tie[1, y])
        for t in range(steps - 2, -1, -1):
            at = start[: live[t + 1]] + t
            after = back[at + 1] + score[at + 1]
            for y in (0, 1):
                back[at, y] = np.logaddexp(tie[y, 0] + after[:, 0], tie[y, 1] + after[:, 1])
    total = ahead + back
    norm = np.logaddexp(total[:, 0], total[:, 1])
    pairs = np.zeros((2, 2))
    inner = np.ones(len(emission), bool)
    inner[start[size > 0]] = False
    at = np.flatnonzero(inner)
    for x in (0, 1):
        for y in (0, 1):
            pairs[x, y] = np.exp(ahead[at - 1, x] + tie[x, y] + score[at, y] + back[at, y] - norm[at]).sum()
    heads = start[size > 0]
    return np.exp(total[:, 1] - norm), pairs, float(norm[heads].sum())


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    tie: np.ndarray
    slope: float
    shift: float
    empty: float

    def score(self, rows: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of a good document, from its lines."""
        out = np.full(len(first) - 1, self.empty)
        if len(rows):
            good, _, _ = forward_backward(_evidence(rows, first, self.mean, self.scale) @ self.weight, first, self.tie)
            weight = sums(length, first)
            full = weight > 0
            total = np.concatenate([[0.0], np.cumsum(good * length)])
            mean = (total[first[1:]] - total[first[:-1]])[full] / weight[full]
            out[full] = _sigmoid(self.slope * _logit(mean) + self.shift)
        return out


def train(rows: np.ndarray, length: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 80, ridge: float = 2.0) -> Field:
    """The field that maximises the penalised likelihood of ``label`` (one a document) on all lines of its document.

    Each document counts as much as any other, whatever its number of lines, so that long ones don't rule the fit.
    """
    mean, scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-3)
    x, size = _evidence(rows, first, mean, scale), np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    y = label[doc].astype(float)
    share = 1.0 / np.maximum(size, 1)[doc]
    weight, tie = np.zeros(x.shape[1]), np.array([[0.5, -0.5], [-0.5, 0.5]])
    inner = np.ones(len(y), bool)
    inner[first[:-1][size > 0]] = False
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (inner & (y == k)).sum()
    n, lines = max(1, int((size > 0).sum())), max(1, len(y))
    momentum = [np.zeros_like(weight), np.zeros_like(tie)]
    spread = [np.zeros_like(weight), np.zeros_like(tie)]
    for step in range(1, rounds + 1):
        good, pairs, _ = forward_backward(x @ weight, first, tie)
        push = [x.T @ ((y - good) * share) / n - ridge * weight / n, (seen - pairs) / lines - ridge * tie / n]
        for k, (value, g) in enumerate(zip((weight, tie), push, strict=True)):
            momentum[k] = 0.9 * momentum[k] + 0.1 * g
            spread[k] = 0.99 * spread[k] + 0.01 * g * g
            value += 0.1 * (momentum[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-8)
    np.clip(tie, -1.5, 1.5, out=tie)  # labels hold for whole documents, lines' need not
    field = Field(mean, scale, weight, tie, 1.0, 0.0, 0.5)
    full = size > 0
    prior = float(label.mean())
    field.empty = float((label[~full].sum() + prior) / ((~full).sum() + 1))
    z, t = _logit(field.score(rows, length, first))[full], label[full].astype(float)
    for _ in range(50):  # Newton's method on two numbers
        p = _sigmoid(field.slope * z + field.shift)
        h = np.maximum(p * (1 - p), 1e-9)
        step_ = np.linalg.solve(np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]]), np.array([((t - p) * z).sum(), (t - p).sum()]))
        field.slope, field.shift = max(1e-3, field.slope + float(np.clip(step_[0], -1, 1))), field.shift + float(np.clip(step_[1], -2, 2))
    return field


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, most_lines: int = 200_000) -> Field | None:
    """A field from at most ``rows`` labelled documents (doc_id, text) and (doc_id, quality); None without any.

    The driver gets at most ``most_lines`` lines (about 12 MB): documents of the sample that no longer fit are left out.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column(1)):
                lines, length, doc = line_statistics(data, bounds)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                packed = [(lines[a:b].tobytes(), length[a:b].astype(np.int64).tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], ["doc_id", "label", "lines", "length"])

    sample = checkpointed(labelled_texts(docs, labels, "quality", rows).withColumn("n_lines", F.size(F.split(F.col("text").cast("string"), "\n"))))
    chosen, left = [], most_lines
    for r in sorted(sample.select("doc_id", "n_lines").collect(), key=lambda r: (r.doc_id * 0x9E3779B1 & 0xFFFFFFFF, r.doc_id)):
        if r.n_lines <= left:
            chosen.append(r.doc_id)
            left -= r.n_lines
    got = sample.filter(F.col("doc_id").isin(chosen)).select("doc_id", "text", "label").mapInArrow(measure, "doc_id long, label int, lines binary, length binary").collect()
    discard(sample)
    if not got:
        return None
    got.sort(key=lambda r: (r.doc_id, r.label, bytes(r.lines)))
    lines = [np.frombuffer(r.lines, np.float32).reshape(-1, WIDTH) for r in got]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    if not first[-1]:
        return None
    return train(np.concatenate(lines).astype(float), np.concatenate([np.frombuffer(r.length, np.int64) for r in got]), first, np.array([r.label for r in got]))


def with_scores(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` (with a text column) with score and n_lines behind its columns, which they replace where names clash."""
    columns = [c for c in docs.columns if c not in ("score", "n_lines")]
    kept = docs.select(*[F.col(f"`{c}`") for c in columns])
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column(at).cast(pa.binary())):
                lines, length, doc = line_statistics(data, bounds)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                score = field.score(lines.astype(float), length, first) if field else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(score), pa.array(np.diff(first))], [*columns, "score", "n_lines"])

    return kept.mapInArrow(run, kept.withColumn("score", F.lit(0.5)).withColumn("n_lines", F.lit(0).cast("long")).schema)


def quality_scores(docs: DataFrame, field: Field | None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, score (probability of good), n_lines (with a word).

    Texts without a word, null ones included, get the smoothed share of good among such training texts.  Without a
    field (no labelled rows) every score is 0.5.  Texts of any length are scored whole.  Repeated rows give repeated
    results, a null doc_id stays null, other columns are ignored, whatever their names, and an empty table gives an empty
    result.
    """
    return with_scores(docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")), field).select("doc_id", "score", "n_lines")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a field that never saw the labels of fold 1 of 3."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = fit(docs, labels.filter(fold("doc_id", 3) != 1))
    scored = quality_scores(docs, field)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines")
