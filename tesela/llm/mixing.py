"""Source mixing to target weights with soft domain membership, all in DataFrame expressions.

1. A labelled table of (doc_id, domain) trains a naive Bayes classifier on dense statistics of texts, cut into bins at
   training quantiles; it gives every document posteriors over the domains.
2. Document rates r >= ``least`` minimise the squared gap between expected domain token totals, the sum of
   r * tokens * posterior, and the targets, by projected gradient steps ``r = max(least, r - posterior . gap)`` with the
   gap scaled so that all directions have one curvature; without bounds a step would do.  Steps depend on a document
   only through its posterior, so documents with the same posterior are one cell, and a step is a pass over the cells.
3. The cells' rates go back to the documents.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, checkpointed, discard, table

#: A few common insults in English; how many of them a text holds is one of the statistics.
INSULTS = ["idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown"]
BINS = 8
DIGITS = 3
#: Up to so many cells (under 10 MB) their rates are broadcast, beyond it they are joined.
MOST_BROADCAST = 100_000


def _with_words(docs: DataFrame) -> DataFrame:
    """``docs`` with ``words`` (of the text) and ``n_tokens``: 0 for a null, empty or blank text."""
    flat = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    # Replacing and splitting at one character each takes half the time of a regular expression.
    spaced = F.col("text")
    for c in "\n\t\r\x0b\x0c":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    words = flat.withColumn("words", F.array_remove(F.split(spaced, " "), ""))
    return words.withColumn("low", F.lower("text")).withColumn("n_tokens", F.size("words").cast("long"))


def _density(chars: str) -> Column:
    """Occurrences of the given characters for each character of the text."""
    n = F.greatest(F.length("text"), F.lit(1))
    return sum((F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit(""))) for c in chars[1:]), F.length("text") - F.length(F.replace(F.col("text"), F.lit(chars[0]), F.lit("")))) / n


def statistics() -> list[Column]:
    """The dense statistics of a text.  They and all that follows compile to code; only whole arrays would not."""
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    return [
        F.log1p("n_tokens"),
        F.length("text") / n,
        _density("*#$%&"),
        _density("!"),
        _density("|"),
        _density(".,"),
        _density("\n"),
        F.size(F.array_distinct("words")) / n,
        F.regexp_count("text", F.lit("[A-Z]")) / F.greatest(F.length("text"), F.lit(1)),
        sum((F.contains("low", F.lit(w)).cast("int") for w in INSULTS[1:]), F.contains("low", F.lit(INSULTS[0])).cast("int")) / F.lit(1.0),
    ]


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and s0, s1...: the statistics of ``text``."""
    return _with_words(docs).select(*keep, *[v.cast("double").alias(f"s{k}") for k, v in enumerate(statistics())])


class Classifier:
    """Naive Bayes over binned statistics: edges of the bins, and log weights by statistic, bin and domain."""

    def __init__(self, docs: DataFrame, labelled: DataFrame, domains: list[str], rows: int):
        known = labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy(F.col("doc_id").cast("long").alias("chosen_id")).agg(F.min("domain").alias("domain"))
        chosen = F.broadcast(bounded_sample(known, "chosen_id", rows))
        sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("chosen_id")).select("domain", "text")
        sample = checkpointed(_measured(sample, "domain"))
        quantiles = [i / BINS for i in range(1, BINS)]
        names = [c for c in sample.columns if c != "domain"]
        cuts = sample.agg(*[F.percentile_approx(c, quantiles, 10_000).alias(c) for c in names]).first()
        self.edges = [sorted(set(cuts[c] or [])) for c in names]
        self.domains = domains
        prior = {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
        bins = F.posexplode(F.array(*[b.cast("int") for b in self.bins()])).alias("k", "bin")
        counted = sample.select("domain", bins).groupBy("k", "bin", "domain").count().collect()
        seen, total = {(r.k, r.bin, r.domain): r["count"] for r in counted}, sum(prior.values())
        self.base = [math.log((prior.get(d, 0) + 1) / (total + len(domains))) for d in domains]
        self.logs = [[[math.log((seen.get((k, b, d), 0) + 0.5) / (prior.get(d, 0) + 0.5 * (len(e) + 1))) for d in domains] for b in range(len(e) + 1)] for k, e in enumerate(self.edges)]
        discard(sample)

    def bins(self) -> list[Column]:
        """The bin of each statistic: how many edges lie under it."""
        return [sum(((F.col(f"s{k}") > e).cast("int") for e in edges), F.lit(0)) for k, edges in enumerate(self.edges)]

    def posteriors(self, docs: DataFrame, columns: list[str]) -> DataFrame:
        """row (the given columns), doc_id, n_tokens and p (one posterior a domain, rounded to ``DIGITS``)."""
        scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        held = ["row", "doc_id", "n_tokens"]
        scored = _measured(scored, *held).select(*held, *[b.alias(f"b{k}") for k, b in enumerate(self.bins())])
        log = lambda d: sum((F.get(F.array(*[F.lit(w[d]) for w in weights]), F.col(f"b{k}")) for k, weights in enumerate(self.logs)), F.lit(self.base[d]))
        scored = scored.select(*held, *[log(d).alias(f"l{d}") for d in range(len(self.domains))])
        most = F.greatest(*[F.col(f"l{d}") for d in range(len(self.domains))]) if len(self.domains) > 1 else F.col("l0")
        scored = scored.select(*held, *[F.exp(F.col(f"l{d}") - most).alias(f"r{d}") for d in range(len(self.domains))])
        whole = sum((F.col(f"r{d}") for d in range(len(self.domains))), F.lit(0.0))
        # Running sums are rounded, and the posteriors are their differences: so they stay nonnegative and sum to 1.
        upto = [F.lit(0.0), *[F.round(sum((F.col(f"r{d}") for d in range(k + 1)), F.lit(0.0)) / whole, DIGITS) for k in range(len(self.domains))]]
        share = F.array(*[F.round(y - x, DIGITS) for x, y in zip(upto, upto[1:], strict=False)])
        return scored.select("row", "doc_id", "n_tokens", share.alias("p"))


def _total(of: str, domains: int) -> list[Column]:
    """Token totals by domain of cells whose tokens are in ``of``."""
    return [F.sum(F.col(of) * F.col("p")[k]).alias(f"m{k}") for k in range(domains)]


def fitted(cells: DataFrame, want: list[float], least: float, most: float, close: float) -> DataFrame:
    """``cells`` (p, n) with ``rate``: the rates whose totals come nearest ``want``, from 1 on.

    A step goes along the gradient, scaled by the second moments of the cells that it can move (those at a bound which it
    would push beyond it stay), and is projected on the bounds.  Where that doesn't lower the squared gap by a millionth
    the plain gradient step is taken, which does unless this is the least squares.  Steps end there, or when every total
    is within ``close`` of its target, relative to it.
    """
    k = len(want)

    def moments(of: DataFrame) -> np.ndarray:
        row = of.agg(*[F.coalesce(F.sum(F.col("n") * F.col("p")[i] * F.col("p")[j]), F.lit(0.0)) for i in range(k) for j in range(k)]).first()
        return np.array(row, float).reshape(k, k)

    def toward(u: np.ndarray) -> Column:
        return sum((F.col("p")[i] * float(u[i]) for i in range(1, k)), F.col("p")[0] * float(u[0]))

    def gap_of(of: DataFrame) -> np.ndarray:
        return np.array(of.withColumn("t", F.col("n") * F.col("rate")).agg(*_total("t", k)).first(), float) - np.array(want)

    metric = moments(cells)
    metric = np.linalg.inv(metric + np.eye(k) * 1e-9 * max(np.trace(metric), 1e-300))
    root = np.linalg.cholesky((metric + metric.T) / 2).T
    cells = checkpointed(cells.withColumn("rate", F.lit(min(max(1.0, least), most))))
    gap = gap_of(cells)
    while (abs(gap) > close * np.array(want)).any():
        push = toward(metric @ gap)
        free = moments(cells.filter(((F.col("rate") > least) | (push < 0)) & ((F.col("rate") < most) | (push > 0))))
        for step in (np.linalg.lstsq(root @ free, root @ gap, rcond=1e-9)[0], metric @ gap):
            rate = F.least(F.lit(most), F.greatest(F.lit(least), F.col("rate") - toward(step)))
            after = checkpointed(cells.select("p", "n", rate.alias("rate")))
            then = gap_of(after)
            better = then @ metric @ then < (1 - 1e-6) * (gap @ metric @ gap)
            discard(cells if better else after)
            if better:
                cells, gap = after, then
                break
        else:
            break
    return cells


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0, most: float = math.inf, growth: float = 1.0, carry: list[str] | None = None, rows: int = 6000, close: float = 1e-3) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): row (a struct of the columns in ``carry``, or all), doc_id, n_tokens, p, rate.

    ``targets`` gives domains their shares of tokens (made to sum to 1); ``labelled`` (doc_id, domain) trains the
    classifier on at most ``rows`` documents.  Expected totals are to sum to ``growth`` times the corpus' own
    tokens, and rates stay between ``least`` and ``most``.  Every domain's total comes within ``close`` of its target, relative
    to it; targets that such rates can't meet end at the least squares.

    Null, empty and blank texts have no tokens and count for nothing, but still get a rate; texts of any length are read
    whole.  Labels of other domains or without doc_id are ignored, and an id labelled twice takes its first domain by
    name; without any labels posteriors are uniform.  Repeated rows give repeated results, a null doc_id stays null,
    clashing names don't meet since the row is one struct; an empty table gives an empty result.
    """
    domains = sorted(targets)
    goal = {d: targets[d] / sum(targets.values()) for d in domains}
    # Texts are read once for the posteriors; what is carried waits beside them in a written table.
    scored = checkpointed(Classifier(docs, labelled, domains, rows).posteriors(docs, carry or docs.columns))
    cells = checkpointed(scored.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("n")))
    size = cells.agg(F.sum("n").alias("n"), F.count("*").alias("cells")).first()
    if not size["n"]:
        return scored.withColumn("rate", F.lit(min(max(1.0, least), most)))
    rates = fitted(cells, [goal[d] * growth * size["n"] for d in domains], least, most, close).select(F.col("p").alias("of"), "rate")
    # There are as many cells as rounded posteriors, however many documents: with three domains half a million at most.
    rates = F.broadcast(rates) if size["cells"] <= MOST_BROADCAST else rates.hint("merge")
    return scored.join(rates, F.col("p") == F.col("of")).drop("of")


def copies(rate: Column, *names: Column) -> Column:
    """A whole number of copies whose expectation is the rate: its floor, and one more for a hash below the rest."""
    draw = F.pmod(F.xxhash64(*names, F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled table: toxic before junk before clean."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean").alias("domain"))


#: Shares of tokens in the mixed corpus.
TARGETS = {"clean": 0.90, "junk": 0.06, "toxic": 0.04}


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixed(docs, domains_of(table(spark, sf_dir, "labels")), TARGETS, carry=["doc_id"])
    shares = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(sorted(TARGETS))]
    return out.select("doc_id", "n_tokens", *shares, "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))
