"""Ranking: BM25, TF-IDF, vectors, rank fusion, selection under a budget.  Statistics are over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions.text import search_fold
from tesela.operators import ordered
from tesela.sources.shared import written


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(search_fold(F.coalesce(text, F.lit(""))), F.lit("[a-zñß0-9]+"), F.lit(0))


def query_terms(query: str, stop: frozenset[str] = frozenset()) -> list[str]:
    """Words of three letters or more without stop words, a final s cut off longer ones; empty for a query over 300 characters."""
    import re

    if not query.strip() or len(query) > 300:
        return []
    words = [w for w in re.findall(r"[^\W_]+", query.lower()) if len(w) >= 3 and w not in stop]
    return list(dict.fromkeys(w[:-1] if w.endswith("s") and len(w) > 4 else w for w in words))


def _begun(prefix: str) -> Column:
    return F.size(F.filter("t", lambda w: w.startswith(prefix)))


def bm25(docs: DataFrame, terms: list[str], k: int | None = None) -> DataFrame:
    """doc_id and score of the documents with a token that begins with a term; smaller is better, as in full-text indexes.

    One pass gives lengths and counts by term (no token is exploded); these few numbers a document are written, so that texts
    are read once for statistics and scores.
    """
    read = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    counted = read.select("doc_id", F.size("t").alias("len"), *[_begun(p).alias(f"n{i}") for i, p in enumerate(terms)])
    return _ranked(written(counted, "counts"), len(terms), k)


def _ranked(counted: DataFrame, terms: int, k: int | None) -> DataFrame:
    """doc_id and score of counted (doc_id, len, n0...)."""
    stats = counted.agg(F.count("*").alias("rows"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in range(terms)])
    some = F.lit(False)
    score = F.lit(0.0)
    for i in range(terms):
        raw = F.ln((F.col("rows") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        tf = F.col(f"n{i}")
        score = score - F.when(raw <= 0, 1e-6).otherwise(raw) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("mean")))
        some = some | (tf > 0)
    out = counted.filter(some).join(F.broadcast(stats)).select("doc_id", F.round(score, 6).alias("score"))
    return out.orderBy("score", "doc_id").limit(k) if k else out


def tfidf(docs: DataFrame) -> DataFrame:
    """doc_id, term (six characters at most) and its normalised weight: (1 + ln tf) * (ln((n+1)/(d+1)) + 1)."""
    counted = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("t")).select("doc_id", F.left("t", F.lit(6)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    total = docs.agg(F.count("*").alias("n"))
    df = counted.groupBy("term").agg(F.count("*").alias("d"))
    weighed = counted.join(df, "term").join(F.broadcast(total)).withColumn("w", (1 + F.ln("tf")) * (F.ln((F.col("n") + 1) / (F.col("d") + 1)) + 1))
    norm = weighed.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norm, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def cosine(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col("embedding").cast("array<double>")
    return vectors.select("vec_id", F.round(dot(v, q) / F.sqrt(dot(v, v) * dot(q, q)), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)


def nearest(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """:func:`cosine` with the one vector of ``asked`` (embedding): none of it passes the driver, and without it there are no rows."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    one = asked.limit(1).select(F.col("embedding").cast("array<double>").alias("q"))
    v = F.col("embedding").cast("array<double>")
    met = vectors.join(F.broadcast(one))
    return met.select("vec_id", F.round(dot(v, F.col("q")) / F.sqrt(dot(v, v) * dot(F.col("q"), F.col("q"))), 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)


def fused(rankings: DataFrame) -> DataFrame:
    """``rankings`` (list, id, score; larger is better) as id and the sum of 1 / (60 + rank), ranks from 0."""
    placed = ordered.ranked(rankings, ["list"], [F.desc("score"), F.col("id")], "rank")
    return placed.groupBy("id").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 9).alias("score"))


def under_budget(pages: DataFrame, by: list[str], order: list[Column], size: str, budget: str) -> DataFrame:
    """Pages of each group in order while those before them stay under the budget; ``order`` must tell all pages apart.

    Ranges that begin beyond the budget go before sums are taken inside ranges.
    """
    deal = ordered.dealt(pages, by, order, F.col(size)).filter(F.col("_start") < F.col(budget))
    return ordered.summed(deal, by, order, "before").filter(F.col("before") < F.col(budget))


def quality(found: DataFrame, k: int = 5) -> DataFrame:
    """``found`` (query, rank from 1, relevant) as hit@1, hit@3 and mean reciprocal rank over the first ``k``."""
    best = found.groupBy("query").agg(F.min(F.when(F.col("relevant") & (F.col("rank") <= k), F.col("rank"))).alias("r"))
    share = lambda c: F.avg(F.coalesce(c.cast("double"), F.lit(0.0)))
    return best.agg(share(F.col("r") <= 1).alias("hit1"), share(F.col("r") <= 3).alias("hit3"), share(1 / F.col("r")).alias("mrr"))


def best_chunk(found: DataFrame) -> DataFrame:
    """``found`` (query, page, similarity) as the best similarity of each page; those not above 0 are dropped."""
    return found.groupBy("query", "page").agg(F.max("similarity").alias("similarity")).filter("similarity > 0")


def weighted_bm25(docs: DataFrame, terms: list[str], k: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id and score over several text columns: a term's count is the weighted sum of its counts in each (title 5, body 1).

    Length and mean length are of all columns together.  The counts are written into one pass, as in :func:`bm25`.
    """
    weights = weights or {"title": 5.0, "body": 1.0}
    read = docs.select("doc_id", *[tokens(F.col(c)).alias(f"t_{c}") for c in weights])
    hits = lambda c, p: F.size(F.filter(f"t_{c}", lambda w: w.startswith(p)))
    length = sum((F.size(f"t_{c}") for c in list(weights)[1:]), F.size(f"t_{next(iter(weights))}"))
    count = lambda p: sum((w * hits(c, p) for c, w in weights.items()), F.lit(0.0))
    return _ranked(written(read.select("doc_id", length.alias("len"), *[count(p).alias(f"n{i}") for i, p in enumerate(terms)]), "counts"), len(terms), k)
