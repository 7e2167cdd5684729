"""An inverted index of fragments of documents, written once and read by the words of a question.

The index is two Parquet tables: ``postings`` (term, fragment, how often, and what a search filters and ranks by),
in folders by the first two letters of the term and sorted by term inside, and ``fragments`` with the texts.  A question
reads only the folders, and there the row groups, of its terms; texts are read for the passages it found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.functions.text import excerpt
from tesela.operators.search import query_terms, tokens

#: Letters of a term that name its folder; no term of a question is shorter.
PREFIX = 2


def write_index(fragments: DataFrame, path: str, folders: int = 64) -> None:
    """Write the index of ``fragments`` (fragment, doc, document, drawer, hidden, page, ordinal, text) under ``path``.

    Postings are counted map-side before they are shuffled, once, by ranges of (prefix, term): a hot prefix lies in many
    ranges, and each range writes few folders.  A null text has no terms; its fragment counts in the statistics.
    """
    read = fragments.withColumn("t", tokens(F.col("text")))
    read.select(*fragments.columns, F.size("t").alias("length")).write.parquet(f"{path}/fragments")
    terms = read.select("fragment", "doc", "drawer", "hidden", F.size("t").alias("length"), F.explode("t").alias("term"))
    counted = terms.groupBy("term", "fragment").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc", "drawer", "hidden", "length")])
    counted = counted.withColumn("prefix", F.left("term", F.lit(PREFIX)))
    counted.repartitionByRange(folders, "prefix", "term", "fragment").sortWithinPartitions("prefix", "term", "fragment").write.partitionBy("prefix").parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """postings and fragments of an index; a term's prefix is text, also where it is all digits."""
    postings = spark.read.schema("term string, fragment string, n long, doc long, drawer string, hidden boolean, length int, prefix string").parquet(f"{path}/postings")
    return postings, spark.read.parquet(f"{path}/fragments")


def _asked(terms: list[str]) -> Column:
    """Postings whose term begins with one of the terms: by folder, then by term."""
    begun = F.lit(False)
    for t in terms:
        begun = begun | ((F.col("prefix") == t[:PREFIX]) & F.col("term").startswith(t))
    return F.col("prefix").isin(sorted({t[:PREFIX] for t in terms})) & begun


def ranked(postings: DataFrame, fragments: DataFrame, terms: list[str], k: int, drawer: str | None = None, document: int | None = None) -> DataFrame:
    """fragment and score (BM25, smaller is better) of the ``k`` best fragments of a drawer, hidden documents left out.

    As in full-text indexes, statistics are over all fragments, whatever drawer they are in and hidden or not.
    """
    hits = postings.filter(_asked(terms)).groupBy("fragment", "doc", "drawer", "hidden", "length")
    counted = hits.agg(*[F.coalesce(F.sum(F.when(F.col("term").startswith(t), F.col("n"))), F.lit(0)).alias(f"n{i}") for i, t in enumerate(terms)])
    sizes = fragments.agg(F.count("*").alias("rows"), F.avg("length").alias("mean"))
    having = counted.agg(*[F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        rarity = F.ln((F.col("rows") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        tf = F.col(f"n{i}")
        score = score - F.when(rarity <= 0, 1e-6).otherwise(rarity) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("length") / F.col("mean")))
    wanted = ~F.coalesce("hidden", F.lit(True))
    wanted = wanted if drawer is None else wanted & (F.col("drawer") == drawer)
    wanted = wanted if document is None else wanted & (F.col("doc") == document)
    # Both sides of these joins are one row each.
    scored = counted.join(F.broadcast(having.join(F.broadcast(sizes)))).filter(wanted)
    return scored.select("fragment", F.round(score, 6).alias("score")).orderBy("score", "fragment").limit(k)


def passages(postings: DataFrame, fragments: DataFrame, question: str, k: int, size: int, drawer: str | None = None, document: int | None = None) -> DataFrame | None:
    """fragment, doc, document, page, snippet and score of what best answers a question; None for one without a usable word.

    At most ``k`` fragments go back to the texts, so that their side of the join is the small one.
    """
    terms = query_terms(question)
    if not terms:
        return None
    found = ranked(postings, fragments, terms, k, drawer, document)
    texts = fragments.select("fragment", "doc", "document", "page", "text").join(F.broadcast(found), "fragment")
    return texts.select("fragment", "doc", "document", "page", excerpt(F.col("text"), F.array(*map(F.lit, terms)), F.lit(size)).alias("snippet"), "score")


def first_fragments(fragments: DataFrame, limit: int, drawer: str | None = None) -> DataFrame:
    """The first fragments of each document that nobody hid, in their order: what is read of it when no word fits.

    ``place`` counts from 1.  Each task keeps a document's first fragments before any are shuffled.
    """
    shown = fragments.filter(~F.coalesce("hidden", F.lit(True)))
    shown = shown if drawer is None else shown.filter(F.col("drawer") == drawer)
    order = Window.partitionBy("doc").orderBy("ordinal", "fragment")
    return shown.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
