"""A corpus from raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.  Written
stages live in the cluster's shared folder, so a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.llm import crf, lines, minhash, mixing, packing
from tesela.llm.common import checkpointed, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is a half or more.

    Null, empty and wordless texts get the share of good ones among such labelled texts.  Repeated rows fare alike, a null
    doc_id passes like any other, texts of any length are scored whole, columns beside the five of documents are
    dropped, and an empty table gives an empty result.  Without labels every score is a half, so all stay.
    """
    labels = table(spark, sf_dir, "labels")
    field = crf.fit(docs, labels)
    # Texts and scores share one pass: rows pass through the scorer whole.
    return crf.with_scores(docs.select(*COLUMNS), field).filter("score >= 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on eight sources or more, with n_chars of what is left.

    A document of such lines alone stays, with an empty text.  Null texts stay null, repeated rows fare alike, a null source
    counts for no site, texts of any length are read whole, columns beside the five are dropped, empty stays empty.
    """
    return lines.line_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity of 0.8 or more), that of the smallest doc_id.

    Rows alike in doc_id and text are one, with the smallest of their other columns; different texts of one doc_id are one
    document and stay or go together.  Rows without doc_id, and texts that are null or without words, are in no group and
    stay.  Texts of any length are read whole; columns beside the five are dropped; an empty table gives an empty result.
    """
    kept = minhash.near_duplicates(docs, threshold=80).filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    docs = docs.select(*COLUMNS)
    named = docs.join(kept.hint("merge"), F.col("doc_id") == F.col("kept_id"), "left_semi")
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = named.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("rest")).select("doc_id", "text", "rest.*").select(*COLUMNS)
    return once.union(docs.filter("doc_id is null"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that expected domain tokens come nearer the targets; every document stays at least once, four times at most.

    Null and wordless texts count for nothing and stay once.  Repeated rows get the same rate each, a null doc_id passes
    like any other, texts of any length are read whole, columns beside the five are dropped, empty stays empty.
    """
    labelled = mixing.domains_of(table(spark, sf_dir, "labels"))
    out = mixing.mixed(docs.select(*COLUMNS), labelled, mixing.TARGETS, least=1.0, most=4.0, growth=1.1)
    out = out.withColumn("copies", mixing.copies(F.col("rate"), F.col("doc_id"), F.col("row.text")))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("copies", F.lit(1)))).alias("copy")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, in the sources' proportions of the mixed corpus.

    A null text is an empty one, which is its end token alone; repeated rows are packed as often as they occur, rows
    without doc_id too; texts of any length are packed whole, further columns are ignored, empty stays empty.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing_to_targets), ("packing", packed)]

#: A trained classifier decides in the first stage, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
