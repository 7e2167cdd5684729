"""Queries over an archive of fragments, each with its SQL.  A turn of a conversation is a fragment of its document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions.text import chunks
from tesela.operators import postings, search
from tesela.sources import shared

QUESTIONS = ["¿que tion?", "ver und einen", "ment eau anan"]
_TERMS = [search.query_terms(q) for q in QUESTIONS]
_SIZE, _K = 90, 8


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    doc, turn = F.col("conv_id").cast("long"), F.col("turn").cast("int")
    return turns.select(F.format_string("%d/%d", doc, turn).alias("fragment"), doc.alias("doc"), F.format_string("Acta %d", doc).alias("document"), F.coalesce("role", F.lit("")).alias("drawer"), (doc % 10 == 0).alias("hidden"), (turn + 1).alias("page"), turn.alias("ordinal"), "text")


def passages_found(spark: SparkSession, d: str) -> DataFrame:
    """The best passages of a drawer for each of three questions, by a written index."""
    path = shared.place(spark, "postings")
    postings.write_index(_fragments(spark, d).dropDuplicates(["fragment"]), path)
    index, texts = postings.read_index(spark, path)
    found = [postings.passages(index, texts, q, _K, _SIZE, "assistant").select(F.lit(i).alias("question"), "fragment", "document", "page", "snippet", "score") for i, q in enumerate(QUESTIONS)]
    return reduce(DataFrame.union, found)


_TOKENS = "regexp_extract_all(translate(lower(coalesce(text, '')), 'áàäéèëíìïóòöúùü', 'aaaeeeiiiooouuu'), '[a-zñß0-9]+')"


def _question_sql(q: int) -> str:
    terms = _TERMS[q]
    score = " + ".join(f"CASE WHEN ln((n_rows - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - d{i} + 0.5) / (d{i} + 0.5)) END * n{i} * 2.2 / (n{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(terms)))
    return f"""SELECT {q} AS question, fragment, document, page, flat, folded, '{"|".join(terms)}' AS terms, score FROM (
  SELECT *, round(-({score}), 6) AS score FROM (SELECT *, {", ".join(f"len(list_filter(t, lambda w: starts_with(w, '{p}'))) AS n{i}" for i, p in enumerate(terms))} FROM f) c,
    (SELECT count(*) AS n_rows, avg(len) AS mean, {", ".join(f"count(*) FILTER (len(list_filter(t, lambda w: starts_with(w, '{p}'))) > 0) AS d{i}" for i, p in enumerate(terms))} FROM f) s
  WHERE ({" OR ".join(f"n{i} > 0" for i in range(len(terms)))}) AND role = 'assistant' AND conv_id % 10 <> 0 ORDER BY score, fragment LIMIT {_K}) x"""


PASSAGES_FOUND_SQL = f"""
WITH f AS (SELECT conv_id || '/' || turn AS fragment, 'Acta ' || conv_id AS document, conv_id, role, turn + 1 AS page, {_TOKENS} AS t, len({_TOKENS}) AS len,
    trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, translate(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'áàäéèëíìïóòöúùü', 'aaaeeeiiiooouuu') AS folded FROM conversations),
p AS ({" UNION ALL ".join(f"SELECT * FROM ({_question_sql(q)}) q{q}" for q in range(len(QUESTIONS)))}),
h AS (SELECT *, greatest(0, length(regexp_extract(folded, '^(.*?(?:^|[^\\p{{L}}\\p{{N}}]))(?:' || terms || ')', 1)) - {_SIZE // 4}) AS near FROM p),
a AS (SELECT *, CASE WHEN near > 0 THEN length(regexp_extract(left(flat, near), '^.* ', 0)) ELSE 0 END AS a FROM h),
b AS (SELECT *, least(a + {_SIZE}, length(flat)) AS e FROM a), c AS (SELECT *, CASE WHEN strpos(substr(flat, e + 1), ' ') > 0 THEN e + strpos(substr(flat, e + 1), ' ') - 1 ELSE length(flat) END AS b FROM b)
SELECT question, fragment, document, CAST(page AS INTEGER) AS page, CASE WHEN a > 0 THEN '…' ELSE '' END || trim(substr(flat, a + 1, b - a)) || CASE WHEN b < length(flat) THEN '…' ELSE '' END AS snippet, score FROM c
"""


def first_fragments(spark: SparkSession, d: str) -> DataFrame:
    return postings.first_fragments(_fragments(spark, d), 2, "user").select("doc", "fragment", "place", F.md5("text").alias("text_md5"))


FIRST_FRAGMENTS_SQL = """
SELECT conv_id AS doc, conv_id || '/' || turn AS fragment, CAST(n AS INTEGER) AS place, md5(text) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id || '/' || turn) AS n FROM conversations WHERE role = 'user' AND conv_id % 10 <> 0) WHERE n <= 2
"""


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of texts whose paragraphs all fit: how many, how long, and that nothing was lost."""
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("chunks", chunks("text"))
    letters = lambda c: F.regexp_replace(c, "\\s+", "")
    return docs.select("doc_id", F.coalesce(F.array_max(F.transform("chunks", F.length)), F.lit(0)).between(0, 1000).alias("fits"), F.md5(letters(F.array_join("chunks", " "))).alias("letters_md5"))


TEXT_CHUNKS_SQL = r"SELECT doc_id, list_max(list_transform(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: length(w))) <= 1000 AS fits, md5(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS letters_md5 FROM documents"

QUERIES = {f.__name__: f for f in (passages_found, first_fragments, text_chunks)}
ORACLES = {k.removesuffix("_SQL").lower(): v for k, v in dict(globals()).items() if k.endswith("_SQL")}
