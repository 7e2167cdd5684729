"""Queries over texts: personal data, search, lines, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.functions.text import line_shape, normal, same_statement
from tesela.operators import personal, records, scanner, search


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_PATTERN = {k: p for k, p, _ in personal.DETECTORS}
_TERMS = ["tion", "licens", "pass"]
_LUHN = """(list_sum(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({x}, length({x}) - i + 1, 1) AS INTEGER)
    WHEN CAST(substr({x}, length({x}) - i + 1, 1) AS INTEGER) > 4 THEN 2 * CAST(substr({x}, length({x}) - i + 1, 1) AS INTEGER) - 9
    ELSE 2 * CAST(substr({x}, length({x}) - i + 1, 1) AS INTEGER) END)) % 10 = 0)"""


def pii_scan_counts(spark: SparkSession, d: str) -> DataFrame:
    return personal.counts(_t(spark, d, "documents"))


def _found_sql(kind: str) -> str:
    found = f"regexp_extract_all(coalesce(text, ''), '{_PATTERN[kind]}')"
    return f"len(list_filter({found}, lambda x: {_LUHN.format(x='x')}))" if kind == "card" else f"len({found})"


PII_SCAN_COUNTS_SQL = "\nUNION ALL\n".join(f"SELECT '{k}' AS kind, count(*) FILTER (n > 0) AS documents, CAST(sum(n) AS BIGINT) AS findings FROM (SELECT {_found_sql(k)} AS n FROM documents)" for k in _PATTERN)


def pii_decisions(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").withColumn("spans", scanner.scanner()("text"))
    choice = F.element_at(F.array(F.lit("keep"), F.lit("redact"), F.lit("override")), (F.col("doc_id") % 3 + 1).cast("int"))
    state = docs.select(personal.decided(F.col("spans"), choice == "override", choice == "redact").alias("decision"), scanner.lists_people(F.col("text"), F.col("spans")).alias("lists_people"))
    return state.groupBy("decision", "lists_people").agg(F.count("*").alias("documents"))


def pii_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").withColumn("spans", scanner.scanner()("text"))
    return docs.select("doc_id", F.size("spans").alias("findings"), F.md5(personal.redacted("text", "spans")).alias("text_md5"))


def pii_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    found = docs.select(F.col("source").alias("scope"), "doc_id", F.posexplode(personal.values(F.coalesce("text", F.lit("")), "phone")).alias("i", "value"))
    found = found.select("scope", F.lit("phone").alias("kind"), "value", F.struct("doc_id", "i").alias("place"))
    return personal.pseudonyms(found).select("scope", F.col("place.doc_id").alias("doc_id"), F.col("place.i").alias("i"), "mark")


PII_PSEUDONYMS_SQL = f"""
WITH f AS (SELECT source AS scope, doc_id, unnest(v) AS value, unnest(range(len(v))) AS i FROM (SELECT source, doc_id, regexp_extract_all(coalesce(text, ''), '{_PATTERN["phone"]}') AS v FROM documents)),
g AS (SELECT scope, value, min((doc_id, i)) AS place FROM f GROUP BY ALL),
m AS (SELECT scope, value, '[PHONE_' || row_number() OVER (PARTITION BY scope ORDER BY place, value) || ']' AS mark FROM g)
SELECT scope, doc_id, CAST(i AS INTEGER) AS i, mark FROM f JOIN m USING (scope, value)
"""


def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(_t(spark, d, "documents"), _TERMS, 20)


_TOKENS = "regexp_extract_all(translate(lower(coalesce(text, '')), 'áàäéèëíìïóòöúùü', 'aaaeeeiiiooouuu'), '[a-zñß0-9]+')"
_SCORE = " + ".join(f"greatest(-1, CASE WHEN ln((n_rows - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - d{i} + 0.5) / (d{i} + 0.5)) END * n{i} * 2.2 / (n{i} + 1.2 * (0.25 + 0.75 * len / mean)))" for i in range(len(_TERMS)))
SEARCH_BM25_SQL = f"""
WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
c AS (SELECT doc_id, len(t) AS len, {", ".join(f"len(list_filter(t, lambda w: starts_with(w, '{p}'))) AS n{i}" for i, p in enumerate(_TERMS))} FROM t),
s AS (SELECT count(*) AS n_rows, avg(len) AS mean, {", ".join(f"count(*) FILTER (n{i} > 0) AS d{i}" for i in range(len(_TERMS)))} FROM c)
SELECT doc_id, round(-({_SCORE}), 6) AS score FROM c, s WHERE {" OR ".join(f"n{i} > 0" for i in range(len(_TERMS)))} ORDER BY score, doc_id LIMIT 20
"""


def search_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """Items whose id is divisible by 100 as queries, against every other item that shares a term."""
    w = search.tfidf(_t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    a, b = w.select(F.col("doc_id").alias("a"), "term", F.col("weight").alias("wa")), w.select(F.col("doc_id").alias("b"), "term", F.col("weight").alias("wb"))
    return a.filter("a % 100 = 0").join(b, "term").filter("a <> b").groupBy("a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("similarity"))


SEARCH_TFIDF_SQL = f"""
WITH t AS (SELECT item_id AS doc_id, unnest({_TOKENS}) AS w FROM benchmark), c AS (SELECT doc_id, left(w, 6) AS term, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, count(*) AS d FROM c GROUP BY ALL), g AS (SELECT doc_id, term, (1 + ln(tf)) * (ln(((SELECT count(*) FROM benchmark) + 1) / (d + 1)) + 1) AS w FROM c JOIN f USING (term)),
h AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM g)
SELECT x.doc_id AS a, y.doc_id AS b, round(sum(x.w * y.w), 6) AS similarity FROM h x JOIN h y ON x.term = y.term AND x.doc_id % 100 = 0 AND y.doc_id <> x.doc_id GROUP BY ALL
"""


def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return search.tfidf(_t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).select("doc_id", "term", F.round("weight", 6).alias("weight"))


TFIDF_WEIGHTS_SQL = f"""
WITH t AS (SELECT item_id AS doc_id, unnest({_TOKENS}) AS w FROM benchmark), c AS (SELECT doc_id, left(w, 6) AS term, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, count(*) AS d FROM c GROUP BY ALL), g AS (SELECT doc_id, term, (1 + ln(tf)) * (ln(((SELECT count(*) FROM benchmark) + 1) / (d + 1)) + 1) AS w FROM c JOIN f USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM g
"""


def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    lists = [e.select(F.lit(c).alias("list"), F.col("user_id").alias("id"), F.col(c).cast("double").alias("score")) for c in ("n", "last")]
    return search.fused(lists[0].union(lists[1]))


RANK_FUSION_SQL = """
WITH e AS (SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL),
r AS (SELECT user_id, row_number() OVER (ORDER BY n DESC, user_id) - 1 AS r FROM e UNION ALL SELECT user_id, row_number() OVER (ORDER BY last DESC, user_id) - 1 FROM e)
SELECT user_id AS id, round(sum(1.0 / (60 + r)), 9) AS score FROM r GROUP BY ALL
"""


def budgeted_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("source", "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    total = docs.groupBy("source").agg(F.least(F.greatest(F.floor(F.sum("size") * 35 / 100), F.lit(8000)), F.lit(40000)).alias("budget"))
    return search.under_budget(docs.join(total, "source"), ["source"], [F.desc("size"), F.col("doc_id")], "size", "budget").select("source", "doc_id", "before")


BUDGETED_PAGES_SQL = """
WITH s AS (SELECT source, doc_id, length(coalesce(text, '')) AS size FROM documents), b AS (SELECT source, least(greatest(floor(sum(size) * 35 / 100), 8000), 40000) AS budget FROM s GROUP BY ALL),
r AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY size DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM s JOIN b USING (source))
SELECT source, doc_id, before FROM r WHERE before < budget
"""


def header_lines_removed(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = lines.select("doc", "page", line_shape(F.col("line")).alias("shape")).filter("shape <> ''").withColumn("shape", F.xxhash64("shape"))
    return records.repeated_lines(lines).groupBy("doc").agg(F.count("*").alias("lines"), F.countDistinct("shape").alias("shapes"))


_SHAPE = r"regexp_replace(trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')), '[0-9]+', '#', 'g')"
HEADER_LINES_REMOVED_SQL = f"""
WITH l AS (SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc, page, {_SHAPE} AS shape FROM l WHERE {_SHAPE} <> ''),
h AS (SELECT doc, shape FROM s GROUP BY ALL HAVING count(DISTINCT page) >= 3)
SELECT doc, count(*) AS lines, count(DISTINCT shape) AS shapes FROM s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc = s.doc AND h.shape = s.shape) GROUP BY ALL
"""


def evidence_states(spark: SparkSession, d: str) -> DataFrame:
    talk = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    quotes = talk.select(F.concat_ws("-", "doc", "page").alias("quote_id"), "doc", F.expr("page - page % 2").alias("cited"), F.substring("text", 5, 40).alias("quote"))
    return records.evidence(quotes, talk).groupBy("state").agg(F.count("*").alias("quotes"))


N, H = r"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))", r"regexp_replace({x}, '(\p{{L}})-\s+(\p{{Ll}})', '\1\2', 'g')"
EVIDENCE_STATES_SQL = f"""
WITH q AS (SELECT conv_id, turn, turn - turn % 2 AS cited, substr(text, 5, 40) AS quote FROM conversations),
h AS (SELECT q.conv_id, q.turn, arg_min(c.turn, abs(c.turn - cited) * 1000000 + c.turn) AS page FROM q JOIN conversations c ON c.conv_id = q.conv_id AND length(trim(quote)) >= 3 AND {N.format(x='quote')} <> '' AND CASE WHEN length(trim(quote)) < 12 THEN list_contains(list_transform(regexp_split_to_array(c.text, '\n|[|]|\t'), lambda x: {N.format(x='x')}), {N.format(x='quote')}) ELSE contains({N.format(x='c.text')}, {N.format(x='quote')}) OR contains({N.format(x=H.format(x='c.text'))}, {N.format(x=H.format(x='quote'))}) END GROUP BY ALL)
SELECT CASE WHEN page IS NULL THEN 'rejected' WHEN page = cited THEN 'verified' ELSE 'relocated' END AS state, count(*) AS quotes FROM q LEFT JOIN h USING (conv_id, turn) GROUP BY 1
"""


def same_statements(spark: SparkSession, d: str) -> DataFrame:
    talk = _t(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return talk.withColumn("before", F.lag("text").over(w)).filter("before is not null").groupBy(same_statement(F.col("text"), F.col("before")).alias("same")).agg(F.count("*").alias("turns"))


def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(normal(F.coalesce("text", F.lit("")))).alias("normal_md5"))


NORMAL_FORMS_SQL = r"SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'))) AS normal_md5 FROM documents"


def vector_top5(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings")
    return search.nearest(v, v.filter("vec_id = 0"), 5)


VECTOR_TOP5_SQL = "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 5"

QUERIES = {f.__name__: f for f in (pii_scan_counts, pii_decisions, pii_redacted, pii_pseudonyms, search_bm25, search_tfidf, tfidf_weights, rank_fusion, budgeted_pages, header_lines_removed, evidence_states, same_statements, normal_forms, vector_top5)}
ORACLES = {k.removesuffix("_SQL").lower(): v for k, v in dict(globals()).items() if k.endswith("_SQL")}
