"""Queries over proposals and changes, with SQL that folds them by recursion.  Orders of a customer are its events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.operators import changes, proposals
from tesela.sources import shared

_RANKS = {("campo0", "F"): 3, ("campo1", "O"): 2}


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, [*["propose"] * 7, "accept", "reject", "save"])), (F.floor(k / 2) % 10 + 1).cast("int"))
    key = _orders(spark, d).select(F.lit("perfil").alias("form"), F.col("o_custkey").cast("string").alias("record"), F.concat(F.lit("campo"), (k % 2).cast("string")).alias("field"), k.alias("at"), k.alias("id"), kind.alias("kind"), "o_orderstatus")
    told = key.withColumn("target", F.lag("id").over(Window.partitionBy("record", "field").orderBy("at")))
    at = F.col("at")
    return told.select("form", "record", "field", "at", "id", "kind", "target", F.when(at % 13 > 0, F.concat(F.lit("v"), (at % 3).cast("string"))).alias("value"), F.when(at % 4 == 0, "ai").otherwise("document").alias("origin"), proposals.authority(F.col("field"), F.col("o_orderstatus"), _RANKS).alias("rank"))


def proposal_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return proposals.outcomes(_events(spark, d)).select("record", "field", "id", "outcome", "waiting")


_FOLDED_PROPOSALS = """
WITH RECURSIVE k AS (SELECT CAST(o_custkey AS VARCHAR) AS record, 'campo' || (o_orderkey % 2) AS field, o_orderkey AS id, ['propose', 'propose', 'propose', 'propose', 'propose', 'propose', 'propose', 'accept', 'reject', 'save'][CAST(floor(o_orderkey / 2) AS BIGINT) % 10 + 1] AS kind,
  CASE WHEN o_orderkey % 13 > 0 THEN 'v' || (o_orderkey % 3) END AS value, o_orderkey % 4 > 0 AS doc, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'F' THEN 3 WHEN o_orderkey % 2 = 1 AND o_orderstatus = 'O' THEN 2 ELSE 1 END AS rank FROM orders),
e AS (SELECT *, lag(id) OVER (PARTITION BY record, field ORDER BY id) AS target, row_number() OVER (PARTITION BY record, field ORDER BY id) AS n FROM k),
s AS (
  SELECT DISTINCT record, field, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS o, false AS filled, CAST([] AS VARCHAR[]) AS refused, CAST(NULL AS BIGINT) AS w, CAST(NULL AS VARCHAR) AS wv, CAST(NULL AS BOOLEAN) AS wd, CAST(NULL AS INTEGER) AS wr FROM e
  UNION ALL
  SELECT record, field, n, id, o,
    CASE WHEN o = 'accepted' THEN true WHEN kind = 'save' THEN value IS NOT NULL ELSE filled END,
    CASE WHEN o = 'rejected' AND wd THEN list_append(refused, wv) ELSE refused END,
    CASE WHEN o = 'kept' THEN id WHEN o IN ('accepted', 'rejected') THEN NULL ELSE w END, CASE WHEN o = 'kept' THEN value ELSE wv END, CASE WHEN o = 'kept' THEN doc ELSE wd END, CASE WHEN o = 'kept' THEN rank ELSE wr END
  FROM (SELECT s.record, s.field, e.n, e.id, e.kind, e.value, e.doc, CAST(e.rank AS INTEGER) AS rank, s.filled, s.refused, s.w, s.wv, s.wd, s.wr,
      CASE e.kind WHEN 'propose' THEN CASE WHEN e.value IS NULL THEN 'empty' WHEN e.doc AND s.filled THEN 'filled' WHEN e.doc AND list_contains(s.refused, e.value) THEN 'rejected_before' WHEN e.doc AND s.w IS NOT NULL AND s.wd AND s.wr > e.rank THEN 'lower_authority' ELSE 'kept' END
        WHEN 'save' THEN CASE WHEN e.value IS NOT NULL AND s.w IS NOT NULL AND s.wd THEN 'rejected' ELSE 'saved' END
        ELSE CASE WHEN s.w IS NULL OR e.target IS NULL OR s.w <> e.target THEN 'not_waiting' WHEN e.kind = 'accept' THEN 'accepted' ELSE 'rejected' END END AS o
    FROM s JOIN e ON s.record = e.record AND s.field = e.field AND e.n = s.n + 1) x
)
"""
PROPOSAL_OUTCOMES_SQL = _FOLDED_PROPOSALS + "SELECT record, field, CAST(id AS VARCHAR) AS id, o AS outcome, CAST(w AS VARCHAR) AS waiting FROM s WHERE n > 0"


def proposals_waiting(spark: SparkSession, d: str) -> DataFrame:
    """Where every kept proposal stands in the end, with its value unless the field is protected."""
    return proposals.status(_events(spark, d), frozenset(["campo1"])).groupBy("field", "status", "value").agg(F.count("*").alias("proposals"))


PROPOSALS_WAITING_SQL = (
    _FOLDED_PROPOSALS
    + """, m AS (SELECT record, field, n, o, w, lag(w) OVER (PARTITION BY record, field ORDER BY n) AS before FROM s),
kept AS (SELECT record, field, id FROM s WHERE o = 'kept'), gone AS (SELECT record, field, before AS id, CASE WHEN o IN ('accepted', 'rejected') THEN o ELSE 'replaced' END AS status FROM m WHERE before IS NOT NULL AND (w IS NULL OR w <> before)),
t AS (SELECT kept.field, coalesce(status, 'pending') AS status, e.value FROM kept LEFT JOIN gone USING (record, field, id) JOIN e ON e.id = kept.id)
SELECT field, status, CASE WHEN field = 'campo0' OR status = 'pending' THEN value END AS value, count(*) AS proposals FROM t GROUP BY ALL
"""
)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    values = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("secret"), F.col("o_orderpriority"))
    entity, base = F.col("o_custkey").cast("string"), F.floor((F.col("n") - 1) / 2)
    own = changes.fingerprint(entity, base, values)
    approved = F.when(F.col("n") % 9 == 0, "another").when(F.col("n") % 2 == 0, own)
    return o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("chg"), F.col("o_orderkey").cast("string")).alias("change"), entity.alias("entity"), base.alias("base_version"), values.alias("values"), approved.alias("approved"), (F.col("n") % 7 > 0).alias("valid"), F.lit("orden_guardada").alias("fact"), F.lit("person").alias("origin"), F.col("o_orderdate").cast("timestamp").alias("at"))


def changes_decided(spark: SparkSession, d: str) -> DataFrame:
    told = changes.decided(spark.createDataFrame([], changes.LEDGER), _changes(spark, d), frozenset(["secret"]))
    said = F.array_join(F.transform("fields", lambda f: F.concat(f["field"], F.lit(":"), F.coalesce(f["before"], F.lit("-")), F.lit(">"), F.coalesce(f["after"], F.lit("-")))), " ")
    return told.select("change", "outcome", "version", said.alias("fields"))


_FOLDED_CHANGES = """
WITH RECURSIVE e AS (SELECT *, CAST(floor((n - 1) / 2) AS BIGINT) AS base, floor((n - 1) / 2) || '|' || o_orderstatus || '|' || o_orderpriority AS print FROM (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) o),
s AS (
  SELECT DISTINCT o_custkey, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS o, CAST(0 AS BIGINT) AS v, CAST(NULL AS BIGINT) AS told, CAST(NULL AS VARCHAR) AS st, CAST(NULL AS VARCHAR) AS pr, CAST(NULL AS VARCHAR) AS fields, CAST([] AS VARCHAR[]) AS done FROM e
  UNION ALL
  SELECT o_custkey, n, id, o, CASE WHEN o = 'applied' THEN v + 1 ELSE v END, CASE WHEN o = 'applied' THEN v + 1 WHEN o = 'already_applied' THEN base + 1 END, CASE WHEN o = 'applied' THEN nst ELSE st END, CASE WHEN o = 'applied' THEN npr ELSE pr END,
    CASE WHEN o = 'applied' THEN array_to_string(list_filter([CASE WHEN pr IS DISTINCT FROM npr THEN 'secret:->-' END, CASE WHEN st IS DISTINCT FROM nst THEN 'status:' || coalesce(st, '-') || '>' || nst END], lambda x: x IS NOT NULL), ' ') END, CASE WHEN o = 'applied' THEN list_append(done, print) ELSE done END
  FROM (SELECT s.o_custkey, e.n, e.o_orderkey AS id, s.v, s.st, s.pr, s.done, e.print, e.base, e.o_orderstatus AS nst, e.o_orderpriority AS npr,
      CASE WHEN list_contains(s.done, e.print) THEN 'already_applied' WHEN e.n % 9 = 0 OR e.base <> s.v THEN 'prepare_again' WHEN e.n % 7 = 0 THEN 'invalid' WHEN s.st = e.o_orderstatus AND s.pr = e.o_orderpriority THEN 'nothing_to_change' ELSE 'applied' END AS o
    FROM s JOIN e ON s.o_custkey = e.o_custkey AND e.n = s.n + 1) x
)
"""
CHANGES_DECIDED_SQL = _FOLDED_CHANGES + "SELECT 'chg' || id AS change, o AS outcome, told AS version, fields FROM s WHERE n > 0"


def ledger_after_replays(spark: SparkSession, d: str) -> DataFrame:
    """What entities hold when a batch is applied twice under one name and once more under another: as after once."""
    path = shared.place(spark, "ledger")
    batch = shared.written(_changes(spark, d), "changes")  # read twice
    for name in ("batch=1", "batch=1", "batch=2"):
        changes.apply_batch(spark, path, name, batch, frozenset(["secret"]))
    ledger = changes.read_ledger(spark, path)
    told = changes.outbox(ledger).groupBy("entity").agg(F.countDistinct("change").alias("facts"))
    fields = changes.history(ledger).groupBy("entity").agg(F.count("*").alias("fields"), F.count("after").alias("open"))
    return changes.current(ledger).join(told, "entity").join(fields, "entity").select("entity", "version", F.col("held")["status"].alias("status"), "facts", "fields", "open")


LEDGER_AFTER_REPLAYS_SQL = (
    _FOLDED_CHANGES
    + """SELECT CAST(o_custkey AS VARCHAR) AS entity, max(v) AS version, arg_max(st, n) AS status, count(*) FILTER (o = 'applied') AS facts,
  CAST(sum(len(string_split(fields, ' '))) AS BIGINT) AS fields, count(*) FILTER (contains(fields, 'status:')) AS open FROM s GROUP BY o_custkey HAVING max(v) > 0
"""
)


def audit_listed(spark: SparkSession, d: str) -> DataFrame:
    """The newest 200 records of two years whose kind begins with "p"; the moment is an argument."""
    events = spark.read.parquet(f"{d}/events.parquet")
    kept = changes.purged(events, "ts", F.lit("2026-01-02").cast("timestamp"))
    return changes.listed(kept, "event_type", "ts", "event_id", "p", 200).select("event_id", "event_type", "user_id")


AUDIT_LISTED_SQL = "SELECT event_id, event_type, user_id FROM events WHERE (ts IS NULL OR ts >= TIMESTAMP '2024-01-02') AND starts_with(event_type, 'p') ORDER BY ts DESC, event_id DESC LIMIT 200"

QUERIES = {f.__name__: f for f in (proposal_outcomes, proposals_waiting, changes_decided, ledger_after_replays, audit_listed)}
ORACLES = {k.removesuffix("_SQL").lower(): v for k, v in dict(globals()).items() if k.endswith("_SQL")}
