"""Prepared changes: applied once, refused when stale, with their history and what others are told in the same row.

A ledger is a folder of Parquet tables, one a batch.  A change is one row of it: version, fields before and after, and
the fact to tell.  So a change and its history and outbox are written together or not at all, and what entities hold now is
the latest row of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.operators.fold import folded

_FIELD = "struct<field:string,before:string,after:string,protected:boolean>"
LEDGER = f"change string, fingerprint string, entity string, version long, held map<string,string>, fields array<{_FIELD}>, fact string, origin string, at timestamp"
_OUT = f"change string, fingerprint string, entity string, version long, held map<string,string>, fields array<{_FIELD}>, fact string, origin string, at timestamp, outcome string"
#: Outcomes of a change.
APPLIED, ALREADY, STALE, INVALID, NOTHING = "applied", "already_applied", "prepare_again", "invalid", "nothing_to_change"


def fingerprint(entity: Column, base: Column, values: Column) -> Column:
    """SHA-256 of what a change is: the same whatever the order of its fields, another for any other version or value."""
    return F.sha2(F.to_json(F.struct(entity.alias("entity"), base.cast("long").alias("base"), F.array_sort(F.map_entries(values)).alias("values"))), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that were written whole; none where there is no ledger yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(there):
        return spark.createDataFrame([], LEDGER)
    batches = [str(s.getPath()) for s in system.listStatus(there) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.schema(LEDGER).parquet(*batches) if batches else spark.createDataFrame([], LEDGER)


def current(ledger: DataFrame) -> DataFrame:
    """entity, version and held of every entity: no sort, and a hot entity is put together map-side."""
    return ledger.groupBy("entity").agg(F.max_by(F.struct("version", "held"), "version").alias("x")).select("entity", "x.*")


def decided(ledger: DataFrame, changes: DataFrame, protected: frozenset[str] = frozenset()) -> DataFrame:
    """Each change with its outcome and, if applied, the row that the ledger gets.

    ``changes`` (seq, change, entity, base_version, values: map of fields, approved: the fingerprint that was approved or null,
    valid, fact, origin, at) are decided in the order of seq:

    - a fingerprint that was applied before, in the ledger or earlier in the batch, is ``already_applied``, with that version;
    - an approved fingerprint that is not the change's own, or a base version that is not the entity's, is ``prepare_again``;
    - then ``invalid``, and ``nothing_to_change`` when every value is held already;
    - else it is ``applied`` at the next version.  Values of protected fields are held but stay out of history.

    A change repeated in a batch, under one seq and entity, counts once; a null entity or seq is left out; entities begin at version 0 with nothing held.
    """
    told = changes.filter("entity is not null and seq is not null").withColumn("fingerprint", fingerprint(F.col("entity"), F.col("base_version"), F.col("values")))
    told = told.withColumn("approved", F.coalesce(F.col("approved") == F.col("fingerprint"), F.lit(True)))
    state = current(ledger).select("entity", F.col("version").alias("now"), "held")
    done = ledger.select(F.col("entity").alias("_entity"), F.col("fingerprint").alias("_print"), F.col("version").alias("done"))
    joined = told.join(state, "entity", "left").join(done, (F.col("entity") == F.col("_entity")) & (F.col("fingerprint") == F.col("_print")), "left").drop("_entity", "_print")

    def start(row: dict) -> dict:
        return {"version": row["now"] or 0, "held": dict(row["held"] or []), "done": {}, "last": None}

    def step(state: dict, row: dict) -> dict | None:
        last, state["last"] = state["last"], (row["seq"], row["change"])
        if last == state["last"]:
            return None
        before = row["done"] or state["done"].get(row["_print"])
        if before:
            return {"outcome": ALREADY, "version": before}
        if not row["approved"] or row["base_version"] != state["version"]:
            return {"outcome": STALE}
        if not row["valid"]:
            return {"outcome": INVALID}
        moved = {f: v for f, v in row["values"] or [] if state["held"].get(f) != v}
        if not moved:
            return {"outcome": NOTHING}
        fields = [{"field": f, "before": None if f in protected else state["held"].get(f), "after": None if f in protected else v, "protected": f in protected} for f, v in sorted(moved.items())]
        state["version"] += 1
        state["held"].update(moved)
        state["done"][row["_print"]] = state["version"]
        return {"outcome": APPLIED, "version": state["version"], "held": sorted(state["held"].items()), "fields": fields}

    seen = joined.select("seq", "change", "entity", "base_version", "values", "approved", "valid", "fact", "origin", "at", "fingerprint", "now", "held", "done", F.col("fingerprint").alias("_print"))
    return folded(seen, ["entity"], ["seq", "change"], start, step, _OUT, ["change", "entity", "fingerprint", "fact", "origin", "at"], ["now", "held"])


def apply_batch(spark: SparkSession, path: str, batch: str, changes: DataFrame, protected: frozenset[str] = frozenset()) -> None:
    """Decide a batch against the ledger at ``path`` and write what is applied as its table ``batch``.

    A batch of that name which was written whole is not written again, and one that was cut short is written anew; its
    changes under another name find their fingerprints applied.  One writer at a time.
    """
    there = f"{path}/{batch}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{there}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return
    applied = decided(read_ledger(spark, path), changes, protected).filter(F.col("outcome") == APPLIED)
    applied.drop("outcome").write.mode("overwrite").parquet(there)


def history(ledger: DataFrame) -> DataFrame:
    """entity, version, at, origin, field, before, after and protected: one row a field that changed."""
    return ledger.select("entity", "version", "at", "origin", F.explode("fields").alias("f")).select("entity", "version", "at", "origin", "f.*")


def outbox(ledger: DataFrame) -> DataFrame:
    """change, entity, fact and at: what happened, for whoever reacts to it."""
    return ledger.select("change", "entity", "fact", "at")


def purged(audit: DataFrame, at: str, now: Column, years: int = 2) -> DataFrame:
    """Records of the last years; those without a time stay."""
    return audit.filter(F.coalesce(F.col(at) >= F.add_months(now, -12 * years), F.lit(True)))


def listed(audit: DataFrame, action: str, at: str, key: str, prefix: str | None, limit: int) -> DataFrame:
    """The newest records, at most 500 and at least one, whose action begins with a prefix."""
    some = audit if prefix is None else audit.filter(F.col(action).startswith(prefix))
    return some.orderBy(F.desc(at), F.desc(key)).limit(max(1, min(500, limit)))
