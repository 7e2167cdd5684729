"""Proposals for fields: which are kept, which wait, and what became of them, as an ordered fold of events."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.operators.fold import folded

KEY = ["form", "record", "field"]
#: Outcomes of a proposal and of a decision.
KEPT, EMPTY, FILLED, REJECTED_BEFORE, LOWER = "kept", "empty", "filled", "rejected_before", "lower_authority"
ACCEPTED, REJECTED, NOT_WAITING = "accepted", "rejected", "not_waiting"


def fingerprint(value: Column) -> Column:
    """What tells a value again when it is no longer kept: SHA-256 of its JSON."""
    return F.sha2(F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r"^\{\"v\":|\}$", ""), 256)


def authority(field_name: Column, kind: Column, ranks: dict[tuple[str, str], int], unlisted: int = 1) -> Column:
    """How much say a kind of document has on a field."""
    if not ranks:
        return F.lit(unlisted)
    listed = F.create_map(*[F.lit(x) for (f, k), n in ranks.items() for x in (f"{f}\n{k}", n)])
    return F.coalesce(listed[F.concat_ws("\n", field_name, kind)], F.lit(unlisted))


@dataclass
class _Field:
    """What is known of one field: whether it holds a value, what was refused for it, and what waits."""

    filled: bool = False
    refused: set = field(default_factory=set)
    waiting: dict | None = None

    def propose(self, e: dict) -> str:
        document = e["origin"] == "document"
        if e["fingerprint"] is None:
            return EMPTY
        if document and self.filled:
            return FILLED
        if document and e["fingerprint"] in self.refused:
            return REJECTED_BEFORE
        if document and self.waiting and self.waiting["origin"] == "document" and (self.waiting["rank"] or 0) > (e["rank"] or 0):
            return LOWER
        self.waiting = e
        return KEPT

    def decide(self, e: dict) -> str:
        if self.waiting is None or self.waiting["id"] != e["target"]:
            return NOT_WAITING
        self.settle(e["kind"] == "accept")
        return ACCEPTED if e["kind"] == "accept" else REJECTED

    def settle(self, accepted: bool) -> None:
        if accepted:
            self.filled = True
        elif self.waiting["origin"] == "document":
            self.refused.add(self.waiting["fingerprint"])
        self.waiting = None

    def save(self, e: dict) -> str:
        """A person saved the field: a value sets a document's waiting proposal aside as if refused; emptying frees the field."""
        self.filled = e["fingerprint"] is not None
        if self.filled and self.waiting and self.waiting["origin"] == "document":
            self.settle(False)
            return REJECTED
        return "saved"

    def step(self, e: dict) -> dict:
        before = self.waiting["id"] if self.waiting else None
        outcome = {"propose": self.propose, "accept": self.decide, "reject": self.decide, "save": self.save}[e["kind"]](e)
        after = self.waiting["id"] if self.waiting else None
        gone = before if before is not None and before != after else None
        return {**{k: e[k] for k in KEY}, "id": e["id"], "outcome": outcome, "gone": gone, "waiting": after}


def outcomes(events: DataFrame) -> DataFrame:
    """form, record, field, id, outcome, gone (the proposal that no longer waits) and waiting (the one that does now).

    ``events`` (form, record, field, at, id, kind, target, value, origin, rank) are, in the order of (at, id):

    - ``propose``: kept unless empty.  One from a document is refused if the field is filled, if the same value was refused
      for it before, or if a document with more say on it still waits.  A kept one replaces what waits.
    - ``accept`` and ``reject`` of a ``target``: once, while it waits.  A refused value of a document is not proposed again.
    - ``save``: by a person, with a value or (null) without; a value sets aside what a document proposed.

    An event repeated, as when a batch is replayed, counts once.  Events of other kinds, without id or without time are left
    out.  Values are known by fingerprint alone.
    """
    known = events.filter(F.col("kind").isin("propose", "accept", "reject", "save") & F.col("id").isNotNull() & F.col("at").isNotNull())
    once = known.dropDuplicates([*KEY, "id"])
    told = once.select(*KEY, "at", F.col("id").cast("string").alias("id"), "kind", F.col("target").cast("string").alias("target"), "origin", F.col("rank").cast("long").alias("rank"),
        F.when(F.trim("value") != "", fingerprint(F.col("value"))).alias("fingerprint"))
    schema = ", ".join(f"{k} {told.schema[k].dataType.simpleString()}" for k in KEY)
    return folded(told, KEY, ["at", "id"], lambda e: _Field(), _Field.step, f"{schema}, id string, outcome string, gone string, waiting string")


def status(events: DataFrame, protected: frozenset[str] = frozenset()) -> DataFrame:
    """form, record, field, id, status and value of every kept proposal: pending, accepted, rejected or replaced.

    What became of a proposal is the latest event that moved it; the value of a protected field is forgotten with the
    decision.  The value comes from the events again, so that the fold carries none.
    """
    told = outcomes(events)
    kept = told.filter(F.col("outcome") == KEPT).select(*KEY, "id")
    moved = told.filter(F.col("gone").isNotNull()).select(*KEY, F.col("gone").alias("id"), F.when(F.col("outcome").isin(ACCEPTED, REJECTED), F.col("outcome")).otherwise("replaced").alias("status"))
    values = events.filter(F.col("kind") == "propose").select(*KEY, F.col("id").cast("string").alias("id"), "value").dropDuplicates([*KEY, "id"])
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in [*KEY, "id"]]
    out = kept.alias("k").join(moved.alias("m"), same("k", "m"), "left").join(values.alias("v"), same("k", "v"), "left")
    out = out.select(*[f"k.{k}" for k in [*KEY, "id"]], F.coalesce("m.status", F.lit("pending")).alias("status"), "v.value")
    hidden = F.col("field").isin(list(protected)) & (F.col("status") != "pending") if protected else F.lit(False)
    return out.withColumn("value", F.when(~hidden, F.col("value")))


def waiting_counts(statuses: DataFrame) -> DataFrame:
    return statuses.filter("status = 'pending'").groupBy("form").agg(F.count("*").alias("n"))


def origins(values: DataFrame, told: DataFrame, key: list[str]) -> DataFrame:
    """``values`` with ``origin``: what is on record, else that of a person."""
    return values.join(told.select(*key, "origin"), key, "left").withColumn("origin", F.coalesce("origin", F.lit("user")))


def named_documents(proposals: DataFrame, documents: DataFrame) -> DataFrame:
    """``proposals`` with document and page from the JSON in ``source_ref``, said where it came from no document.

    JSON that can't be read, or that names no document there is, gives nulls.
    """
    field_of = lambda name: F.get_json_object("source_ref", f"$.{name}")
    named = proposals.withColumn("_doc", field_of("document_id")).join(documents.select(F.col("id").cast("string").alias("_id"), F.col("name").alias("document")), F.col("_doc") == F.col("_id"), "left")
    from_document = F.col("_doc").isNotNull()
    return named.withColumn("page", F.when(from_document, field_of("page").try_cast("long"))).withColumn("said", F.when(~from_document, field_of("quote"))).drop("_doc", "_id")
