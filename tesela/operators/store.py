"""A whole store at once: every text column of every table in one plan, from the tables' schemas alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from tesela.operators import scanner


def text_columns(schema: StructType) -> list[str]:
    """The columns that hold words: texts, and lists, structs and maps with texts in them."""

    def holds(kind: DataType) -> bool:
        if isinstance(kind, StructType):
            return any(holds(f.dataType) for f in kind)
        if isinstance(kind, ArrayType):
            return holds(kind.elementType)
        return isinstance(kind, StringType) or isinstance(kind, MapType) and (holds(kind.keyType) or holds(kind.valueType))

    return [f.name for f in schema if holds(f.dataType)]


def with_column(tables: dict[str, DataFrame], column: str) -> list[str]:
    """The tables that have a column, as one that says where a row comes from."""
    return sorted(name for name, t in tables.items() if column in t.columns)


def texts_of(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column and text of every text column that isn't null; what is no plain text is read as its JSON.

    One row of a table gives one row a column, in one pass over the table with no other column read.
    """
    parts = []
    for name, t in tables.items():
        kinds = {f.name: f.dataType for f in t.schema}
        plain = lambda c, kinds=kinds: F.col(f"`{c}`") if isinstance(kinds[c], StringType) else F.to_json(f"`{c}`")
        told = [F.struct(F.lit(c).alias("column"), plain(c).alias("text")) for c in text_columns(t.schema)]
        if told:
            parts.append(t.select(F.lit(name).alias("table"), F.explode(F.array(*told)).alias("x")).select("table", "x.*").filter("text is not null"))
    if not parts:
        raise ValueError("no table has a text column")
    return reduce(DataFrame.unionAll, parts)


def scanned(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, texts, findings and texts_with: identifiers of people that nobody may clear, counted, never shown.

    Only a text that may hold an identifier is folded and looked at; counts are added up map-side, one row a column.
    """
    rows = texts_of(tables)
    t = F.col("t")
    found = scanner.sized(t, *(scanner.gated(t, k) for k in sorted(scanner.BLOCKING)), F.filter(scanner.gated(t, "curp"), scanner.curp_check))
    counted = rows.select("table", "column", scanner.sought(F.col("text")).alias("t")).select("table", "column", found.alias("n"))
    return counted.groupBy("table", "column").agg(F.count("*").alias("texts"), F.sum("n").alias("findings"), F.count_if(F.col("n") > 0).alias("texts_with"))


def forgotten(tables: dict[str, DataFrame], lineage: str, document: str) -> dict[str, DataFrame]:
    """The tables with a lineage column (JSON naming a document) without the rows that come from a document.

    A null, or what is no JSON, comes from no document and stays.
    """
    own = F.coalesce(F.get_json_object(lineage, "$.document_id") == document, F.lit(False))
    return {name: tables[name].filter(~own) for name in with_column(tables, lineage)}
