"""Nested readings of calls as JSON: items, amounts, days and what is missing as rows; cards; evidence; the second reading.

A document is a VARIANT, parsed once; projections are typed paths into it, so that Spark reads only what they name.  Walks
of unknown depth, and masks whose places matter, are Arrow functions over whole batches.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tesela.functions.arrow import each
from tesela.operators.fold import folded

#: Groups of a summary with their section and field, in the order in which a person reads them.
GROUPS = {
    "supported": "identidad.que_apoya", "who_can": "elegibilidad.quienes_pueden_participar", "who_cannot": "elegibilidad.quienes_no_pueden", "org_requirements": "elegibilidad.requisitos_organizacion",
    "regions": "elegibilidad.regiones", "target_population": "elegibilidad.poblacion_objetivo", "participation_limits": "elegibilidad.limites_participacion", "fundable": "financiamiento.conceptos_financiables",
    "not_fundable": "financiamiento.conceptos_no_financiables", "support_conditions": "financiamiento.condiciones_del_apoyo", "project_types": "proyecto.tipos", "objectives": "proyecto.objetivos",
    "expected_results": "proyecto.resultados_esperados", "indicators": "proyecto.indicadores", "project_requirements": "proyecto.requisitos_del_proyecto", "docs_required": "documentacion.obligatoria",
    "docs_conditional": "documentacion.condicional", "docs_optional": "documentacion.opcional", "formats": "documentacion.formatos_a_utilizar", "priorities": "evaluacion.prioridades",
    "disqualification": "evaluacion.causas_descalificacion", "evaluation_process": "evaluacion.proceso_evaluacion", "how_to_deliver": "entrega.instrucciones", "contact": "entrega.contacto",
}
#: Single amounts, fields whose absence is told, and blocks of a card with their groups.
AMOUNTS = {"max_amount": "monto_maximo", "min_amount": "monto_minimo", "cofunding": "porcentaje_cofinanciamiento", "admin_cap": "tope_gastos_administrativos"}
KEY_FIELDS = [
    "identidad.nombre", "identidad.convocante", "financiamiento.monto_maximo", "financiamiento.porcentaje_cofinanciamiento", "temporalidad.periodo_ejecucion", "entrega.medio_o_lugar", "evaluacion.criterios",
    "documentacion.obligatoria",
]
BLOCKS = {"who_can": ("who_can", "org_requirements"), "supported": ("supported",), "fundable": ("fundable",), "not_fundable": ("not_fundable",)}
OBLIGATIONS = ("obligatorio", "deseable", "informativo")
#: Letters of a line, points of a block, and what a walk for evidence keeps and passes by.
LINE, POINTS = 320, 3
EVIDENCE = frozenset("cita valor_texto titulo etiqueta aplica_a inicio_texto fin_texto nombre tema texto".split())
NO_EVIDENCE = frozenset("metadatos normalizado nota".split())
#: What stands for a passage that is taken already, letters of a group of pages and how many groups there are.
TAKEN, GROUP_LETTERS, MOST_GROUPS = "[…ya extraído…]", 40_000, 3

_PROOF = "evidencias: array<struct<cita: string, pagina: bigint, documento: string>>"
_ITEMS = f"array<struct<titulo: string, aplica_a: string, obligatoriedad: string, ponderacion: string, {_PROOF}>>"
_SINGLE = f"struct<estado: string, valor_texto: string, {_PROOF}>"
_DAYS = f"array<struct<tipo: string, etiqueta: string, inicio_texto: string, fin_texto: string, {_PROOF}>>"


def parsed(docs: DataFrame) -> DataFrame:
    """doc and v of ``docs`` (doc, json); what is no JSON is null."""
    return docs.select("doc", F.try_parse_json("json").alias("v"))


def _at(path: str, kind: str) -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def said(text: Column) -> Column:
    """A text on one line; null when blank."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(flat != "", flat)


def clipped(text: Column) -> Column:
    return F.when(F.length(text) <= LINE, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(LINE))), F.lit("…")))


def _source(x: Column) -> tuple[Column, Column, Column]:
    """Page, file and quote of the first proof."""
    proof = F.get(x["evidencias"], F.lit(0))
    return proof["pagina"], said(proof["documento"]), said(proof["cita"])


def items(docs: DataFrame) -> DataFrame:
    """doc, group, n (place in its list), text, applies_to, requirement, page and file of every item of every group.

    Criteria are a group of their own, with their weight behind the title.  An item without title is told by its quote, one
    without either is left out.
    """
    lists = [F.struct(F.lit(i).alias("g"), F.lit(name).alias("group"), _at(f"{path}.elementos", _ITEMS).alias("list")) for i, (name, path) in enumerate(GROUPS.items())]
    lists.append(F.struct(F.lit(len(GROUPS)).alias("g"), F.lit("criteria").alias("group"), _at("evaluacion.criterios.criterios", _ITEMS).alias("list")))
    each = parsed(docs).select("doc", F.explode(F.array(*lists)).alias("x")).select("doc", "x.group", F.posexplode("x.list").alias("n", "i"))
    page, file, quote = _source(F.col("i"))
    weight = said(F.col("i.ponderacion"))
    line = clipped(F.coalesce(said(F.col("i.titulo")), quote))
    told = F.when((F.col("group") == "criteria") & weight.isNotNull(), F.concat(line, F.lit(" ("), weight, F.lit(")"))).otherwise(line)
    own = F.col("group") != "criteria"
    out = each.select("doc", "group", "n", told.alias("text"), F.when(own, said(F.col("i.aplica_a"))).alias("applies_to"), F.when(own & F.col("i.obligatoriedad").isin(*OBLIGATIONS), F.col("i.obligatoriedad")).alias("requirement"), page.alias("page"), file.alias("file"))
    return out.filter("text is not null")


def amounts(docs: DataFrame) -> DataFrame:
    """doc, kind, value, page and file of the amounts that a call names once."""
    each = parsed(docs).select("doc", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _at(f"financiamiento.{f}", _SINGLE).alias("x")) for k, f in AMOUNTS.items()])).alias("a")).select("doc", "a.*")
    page, file, quote = _source(F.col("x"))
    value = F.when(F.coalesce(F.col("x.estado"), F.lit("")) != "no_aparece", clipped(F.coalesce(said(F.col("x.valor_texto")), quote)))
    return each.select("doc", "kind", value.alias("value"), page.alias("page"), file.alias("file")).filter("value is not null")


def days(docs: DataFrame) -> DataFrame:
    """doc, n, kind, label, when, page and file of the milestones that have a start."""
    each = parsed(docs).select("doc", F.posexplode(_at("temporalidad.hitos.hitos", _DAYS)).alias("n", "h"))
    page, file, quote = _source(F.col("h"))
    start, end = said(F.col("h.inicio_texto")), said(F.col("h.fin_texto"))
    when = F.when(end.isNotNull(), F.concat(start, F.lit(" al "), end)).otherwise(start)
    label = F.coalesce(clipped(F.coalesce(said(F.col("h.etiqueta")), quote)), F.lit(""))
    return each.filter(start.isNotNull()).select("doc", "n", F.coalesce("h.tipo", F.lit("otro")).alias("kind"), label.alias("label"), when.alias("when"), page.alias("page"), file.alias("file"))


def missing(docs: DataFrame) -> DataFrame:
    """doc and field of the fields whose absence a person should hear about: not found, and no list in their place."""
    empty = lambda path, name: F.coalesce(F.size(_at(f"{path}.{name}", "array<variant>")), F.lit(0)) <= 0
    absent = [F.when((F.coalesce(_at(f"{p}.estado", "string"), F.lit("no_aparece")) == "no_aparece") & empty(p, "elementos") & empty(p, "criterios"), F.lit(p)) for p in KEY_FIELDS]
    return parsed(docs).select("doc", F.explode(F.array_compact(F.array(*absent))).alias("field"))


def cards(told: DataFrame) -> DataFrame:
    """doc, block, points (three texts at most) and more of :func:`items`: each line once in its block.

    Without what a call supports, its objectives stand there.  A block that says what an earlier one does is left out.
    """
    block, rank = F.lit(None).cast("string"), F.lit(0)
    for name, groups in {**BLOCKS, "objectives": ("objectives",)}.items():
        for i, g in enumerate(groups):
            block, rank = F.when(F.col("group") == g, name).otherwise(block), F.when(F.col("group") == g, i).otherwise(rank)
    lines = told.withColumn("block", block).withColumn("rank", rank).filter("block is not null").withColumn("key", F.lower("text"))
    once = lines.groupBy("doc", "block", "key").agg(F.min(F.struct("rank", "n", "text")).alias("x"))
    blocks = once.groupBy("doc", "block").agg(F.sort_array(F.collect_list("x")).alias("all"))
    supported = F.max(F.col("block") == "supported")
    known = blocks.groupBy("doc").agg(supported.alias("has"), F.collect_list(F.struct("block", F.transform("all", lambda x: x["text"]).alias("texts"))).alias("blocks"))
    order = F.array(*[F.lit(b) for b in BLOCKS])
    named = F.transform(F.filter("blocks", lambda b: (b["block"] != "objectives") | ~F.col("has")), lambda b: F.struct(F.array_position(order, F.when(b["block"] == "objectives", "supported").otherwise(b["block"])).alias("at"), F.slice(b["texts"], 1, POINTS).alias("points"), (F.size(b["texts"]) - F.least(F.size(b["texts"]), F.lit(POINTS))).alias("more")))
    low = lambda points: F.transform(points, F.lower)
    start = F.slice(named, 1, 0)
    kept = F.aggregate(F.array_sort(named), start, lambda a, b: F.when(F.exists(a, lambda x: low(x["points"]) == low(b["points"])), a).otherwise(F.array_append(a, b)))
    return known.select("doc", F.explode(kept).alias("b")).select("doc", F.element_at(order, F.col("b.at").cast("int")).alias("block"), "b.points", "b.more")


def walk(value: object, keep: frozenset[str], skip: frozenset[str]) -> list[str]:
    """The texts under some keys anywhere in nested JSON, in its order; what is under others is passed by."""
    out: list[str] = []
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, dict):
            for k, x in reversed(v.items()):
                if k in keep and isinstance(x, str):
                    todo.append(_Said(x))
                elif k not in skip:
                    todo.append(x)
        elif isinstance(v, _Said):
            out.append(v.text)
    return out


class _Said:
    """A text that a walk has chosen to keep, while it waits for its turn."""

    def __init__(self, text: str):
        self.text = text


@F.arrow_udf(StringType())
def evidence_text(text: pa.Array) -> pa.Array:
    """What a reading quotes and copies, a line each, without notes and normal forms; null for what is no JSON."""

    def read(t: str | None) -> str | None:
        try:
            return None if t is None else "\n".join(walk(json.loads(t), EVIDENCE, NO_EVIDENCE))
        except ValueError:
            return None

    return pa.array([read(t) for t in text.to_pylist()], pa.string())


def masked_text(text: str, quotes: list[str]) -> str:
    """The text with :data:`TAKEN` for each quote, whatever the blanks between its words, once for neighbours and overlaps."""
    spans = sorted(m.span() for q in quotes if q.split() for m in re.finditer(r"\s+".join(map(re.escape, q.split())), text))
    out, at = "", 0
    for a, b in spans:
        if b <= at:
            continue
        out += text[at:a] if a > at else ""
        out += "" if out.rstrip().endswith(TAKEN) else TAKEN
        at = b
    return out + text[at:]


@F.arrow_udf(StringType())
def masked(text: pa.Array, quotes: pa.Array) -> pa.Array:
    """:func:`masked_text` of each row; null quotes are none."""
    return each(lambda t, q: None if t is None else masked_text(t, [x for x in q or [] if x]), pa.string(), text, quotes)


def page_groups(pages: DataFrame, letters: int = GROUP_LETTERS, most: int = MOST_GROUPS) -> DataFrame:
    """doc, page and group (from 0) of ``pages`` (doc, page, text): runs of pages within so many letters, so many runs at most.

    Pages of later groups are left out, as is the purpose; a page that is longer than a group goes alone.  A null text has no
    letters; pages stream in order, so a document of any number of pages takes one number of memory.
    """
    sized = pages.select("doc", F.col("page").cast("long").alias("page"), F.length(F.coalesce("text", F.lit(""))).alias("size"))

    def step(state: dict, row: dict) -> dict | None:
        if state["group"] < 0 or state["size"] + row["size"] > letters:
            state["group"], state["size"] = state["group"] + 1, 0
        state["size"] += row["size"]
        return {"doc": row["doc"], "page": row["page"], "group": state["group"]} if state["group"] < most else None

    return folded(sized, ["doc"], ["page"], lambda row: {"group": -1, "size": 0}, step, f"doc {sized.schema['doc'].dataType.simpleString()}, page long, group int")


@F.arrow_udf(ArrayType(StringType()))
def quotes_of(text: pa.Array) -> pa.Array:
    """Every quote of a reading, at any depth and in its order; null for what is no JSON."""

    def read(t: str | None) -> list[str] | None:
        try:
            return None if t is None else walk(json.loads(t), frozenset(("cita",)), frozenset())
        except ValueError:
            return None

    return pa.array([read(t) for t in text.to_pylist()], pa.list_(pa.string()))
