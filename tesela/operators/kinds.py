"""What a text is: the kind of a document by its words, and the line that tells what a page is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions.text import line_shape, search_fold

#: A kind's code, the phrases of its text and those of file names; a phrase is words that must all occur.
Kind = tuple[str, list[list[str]], list[list[str]]]
#: Characters that say what a document is, and characters read to recognise it.
HEAD, BODY = 400, 6_000

#: The papers of an institution, what their texts say and what names of their files do.
PAPERS: list[Kind] = [
    ("tax_status_certificate", [["constancia de situacion fiscal"], ["cedula de identificacion fiscal"]], [["constancia", "fiscal"], ["csf"]]),
    ("tax_compliance_opinion", [["opinion del cumplimiento"], ["opinion de cumplimiento", "obligaciones fiscales"]], [["opinion"], ["32 d"], ["32d"]]),
    ("donee_authorization", [["donativos deducibles", "oficio", "autoriza"], ["donataria autorizada", "oficio"]], [["donataria"]]),
    ("cluni_certificate", [["clave unica de inscripcion"], ["registro federal de las organizaciones de la sociedad civil"]], [["cluni"]]),
    ("power_of_attorney", [["poder general"], ["pleitos y cobranzas", "apoderad"], ["otorga", "poder especial"]], [["poder"]]),
    ("bylaws_amendments", [["reforma", "estatutos", "protocoliza"], ["modificacion", "estatutos", "acta de asamblea"]], [["reforma"], ["modificacion", "estatutos"]]),
    ("articles_of_incorporation", [["escritura", "constituir", "estatutos"], ["acta constitutiva"]], [["constitutiva"]]),
    ("junta_registration", [["junta", "asistencia privada", "constancia de registro"], ["junta", "asistencia privada", "registro", "folio"], ["numero de institucion", "objeto"]], [["registro", "junta"], ["registro", "jap"]]),
    ("social_care_registry", [["registro nacional de centros de asistencia social"]], [["rncas"], ["centros de asistencia"]]),
    ("sanitary_notice", [["aviso de funcionamiento"]], [["aviso", "funcionamiento"]]),
    ("land_use_license", [["uso de suelo"], ["uso del suelo"]], [["uso", "suelo"]]),
    ("civil_protection_program", [["programa interno de proteccion civil"]], [["proteccion civil"]]),
    ("privacy_notice", [["aviso de privacidad"]], [["privacidad"]]),
    ("internal_rules", [["reglamento interno"]], [["reglamento"]]),
    ("org_chart", [["organigrama"]], [["organigrama"]]),
    ("financial_statements", [["estados financieros"], ["estado de actividades"], ["estado de posicion financiera"]], [["estados financieros"], ["estado financiero"]]),
    ("junta_budget", [["presupuesto", "junta", "asistencia privada"]], [["presupuesto"]]),
    ("annual_report", [["informe anual"], ["informe de actividades"]], [["informe"]]),
]
#: Classes of calls in the order in which they are looked for, by whole words and phrases, and by letters alone
#: for titles that are set wide.
CLASSES: list[tuple[str, list[str], list[str], list[str]]] = [
    ("reglas_de_operacion", [], ["reglas de operacion", "reglas operativas"], ["reglasdeoperacion"]),
    ("lineamientos", ["lineamientos", "reglamento"], [], ["lineamientos", "reglamento"]),
    ("convocatoria", ["convocatoria", "bases", "convocatorias"], [], ["convocatoria"]),
    ("aviso", ["aviso", "comunicado"], ["fe de erratas"], ["comunicado"]),
    ("guia", ["guia", "manual", "instructivo"], [], ["instructivo"]),
    ("formato", ["formato", "solicitud", "formulario", "cuestionario"], ["carta compromiso"], ["formulario", "cuestionario", "cartacompromiso"]),
    ("anexo", ["anexo"], [], []),
]
#: Fixed value: from this confidence on a file is kept where it was put.
SURE = 1


def _holds(text: Column, phrase: list[str]) -> Column:
    found = F.contains(text, F.lit(phrase[0]))
    for w in phrase[1:]:
        found = found & F.contains(text, F.lit(w))
    return found


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def scores(text: Column, kinds: list[Kind]) -> Column:
    """(score, code) of every kind: three for each phrase in the first lines, one for one further on."""
    body = F.left(search_fold(F.left(F.coalesce(text, F.lit("")), F.lit(BODY))), F.lit(BODY))

    def scored(t: Column) -> Column:
        points = lambda p: F.when(_holds(t["head"], p), 3).when(_holds(t["body"], p), 1).otherwise(0)
        return F.array(*[F.struct(sum(map(points, phrases[1:]), points(phrases[0])).alias("score"), F.lit(code).alias("code")) for code, phrases, _ in kinds])

    return _once(body, lambda b: _once(F.struct(F.left(b, F.lit(HEAD)).alias("head"), b.alias("body")), scored))


def recognised(scored: Column) -> Column:
    """The kind with most points; null without any or where two share them."""

    def best(all_: Column) -> Column:
        top = F.array_max(all_)
        shared = F.size(F.filter(all_, lambda s: s["score"] == top["score"])) > 1
        return F.when((top["score"] > 0) & ~shared, top["code"])

    return _once(scored, best)


def confidence(scored: Column, file_name: Column, put_on: Column, kinds: list[Kind]) -> Column:
    """The points of the kind a file was put on, less the best rival's, and one if its name says so; sure from one on."""
    most = lambda own: F.coalesce(F.array_max(F.transform(F.filter(scored, lambda s: (s["code"] == put_on) == own), lambda s: s["score"])), F.lit(0))
    stem = F.regexp_replace(search_fold(F.coalesce(file_name, F.lit(""))), "\\.[^.]*$", "")
    words = F.array_join(F.filter(F.split(stem, "[^\\p{L}\\p{N}]+"), lambda w: w != ""), " ")
    named = F.lit(False)
    for code, _, names in kinds:
        for n in names:
            named = named | ((put_on == code) & _holds(words, n))
    return F.when(put_on.isin([k[0] for k in kinds]), most(True) - most(False) + named.cast("int")).otherwise(0)


def page_labels(pages: DataFrame) -> DataFrame:
    """``pages`` (doc, page, text) with ``label``: the first line of three letters or more that is no running header.

    In documents of four pages or more, a shape on three tenths of them is a header; where all lines are, the first counts
    after all.  Shapes are counted by their hashes over all pages of a document, not in one task.
    """
    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    lines = lines.filter(F.length(F.regexp_replace("line", "[^\\p{L}]", "")) >= 3).withColumn("shape", F.xxhash64(line_shape(F.col("line"))))
    many = pages.groupBy("doc").agg(F.count("*").alias("pages"))
    repeats = lines.select("doc", "page", "shape").distinct().groupBy("doc", "shape").agg(F.count("*").alias("on"))
    headers = repeats.join(many, "doc").filter((F.col("pages") >= 4) & (F.col("on") * 10 >= F.col("pages") * 3)).select("doc", "shape", F.lit(1).alias("header"))
    told = lines.join(headers, ["doc", "shape"], "left")
    first = told.groupBy("doc", "page").agg(F.min_by("line", F.struct(F.coalesce("header", F.lit(0)), "n")).alias("line"))
    return pages.join(first, ["doc", "page"], "left").select("doc", "page", F.left(F.coalesce("line", F.lit("")), F.lit(80)).alias("label"))


def placement(scored: Column, file_name: Column, put_on: Column, kinds: list[Kind]) -> Column:
    """struct(state, kind): sure where a file fits or its kind is none of the list, other (with the kind its words say) or unsure."""
    fits = ~F.coalesce(put_on.isin([k[0] for k in kinds]), F.lit(False)) | (confidence(scored, file_name, put_on, kinds) >= SURE)
    said = recognised(scored)
    elsewhere = said.isNotNull() & (said != put_on)
    return F.struct(F.when(fits, "sure").when(elsewhere, "other").otherwise("unsure").alias("state"), F.when(~fits & elsewhere, said).alias("kind"))


def call_class(text: Column) -> Column:
    """The class a call names itself by: the first whose words or phrases it holds, else by its letters without blanks."""

    def told(words: Column) -> Column:
        joined, letters = F.array_join(words, " "), F.array_join(words, "")
        out = F.lit(None).cast("string")
        for code, _, _, wide in reversed(CLASSES):
            for x in wide:
                out = F.when(F.contains(letters, F.lit(x)), code).otherwise(out)
        for code, single, phrases, _ in reversed(CLASSES):
            found = F.arrays_overlap(words, F.array(*map(F.lit, single)).cast("array<string>"))
            for p in phrases:
                found = found | F.contains(joined, F.lit(p))
            out = F.when(F.coalesce(found, F.lit(False)), code).otherwise(out)
        return out

    return _once(F.filter(F.split(search_fold(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != ""), told)
