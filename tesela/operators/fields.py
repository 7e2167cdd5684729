"""What documents of a known kind say of themselves, by rules that are data: label, shape of the value, kind, field.

Pages are cut into lines; each rule of a document's kind looks at each line, and the first line of the first page that
answers wins, by a minimum that is taken map-side.  Every value comes with its page and line; what no rule finds is not
guessed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesela.functions import readings
from tesela.functions.checks import organisation_rfc_valid
from tesela.functions.text import search_fold

#: Fixed value: letters of a line that is kept as the place of a value.
LINE = 200
#: Words that tell a legal form, in the order in which they are looked for, and activities after their label.
LEGAL_FORMS = {
    "institucion de asistencia privada": "iap", "institucion de beneficencia privada": "ibp", "asociacion de beneficencia privada": "abp", "asociacion civil": "ac", "sociedad civil": "sc",
    " iap": "iap", " ibp": "ibp", " abp": "abp",
}
ACTIVITIES = {
    "asistencial": "assistance", "educativ": "education", "investigacion cientifica": "research", "cultural": "culture", "becante": "scholarships", "becas": "scholarships", "ecologic": "ecology", "especies": "species",
    "apoyo economico de donatarias": "support_donees", "obras o servicios publicos": "public_works", "bibliotecas": "libraries", "museos": "museums", "desarrollo social": "social_development",
}
NUMBER = ("número", "núm.", "núm", "no.", "")
DEEDS = ("articles_of_incorporation", "bylaws_amendments", "power_of_attorney")
#: What a picture shows in place of the six digits of a date in an identifier.
MISREAD_FROM, MISREAD_TO = "OILSB", "01158"

_VOWELS = {"a": "[aá]", "e": "[eé]", "i": "[ií]", "o": "[oó]", "u": "[uúü]"}


def said(phrase: str) -> str:
    """A pattern for a phrase whatever its case, accents and blanks."""
    plain = phrase.lower().translate(str.maketrans("áéíóú", "aeiou"))
    return r"\s+".join("".join(_VOWELS.get(c, "\\" + c if c in ".()/" else c) for c in w) for w in plain.split())


def first_of(text: Column, listed: dict[str, str]) -> Column:
    """The code of the first listed words that a folded text holds."""
    out = F.lit(None).cast("string")
    for words, code in reversed(listed.items()):
        out = F.when(F.contains(text, F.lit(words)), code).otherwise(out)
    return out


@dataclass(frozen=True)
class Rule:
    """A field of a kind of document: how to read it from a line and the next one; of two for a field the first that answers wins."""

    kind: str
    field: str
    read: Callable[[Column, Column], Column]
    page: int | None = None  # only on this page
    order: int = 0


def labelled(labels: tuple[str, ...], shape: str, use: Callable[[Column], Column] = F.trim, ignore_case: bool = True) -> Callable[[Column, Column], Column]:
    """Reads a value of some shape behind one of some labels and perhaps a colon."""
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?iu:{'|'.join(said(x) for x in labels)})\s*:?\s*({'(?i)' if ignore_case else ''}{shape})"

    def read(line: Column, after: Column) -> Column:
        value = F.regexp_extract(line, pattern, 1)
        return F.when(value != "", use(value))

    return read


def holding(phrases: tuple[str, ...], value: str) -> Callable[[Column, Column], Column]:
    """A value that a line tells by holding one of some phrases."""

    def read(line: Column, after: Column) -> Column:
        folded, found = search_fold(line), F.lit(False)
        for p in phrases:
            found = found | F.contains(folded, F.lit(p))
        return F.when(found, value)

    return read


def dated(labels: tuple[str, ...]) -> Callable[[Column, Column], Column]:
    """The first date behind a label on its line, else on the next."""
    pattern = f"(?iu)({'|'.join(said(x) for x in labels)})(.*)$"

    def read(line: Column, after: Column) -> Column:
        rest = F.regexp_extract(line, pattern, 2)
        dates = F.concat(readings.dates_in(rest), F.slice(readings.dates_in(F.coalesce(after, F.lit(""))), 1, 1))
        return F.when(F.regexp_extract(line, pattern, 1) != "", F.try_element_at(dates, F.lit(1)))

    return read


def _rfc(value: Column) -> Column:
    upper = F.upper(value)
    mended = F.concat(F.left(upper, F.lit(3)), F.translate(F.substring(upper, 4, 6), MISREAD_FROM, MISREAD_TO), F.substring(upper, 10, 3))
    return F.when(organisation_rfc_valid(mended), mended)


def _person(value: Column) -> Column:
    words = F.transform(F.split(F.trim(value), r"\s+"), lambda w: F.when(F.lower(w).isin("de", "del", "la", "las", "los", "y"), F.lower(w)).otherwise(F.initcap(w)))
    return F.array_join(words, " ")


def _deed(value: Column) -> Column:
    figures = F.regexp_replace(F.regexp_extract(value, r"^[0-9][0-9.,]*", 0), "[.,]", "")
    return F.when(figures != "", figures).otherwise(readings.leading_number_in_words(value).cast("string"))


def _with_digit(value: Column) -> Column:
    return F.when(value.rlike("[0-9]"), F.trim(value))


def _unpointed(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"\.+$", "")


def _first_date(line: Column, after: Column) -> Column:
    return F.try_element_at(readings.dates_in(line), F.lit(1))


_FOLIO = labelled(tuple(f"folio {n}".strip() for n in NUMBER), r"[A-Z0-9][A-Z0-9\-/]{2,20}", _with_digit)
_OFICIO = labelled(tuple(f"oficio {n}" for n in NUMBER if n), r"\d[0-9A-Z.\-/]{4,}", _unpointed)
_CLUNI = labelled(("cluni", "cluni)"), "[A-Z0-9]{10,20}")
_DEED = labelled(tuple(f"{e} {n}" for e in ("escritura", "escritura pública") for n in NUMBER if n), ".+", _deed)
_ISSUED = dated(tuple(f"fecha de {x}" for x in ("emisión", "expedición", "presentación", "inscripción", "registro")))
_VALID = dated(("vigente hasta", "vigencia hasta", "válido hasta", "vigencia: hasta"))
#: Kinds whose window says when they were issued and until when they are valid.
WINDOWS = ("tax_status_certificate", "tax_compliance_opinion", "donee_authorization", "cluni_certificate", "junta_registration", *DEEDS)

RULES = [
    Rule("tax_status_certificate", "institution.legal_rfc", labelled(("rfc", "r.f.c."), "[A-ZÑ&]{3}[0-9OILSB]{6}[A-Z0-9]{3}(?![A-Z0-9])", _rfc)),
    Rule("tax_status_certificate", "institution.legal_name", labelled(("denominación o razón social", "denominación/razón social"), ".+")),
    Rule("tax_status_certificate", "institution.legal_form", labelled(("régimen capital", "régimen de capital"), ".+", lambda v: first_of(F.replace(search_fold(v), F.lit("."), F.lit("")), LEGAL_FORMS))),
    Rule("tax_status_certificate", "institution.tax_regime", holding(("personas morales con fines no lucrativos",), "non_profit")),
    Rule("tax_status_certificate", "institution.tax_regime", holding(("regimen general de ley",), "general"), order=1),
    Rule("tax_status_certificate", "institution.fiscal_postal_code", labelled(("código postal",), r"\d{5}(?!\d)")),
    Rule("tax_status_certificate", "institution.record.reference", labelled(("idcif",), r"\d{8,12}(?!\d)")),
    Rule("donee_authorization", "institution.authorized_donee", holding(("autoriz",), "yes")),
    Rule("donee_authorization", "institution.authorized_donee", holding(("donativos deducibles",), "yes"), order=1),
    Rule("donee_authorization", "institution.donee_letter_number", _OFICIO),
    Rule("donee_authorization", "institution.record.reference", _OFICIO),
    Rule("donee_authorization", "institution.donee_letter_date", _first_date, page=1),
    Rule("donee_authorization", "institution.donee_category", labelled(("rubro",), ".{1,80}", lambda v: first_of(search_fold(v), ACTIVITIES))),
    Rule("articles_of_incorporation", "institution.founded_year", lambda a, b: F.left(_first_date(a, b), F.lit(4)), page=1),
    Rule("power_of_attorney", "institution.legal_rep_name", labelled(tuple(f"a favor de {x}".strip() for x in ("la señora", "el señor", "la licenciada", "el licenciado", "la contadora", "el contador", "")), r"[A-ZÁÉÍÓÚÑ]{2,}(?:\s+[A-ZÁÉÍÓÚÑ]{2,}){1,5}", _person, ignore_case=False)),
    Rule("cluni_certificate", "institution.cluni", labelled(("cluni", "cluni)"), "[A-Z0-9]{10,20}", lambda v: F.lit("yes"))),
    Rule("cluni_certificate", "institution.cluni_key", _CLUNI),
    Rule("cluni_certificate", "institution.record.reference", _CLUNI),
    Rule("junta_registration", "institution.junta_folio", _FOLIO),
    Rule("junta_registration", "institution.junta_folio", labelled(("número de institución", "número de registro"), r"\d[0-9A-Z\-/]{0,19}"), order=1),
    Rule("junta_registration", "institution.record.reference", _FOLIO),
    Rule("tax_compliance_opinion", "institution.record.reference", _FOLIO),
    *[Rule(k, "institution.record.reference", _DEED) for k in DEEDS],
    *[Rule(k, "institution.record.issued_on", _ISSUED) for k in WINDOWS],
    *[Rule(k, "institution.record.valid_until", _VALID) for k in WINDOWS],
]


def found(pages: DataFrame, rules: list[Rule] | None = None, opinion_days: int = 30) -> DataFrame:
    """doc, field, value, page, line and computed of what ``pages`` (doc, kind, page, text) say by the rules of their kind.

    The first page and line that answer win, a rule before those of a later order.  A tax opinion without an end is valid
    ``opinion_days`` from its issue: that is computed.  A null text has no lines; kinds without rules have no rows.
    """
    rules = RULES if rules is None else rules
    parts = F.split("text", "\r?\n")
    both = F.transform(parts, lambda x, i: F.struct(i.alias("n"), x.alias("line"), F.get(parts, i + 1).alias("after")))
    known = pages.filter(F.col("kind").isin(sorted({r.kind for r in rules})))
    lines = known.select("doc", "kind", "page", F.explode(both).alias("l")).select("doc", "kind", "page", "l.*").filter(F.trim("line") != "")
    whole = lambda r: (F.col("kind") == r.kind) if r.page is None else (F.col("kind") == r.kind) & (F.col("page") == r.page)
    # A rule is read once for all kinds that share it.
    readers = {r.read: r.read(F.col("line"), F.col("after")) for r in rules}
    names = {read: f"v{i}" for i, read in enumerate(readers)}
    wanted = {read: F.lit(False) for read in readers}
    for r in rules:
        wanted[r.read] = wanted[r.read] | whole(r)
    values = lines.select("*", *[F.when(wanted[read], value).alias(names[read]) for read, value in readers.items()])
    told = [F.when(whole(r), F.struct(F.lit(r.field).alias("field"), F.col(names[r.read]).alias("value"), F.lit(r.order).alias("order"))) for r in rules]
    rows = values.select("doc", "kind", "page", "n", "line", F.explode(F.filter(F.array(*told), lambda x: x["value"].isNotNull())).alias("x"))
    best = rows.groupBy("doc", "kind", "x.field").agg(F.min_by(F.struct("x.value", "page", "line"), F.struct("x.order", "page", "n")).alias("b"))
    flat = F.trim(F.regexp_replace("b.line", r"\s+", " "))
    short = F.when(F.length(flat) > LINE, F.concat(F.rtrim(F.left(flat, F.lit(LINE - 1))), F.lit("…"))).otherwise(flat)
    read = best.select("doc", "kind", "field", "b.value", "b.page", short.alias("line"), F.lit(False).alias("computed"))
    opinions = read.filter("kind = 'tax_compliance_opinion'").groupBy("doc").agg(
        F.max(F.when(F.col("field") == "institution.record.issued_on", F.struct("value", "page"))).alias("issued"), F.count_if(F.col("field") == "institution.record.valid_until").alias("ends")
    )
    until = F.date_format(F.date_add(F.col("issued.value").cast("date"), opinion_days), "yyyy-MM-dd")
    computed = opinions.filter("issued is not null and ends = 0").select("doc", F.lit("institution.record.valid_until").alias("field"), until.alias("value"), "issued.page", F.lit(f"{opinion_days} días naturales desde su emisión").alias("line"), F.lit(True).alias("computed"))
    return read.drop("kind").union(computed)
