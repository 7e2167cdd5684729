"""Hand-worked values of the scalar functions and operators that the driver's tables don't exercise."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tesela.functions import checks, text, values
from tesela.operators import personal, records, search
from tesela.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (checks.clabe_valid, "002115016003269411", True), (checks.clabe_valid, "002115016003269412", False), (checks.nss_valid, "73015628404", True), (checks.nss_valid, "73015628405", False),
        (checks.card_valid, "4539 1488 0343 6467", True), (checks.card_valid, "4539148803436468", False), (checks.plausible_yymmdd, "010229", True), (checks.plausible_yymmdd, "010431", False),
        (text.search_fold, "Niño ÁRBOL", "niño arbol"), (text.scan_fold, "Niño árbol", "NINO ARBOL"), (text.normal, "  A--b, ¡C 3! ", "a b c 3"), (text.line_shape, "Page 12 of 340", "page # of #"),
        (text.dehyphenated, "exam-\nple Co-Op", "example Co-Op"), (text.cleaned, "ﬁn \n\n\n\nx", "fin\n\nx"), (values.pesos, "$ 1,250,000", 1250000), (values.pesos, "12,50", None), (values.pesos, "10.50", None),
        (values.locale_number, "1,250,000.50", 1250000.5), (values.locale_number, "1.250.000,50", 1250000.5), (values.locale_number, "1,5", 1.5), (values.locale_number, "250 000", 250000.0), (values.locale_number, "x", None), (values.locale_number, "1.250", 1.25), (values.locale_number, "1,234567", 1234567.0), (values.locale_number, "250,", 250.0), (values.pesos, "1.250.000", 1250000), (values.pesos, "1 250", 1250), (values.pesos, "99999999999999999999", None), (checks.nss_valid, "7301 5628-404", True), (checks.curp_check, "?OMC850101HDFRRL09", False), (text.search_fold, "âé", "âe"), (text.scan_fold, "Straße e\u0301", "STRAßE E"), (text.cleaned, " a\u00ad\ufb03  b\r\n c https:/ /x ", "affi b\nc https://x"), (text.dominant_year, "2019 2021 2021 2019 1999", 2021),
        (values.date_valid, "2024-02-29", True), (values.date_valid, "2023-02-29", False), (values.date_valid, "1850-01-01", False), (values.date_valid, None, False),
    ],
)
def test_scalar(spark, function, value, want):
    assert one(spark, function(F.lit(value).cast("string"))) == want


def test_check_digits_single_out_one_of_ten(spark):
    """Of the ten ends of an identifier just one may be right."""
    for valid, stem, ends in ((checks.clabe_valid, "01218000118359719", "0123456789"), (checks.curp_valid, "GOMC850101HDFRRL0", "0123456789"), (checks.rfc_valid, "GOMC850101AB", "0123456789A")):
        rows = spark.createDataFrame([(stem + c,) for c in ends], "v string")
        assert rows.filter(valid(F.col("v"))).count() == 1


def test_names_of_one_form_and_statements(spark):
    same = lambda a, b: one(spark, text.same_statement(F.lit(a), F.lit(b)))
    assert same("The term is 12 months", "term is 12 months") and not same("12 months", "10 months") and not same("", "") and not same("a1 b", "1 b")
    assert one(spark, text.scan_places(F.lit("ae\u0301b"))) == [0, 1, 3]
    assert tuple(one(spark, checks.curp_birth(F.lit("gomc 850431-HDFRRL09")))) == (85, 4, 31)
    assert one(spark, checks.month_and_day(F.lit("850431"))) and not one(spark, checks.month_and_day(F.lit("851301")))
    assert one(spark, checks.masked(F.lit("ab-cd ef"), 2, 2)) == "AB••EF"
    assert one(spark, values.banded(F.lit(5), *values.SENIORITY)) == "5 to 9" and one(spark, values.annual(F.lit(5), F.lit("monthly"))) == 60


def test_chunks_and_excerpts(spark):
    long = "word " * 450
    df = spark.createDataFrame([("a\n\n b \n\n\n" + "c" * 997,), (long + "\n\ntail",), (None,), (" ",)], "t string").select(text.chunks("t").alias("c"))
    got = [r.c for r in df.collect()]
    assert got[0] == ["a\n\nb", "c" * 997] and got[2] == got[3] == []
    assert all(len(x) < 1000 for x in got[1]) and " ".join(got[1]).split() == [*long.split(), "tail"] and got[1][-1] == "tail"
    cut = lambda t, terms, n: one(spark, text.excerpt(F.lit(t), F.array(*map(F.lit, terms)), F.lit(n)))
    assert cut("one two three four five six", ["four"], 8) == "…three four…" and cut("one two", ["x"], 50) == "one two" and cut("Él da becás hoy a todos", ["beca"], 6).startswith("…")


def test_forms(spark):
    rows = spark.createDataFrame([(1, "yes", " ", "x"), (2, "no", None, "y"), (3, None, "z", None)], "k int, has string, which string, name string")
    fields = [("has", True, None), ("which", True, F.col("has") == "yes"), ("name", True, None)]
    assert {tuple(r) for r in records.missing(rows, "k", fields).collect()} == {(1, "which"), (3, "has"), (3, "name")}
    assert [r.which for r in records.without_hidden_values(rows, fields).orderBy("k").collect()] == [" ", None, None]
    assert [r.p for r in rows.orderBy("k").select(records.progress(fields).alias("p")).collect()] == [66, 100, 0]
    assert records.optional(rows, has=None, name="x").count() == 1


def test_prices_in_force(spark):
    from tesela.operators import usage

    day = lambda m: dt.datetime(2024, m, 5)
    calls = spark.createDataFrame([(1, "big-2", day(1), 10, 1, 0, 0), (2, "big-2", day(3), 10, 1, 10, 4), (3, "big-9", day(1), 1, 0, 0, 0), (4, "odd", day(1), 1, 1, 0, 0)], "call_id int, model string, at timestamp, input long, output long, cached long, written long")
    prices = spark.createDataFrame([("big-2", dt.date(2024, 1, 1), 2, 8), ("big-2", dt.date(2024, 2, 1), 3, 9), ("big", dt.date(2023, 1, 1), 5, 6)], "name string, from_day date, price_in int, price_out int")
    assert {r.call_id: r.cost for r in usage.priced(calls, prices).collect()} == {1: 28.0, 2: 3 * (10 + 1 + 5) + 9.0, 3: 5.0, 4: 13.0}


def test_short_quotes_are_whole_lines(spark):
    pages = spark.createDataFrame([("d", 1, "Amount | 500\nthe exam-\nple goes on here"), ("d", 2, "it is 5000 in all")], "doc string, page int, text string")
    quotes = spark.createDataFrame([("a", "d", 2, "500"), ("b", "d", 1, "Example goes, on"), ("c", "d", 1, "50"), ("e", "d", 1, "goes on")], "quote_id string, doc string, cited int, quote string")
    assert {r.quote_id: r.state for r in records.evidence(quotes, pages).collect()} == {"a": "relocated", "b": "verified", "c": "rejected", "e": "rejected"}


def test_years_and_masks(spark):
    between = lambda a, b: one(spark, values.years_between(F.lit(a).cast("date"), F.lit(b).cast("date")))
    assert [between("2004-02-29", "2005-02-28"), between("2004-02-29", "2005-03-01"), between("1990-06-15", "2020-06-15")] == [0, 1, 30]
    assert one(spark, checks.masked(F.lit("ABCDEFGH"), 2, 2)) == "AB••••GH" and one(spark, checks.masked(F.lit("ABC"), 2, 2)) == "•••"
    assert [one(spark, values.vacation_days(F.lit(y))) for y in (0, 1, 2, 5, 6, 10, 11)] == [0, 12, 14, 20, 22, 22, 24]
    assert [one(spark, values.lockout_seconds(F.lit(n))) for n in (4, 5, 6, 9, 10, 50)] == [0, 30, 60, 480, 900, 900]


def test_overlaps_and_redaction(spark):
    assert personal.resolve([(0, 10, 2), (5, 20, 0), (20, 25, 3)]) == [(5, 20, 0), (20, 25, 3)]
    docs = spark.createDataFrame([("mail a@b.example and 4539148803436467, +1 (200) 555-0100",), (None,), ("",)], "text string").withColumn("s", personal.findings("text"))
    out = docs.select(personal.redacted("text", "s").alias("r"), personal.decided(F.col("s"), F.lit(True)).alias("d")).collect()
    assert [tuple(r) for r in out] == [("mail [EMAIL] and [CARD], [PHONE]", "quarantine"), (None, "clean"), ("", "clean")]


def test_as_of_tells_emptied_from_absent(spark):
    rows = [(1, dt.datetime(2024, 1, 1), 1, "a"), (1, dt.datetime(2024, 1, 2), 2, None), (2, dt.datetime(2024, 3, 1), 3, "z")]
    out = records.as_of(spark.createDataFrame(rows, "k int, at timestamp, n int, v string"), ["k"], "at", "n", "v", F.lit("2024-02-01").cast("timestamp")).collect()
    assert [tuple(r) for r in out] == [(1, None)]


def test_coverage_counts_overlaps_once(spark):
    rows = [("a", 0, 10), ("a", 5, 8), ("a", 9, 12), ("a", 20, 21), ("b", 3, 3)]
    assert {tuple(r) for r in records.coverage(spark.createDataFrame(rows, "g string, s long, e long"), ["g"], "s", "e").collect()} == {("a", 13), ("b", 0)}


def test_search_terms_and_quality(spark):
    assert search.query_terms("The becas of 2024 are becas", frozenset({"the", "are"})) == ["beca", "2024"]
    assert search.query_terms(" ") == [] and search.query_terms("x" * 301) == []
    found = spark.createDataFrame([("q1", 1, True), ("q2", 1, False), ("q2", 4, True), ("q3", 2, False)], "query string, rank int, relevant boolean")
    assert [round(x, 4) for x in search.quality(found).first()] == [0.3333, 0.3333, 0.4167]


def test_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w"><w:p><w:t>one </w:t><w:t>two</w:t></w:p><w:p><w:t>three</w:t></w:p></w:d>')
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<s xmlns="s"><si><t>x</t></si></s>')
        z.writestr("xl/worksheets/sheet1.xml", '<s xmlns="s"><row><c t="s"><v>0</v></c><c><v>7</v></c></row></s>')
    (tmp_path / "b.xlsx").write_bytes(sheet.getvalue())
    (tmp_path / "c.xlsx").write_bytes(b"no zip")
    (tmp_path / "d.txt").write_text("x")
    got = {r.path[-6:]: (r.text, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("one two\nthree", None), "b.xlsx": ("x | 7", None), "c.xlsx": (None, "damaged"), "/d.txt": (None, "unsupported")}
    assert files.pieces("aa\nbb\ncccccccc\nd", 5) == ["aa\nbb", "cccccccc", "d"]


def test_frozen_months(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([("2024-01", 1)], "m string, n int")
    files.write_month(df, path, F.col("m"), "2024-01")
    files.write_month(df.select(F.lit("2024-02").alias("m"), "n"), path, F.col("m"), "2024-02")
    with pytest.raises(ValueError, match="frozen"):
        files.write_month(df, path, F.col("m"), "2024-02")
    files.append(df, str(tmp_path / "h")), files.append(df, str(tmp_path / "h"))
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(str(tmp_path / "h")).count() == 2


def test_stream_equals_table(spark, sf, tmp_path):
    from tesela.streaming.usage import windowed_usage

    table = spark.read.parquet(f"{sf}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = windowed_usage(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "1 day")
    query = stream.writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {tuple(r) for r in windowed_usage(table, "1 day").collect()}
    assert {tuple(r) for r in spark.table("usage").collect()} == want


def test_texts_without_findings_are_not_sent_to_be_cut(spark):
    """Before, every text went to a second Python process, whether or not there was something to cut."""
    span = "array<struct<start:int,end:int,kind:string>>"
    rows = [("ab cd", [(0, 2, "nss")]), ("x", []), ("y", None), (None, []), ("", [])]
    df = spark.createDataFrame(rows, f"text string, s {span}").select("text", personal.redacted("text", "s").alias("r"))
    assert [r.r for r in df.collect()] == ["[NSS] cd", "x", "y", None, ""]
    assert "CASE WHEN (size(s" in df._jdf.queryExecution().analyzed().toString()
