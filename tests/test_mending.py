"""Mended letters, words and places on hand-worked cases; all values are invented."""

import random

from pyspark.sql import functions as F

from tesela.functions import mending


def each(spark, function, *texts):
    return [r.x for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


def test_letters_by_name(spark):
    texts = ["a&ntilde;o &#237;&#xE9; &amp;lt; &nbsp;x", "&&eacute;; & &; &longername; &#55296; &#99999999;", None, "", "sin nada"]
    assert each(spark, mending.unescaped, *texts) == ["año í&#xE9; &lt;  x", "&é; & &; &longername; &#55296; &#99999999;", None, "", "sin nada"]


def test_words_with_a_digit():
    known = frozenset(("botón", "dejé", "café", "cafe", "solo", "según", "papá", "caso", "casó"))
    m = lambda w: mending.mended_word(w, known)
    assert [m(w) for w in ("bot3n", "dej3", "D3je", "caf3", "s0lo", "Seg8n", "pap4", "cas0")] == ["botón", "dejé", "D3je", "café", "solo", "Según", "papá", "casó"]
    assert [m(w) for w in ("3ra", "a1", "B0T", "x4y4", "", "plain", "sol9")] == ["3ra", "a1", "B0T", "x4y4", "", "plain", "sol9"]


def test_words_against_brute_force():
    """Whatever is mended is a known word that differs in the digit alone; what two accents could mean stays."""
    draw = random.Random(6)
    letters = "aeioubñ" + mending.ACCENTED
    known = frozenset("".join(draw.choice(letters) for _ in range(4)) for _ in range(600))
    mended = 0
    for _ in range(3000):
        word = list("".join(draw.choice(letters) for _ in range(4)))
        at = draw.randrange(1, 4)
        word[at] = draw.choice("0123456789")
        word = "".join(word)
        got = mending.mended_word(word, known)
        makes = [v for v in mending.ACCENTED if word[:at] + v + word[at + 1 :] in known]
        looks = mending.LOOKS_LIKE.get(word[at], "")
        if got != word:
            mended += 1
            assert got in known and got[:at] + got[at + 1 :] == word[:at] + word[at + 1 :] and (got[at] == looks[:1] or [got[at]] == makes or got[at] == looks[1:])
        else:
            assert looks[:1] not in makes or not looks
    assert mended > 50


def test_whole_texts(spark):
    df = spark.createDataFrame([(1, "la dej3 en caf3-bar 3ra", ["dejé", "café"]), (2, "caf3", None), (3, None, ["a"])], "i int, t string, k array<string>")
    assert [r.x for r in df.select("i", mending.mended("t", "k").alias("x")).orderBy("i").collect()] == ["la dejé en café-bar 3ra", "caf3", None]
    assert each(spark, mending.whole_units, "Uno | dos\n\n UNO |", None, "|") == [["uno", "dos"], [], []]


def test_places(spark):
    catalog = spark.createDataFrame([("CMX", "Benito Juárez"), ("ROO", "Benito Juárez"), ("CMX", "La Paz"), ("BCS", "La Páz"), ("X", "Único"), ("X", "Municipio")], "state string, name string")
    said = [(1, "CMX", "ALCALDÍA  benito juarez"), (2, None, "Benito Juarez"), (3, None, "la paz"), (4, "BCS", "la paz"), (5, "ZZZ", "único"), (6, None, "municipio de Único"), (7, "X", ""), (8, "X", None), (9, "X", "municipio")]
    got = {r.i: r.official for r in mending.resolved_places(spark.createDataFrame(said, "i int, state string, place string"), catalog).collect()}
    assert got == {1: "Benito Juárez", 2: "Benito Juárez", 3: None, 4: "La Páz", 5: None, 6: "Único", 7: None, 8: None, 9: None}


def test_ranges_and_snapshots(spark):
    assert each(spark, mending.education_range, "none", "technical", "postgraduate", "other", None) == ["basic", "high_school_or_technical", "higher", None, None]
    rows = [("a", "2024-01-01 10:00:00", 1, -5), ("a", "2024-01-31 09:00:00", None, 0), ("a", "2024-02-01 00:00:00", 3, None), ("b", "2024-01-05 00:00:00", 4, 9)]
    taken = spark.createDataFrame(rows, "id string, at string, people int, balance int").withColumn("at", F.col("at").cast("timestamp"))
    got = {(r.id, r.month): r.figures_json for r in mending.snapshots(taken, ["people"], "balance").collect()}
    assert got == {("a", "2024-01"): '{"people":null,"balance":"even"}', ("a", "2024-02"): '{"people":3,"balance":null}', ("b", "2024-01"): '{"people":4,"balance":"surplus"}'}


def test_snapshots_of_one_moment(spark, tmp_path):
    """Before, the JSON of the largest text stayed, whatever the numbers: 9 of 9, 80009 and 160009."""
    import duckdb

    from tesela.plans.mending import MONTHLY_SNAPSHOTS_SQL, monthly_snapshots

    rows = [(k + 80000 * copy, 7, k) for copy in range(3) for k in (9, 10, 11)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, day int").select("o_orderkey", "o_custkey", F.lit("2024-01-05").cast("timestamp").alias("o_orderdate"))
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(MONTHLY_SNAPSHOTS_SQL).fetchall()
    assert [tuple(r) for r in monthly_snapshots(spark, str(tmp_path)).collect()] == want == [(7, "2024-01", '{"people":11,"waiting":4,"balance":"deficit"}')]


def test_snapshots_of_one_moment_in_the_order_of_the_table(spark, tmp_path):
    """Before, the lowest number stayed, 2001; the SQL over one row group of Parquet gives the first, whatever its number."""
    import duckdb

    from tesela.plans.mending import MONTHLY_SNAPSHOTS_SQL, monthly_snapshots

    con = duckdb.connect()
    keys = "(VALUES (0, 162001), (1, 2001), (2, 82001), (3, 1999), (4, 242001)) v(n, k)"
    con.execute(f"COPY (SELECT k AS o_orderkey, 7 AS o_custkey, TIMESTAMP '2024-01-05' AS o_orderdate FROM {keys} ORDER BY n) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = con.execute(MONTHLY_SNAPSHOTS_SQL).fetchall()
    assert [tuple(r) for r in monthly_snapshots(spark, str(tmp_path)).collect()] == want == [(7, "2024-01", '{"people":162001,"waiting":0,"balance":"deficit"}')]
