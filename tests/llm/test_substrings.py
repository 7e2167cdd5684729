import re
from collections import Counter

import duckdb
import pytest

from tesela.llm.substrings import OP10_SQL, UNITS, cut, op10, repeated_spans, repeated_units, units_of


def brute(rows, by="line", least=1):
    """(doc_id, unit, start, end, n_words, kept_doc_id, kept_unit) by a loop over all units in order."""
    seen, out = {}, []
    for d, text in sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, r[0])):
        k = 0
        for s, e in units_of(text, by):
            words = tuple(re.findall(r"[^\W_]+", text[s:e].lower()))
            if len(words) >= least:
                if words in seen:
                    out.append((d, k, s, e, len(words), *seen[words]))
                else:
                    seen[words] = (d, k)
            k += bool(words)
    return sorted(out, key=str)


def runs(repeats, least):
    """(doc_id, start, end, n_units, n_words, kept_doc_id) of runs of neighbouring units."""
    out = []
    for d, k, s, e, n, kept, _ in sorted(repeats):
        if out and out[-1][0] == d and out[-1][-1] == k - 1:
            last = out[-1]
            best = max(last[6], (n, -k, kept))
            out[-1] = [d, last[1], e, last[3] + 1, last[4] + n, best[2], best, k]
        else:
            out.append([d, s, e, 1, n, kept, (n, -k, kept), k])
    return sorted(tuple(x[:6]) for x in out if x[4] >= least)


def got(df):
    return sorted(map(tuple, df.drop("row").collect()), key=str)


def test_table_against_sql_and_brute_force(spark, sf):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = sorted(map(tuple, op10(spark, sf).collect()))
    assert rows and rows == sorted(db.sql(OP10_SQL).fetchall())
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows == runs(brute(docs, "clause"), 25)


def test_passages_inside_lines_are_found(spark, sf):
    """Held against 50-word shingles that occur in two documents or more, whatever lines and clauses they lie in."""
    sf = sf.replace("sf0.001", "sf0.01")
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    words = {d: list(re.finditer(r"[^\W_]+", t)) for d, t in docs.items()}
    shingles = {d: [tuple(w[0].lower() for w in ws[k : k + 50]) for k in range(len(ws) - 49)] for d, ws in words.items()}
    holders = Counter(s for d in shingles for s in set(shingles[d]))
    first = {}
    for d in sorted(shingles):
        for s in shingles[d]:
            first.setdefault(s, d)
    spans = {}
    for r in op10(spark, sf).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    # One clause of the repeated words: only what holds marks can be found through its clauses.
    total = covered = 0
    later = set()
    for d, ss in shingles.items():
        inside = set()
        for k, s in enumerate(ss):
            if holders[s] > 1 and first[s] < d and len(set(s)) > 10 and sum(docs[d][words[d][k].start() : words[d][k + 49].end()].count(m) for m in ".,!?\n") >= 3:
                inside.update(range(k, k + 50))
        if inside:
            later.add(d)
        for k in inside:
            total += 1
            covered += any(a <= words[d][k].start() < b for a, b in spans.get(d, ()))
    assert len(later) > 30 and total > 10_000
    assert len(later & set(spans)) >= 0.95 * len(later) and covered >= 0.85 * total


@pytest.mark.parametrize("by", UNITS)
def test_units_and_edges(spark, by):
    rows = [
        (3, "A b c.\nother line here\n\na  B, c!"),
        (1, "x\n\n  \nc d e é\r\n\nÉ"),
        (2, "c d e É\n\n\nA b c\n\nA b c\n\n\n"),
        (4, None),
        (5, ""),
        (7, "\n\n".join(["long tail of words"] * 5000)),
        (8, "...!!\n,,\n"),
        (None, "a b c\n\nc d e é"),
    ]
    df = spark.createDataFrame([(d, t, 1, "x", 2.5, "r", 3) for d, t in rows], "doc_id long, text string, unit int, hi string, rank double, row string, start int")
    assert got(repeated_units(df, by)) == brute(rows, by)
    assert got(repeated_units(df, by, 2)) == brute(rows, by, 2)
    assert repeated_units(df.limit(0), by).count() == repeated_spans(df.limit(0), by).count() == 0


def test_offsets_name_the_original_text_and_cutting_keeps_first_occurrences(spark):
    rows = [(1, "keep me here\nshared line of words\ntail"), (2, "Shared line, of words\nown text\nshared line of words"), (3, "shared line of words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = repeated_units(df, min_words=3)
    texts = dict(rows)
    for r in spans.collect():
        assert re.findall(r"\w+", texts[r.doc_id][r.start : r.end].lower()) == ["shared", "line", "of", "words"]
    assert {tuple(r) for r in cut(df, spans).collect()} == {(1, rows[0][1]), (2, "own text\n"), (3, "")}


def test_a_passage_laid_out_in_other_lines_is_one_span(spark):
    passage = "the first part of it, and the second part. Then the third one; the fourth"
    rows = [(1, f"own words before {passage} own after"), (2, f"Quite other words: it begins.\nno match {passage.replace('. ', '.' + chr(10))} and ends. Tail"), (2, "another text of that id. And the second part")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, cut_id string")
    spans = repeated_spans(df, min_words=8)
    (r,) = spans.collect()
    assert rows[1][1][r.start : r.end] == " and the second part.\nThen the third one;" and (r.n_units, r.n_words, r.kept_doc_id) == (2, 8, 1)
    assert sorted(x.text for x in cut(df, spans).collect()) == sorted([rows[0][1], rows[1][1][: r.start] + rows[1][1][r.end :], rows[2][1]])


def test_rank_comes_before_doc_id_and_repeated_rows_are_one(spark):
    rows = [(1, "one two three", None), (2, "one two three", 5.0), (3, "one two three", 2.0), (3, "one two three", 2.0)]
    out = repeated_units(spark.createDataFrame(rows, "doc_id long, text string, score double"), rank="score")
    assert sorted(r.doc_id for r in out.collect()) == [1, 2] and {r.kept_doc_id for r in out.collect()} == {3}


def test_unknown_unit_is_refused(spark):
    with pytest.raises(ValueError):
        repeated_units(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "sentence")
