from collections import defaultdict

import duckdb

from tesela.llm.lines import OP5_SQL, line_dedup, op5


def brute(rows, least):
    strip = lambda text: [x.strip(" ") for x in (text or "").split("\n")]

    def spread(chosen):
        sites = defaultdict(set)
        for _, text, source in chosen:
            for line in strip(text):
                if line and source is not None:
                    sites[line].add(source)
        return {x for x, s in sites.items() if len(s) >= least}

    once = spread(rows)
    found = once & spread([r for r in rows if 2 * sum(len(x) for x in strip(r[1]) if x in once) <= sum(map(len, strip(r[1])))])
    out = []
    for d, text, source in rows:
        hit = [x in found for x in strip(text)]
        rest = "\n".join(x for x, h in zip((text or "").split("\n"), hit, strict=True) if not h) if any(hit) else text
        out.append((d, rest, source, sum(x != "" for x in strip(text)), sum(hit)))
    return sorted(out, key=str)


def test_table_against_sql(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(map(tuple, op5(spark, sf).collect()))
    assert got == sorted(db.sql(OP5_SQL).fetchall()) and any(r[2] for r in got)


def test_edges_against_brute_force(spark):
    filler = "\n".join(f"own line number {i} with some more words to fill it" for i in range(4))
    rows = [(i, f"Shared  note\n{filler}{i}\n\n shared end ", f"s{i % 5}") for i in range(20)]
    rows += [(100 + i, "Shared  note", f"s{i}") for i in range(5)]
    rows += [(200, None, "s1"), (201, "", "s2"), (202, "x", None), (203, "\n \n", "s3"), (204, "Shared  note\n" * 3 + filler * 3, None), (None, f"Shared  note\n{filler}", "s9"), (7, "another text of the same id\nShared  note\nmore and more words here", "s1")]
    rows += [rows[0]] * 2
    rows.append((300, "\n".join(["Shared  note"] * 3000 + [filler] * 3000), "s0"))
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, source string, line int, hits string")
    for least in (2, 5, 6):
        got = line_dedup(df, least)
        assert got.columns == ["doc_id", "text", "source", "line", "hits", "n_lines", "n_removed"]
        assert sorted(((r.doc_id, r.text, r.source, r.n_lines, r.n_removed) for r in got.collect()), key=str) == brute(rows, least)
    assert line_dedup(df.limit(0)).count() == 0


def test_spread_over_thousands_of_sites_is_counted(spark):
    rows = [(i, f"everywhere\nonly here {i} and some further words to fill\n{'half' if i % 2 else 'other'} of them all in all", f"s{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup(df, 1500)
    assert got.filter("n_removed = 2").count() == 3000
    assert line_dedup(df, 1501).filter("n_removed = 1").count() == 3000


def test_copies_are_no_evidence_and_boilerplate_goes_whatever_its_share(spark):
    page = "\n".join(f"line {i} of a page that many sites copied, some with a word changed" for i in range(10))
    rows = [(i, page.replace(f"line {i % 10} of", f"line {i} in") if i % 3 else page, f"s{i % 20}") for i in range(60)]
    rows += [(100 + i, f"own words of page {i} and some more of them here\nAll rights reserved", f"s{i % 20}") for i in range(30)]
    rows += [(200, "All rights reserved", "s1"), (201, "tiny\nAll rights reserved\nAll rights reserved", "s2"), (202, page + "\nAll rights reserved", "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup(df).collect()}
    assert all(got[i] == rows[i][1] for i in range(60))
    assert all("reserved" not in got[100 + i] for i in range(30))
    assert (got[200], got[201], got[202]) == ("", "tiny", page)
