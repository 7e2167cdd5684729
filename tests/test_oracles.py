"""Every registered query against its SQL, or, where it has none, that it runs and gives rows."""

import math
from pathlib import Path

import duckdb
import pytest

from tesela.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None else round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in records), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf) / t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in ORACLES:
        out = duck.execute(ORACLES[name])
        want = rows([c[0] for c in out.description], out.fetchall())
        assert got == want


def test_tfidf_weights_cover_every_item(spark, sf, duck):
    """Before, the only registered result was of items 0-4 against the others."""
    want = {r[0] for r in duck.execute("SELECT item_id FROM benchmark WHERE regexp_matches(text, '[A-Za-z0-9]')").fetchall()}
    got = {r.doc_id for r in QUERIES["tfidf_weights"](spark, sf).collect()}
    assert want <= got and len(got) > 5
