"""Every registered query with an oracle gives DuckDB's rows on the smallest tables."""

import math
import os

import pytest

from quarterdeck.plans import candidate_queries, corpus_queries, detail_queries, extraction_queries, gate_queries, lineage_queries, portfolio_queries, statement_queries  # noqa: F401  register their queries
from quarterdeck.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.isoformat()[:10] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert got
