"""Every query of the library against its oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from siftwell.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return float(v) if isinstance(v, float) else v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(repr(tuple(map(plain, r))) for r in pdf[cols].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows_of(got) == rows_of(duck.sql(ORACLES[name]).df())
    else:
        assert len(got)
