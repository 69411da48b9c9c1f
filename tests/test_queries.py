"""Each named query against its SQL at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from siltstone.plans.named import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    tidy = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 6) if isinstance(x, float) else x
    return sorted(repr(tuple(tidy(r[k]) for k in order)) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, str(DATA))
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in ORACLES:
        assert frame.columns and got
        return
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert got == rows(names, result.fetchall())
