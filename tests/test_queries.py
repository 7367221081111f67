"""Every bound query against its SQL in DuckDB, and row checks for those without."""

import datetime
import decimal
import math

import pytest

from lumenfold.plans.registry import ORACLE_SQL, QUERIES

from .conftest import DATA


def plain(v):
    if v is None or isinstance(v, (bool, str, datetime.date)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in columns]).collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    got = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(plain(r[k]) for k in order)) for r in got.fetchall())
    assert sorted(repr(tuple(plain(v) for v in r)) for r in rows) == expected
