"""Every registered query against its independent SQL on the driver tables."""

import datetime
import decimal
import math

import pytest

from stockloom.plans import registry

Q, O = registry.queries(), registry.oracle_sql()


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, int):
        return float(v)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def test_every_query_has_sql():
    assert set(Q) == set(O)


@pytest.mark.parametrize("name", sorted(Q))
def test_matches_sql(spark, duck, sf, name):
    df = Q[name](spark, sf)
    result = duck.execute(O[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())
