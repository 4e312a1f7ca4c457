"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from planewise.plans.queries import PLANS, SQL


def plain(value):
    if type(value).__name__ == "Decimal":
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in found), key=str)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, sf_dir, name):
    df = PLANS[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in SQL:
        con = duckdb.connect()
        for f in os.listdir(sf_dir):
            con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
        cursor = con.execute(SQL[name])
        want = rows([c[0] for c in cursor.description], cursor.fetchall())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        for a, b in zip(got[1], want[1], strict=True):
            for x, y in zip(a, b, strict=True):
                assert x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)), (a, b)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
