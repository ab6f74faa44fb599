"""Every query of the key-log engine against its oracle."""

from __future__ import annotations

import os

import duckdb
import pytest

from keytide import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("customer", "part", "orders", "pages", "events", "documents")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(value: object) -> object:
    return value if value is None or isinstance(value, str) else float(value)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_oracle(spark, duck, name):
    found = catalog.queries()[name](spark, DATA)
    result = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(found.columns) == sorted(columns)
    order = sorted(columns)
    want = [tuple(plain(row[columns.index(c)]) for c in order) for row in result.fetchall()]
    got = [tuple(plain(r[c]) for c in order) for r in found.collect()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_searches_stay_in_the_jvm_and_shuffle_once(spark, duck):
    plan = catalog.queries()["f_regex_search"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("WindowGroupLimit") == 2
    # the tree is printed from the result down: the pattern's filter comes after the exchange
    assert plan.index("Exchange") < plan.rindex("RLIKE")
