"""Each query with SQL against the same SQL in DuckDB, over the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from probeframe import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return ("nan" if math.isnan(v) else round(v, 7) + 0.0) if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)) if not isinstance(x, (int, float)) else "", x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(name, spark, con, sf):
    got = plans.QUERIES[name](spark, sf)
    want = con.sql(plans.ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert ordered([tuple(map(plain, r)) for r in got.select(*columns).collect()]) == ordered([tuple(plain(r[i]) for i in at) for r in want.fetchall()])


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_the_subpackage():
    import subprocess
    import sys

    code = "import sys, probeframe.plans, probeframe.streaming.delivery, probeframe.streaming.steps, probeframe.sources.codec; assert not [m for m in sys.modules if m.startswith('probeframe.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
