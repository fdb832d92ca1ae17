import importlib

import pytest

import __spark_entry__ as entry
from tests.compare import DATA, same, views

CORE = {k: (f, m.ORACLES.get(k)) for m in map(importlib.import_module, entry.MODULES) for k, f in m.QUERIES.items()}
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    f, sql = CORE[name]
    df = f(spark, str(DATA))
    assert len(set(df.columns)) == len(df.columns)
    if sql:
        same(df, con, sql)
    else:
        df.collect()


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_names():
    assert not set(entry.oracle_sql()) - set(entry.queries())
