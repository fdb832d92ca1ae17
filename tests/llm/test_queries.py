import pytest

from gridloom.llm import queries
from tests.compare import DATA, same, views

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, str(DATA))
    if name in queries.ORACLES:
        same(df, con, queries.ORACLES[name])
    else:
        df.collect()


def test_columns(spark):
    want = {"p2_found": "project_id string, group_node_id bigint, node_id bigint", "p3_found": "table_name string, row_id bigint", "p4_found": "row_id bigint, field_name string", "p6_found": "first_id bigint, copy_id bigint", "p7_ids": "doc_id bigint, ids array<int>", "p9_found": "doc_id bigint"}
    for name, columns in want.items():
        assert ", ".join(f"{c} {t}" for c, t in queries.QUERIES[name](spark, str(DATA)).dtypes) == columns
