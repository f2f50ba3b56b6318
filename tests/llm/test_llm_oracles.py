from pathlib import Path

import pytest

from larder.llm import queries, sql
from tests.oracle import DATA, same

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    if name in sql.oracle_sql():
        same(df, sql.oracle_sql()[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name,columns", [("p2_found", "customer_id first_order_id last_order_id"), ("p3_found", "result_id round_no defect"), ("p4_found", "item_kind item_a item_b"), ("p7_found", "doc_id item_id"), ("p9_found", "doc_id seg_no lang")])
def test_columns(spark, name, columns):
    assert queries.queries()[name](spark, DATA).columns == columns.split()
