import pytest

from tests import oracle
from vellumspark.llm import queries as Q

pytestmark = pytest.mark.skipif(not oracle.DATA.exists(), reason="no test tables here")
COLUMNS = {
    "p1_found": ["mark", "term"], "p2_found": ["line_id"], "p3_found": ["defect", "rec", "rec_id", "token"], "p4_found": ["block_id"], "p5_found": ["rec", "rec_id"], "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    cols, rows = oracle.rows_of(Q.queries()[name](spark, str(oracle.DATA)))
    assert rows
    if name in COLUMNS:
        assert cols == COLUMNS[name] and len(set(rows)) == len(rows)
    if name in Q.oracle_sql():
        assert (cols, rows) == oracle.sql_rows(oracle.connect(), Q.oracle_sql()[name])
