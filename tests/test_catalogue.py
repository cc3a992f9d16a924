import pytest

from tests import oracle
from vellumspark.plans import catalogue

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()
pytestmark = pytest.mark.skipif(not oracle.DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    cols, rows = oracle.rows_of(QUERIES[name](spark, str(oracle.DATA)))
    if name in ORACLE:
        assert (cols, rows) == oracle.sql_rows(con, ORACLE[name])
    else:
        assert cols and isinstance(rows, list)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
