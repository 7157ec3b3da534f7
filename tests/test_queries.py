"""Every registered query against its SQL oracle on the smallest tables."""

import pytest
from check import rows_of
from conftest import SMALL

from spanledger.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got, columns = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        assert columns
        return
    cur = duck.execute(ORACLES[name])
    want, wanted_columns = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert columns == wanted_columns
    assert got == want


def test_no_oracle_without_query():
    assert set(ORACLES) <= set(QUERIES)
