"""Every forecast query against DuckDB on the small tables."""

import pytest
from oracle import DATA, compare, connection

from gridcast.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck():
    return connection("sf0.01")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.01")
    compare(df, ORACLE_SQL[name], duck)
