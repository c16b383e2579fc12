import pytest

import __spark_entry__
from strayline import catalog

from .compare import assert_same, duck

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    assert len(found) > 0
    if name in ORACLES:
        assert_same(found, duck(sf_dir).execute(ORACLES[name]).df())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
