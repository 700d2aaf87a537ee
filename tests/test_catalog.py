"""Every registered query against its SQL, and the stability of the entry points."""

import pytest
from compare import difference, duck, duck_rows, spark_rows

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    result = entry(spark)
    assert result.columns == [
        "recommendation_date",
        "liked_conversations",
        "number_recommended",
        "like_percentage",
    ]
    assert result.count() > 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, folder, name):
    assert difference(spark_rows(spark, folder, name), duck_rows(con, name)) is None
