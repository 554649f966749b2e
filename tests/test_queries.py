"""Every registered query of the library against its SQL twin on the smallest tables."""

import pytest
from compare import check

from castline.catalogue import oracle_sql, queries

SF = "/root/testdata/sf0.001"
SQL, QUERIES = oracle_sql(), queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    check(QUERIES[name], SQL[name], spark, SF)


def test_every_query_has_sql_but_the_numerical_fit():
    assert set(QUERIES) - set(SQL) == {"fc_sarima_grid", "fc_backtest_models", "fc_select_models", "fc_diagnostics_models"}
