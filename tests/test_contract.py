"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest
from compare import connect, difference

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


def test_every_statement_has_a_query_and_parses():
    con = connect(SF)
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries)
    for name, statement in sql.items():
        try:
            con.execute(f"EXPLAIN {statement}")
        except duckdb.Error as e:  # name the query
            pytest.fail(f"{name}: {e}")


@pytest.mark.parametrize(
    "name",
    ["merge_barcodes", "set_aside", "features", "duplicate_differs", "pair_skip_rules", "silhouette"],
)
def test_query_equals_sql(spark, name):
    got = contract.queries()[name](spark, SF).toPandas()
    want = connect(SF).execute(contract.oracle_sql()[name]).df()
    assert difference(got, want) is None
