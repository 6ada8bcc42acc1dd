"""Every query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("lineitem", "orders", "customer", "supplier"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    answer = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in answer.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(columns, answer.fetchall())


@pytest.mark.parametrize("name", ["nv12_to_rgba_all", "layout_totals_all"])
def test_all_rows_have_a_result(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def test_every_query_runs(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLES):
        assert registry.QUERIES[name](spark, DATA).count() > 0
