import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from hourgrid.plans import catalog

SF = "/root/testdata/sf0.001"
#: Learned models take long to fit and have no SQL form; they have tests of their own.
SLOW = {"gbt_forecast", "state_change_model", "event_model", "soft_logistic", "learned_tournament", "feature_importances", "spatial_forecast", "recursive_boosted"}


def rows_of(columns, rows):
    def norm(x):
        if x is None or isinstance(x, bool | str):
            return x
        return float(x) if isinstance(x, int | float) else str(x)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SLOW))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


def test_every_query_has_sql_or_is_a_learned_model():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == SLOW


def test_entry(spark):
    assert entry_points.entry(spark).count() == 10
    assert set(catalog.queries()) <= set(entry_points.queries())
