"""Every query against its SQL."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from marketloom.plans import registry  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


def canonical(rows, columns):
    def plain(v):
        if v is None or v != v:
            return ""
        return f"{float(v):.6f}" if type(v).__name__ in ("float", "Decimal", "int") else str(v)

    order = sorted(columns)
    return sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in rows), order


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_same_rows(spark, oracle, name):
    found = registry.QUERIES[name](spark, SF)
    expected = oracle.sql(registry.ORACLE_SQL[name])
    assert canonical([tuple(r) for r in found.collect()], found.columns) == canonical(expected.fetchall(), expected.columns)


def test_quantile_interpolates(spark):
    from marketloom.operators import series

    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 101)], "k string, value double")
    out = series.quantile(series.buckets(rows, [10.0, 50.0, 90.0], "k"), 0.3).first()
    assert out["quantile"] == pytest.approx(30.0)
    assert series.quantile(series.buckets(rows, [10.0, 50.0], "k"), 0.99).first()["quantile"] == 50.0
