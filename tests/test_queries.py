"""Every query with an oracle gives what DuckDB gives."""

import duckdb
import pytest

from tallyspark.plans import archive, attention, calls, capture, catalog, ledger, lifecycle, reading, reports, retention  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def duck():
    import pathlib

    con = duckdb.connect()
    for t in TABLES:
        path = pathlib.Path(f"{SF}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, duck, name):
    want = duck.execute(catalog.ORACLE[name])
    columns = [x[0] for x in want.description]
    got = catalog.QUERIES[name](spark, SF)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
