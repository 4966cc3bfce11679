"""Every registered query with a DuckDB twin, side by side on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import pytest

from paperloom.plans import registry

TABLES = Path("/root/testdata/sf0.001")


def shown(value):
    if value is None or isinstance(value, float) and value != value:
        return "-"
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.5f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(shown, value)) + "]"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([shown(r[i]) for i in order] for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.skipif(not TABLES.exists(), reason="the supplied tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, str(TABLES))
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, want.fetchall())
    spark.catalog.clearCache()
