"""Every query with SQL gives the rows that DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from stringloom import programs as catalogue

SF = "/root/testdata/sf0.001"


def rows(df) -> list:
    return sorted(map(tuple, df[sorted(df.columns)].astype(str).values.tolist()))


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, name):
    found = catalogue.QUERIES[name](spark, SF).toPandas()
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.sql(f"create view {path.stem} as select * from '{path}'")
    expected = db.sql(catalogue.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
    assert len(found) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["input_id", "value", "offset", "quality"]
