"""Every query with SQL gives DuckDB's rows; the others keep their stated properties."""

from pathlib import Path

import duckdb
import pytest

from bitloom import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, sf, name):
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert ours[columns].dtypes.astype(str).tolist() == theirs[columns].dtypes.astype(str).tolist()
    a, b = (t[columns].sort_values(columns).reset_index(drop=True) for t in (ours, theirs))
    assert len(a) > 0 and a.equals(b)


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_random_cells_are_distinct_and_as_many_as_asked(spark, sf):
    found = catalog.QUERIES["random_tensor"](spark, sf).collect()
    assert len(set(found)) == len(found) == 600
    assert len(catalog.QUERIES["init_factor"](spark, sf).distinct().collect()) == int(0.3 * 40 * 6)


def test_balanced_ranges_cover_all(spark, sf):
    parts = catalog.QUERIES["split_range_balanced"](spark, sf).collect()
    assert [p.part for p in parts] == list(range(6))
    assert all(a.hi + 1 == b.lo for a, b in zip(parts, parts[1:], strict=False))
    assert sum(p.cnt for p in parts) == catalog.QUERIES["nnz"](spark, sf).first()[0]
