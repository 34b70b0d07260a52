"""Every query with SQL against DuckDB on the smallest tables, and the others for their shape."""

import duckdb
import pytest

from conceptloom import catalogue

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = ("bounding_box", "distance_lookup")
TABLES = "customer embeddings events lineitem nation orders part region supplier"


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "year"):
        return str(value)[:10]
    return value


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str([plain(v) for v in row]) for row in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, sql, name):
    got = rows_of(catalogue.QUERIES[name](spark, SF).toPandas())
    assert got == rows_of(sql.sql(catalogue.ORACLE[name]).df())
    assert got[1] or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE) - {"glove_embeddings"}))
def test_other_queries_have_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_module_has_every_query(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_the_first_hundred_sequences_are_aligned_with_each_other(spark):
    pairs = {(r.position_1, r.position_2) for r in catalogue.alignment_steps(spark, SF).select("position_1", "position_2").distinct().collect()}
    assert pairs == {(i, j) for j in range(100) for i in range(j)}
