"""Every query over captures against its SQL in DuckDB."""

import duckdb
import pytest

from shelfmark.plans import catalogue

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


#: A larger scale, whose pages reach every rule and spelling of the queries that choose among many by a page's number.
LARGER = "/root/testdata/sf0.01"
MANY = ["beacon_filter", "url_parts", "html_escapes", "audit_strip", "serving_parity", "canonical_json_forms", "recorded_cdx", "excerpts"]


def connected(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected(DATA)


def as_rows(frame, columns):
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return sorted(repr([plain(v) for v in row]) for row in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, DATA).toPandas()
    if name in catalogue.oracle_sql():
        wanted = duck.sql(catalogue.oracle_sql()[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert as_rows(found, sorted(found.columns)) == as_rows(wanted, sorted(found.columns))
    else:
        assert len(found)


@pytest.mark.parametrize("name", MANY)
def test_query_at_a_larger_scale(spark, name):
    found = catalogue.queries()[name](spark, LARGER).toPandas()
    wanted = connected(LARGER).sql(catalogue.oracle_sql()[name]).df()
    assert as_rows(found, sorted(found.columns)) == as_rows(wanted, sorted(found.columns))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
