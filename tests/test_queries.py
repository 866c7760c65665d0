"""Registered queries against SQL on the same tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES
from linkloom.plans import catalog, oracles

QUERIES = catalog.registered()
ORACLES = oracles.sql()
# labels share one code path; these stand for it here, check.py runs all
SAMPLED = {"link_href", "link_custom_REGEX", "link_custom_REGEX_element", "link_data", "link_custom_data", "link_social_media"}
NAMES = [n for n in QUERIES if not n.startswith("link_") or n in SAMPLED]


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracles.sql())
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    relation = tables.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    want = Counter(tuple(r[i] for i in order) for r in relation.fetchall())
    assert Counter(tuple(r) for r in frame.select(*columns).collect()) == want


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["source", "url", "where_url"] and not frame.isEmpty()
